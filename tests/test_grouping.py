import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import groups as gp
from tabprobe.operators.grouping import GroupedTables
from tabprobe.plans import q_domains as qd
from tabprobe.plans.domains import loan_default, medical_cost, taxi_trips

from conftest import SF_SMALL

SPEC = {"all": ((), {"n": ("count", "*"), "s": ("sum", "v"), "m": ("avg", "v")}),
        "a": (["a"], {"s": ("sum", "v"), "n": ("count", "v")}),
        "b": (["b"], {"hi": ("max", "v"), "lo": ("min", "v")}),
        "ba": (["b", "a"], {"m": ("avg", "v")}),
        "v": (["v"], {"n": ("count", "*"), "s": ("sum", "v")})}


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def plain(df, name):
    keys, aggs = SPEC[name]
    functions = {"avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    made = [(F.count(F.lit(1)) if c == "*" else functions[f](c)).alias(n) for n, (f, c) in aggs.items()]
    return gp.group_agg(df, list(keys), *made) if keys else df.agg(*made)


def test_tables_equal_their_own_aggregations(spark):
    data = [("x", 1, 2.0), ("x", None, 3.0), (None, 1, 4.0), (None, None, 5.0), ("y", 2, None), ("hot", 7, 1.0)] + [("hot", i % 3, float(i)) for i in range(500)]
    df = spark.createDataFrame(data, "a string, b int, v double")
    tables = GroupedTables(df, SPEC)
    for name in SPEC:
        assert rows(tables[name]) == rows(plain(df, name)), name
    with_null = {r.a: r.n for r in tables.rows("a").collect()}
    assert with_null[None] == 2 and with_null["y"] == 0


def test_empty_frame_and_tables_without_keys(spark):
    df = spark.createDataFrame([], "a string, b int, v double")
    tables = GroupedTables(df, SPEC)
    assert [tuple(r) for r in tables["all"].collect()] == [(0, None, None)]
    assert all(tables[n].count() == 0 for n in ("a", "b", "ba")) and tables.rows("all").count() == 0
    alone = GroupedTables(df, {"all": SPEC["all"]})
    assert [tuple(r) for r in alone["all"].collect()] == [(0, None, None)] and alone.rows("all").count() == 0
    one = GroupedTables(spark.createDataFrame([("p", 1, None)], "a string, b int, v double"), {"all": SPEC["all"]})
    assert [tuple(r) for r in one["all"].collect()] == [(1, None, None)]


def test_fill_levels_equals_pandas_observed_false(spark):
    pdf = pd.DataFrame({"k": pd.Categorical(["a", "b", None, "a"], categories=["a", "b", "c"]), "by": ["u", "u", "w", None], "v": [1.0, 0.0, 1.0, 1.0]})
    df = spark.createDataFrame([("a", "u", 1.0), ("b", "u", 0.0), (None, "w", 1.0), ("a", None, 1.0)], "k string, by string, v double")
    tables = GroupedTables(df, {"k": (["by", "k"], {"rate": ("avg", "v"), "count": ("count", "v")})})
    got = {(r.by, r.k): (r.rate, r["count"]) for r in gp.fill_levels(tables.rows("k"), "k", ["a", "b", "c"], ["by"]).collect()}
    want = pdf.groupby(["by", "k"], observed=False)["v"].agg(["mean", "count"])
    assert got == {i: (None if pd.isna(m) else m, n) for i, m, n in want.itertuples()}


@pytest.mark.parametrize("page,view,names", [
    (loan_default, qd.loan_view, ["kpis", "by_grade", "by_term", "by_purpose", "by_dti_bin"]),
    (taxi_trips, qd.taxi_view, ["kpis", "by_hour", "by_payment", "by_passengers", "weekday_weekend", "fare_per_mile_by_distance"]),
    (medical_cost, qd.medical_view, ["kpis", "by_smoker", "by_smoker_children", "age_group_x_smoker", "bmi_x_smoker", "region_x_smoker"])])
def test_a_page_scans_its_frame_once(spark, monkeypatch, page, view, names):
    """All grouped tables of a page come from one stored aggregation."""
    from tabprobe.operators import grouping
    stored = []
    real = grouping.persist
    monkeypatch.setattr(grouping, "persist", lambda df: stored.append(df) or real(df))
    frame = page.features(page.clean(view(spark, SF_SMALL)))
    tables = page.results(frame)
    for n in names:
        assert tables[n].count() > 0
    assert len(stored) == 1
    plan = tables[names[1]]._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()
