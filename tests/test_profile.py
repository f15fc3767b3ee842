"""Profiling operators against pandas on golden micro-tables."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import quality as qa
from tabprobe.operators import stats as st
from tabprobe.operators.outliers import outlier_report_iqr
from tabprobe.operators.quantiles import column_quantiles, exact_quantiles
from tabprobe.sources.io import nan_to_null


def close(a, b, tol=1e-9):
    if a is None or b is None or (isinstance(b, float) and math.isnan(b)):
        return a is None and (b is None or (isinstance(b, float) and math.isnan(b)))
    return abs(a - b) <= tol * max(1.0, abs(b))


def test_data_quality_report_nan_array_and_sample(spark):
    df = spark.createDataFrame(
        [(1.0, "x", ["a"]), (float("nan"), None, ["b"]), (None, "y", None), (1.0, "x", ["a"])],
        "a double, b string, c array<string>")
    rep = {r.column: r for r in qa.data_quality_report(nan_to_null(df)).collect()}
    assert (rep["a"].non_null, rep["a"].nulls, rep["a"].cardinality, rep["a"].sample) == (2, 2, 1, "1.0")
    assert rep["a"].null_pct == 50.0
    assert (rep["b"].nulls, rep["b"].cardinality, rep["b"].sample) == (1, 2, "x")
    assert rep["c"].cardinality is None and rep["c"].sample == ""
    assert rep["c"].dtype == "array<string>"


def test_missing_values_sorted(spark):
    df = spark.createDataFrame([(None, 1, None), (1, 2, None), (None, 3, 4)], "a int, b int, c int")
    got = [(r.column, round(r.null_pct, 4)) for r in qa.missing_values(qa.data_quality_report(df)).collect()]
    assert got == [("a", 66.6667), ("c", 66.6667)]


def test_duplicate_summary_nulls_equal_and_nested_ignored(spark):
    rows = [(1, None, ["x"]), (1, None, ["y"]), (2, "a", None), (2, "a", None), (2, "a", None), (3, "b", None)]
    df = spark.createDataFrame(rows, "a int, b string, c array<string>")
    r = qa.duplicate_summary(df).first()
    pdf = pd.DataFrame([(a, b) for a, b, _ in rows], columns=["a", "b"])
    assert (r.total_rows, r.duplicate_rows) == (6, int(pdf.duplicated().sum()))
    assert abs(r.duplicate_pct - 50.0) < 1e-12


def test_duplicate_summary_empty(spark):
    r = qa.duplicate_summary(spark.createDataFrame([], "a int")).first()
    assert (r.total_rows, r.duplicate_rows, r.duplicate_pct) == (0, 0, 0.0)


def _rand_frame(spark, n=500, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a = float(rnd.randint(0, 40)) if rnd.random() > 0.1 else None   # ties + nulls
        b = rnd.gauss(10, 3)
        c = 7.0                                                          # constant
        g = rnd.choice(["x", "y", "z"])
        rows.append((a, b, c, g))
    return spark.createDataFrame(rows, "a double, b double, c double, g string"), \
        pd.DataFrame(rows, columns=["a", "b", "c", "g"])


def test_descriptive_stats_match_pandas(spark):
    df, pdf = _rand_frame(spark)
    got = {r.column: r for r in st.descriptive_stats(df, ["a", "b", "c", "g", "missing"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for c in ["a", "b", "c"]:
        s = pdf[c]
        exp = dict(count=s.count(), mean=s.mean(), std=s.std(), min=s.min(), p25=s.quantile(.25),
                   median=s.quantile(.5), p75=s.quantile(.75), max=s.max(), skew=s.skew(), kurtosis=s.kurtosis())
        for k, v in exp.items():
            assert close(got[c][k], float(v), 1e-7), (c, k, got[c][k], v)


def test_small_frames_skew_kurt_need_3_and_4(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    r = st.descriptive_stats(df, ["x"]).first()
    assert close(r.skew, float(pd.Series([1.0, 2.0, 4.0]).skew())) and r.kurtosis is None
    assert st.descriptive_stats(df, ["nope"]) is None


@pytest.mark.parametrize("kw", [dict(), dict(max_bracket=20), dict(max_bracket=5, approx_start=False),
                                dict(max_bracket=40, accuracy=200)])
def test_exact_quantiles_all_paths(spark, kw):
    rnd = random.Random(7)
    rows = [(rnd.choice("pq"), float(rnd.randint(0, 30)) if rnd.random() > 0.05 else None) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, ["g"], "v", probs, **kw).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, s in pdf.groupby("g")["v"]:
        for p in probs:
            assert close(got[(g, p)], float(s.quantile(p)), 1e-12), (g, p, kw)


def test_quantiles_empty_group_gives_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, v double")
    got = {r.g: (r.n, r.q) for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {"a": (1, 1.0), "b": (0, None)}


def test_quantiles_invariant_under_repartition(spark):
    df, _ = _rand_frame(spark)
    a = sorted(tuple(r) for r in column_quantiles(df.repartition(1), ["a", "b"], [0.3]).collect())
    b = sorted(tuple(r) for r in column_quantiles(df.repartition(13), ["a", "b"], [0.3]).collect())
    assert a == b


def test_quantiles_with_infinities(spark):
    vals = [float(i) for i in range(3000)] + [float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for kw in ({}, {"max_bracket": 50, "approx_start": False}):
        got = {r.p: (r.n, r.q) for r in column_quantiles(df, ["v"], [0.0, 0.25, 0.5, 1.0], **kw).collect()}
        s = pd.Series([v for v in vals if v is not None]).dropna()
        for p in (0.25, 0.5):
            assert got[p] == (3002, float(s.quantile(p)))
        assert got[0.0][1] == float("-inf") and got[1.0][1] == float("inf")


def test_quantile_rounds_are_never_silent(spark):
    df = spark.createDataFrame([(float(i) ** 9,) for i in range(2000)], "v double")
    with pytest.raises(RuntimeError):
        column_quantiles(df, ["v"], [0.5], max_bracket=5, bins=2, max_rounds=1, approx_start=False).collect()


MISSING = [("a", 1.0), ("a", 2.0), ("a", float("nan")), ("a", 3.0), ("a", 4.0), (None, 50.0), (None, 60.0), ("b", None)]


def test_missing_values_in_every_profile_operator(spark):
    df = spark.createDataFrame(MISSING, "g string, x double")
    five = df.filter("g = 'a'").select("x")
    r = st.descriptive_stats(five, ["x"]).first()
    assert (r["count"], r["mean"], r["max"], r["median"]) == (4, 2.5, 4.0, 2.5)
    o = outlier_report_iqr(five, ["x"]).first()
    assert (o.outliers, o.min, o.max, o.outlier_pct) == (0, 1.0, 4.0, 0.0)
    assert st.box_summary(five, ["x"]).first().outliers == 0
    assert [h["count"] for h in st.histogram(five, ["x"], bins=3).orderBy("bin").collect()] == [1, 1, 2]
    for out in (st.descriptive_stats(df, ["x"], by=["g"]), outlier_report_iqr(df, ["x"], by=["g"]), st.box_summary(df, ["x"], by=["g"]),
                st.histogram(df, ["x"], bins=2, by=["g"]), st.scatter_bins(df, "x", "x", 2, 2, by=["g"])):
        assert None not in {r.g for r in out.collect()}
    pts = df.select("g", "x", F.lit(1.0).alias("y")).union(spark.createDataFrame([("a", float("inf"), 1.0)], "g string, x double, y double"))
    assert sum(r["count"] for r in st.scatter_bins(pts, "x", "y", by=["g"]).collect()) == 4
    assert sum(r["count"] for r in st.histogram(pts, ["x"], bins=4, by=["g"]).collect()) == 4


def test_moments_of_an_empty_frame(spark):
    for k in (2, 12):
        df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(k)))
        assert [(r["count"], r["mean"]) for r in st.moments(df, df.columns).collect()] == [(0, None)] * k


def test_outlier_report_iqr_matches_pandas(spark):
    vals = [float(i) for i in range(1, 21)] + [100.0, None, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = outlier_report_iqr(df, ["x"]).first()
    s = pd.Series(vals, dtype="float")
    q1, q3 = s.quantile(.25), s.quantile(.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    n_out = int(((s < lo) | (s > hi)).sum())
    assert r.outliers == n_out == 1
    assert close(r.outlier_pct, n_out / len(vals) * 100)
    assert close(r.lower_bound, lo) and close(r.upper_bound, hi)
    assert (r.min, r.max) == (1.0, 100.0)


def test_histogram_counts_sum_and_edges(spark):
    df, pdf = _rand_frame(spark)
    h = st.histogram(df, ["a", "b"], bins=10).collect()
    for c in ["a", "b"]:
        rows = [r for r in h if r.column == c]
        assert len(rows) == 10
        assert sum(r["count"] for r in rows) == pdf[c].count()
        assert close(min(r.bin_lo for r in rows), float(pdf[c].min()))
        assert close(max(r.bin_hi for r in rows), float(pdf[c].max()))


def test_histogram_by_group_shares_edges(spark):
    df, pdf = _rand_frame(spark)
    h = st.histogram(df, ["b"], bins=8, by=["g"]).collect()
    assert len(h) == 3 * 8
    for g in "xyz":
        assert sum(r["count"] for r in h if r.g == g) == int((pdf.g == g).sum())


def test_box_summary_whiskers(spark):
    vals = [float(i) for i in range(1, 21)] + [100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = st.box_summary(df, ["x"]).first()
    assert (r.whisker_low, r.whisker_high, r.outliers) == (1.0, 20.0, 1)
    assert close(r.median, float(np.median(vals)))


def test_data_quality_of_a_wide_frame(spark):
    rnd = random.Random(8)
    rows = [tuple([rnd.choice([None, 0.0, -0.0, 1.5, float("nan")])] + [rnd.randint(0, 5) for _ in range(11)]
                  + [rnd.choice(["a", "b", None])]) for _ in range(200)]
    schema = "d double, " + ", ".join(f"i{k} int" for k in range(11)) + ", s string"
    got = {r.column: r for r in qa.data_quality_report(spark.createDataFrame(rows, schema)).collect()}
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    for c in pdf.columns:
        assert (got[c].cardinality, got[c].nulls, got[c].non_null) == (pdf[c].nunique(), int(pdf[c].isna().sum()), int(pdf[c].notna().sum()))



def test_properties_correlation_symmetric_bounded(spark):
    from tabprobe.operators import correlation as cr
    df, _ = _rand_frame(spark)
    m = {(r.var1, r.var2): r.corr for r in cr.correlation_long(df, ["a", "b", "c"]).collect()}
    for (a, b), r in m.items():
        assert m[(b, a)] == r
        assert r is None or -1.0 <= r <= 1.0


def test_properties_outliers_invariant_under_repartition(spark):
    df, _ = _rand_frame(spark)
    a = sorted(tuple(r) for r in outlier_report_iqr(df.repartition(1), ["a", "b"]).collect())
    b = sorted(tuple(r) for r in outlier_report_iqr(df.repartition(16), ["a", "b"]).collect())
    assert a == b


def test_properties_duplicates_plus_distinct_is_rows(spark):
    df, _ = _rand_frame(spark)
    sub = df.select("a", "g")
    r = qa.duplicate_summary(sub).first()
    assert r.total_rows - r.duplicate_rows == sub.distinct().count()


def test_sample_is_the_first_value_in_a_stated_order(spark):
    rows = [(3, "z", None, 1.0), (1, None, "late", float("nan")), (2, "m", "b", 2.5), (4, "a", "a", 0.5)]
    df = spark.createDataFrame(rows, "at int, x string, y string, v double").withColumn("none", F.lit(None).cast("int"))
    first = {r.column: r["sample"] for r in qa.data_quality_report(df, order_by=["at"]).collect()}
    assert first == {"at": "1", "x": "m", "y": "late", "v": "2.5", "none": ""}
    assert {r.column: r["sample"] for r in qa.data_quality_report(df).collect()}["x"] == "a"


def test_duplicates_with_more_repeated_hashes_than_are_broadcast(spark, monkeypatch):
    df = spark.range(6000).select((F.col("id") % 1500).alias("a"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("b"), F.lit(None).cast("string").alias("c"))
    want = 6000 - df.distinct().count()
    for limit in (0, 10 ** 6):
        monkeypatch.setattr(qa, "BROADCAST_ROWS", limit)
        r = qa.duplicate_summary(df).first()
        assert (r.total_rows, r.duplicate_rows) == (6000, want)


def test_statistics_and_outliers_read_their_source_once(spark):
    """What is behind the frame (a join, say) runs once for all passes of quartiles and moments."""
    from tabprobe.operators.outliers import outlier_report_iqr
    from tabprobe.operators.stats import box_summary, descriptive_stats
    for table in (descriptive_stats, outlier_report_iqr, box_summary):
        runs = spark.sparkContext.accumulator(0)

        def counted(batches):
            for batch in batches:
                runs.add(batch.num_rows)
                yield batch

        df = spark.range(30_000).selectExpr("id", "cast(id % 977 as double) x", "cast(id as double) y").mapInArrow(counted, "id long, x double, y double")
        got = table(df, ["x", "y"])
        assert {r["column"] for r in got.collect()} == {"x", "y"} and runs.value == 30_000, (table.__name__, runs.value)
