import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabprobe.operators import sketches as sk
from tabprobe.operators import stats
from tabprobe.operators._util import persist
from tabprobe.operators.heavy import heavy_hitters
from tabprobe.operators.outliers import outlier_report_iqr
from tabprobe.operators.quantiles import exact_quantiles
from tabprobe.plans.q_domains import games_view
from tabprobe.sources.io import table, write_observed

from conftest import SF_ORACLE, SF_SMALL


def test_merged_sketches_keep_the_rank_error(spark):
    r = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in r.lognormal(size=20_000)] + [(f"k{i % 5}", float(i % 100)) for i in range(10_000)] + [("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    parts = persist(sk.quantile_sketches(df, ["v"], ["g"], part=F.spark_partition_id()))
    assert parts.select("part").distinct().count() == 7
    probs = [0.0, 0.01, 0.3, 0.5, 0.9, 1.0]
    got = {(x.g, x.p): (x.n, x.q) for x in sk.sketch_quantiles(sk.merge_sketches(parts, ["g", "column"]), ["g"], probs).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, p in itertools.product(["hot", "k0", "k4"], probs):
        v = np.sort(pdf[pdf.g == g].v.to_numpy())
        n, q = got[g, p]
        assert n == len(v)
        assert np.mean(v < q) - 2 * sk.rank_error() <= p <= np.mean(v <= q) + 2 * sk.rank_error()
    assert got["none", 0.5] == (0, None) and not any(g is None for g, _ in got)


def test_approx_is_an_option_of_the_profile_operators(spark):
    li = table(spark, SF_ORACLE, "lineitem")
    exact = {x.column: x for x in stats.descriptive_stats(li, ["l_extendedprice", "l_quantity"]).collect()}
    near = {x.column: x for x in stats.descriptive_stats(li, ["l_extendedprice", "l_quantity"], approx=True).collect()}
    for c in exact:
        assert near[c]["count"] == exact[c]["count"] and abs(near[c].median - exact[c].median) <= 0.03 * exact[c].median
    assert {x.column for x in outlier_report_iqr(li, ["l_tax"], approx=True).collect()} == {"l_tax"}
    one = exact_quantiles(li.select(F.lit(1).alias("k"), "l_tax"), ["k"], "l_tax", [0.5], approx=True).first()
    assert one.n == 60_000 and one.q in (0.03, 0.04, 0.05)


def test_bitmaps_count_exactly_and_merge(spark):
    """One key holds a third of the rows, spread over many buckets; negative and far values."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 11)).alias("g"),
        (F.col("id") % 7).alias("day"),
        F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 3 == 0, F.col("id") * 977 - 10_000_000).otherwise(F.col("id") % 50).alias("v"))
    df = df.unionByName(spark.createDataFrame([("far", 1, -2 ** 62), ("far", 2, 2 ** 62), ("far", 2, 0), ("far", 2, None), ("nothing", 1, None)], df.schema))
    days = persist(sk.distinct_bitmaps(df, ["g", "day"], "v"))
    got = {x.g: x.n for x in sk.count_bitmaps(sk.merge_bitmaps(days, ["g"]), ["g"], "n").collect()}
    want = {x.g: x.n for x in df.dropna().groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    assert got == want and want["hot"] > 18_000 and want["far"] == 3
    daily = {(x.g, x.day): x.n for x in sk.count_bitmaps(days, ["g", "day"], "n").collect()}
    assert daily == {(x.g, x.day): x.n for x in df.dropna().groupBy("g", "day").agg(F.count_distinct("v").alias("n")).collect()}
    with pytest.raises(TypeError, match="whole numbers"):
        sk.distinct_bitmaps(df.withColumn("x", F.lit(0.5)), ["g"], "x")


def full_count(df, value, k):
    return [tuple(r) for r in df.dropna(subset=[value]).groupBy(value).count().orderBy(F.desc("count"), value).limit(k).collect()]


@pytest.mark.parametrize("counters", [4, 64, 2048])
def test_heavy_hitters_equal_a_full_count(spark, counters):
    """Skewed, flat and tied counts; few counters must be found out and raised."""
    skewed = spark.range(20_000).select(F.floor(F.pow(F.lit(1.001), F.col("id") % 7000)).alias("v")).repartition(5)
    flat = spark.range(3000).select((F.col("id") % 1000).cast("string").alias("v"))
    hot = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.col("id") % 700)).alias("v"))
    null = spark.createDataFrame([(None,), ("a",), (None,)], "v string")
    for df in (skewed, flat, hot, null, flat.limit(0)):
        for k in (1, 10):
            assert [tuple(r) for r in heavy_hitters(df, "v", k, counters=counters).collect()] == full_count(df, "v", k)


def test_heavy_hitters_shuffle_counters_only(spark):
    """A heavy value is found with less than a tenth of the distinct values in the exchange."""
    from tabprobe.operators import heavy
    df = spark.range(200_000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 5).otherwise(F.col("id") + 10).alias("v")).repartition(4)
    held = heavy.HELD
    parts = heavy._summaries(df, 500)
    assert parts.count() <= 4 * 501 and held > 500
    assert [tuple(r) for r in heavy_hitters(df, "v", 5, counters=500).collect()] == full_count(df, "v", 5)


def test_scatter_matrix_equals_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 4))
    x[:, 3] = 7.0
    x[5, 0], x[6, 1], x[7, 2] = np.nan, np.inf, -np.inf
    df = spark.createDataFrame([tuple(map(float, row)) for row in x] + [(None, 0.0, 0.0, 7.0)], "a double, b double, c double, d double").repartition(3)
    got = {(q.x, q.y, q.x_bin, q.y_bin): q["count"] for q in stats.scatter_matrix(df, ["a", "b", "c", "d"], bins=6).collect()}
    x = np.vstack([x, [np.nan, 0.0, 0.0, 7.0]])
    want = {}
    low, high = (f(np.where(np.isfinite(x), x, np.nan), axis=0) for f in (np.nanmin, np.nanmax))
    for (i, p), (j, q) in itertools.combinations(enumerate("abcd"), 2):
        for row in x[np.isfinite(x[:, i]) & np.isfinite(x[:, j])]:
            place = [0 if high[k] == low[k] else min(int((row[k] - low[k]) // ((high[k] - low[k]) / 6)), 5) for k in (i, j)]
            want[p, q, *place] = want.get((p, q, *place), 0) + 1
    assert got == want
    vectors = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],), ([1.0],), (None,)], "e array<double>")
    assert [tuple(q) for q in stats.scatter_matrix(vectors, vector="e", bins=2).orderBy("x_bin").collect()] == [("0", "1", 0, 0, 1), ("0", "1", 1, 1, 1)]
    assert stats.scatter_matrix(df.limit(0), ["a", "b"]).count() == 0 and stats.scatter_matrix(vectors.limit(0), vector="e").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.floats(-1e9, 1e9), st.floats(1e-6, 1e9), st.integers(1, 200))
def test_nice_steps_are_one_two_five_and_few_enough(low, width, bins):
    step = stats.nice_step(low, low + width, bins)
    if low + width > low:
        raw = (low + width - low) / bins
        assert raw <= step * (1 + 1e-9) and step <= 5.1 * raw
        lead = step / 10.0 ** math.floor(math.log10(step) + 1e-9)
        assert min(abs(lead - m) for m in (1, 2, 5, 10)) < 1e-6
    else:
        assert step == 1.0


def test_nice_histogram_shares_aligned_edges(spark):
    rows = [("a", 0.3), ("a", 9.7), ("b", 4.99), ("b", 5.0), ("b", float("inf")), ("a", float("nan")), ("a", None), (None, 2.0), ("b", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("flat", F.lit(2.5))
    h = [tuple(r) for r in stats.histogram_nice(df, ["v"], 10, ["g"]).orderBy("g", "bin_lo").collect()]
    assert h == [(g, "v", float(i), float(i + 1), {("a", 0): 1, ("a", 9): 1, ("b", 4): 1, ("b", 5): 1}.get((g, i), 0)) for g in "ab" for i in range(10)]
    assert [tuple(r) for r in stats.histogram_nice(df, ["flat"], 10).collect()] == [("flat", 2.0, 3.0, len(rows))]
    assert stats.histogram_nice(df.limit(0), ["v"]).count() == 0


def test_observed_metrics_equal_a_second_scan(spark, tmp_path):
    df = games_view(spark, SF_SMALL)
    aggs = {"games": F.count(F.lit(1)), "no_developer": F.count_if(F.col("developer").isNull()), "longest": F.max(F.length("name"))}
    got = write_observed(df, str(tmp_path / "t"), aggs)
    want = df.agg(*[c.alias(n) for n, c in aggs.items()])
    assert got.collect() == want.collect() and got.dtypes == want.dtypes
    assert spark.read.parquet(str(tmp_path / "t")).count() == want.first().games
