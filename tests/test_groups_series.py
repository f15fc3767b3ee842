import datetime as dt
import math
import random
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from tabprobe.operators import groups as gp
from tabprobe.operators import ranks as rk
from tabprobe.operators import reshape as rs
from tabprobe.operators import co_moments as cm
from tabprobe.operators import series as se


def test_rate_by_levels_keeps_empty_levels_and_drops_null_keys(spark):
    df = spark.createDataFrame([("<25", 1), ("<25", 0), ("65+", 1), (None, 1)], "k string, y int")
    got = {r.k: (r.rate, r["count"], r.k_ord) for r in gp.rate_by_levels(df, "k", ["<25", "25-34", "65+"], "y").collect()}
    assert got == {"<25": (0.5, 2, 0), "25-34": (None, 0, 1), "65+": (1.0, 1, 2)}


def test_grid_levels_by_observed_values(spark):
    df = spark.createDataFrame([("a", "yes", 1.0), ("b", "no", 3.0)], "k string, s string, v double")
    got = gp.rate_by_levels(df, "k", ["a", "b", "c"], "v", by=["s"]).collect()
    assert len(got) == 6
    assert {(r.s, r.k): r["count"] for r in got}[("yes", "b")] == 0


def test_class_balance_percent_sums_to_100(spark):
    df = spark.createDataFrame([(c,) for c in "aabbbc"] + [(None,)], "t string")
    rows = gp.class_balance(df, "t").collect()
    assert [r.t for r in rows] == ["b", "a", "c"]
    assert abs(sum(r.percent for r in rows) - 100.0) < 1e-9


def test_top_k_tie_break(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 1)], "k string, v int")
    assert [r.k for r in gp.top_k(df, "v", 3, ["k"]).collect()] == ["c", "a", "b"]


def test_sort_by_levels_unmatched_last(spark):
    df = spark.createDataFrame([("jan",), ("mar",), ("dec",)], "m string")
    assert [r.m for r in gp.sort_by_levels(df, "m", ["mar", "dec"]).collect()] == ["mar", "dec", "jan"]


def test_median_by_groups(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("xy"), rnd.random()) for _ in range(301)]
    got = {r.g: r.median for r in gp.median_by(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, s in pdf.groupby("g")["v"]:
        assert abs(got[g] - s.median()) < 1e-12


def test_average_ranks_match_pandas(spark):
    rnd = random.Random(2)
    vals = [float(rnd.randint(0, 20)) for _ in range(200)]
    df = spark.createDataFrame([("k", v) for v in vals], "g string, v double").repartition(7)
    got = {r.v: r["rank"] for r in rk.average_ranks(df, ["g"], "v", partitions=5).collect()}
    exp = pd.Series(vals).rank(method="average")
    for v, r in zip(vals, exp):
        assert got[v] == r


def test_row_index_dense_per_key(spark):
    rows = [(k, i) for k in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t int").repartition(4)
    out = rk.row_index(df, ["k"], ["t"], partitions=6).collect()
    assert all(r.row_idx == r.t for r in out)


def test_melt_and_pivot(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, None)], "id string, x double, y double")
    long = rs.melt(df, ["id"])
    assert long.count() == 4
    p = rs.pivot_table(long, ["id"], "variable", "value", levels=["x", "y"], aggfunc="sum").collect()
    assert {r.id: (r.x, r.y) for r in p} == {"a": (1.0, 2.0), "b": (3.0, None)}


def test_explode_tokens_null_row(spark):
    df = spark.createDataFrame([("Action, RPG",), (None,)], "g string")
    got = [r.token for r in rs.explode_tokens(df, "g").collect()]
    assert got == ["Action", "RPG", None]


def _stock_frame(spark, n=25):
    rnd = random.Random(9)
    rows = []
    for k in ["A", "B"]:
        price = 100.0
        for i in range(n if k == "A" else 21):
            price *= 1 + rnd.gauss(0, 0.02)
            rows.append((k, dt.date(2024, 1, 1) + dt.timedelta(days=i), price))
    rnd.shuffle(rows)  # unsorted input
    return spark.createDataFrame(rows, "k string, d date, close double"), pd.DataFrame(rows, columns=["k", "d", "close"])


def _expected_features(pdf, window=20):
    """From the definitions, by a walk over each entity's rows in time order."""
    out = []
    for k in sorted(set(pdf.k)):
        rows = sorted((r.d, r.close) for r in pdf.itertuples() if r.k == k)
        changes = []
        for i, (d, close) in enumerate(rows):
            before = rows[i - 1][1] if i else None
            changes.append(None if before is None else 100.0 * (close - before) / before)
            last = changes[max(0, i - window + 1):]
            vol = statistics.stdev(last) if len(last) == window and None not in last else None
            out.append((k, d, changes[-1], None if before is None else math.log(close) - math.log(before), vol, 100.0 * close / rows[0][1]))
    return pd.DataFrame(out, columns=["k", "d", "ret", "logr", "vol", "norm"])


def _check_features(out, pdf):
    got = {(r.k, r.d): r for r in out.collect()}
    for _, e in pdf.iterrows():
        r = got[(e.k, e.d)]
        for a, b in [(r.daily_return, e.ret), (r.log_return, e.logr), (r.volatility_20, e.vol), (r.normalized, e.norm)]:
            if b is None or (isinstance(b, float) and math.isnan(b)):
                assert a is None
            else:
                assert abs(a - b) < 1e-9


def test_series_features_first_vol_on_row_21(spark):
    df, pdf = _stock_frame(spark)
    out = se.series_features(df, "k", "d", "close", window=20)
    exp = _expected_features(pdf)
    _check_features(out, exp)
    a = exp[exp.k == "A"].reset_index(drop=True)
    assert a.vol.first_valid_index() == 20


def test_series_features_blocked_equals_plain(spark):
    df, pdf = _stock_frame(spark)
    out = se.series_features(df, "k", "d", "close", window=20, block_rows=6)
    _check_features(out, _expected_features(pdf))


def test_period_return(spark):
    df, pdf = _stock_frame(spark)
    got = {r.k: r.period_return for r in se.period_return(df, "k", "d", "close", days=10).collect()}
    pdf = pdf.sort_values(["k", "d"])
    cutoff = pdf.d.max() - dt.timedelta(days=10)
    last = pdf.groupby("k")["close"].last()
    first = pdf[pdf.d >= cutoff].groupby("k")["close"].first()
    for k in "AB":
        exp = last[k] / first.get(k, float("nan")) - 1
        assert (got[k] is None and math.isnan(exp)) or abs(got[k] - exp) < 1e-12


def test_series_features_by_hand(spark):
    df = spark.createDataFrame([("A", 1, 100.0), ("A", 2, 110.0), ("A", 3, 99.0), ("A", 4, 99.0)], "k string, d int, close double")
    got = se.series_features(df, "k", "d", "close", window=2).orderBy("d").collect()
    for r, (ret, vol, norm) in zip(got, [(None, None, 100), (10, None, 110), (-10, 14.142135623730951, 99), (0, 7.0710678118654755, 99)]):
        for a, b in ((r.daily_return, ret), (r.volatility_2, vol), (r.normalized, norm)):
            assert a is None if b is None else abs(a - b) < 1e-9


def test_blocks_keep_rows_without_an_entity(spark):
    df = spark.createDataFrame([("a", 1, 1.0), (None, 1, 5.0), ("a", 2, 2.0), (None, 2, 6.0), (None, 3, 9.0)], "k string, d int, v double")
    plain, blocks = (sorted(map(repr, se.series_features(df, "k", "d", "v", window=2, block_rows=n).collect())) for n in (100, 2))
    assert plain == blocks and len(plain) == 5


def test_pivot_returns_match_pandas(spark):
    df, pdf = _stock_frame(spark)
    got = {r.d: (r.A, r.B) for r in se.pivot_returns(df, "k", "d", "close", ["A", "B"]).collect()}
    exp = pdf.pivot_table(index="d", columns="k", values="close").sort_index().pct_change(fill_method=None).dropna()
    assert set(got) == set(exp.index)
    for d, row in exp.iterrows():
        assert abs(got[d][0] - row["A"]) < 1e-12 and abs(got[d][1] - row["B"]) < 1e-12


def _expected_correlation(pdf, complete):
    """pandas: pivot of means, change between rows, pairwise correlation."""
    r = pdf.pivot_table(index="t", columns="e", values="v").sort_index().pct_change(fill_method=None)
    r = r.dropna() if complete else r
    c, has = r.corr(min_periods=2), r.notna().astype(int)
    n = has.T @ has
    return {(a, b): (int(n.loc[a, b]), None if math.isnan(c.loc[a, b]) else c.loc[a, b]) for a in c.index for b in c.columns}


def _check_correlation(df, pdf, **sizes):
    for complete in (True, False):
        returns = cm.long_returns(df, "e", "t", "v")
        names = returns.select("e").distinct()
        if complete:
            returns = cm.complete_rows(returns, names.count())
        got = {(r.var1, r.var2): (r.n, r["corr"]) for r in cm.long_correlation(returns, "e", names=names, **sizes).collect()}
        want = _expected_correlation(pdf, complete)
        assert set(got) == set(want)
        for k, (n, c) in want.items():
            assert got[k][0] == n, k
            assert (got[k][1] is None) == (c is None) and (c is None or abs(got[k][1] - c) < 1e-9), (k, got[k], c)


def test_long_correlation_equals_pandas_with_a_hot_entity(spark):
    """One entity holds a third of all rows; others are sparse, one is constant, one has a single value."""
    r = np.random.default_rng(8)
    rows = [("hot", t, float(v)) for t, v in enumerate(50 + r.normal(size=300).cumsum())]
    rows += [(f"e{i}", int(t), float(100 + 30 * i + r.normal())) for i in range(20) for t in sorted(r.choice(300, 28, replace=False))]
    rows += [(f"d{i}", t, float(10 + r.random())) for i in range(3) for t in range(40, 60)]
    rows += [("flat", t, 7.0) for t in range(30, 60)] + [("one", 5, 1.0)] + [("hot", 7, 55.0)]
    pdf = pd.DataFrame(rows, columns=["e", "t", "v"])
    df = spark.createDataFrame(rows + [(None, 3, 1.0), ("hot", None, 2.0)], "e string, t int, v double")
    _check_correlation(df, pdf, entities=4, time_rows=16)
    few = pdf[pdf.e.isin(["hot", "d0", "d1", "flat"])]
    _check_correlation(spark.createDataFrame(few), few)


def test_long_correlation_of_many_entities(spark):
    df = (spark.range(600).withColumnRenamed("id", "e").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(11))))
          .withColumn("v", 10 + F.pmod(F.xxhash64("e", "t"), F.lit(1000)) / 100.0))
    got = cm.return_correlation(df, "e", "t", "v")
    assert got.count() == 600 * 600 and got.filter("n <> 11 or corr is null or abs(corr) > 1").count() == 0
    pdf = df.toPandas()
    want = _expected_correlation(pdf[pdf.e < 5], True)
    assert all(abs(r["corr"] - want[r.var1, r.var2][1]) < 1e-9 for r in got.filter("var1 < 5 and var2 < 5").collect())


def test_long_correlation_shuffles_no_pairs(spark):
    """With one span of times, the pairs leave their task finished; one without a value keeps its pairs."""
    rows = [(e, t, float((e * 7 + t * t) % 11 + 1)) for e in range(40) for t in range(6)] + [(99, 3, 1.0)]
    got = cm.return_correlation(spark.createDataFrame(rows, "e long, t int, v double"), "e", "t", "v", complete=False, digits=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan[:plan.index("FlatMapGroupsInArrow")]
    found = {(r.var1, r.var2): (r.n, r["corr"]) for r in got.collect()}
    assert len(found) == 41 * 41 and found[99, 5] == found[5, 99] == (0, None) and found[3, 3] == (5, 1.0)


def test_long_correlation_copies_a_series_a_few_times(spark, monkeypatch):
    """What is dealt out to tasks grows with the entities: 8 copies of each of 20,000 series, not one per 1,024 entities."""
    dealt = []
    apply = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *a: dealt.append(self._df) or apply(self, *a))
    returns = spark.range(20_000).select(F.col("id").alias("e"), F.lit(1).alias("position"), F.col("id").cast("double").alias("ret"))
    cm.long_correlation(returns, "e")
    assert [df.count() for df in dealt] == [8 * 20_000]


def test_long_correlation_in_tiles(spark):
    """Blocks of several tiles, also on the diagonal; a pair is the same in both directions, rounded or not."""
    r = np.random.default_rng(3)
    rows = [(f"e{i}", t, float(10 + r.random())) for i in range(50) for t in range(12) if r.random() < 0.8] + [("one", 3, 1.0)]
    pdf, df = pd.DataFrame(rows, columns=["e", "t", "v"]), spark.createDataFrame(rows, "e string, t int, v double")
    _check_correlation(df, pdf, entities=7, tile=3)
    _check_correlation(df, pdf, entities=7, tile=3, time_rows=5)
    want = _expected_correlation(pdf, False)
    got = {(r.var1, r.var2): (r.n, r["corr"]) for r in cm.long_correlation(cm.long_returns(df, "e", "t", "v"), "e", names=df, tile=2, digits=6).collect()}
    assert set(got) == set(want) and all(got[a, b] == got[b, a] for a, b in got)
    for k, (n, c) in want.items():
        assert got[k][0] == n and (got[k][1] is None if c is None else got[k][1] == round(got[k][1], 6) and abs(got[k][1] - c) < 6e-7), k


def test_long_correlation_of_nothing(spark):
    df = spark.createDataFrame([], "e string, t int, v double")
    assert cm.return_correlation(df, "e", "t", "v").count() == 0
    one = spark.createDataFrame([("a", 1, 2.0)], "e string, t int, v double")
    assert [(r.var1, r.n, r["corr"]) for r in cm.return_correlation(one, "e", "t", "v", complete=False).collect()] == [("a", 0, None)]
