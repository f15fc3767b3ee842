import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import correlation as cr


def brute_force_tau_b(x, y):
    """O(n²) reference."""
    pts = [(a, b) for a, b in zip(x, y) if a is not None and b is not None
           and not (isinstance(a, float) and math.isnan(a)) and not (isinstance(b, float) and math.isnan(b))]
    s = n1 = n2 = 0
    for i in range(len(pts)):
        for j in range(i + 1, len(pts)):
            dx = (pts[i][0] > pts[j][0]) - (pts[i][0] < pts[j][0])
            dy = (pts[i][1] > pts[j][1]) - (pts[i][1] < pts[j][1])
            s += dx * dy
            n1 += dx == 0
            n2 += dy == 0
    n0 = len(pts) * (len(pts) - 1) // 2
    den = (n0 - n1) * (n0 - n2)
    return s / math.sqrt(den) if den > 0 else float("nan")


def _frame(spark, n=300):
    rnd = random.Random(11)
    rows = []
    for _ in range(n):
        x = rnd.gauss(0, 1)
        y = 2 * x + rnd.gauss(0, 1) if rnd.random() > 0.1 else None
        z = float(rnd.randint(0, 5))          # heavy ties
        w = x * x if rnd.random() > 0.2 else None
        rows.append((x, y, z, w, 3.0))
    cols = ["x", "y", "z", "w", "const"]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), pd.DataFrame(rows, columns=cols), cols


def _check(got, exp, tol=1e-9):
    for (a, b), r in got.items():
        e = exp.loc[a, b]
        if math.isnan(e):
            assert r is None, (a, b, r)
        else:
            assert abs(r - e) < tol, (a, b, r, e)


def test_pearson_pairwise_complete_and_constant(spark):
    df, pdf, cols = _frame(spark)
    got = {(r.var1, r.var2): r.corr for r in cr.correlation_long(df.repartition(4), cols).collect()}
    assert len(got) == 25
    _check(got, pdf.corr())


def test_spearman_ties_and_nulls(spark):
    df, pdf, cols = _frame(spark)
    got = {(r.var1, r.var2): r.corr for r in cr.correlation_long(df.repartition(3), cols, "spearman").collect()}
    _check(got, pdf.corr(method="spearman"))


def test_fewer_than_two_columns(spark):
    df, _, _ = _frame(spark)
    assert cr.correlation_long(df, ["x"]) is None


def test_top_correlations_distinct_pairs(spark):
    df, pdf, cols = _frame(spark)
    top = cr.top_correlations(df, cols, n=3).collect()
    assert len(top) == 3
    assert (top[0].var1, top[0].var2) == ("x", "y")
    absr = [abs(r.corr) for r in top]
    assert absr == sorted(absr, reverse=True)


@pytest.mark.parametrize("cap", [10_000, 7])
def test_kendall_matches_brute_force(spark, cap):
    from tabprobe.operators.kendall import kendall_pairs
    df, pdf, cols = _frame(spark, n=160)
    use = ["x", "y", "z", "w"]
    got = {(r.i, r.j): r.corr for r in kendall_pairs(df.repartition(3), use, cap=cap).collect()}
    for i, a in enumerate(use):
        for j in range(i, len(use)):
            b = use[j]
            exp = brute_force_tau_b(list(pdf[a].where(pdf[a].notna(), None)), list(pdf[b].where(pdf[b].notna(), None)))
            assert abs(got[(i, j)] - exp) < 1e-12, (a, b, got[(i, j)], exp)


def test_kendall_hot_value(spark):
    from tabprobe.operators.kendall import kendall_pairs
    rnd = random.Random(4)
    rows = [(5.0 if rnd.random() < 0.4 else float(rnd.randint(0, 60)), float(rnd.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {(r.i, r.j): r.corr for r in kendall_pairs(df, ["a", "b"], cap=9).collect()}
    exp = brute_force_tau_b([r[0] for r in rows], [r[1] for r in rows])
    assert abs(got[(0, 1)] - exp) < 1e-12


@pytest.mark.parametrize("order", ["k", "-k", "k % 7"])
def test_pearson_does_not_depend_on_a_prefix(spark, order):
    """A column that is missing in its first rows and has a large mean."""
    df = spark.range(40_000).select(F.col("id").alias("k"), F.when(F.col("id") >= 12_000, F.lit(1.7e9) + F.col("id") % 1000).alias("x"),
                                    (F.col("id") % 1000).cast("double").alias("y"), F.lit(0.1).alias("c")).orderBy(F.expr(order))
    got = {(r.var1, r.var2): r["corr"] for r in cr.correlation_long(df, ["x", "y", "c"]).collect()}
    assert abs(got["x", "y"] - 1) < 1e-9 and abs(got["x", "x"] - 1) < 1e-9 and got["c", "c"] is None and got["x", "c"] is None


def test_pearson_of_columns_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0), (None, 5.0)], "a double, b double")
    got = {(r.var1, r.var2): r["corr"] for r in cr.correlation_long(df, ["a", "b"]).collect()}
    assert got["a", "b"] is None and abs(got["a", "a"] - 1) < 1e-12


def test_kendall_of_a_large_table_agrees_with_a_pair_count(spark):
    """More points than one base case holds, so that the division into buckets runs."""
    from tabprobe.operators.kendall import kendall_pairs
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 40)), float(rnd.randint(0, 900))) for _ in range(1500)]
    got = {(r.i, r.j): r["corr"] for r in kendall_pairs(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], cap=200).collect()}
    assert abs(got[0, 1] - brute_force_tau_b([r[0] for r in rows], [r[1] for r in rows])) < 1e-9


def test_kendall_of_lineitem_in_small_base_cases(spark):
    """All of lineitem's columns and rows through the division into buckets, against all pairs of rows."""
    import numpy as np
    from conftest import SF_SMALL
    from tabprobe.operators.kendall import kendall_pairs
    from tabprobe.plans.q_profile import _CORR_COLS
    from tabprobe.plans.registry import QUERIES
    df = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(_CORR_COLS)
    pdf = df.toPandas().astype(float)
    assert len(pdf) == 6000
    signs = [np.sign(v[:, None] - v[None, :]).astype(np.float32) for v in (pdf[c].to_numpy() for c in _CORR_COLS)]
    size = [np.sqrt(np.abs(s).sum(dtype=float)) for s in signs]
    exp = {(i, j): (signs[i] * signs[j]).sum(dtype=float) / (size[i] * size[j]) for i in range(5) for j in range(i, 5)}
    got = {(r.i, r.j): r["corr"] for r in kendall_pairs(df, _CORR_COLS, cap=500).collect()}
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-9 for k in exp)
    registered = {(r.var1, r.var2): r["corr"] for r in QUERIES["corr_kendall_lineitem"](spark, SF_SMALL).collect()}
    assert all(abs(registered[_CORR_COLS[i], _CORR_COLS[j]] - v) < 2e-9 for (i, j), v in exp.items())


def test_kendall_sweep_of_many_points_counts_discordant_pairs():
    """A task's points are counted bit by bit of the ranks: weights, ties in either column, against all pairs."""
    import numpy as np
    from tabprobe.operators import kendall as kd
    r = np.random.default_rng(5)
    for levels in (2, 9, 70):
        x, y = np.unique(np.stack([r.integers(0, 90, 400), r.integers(0, levels, 400)]), axis=1).astype(float)
        w = r.integers(1, 6, len(x)).astype(float)
        mixed = r.permutation(len(x))
        x, y = x[mixed], y[mixed]
        want = 0.5 * (w[:, None] * w * np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum()
        assert kd._s_points(x, y, w) == kd._s_points(y, x, w) == want
    assert kd._s_points(np.array([2.0]), np.array([1.0]), np.array([3.0])) == 0


def test_kendall_needs_few_sub_problems(spark, monkeypatch):
    """60,000 points, three times the points a task took before, are one problem: no division into buckets."""
    from tabprobe.operators import kendall as kd
    monkeypatch.setattr(kd, "_split", lambda *a: (_ for _ in ()).throw(AssertionError("divided")), raising=False)
    points = spark.range(60_000).select(F.lit("0-1").alias("pid"), F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"),
                                        F.lit(1.0).alias("w"))
    assert kd.kendall_s(points).first()["s"] == -60_000 * 59_999 / 2
