"""Exact Kendall tau-b for large data, pairwise-complete.

tau_b = S / sqrt((n0 - n1)(n0 - n2)) with S = Σ_{i<j} sgn(x_i-x_j)·sgn(y_i-y_j),
n0 = n(n-1)/2 and n1, n2 the tied pairs in x and in y.

S needs every pair, so it is computed by divide and conquer on weighted
points (x, y, w) (rows collapsed map side, ``w`` = multiplicity).  A problem
with more than ``cap`` points is cut into x-buckets and y-buckets at sample
quantiles of its values (about ``4m/cap`` of them, at most ``sqrt(m)/4``).  A
value at a cut gets a bucket of its own, so that a value with many points
is alone in its bucket; the values between two cuts make one.  Then

    S(P) = Σ_X S(P ∩ X)                       pairs inside one x-bucket
         + Σ_Y S({(bx, y) : p ∈ P ∩ Y})       same y-bucket, different x-bucket
         + S({(bx, by), Σw})                   different buckets in both

because the sign of ``x_i - x_j`` equals the sign of ``bx_i - bx_j`` across
buckets (and likewise for y); single-value buckets contribute 0.  Any cuts are
right, good ones only make the sub-problems small. Every sub-problem is again
a Kendall S problem with fewer points, so all problems of one level run
together as one grouped DataFrame and the recursion ends when every problem
fits ``cap`` points; those are solved exactly in ``applyInPandas`` by counting
inversions bit by bit of the ranks (numpy).  The cuts, a few numbers a
problem, are all the driver learns; tasks place points by them, without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.operators._util import persist
from tabprobe.sources.io import col

CAP = 500_000  # points a task sweeps
LEAST = 16  # a grid of 3 x 3 buckets is smaller


def _inversions(r: np.ndarray, w: np.ndarray) -> float:
    """Σ w_i·w_j over i < j with r_i > r_j (``r``: ranks from 0). A pair is counted at the highest bit in which its ranks
    differ: at each bit, points are grouped by the bits above it, in their first order within a group."""
    bits = int(r.max()).bit_length() if len(r) else 0
    below = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=1 << bits))))  # points of smaller rank
    total = 0.0
    for bit in range(bits - 1, -1, -1):
        group = (r >> (bit + 1)) << (bit + 1)
        start, middle = below[group], below[group + (1 << bit)]
        one = (r >> bit) & 1
        heavy = np.concatenate(([0.0], np.cumsum(w * one)))
        ones = np.concatenate(([0], np.cumsum(one)))
        total += float((w * (1 - one) * (heavy[:-1] - heavy[start])).sum())
        ones_before = ones[:-1] - ones[start]
        to = np.where(one == 1, middle + ones_before, np.arange(len(r)) - ones_before)
        moved, moved_w = np.empty_like(r), np.empty_like(w)
        moved[to], moved_w[to] = r, w
        r, w = moved, moved_w
    return total


def _tied(ranks: np.ndarray, w: np.ndarray) -> float:
    """Σ w_i·w_j over pairs of points of equal rank."""
    return 0.5 * float((np.bincount(ranks, w) ** 2).sum() - (w * w).sum())


def _s_points(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Weighted S of distinct points: all pairs less ties less twice the discordant ones, which are the inversions of y in
    the order of (x, y)."""
    x, y = (np.unique(v, return_inverse=True)[1].astype(np.int64) for v in (x, y))
    if len(x) and x.max() < y.max():
        x, y = y, x
    order = np.lexsort((y, x))
    pairs = 0.5 * (float(w.sum()) ** 2 - float((w * w).sum()))
    return pairs - _tied(x, w) - _tied(y, w) - 2.0 * _inversions(y[order], w[order])


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact weighted S of one small problem (one ``applyInPandas`` group)."""
    x, y, w = (pdf[c].to_numpy(dtype=np.float64) for c in "xyw")
    return pd.DataFrame({"pid": [pdf["pid"].iloc[0]], "s": [_s_points(x, y, w)]})


def _cuts(p: DataFrame, big: dict[str, int], cap: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Cut values in x and y of each big problem, by its number of points."""
    buckets = {pid: int(max(2, min(-(-4 * m // cap), m ** 0.5 // 4))) for pid, m in big.items()}
    most = max(buckets.values())
    shares = [i / most for i in range(1, most)]
    found = p.groupBy("pid").agg(*[F.percentile_approx(c, shares, max(1000, 16 * most)).alias(c) for c in "xy"]).collect()
    cuts = {}
    for row in found:
        n = buckets[row["pid"]]
        at = [round(k * most / n) - 1 for k in range(1, n)]
        cuts[row["pid"]] = tuple(np.unique(np.array(row[c])[at]) for c in "xy")
    return cuts


def _bucket(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bucket ids in the order of values; odd ones hold the single value of a cut."""
    left = np.searchsorted(cuts, values, "left")
    return left + np.searchsorted(cuts, values, "right")


def _split(p: DataFrame, cuts: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The points of the sub-problems of problems with ``cuts``."""

    def place(batches):
        for batch in batches:
            found = []
            pid = batch.column("pid").dictionary_encode()
            code, x, y, w = pid.indices.to_numpy(), *(batch.column(c).to_numpy() for c in "xyw")
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if not len(part):
                    continue
                name = pid.dictionary[int(code[part[0]])].as_py()
                bx, by = (_bucket(v[part], c) for v, c in zip((x, y), cuts[name]))
                inx, iny = bx % 2 == 0, by % 2 == 0
                for mark, ids, px, py, pw in (("X", bx[inx], x[part][inx], y[part][inx], w[part][inx]),
                                              ("Y", by[iny], bx[iny], y[part][iny], w[part][iny]), ("G", None, bx, by, w[part])):
                    names, of = ([f"{name}/{mark}"], np.zeros(len(px), np.int32)) if ids is None else np.unique(ids, return_inverse=True)
                    names = pa.array([n if ids is None else f"{name}/{mark}{n}" for n in names], pa.string())
                    found.append(pa.record_batch([names.take(pa.array(of)), *(pa.array(v.astype(np.float64)) for v in (px, py, pw))],
                                                 names=["pid", "x", "y", "w"]))
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    # x-buckets keep their points apart; the others may fall together
    return p.mapInArrow(place, "pid string, x double, y double, w double").groupBy("pid", "x", "y").agg(F.sum("w").alias("w"))


def kendall_s(points: DataFrame, cap: int = CAP, max_levels: int = 40) -> DataFrame:
    """S per root problem.  ``points``: (pid string, x double, y double, w double)
    with distinct (pid, x, y).  Returns (pid, s)."""
    cap = max(cap, LEAST)
    leaves = []
    p = persist(points.select("pid", "x", "y", "w"))
    for _ in range(max_levels):
        sizes = p.groupBy("pid").agg(F.count(F.lit(1)).alias("m"))
        big = {r["pid"]: r["m"] for r in sizes.filter(F.col("m") > cap).collect()}  # at most points / cap
        too_big = F.col("pid").isin(list(big))
        leaves.append((p.filter(~too_big) if big else p).groupBy("pid").applyInPandas(_sweep, "pid string, s double"))
        if not big:
            break
        pb = p.filter(too_big)
        p = persist(_split(pb, _cuts(pb, big, cap)))
    else:
        raise RuntimeError("kendall: recursion did not converge")
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    root = F.split("pid", "/").getItem(0)
    return out.groupBy(root.alias("pid")).agg(F.sum("s").alias("s"))


def kendall_pairs(df: DataFrame, columns: Sequence[str], cap: int = CAP) -> DataFrame:
    """Upper triangle incl. diagonal: ``i, j, n, corr`` of Kendall tau-b over
    the rows where both values are present."""
    cols = list(columns)
    k = len(cols)
    x = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}")
                    for i, c in enumerate(cols)])
    # a column against itself has tau-b 1 (NULL when constant): no pair search
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    recs = F.array(*[F.struct(F.lit(f"{i}-{j}").alias("pid"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y"))
                     for i, j in pairs])
    diag = x.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(k)],
                 *[(F.min(f"c{i}") < F.max(f"c{i}")).alias(f"d{i}") for i in range(k)])
    diag = diag.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(i).alias("j"), F.col(f"n{i}").alias("n"),
                 F.when(F.col(f"d{i}"), F.lit(1.0)).alias("corr")) for i in range(k)])))
    if not pairs:
        return diag
    long = x.select(F.inline(recs)).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    pts = long.groupBy("pid", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    pts = persist(pts)
    s = kendall_s(pts, cap=cap)
    tx = pts.groupBy("pid", "x").agg(F.sum("w").alias("t")).groupBy("pid").agg(
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("n1"), F.sum("t").alias("n"))
    ty = pts.groupBy("pid", "y").agg(F.sum("w").alias("t")).groupBy("pid").agg(
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("n2"))
    stats = tx.join(ty, "pid").join(s, "pid", "left")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    den = (n0 - F.col("n1")) * (n0 - F.col("n2"))
    tau = F.when(den > 0, F.coalesce(F.col("s"), F.lit(0.0)) / F.sqrt(den))
    ij = F.split("pid", "-")
    off = stats.select(ij.getItem(0).cast("int").alias("i"), ij.getItem(1).cast("int").alias("j"),
                       F.col("n").cast("long").alias("n"),
                       F.least(F.lit(1.0), F.greatest(F.lit(-1.0), tau)).alias("corr"))
    return off.unionByName(diag.select("i", "j", F.col("n").cast("long").alias("n"), "corr"))
