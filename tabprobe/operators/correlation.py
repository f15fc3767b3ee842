"""Pairwise-complete correlation matrices (Pearson, Spearman) and top pairs.

Pearson for k columns is computed from partial moments: each task turns its
Arrow batches into numpy matrices and keeps, for every column pair over the rows
where both values are present, ``n``, both means and the centred sums
``Σ(x-mx)²``, ``Σ(y-my)²``, ``Σ(x-mx)(y-my)`` (null-masked matrix products).  A
task emits k² numbers; two small aggregates per pair merge them by the
parallel-variance rule.  This replaces k(k-1)/2 ``corr`` aggregates
(codegen-bound for wide k) with one pass, and nothing depends on the rows'
order.  A pair whose spread is no more than rounding error yields NULL (pandas
NaN) instead of a division error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.operators._util import broadcast_if_small, persist
from tabprobe.operators.ranks import average_ranks
from tabprobe.operators.stats import numeric_columns
from tabprobe.sources.io import col

_MOMENT_SCHEMA = "i int, j int, n double, mx double, my double, vx double, vy double, cxy double"


def _merge(a, b):
    """Moments of two disjoint sets of rows from the moments of each."""
    na, nb = a[0], b[0]
    n = na + nb
    share = np.divide(nb, n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = na * share
    return n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w


def _batch_moments(x):
    """Pairwise moments of a batch (NaN = missing): centred on the column means first, then on each pair's own."""
    m = ~np.isnan(x)
    c = np.where(m, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
    x0 = np.where(m, x - c, 0.0)
    mf = m.astype(np.float64)
    n = mf.T @ mf
    some = np.maximum(n, 1.0)
    dx = (x0.T @ mf) / some
    sq = (x0 * x0).T @ mf
    vx = np.maximum(sq - n * dx * dx, 0.0)
    cxy = x0.T @ x0 - n * dx * dx.T
    mx = np.where(n > 0, c[:, None] + dx, 0.0)
    return n, mx, mx.T.copy(), vx, vx.T.copy(), cxy


def _partial_moments_fn(k: int):
    def fn(batches):
        total = None
        for b in batches:
            if b.num_rows == 0:
                continue
            x = np.column_stack([
                b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)])
            own = _batch_moments(x)
            if total is not None:  # pairs one side has no rows of take the other side's mean
                own = tuple(own[:1]) + tuple(np.where(own[0] > 0, o, t) for o, t in zip(own[1:3], total[1:3])) + own[3:]
                total = tuple(total[:1]) + tuple(np.where(total[0] > 0, t, o) for o, t in zip(own[1:3], total[1:3])) + total[3:]
            total = own if total is None else _merge(total, own)
        if total is None:
            return
        ii, jj = np.triu_indices(k)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(ii.astype(np.int32)), "j": pa.array(jj.astype(np.int32)),
            **{name: v[ii, jj] for name, v in zip(("n", "mx", "my", "vx", "vy", "cxy"), total)}})

    return fn


def _corr_from_parts(part: DataFrame) -> DataFrame:
    """Merge the tasks' moments: the pair's means first, then the centred sums moved to them."""
    part = part.filter(F.col("n") > 0)
    tot = part.groupBy("i", "j").agg(F.sum("n").alias("nt"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("mxt"),
                                     (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("myt"))
    dx, dy = F.col("mx") - F.col("mxt"), F.col("my") - F.col("myt")
    m = part.join(tot, ["i", "j"]).groupBy("i", "j").agg(
        F.max("nt").alias("n"), F.max("mxt").alias("mx"), F.max("myt").alias("my"),
        F.sum(F.col("vx") + F.col("n") * dx * dx).alias("vx"), F.sum(F.col("vy") + F.col("n") * dy * dy).alias("vy"),
        F.sum(F.col("cxy") + F.col("n") * dx * dy).alias("cxy"))
    n, noise = F.col("n"), 1e-28  # of the squared mean: what rounding leaves of a constant column
    flat = (n < 2) | (F.col("vx") <= n * noise * F.col("mx") ** 2) | (F.col("vy") <= n * noise * F.col("my") ** 2)
    r = F.when(flat, F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(
        F.lit(-1.0), F.col("cxy") / (F.sqrt("vx") * F.sqrt("vy")))))
    return m.select("i", "j", n.cast("long").alias("n"), r.alias("corr"))


def _corr_from_moments(m: DataFrame) -> DataFrame:
    n = F.col("n")
    cov = F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n)
    vx = F.col("sxx") / n - (F.col("sx") / n) ** 2
    vy = F.col("syy") / n - (F.col("sy") / n) ** 2
    tiny = 1e-12
    degenerate = (n < 2) | (vx <= tiny * (F.col("sxx") / n)) | (vy <= tiny * (F.col("syy") / n))
    r = F.when(degenerate, F.lit(None).cast("double")).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cov / F.sqrt(vx * vy))))
    return m.select("i", "j", n.cast("long").alias("n"), r.alias("corr"))


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle incl. diagonal: ``i, j, n, corr`` (column indexes)."""
    cols = list(columns)
    x = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}")
                    for i, c in enumerate(cols)])
    part = _corr_from_parts(x.mapInArrow(_partial_moments_fn(len(cols)), _MOMENT_SCHEMA))
    # pairs without a common row keep theirs
    spark = df.sparkSession
    grid = spark.createDataFrame([(i, j) for i in range(len(cols)) for j in range(i, len(cols))], "i int, j int")
    return grid.join(part, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _rank_columns(x: DataFrame, names: list[str]) -> DataFrame:
    """Replace each column by its average rank.  All columns are ranked in one
    distributed-rank pass over the unpivoted values; each column's rank table
    (one row per distinct value) is then joined back on the value, broadcast
    only when its size allows."""
    long = x.select(*names).unpivot([], names, "_col", "_val")
    r = persist(average_ranks(long, ["_col"], "_val"))
    sizes = {row[0]: row[1] for row in r.groupBy("_col").count().collect()}
    out = x
    for c in names:
        rc = r.filter(F.col("_col") == c).select(F.col("_val").alias(f"_rv_{c}"), F.col("rank").alias(f"_rk_{c}"))
        out = out.join(broadcast_if_small(rc, n_rows=sizes.get(c, 0)), F.col(c) == F.col(f"_rv_{c}"), "left")
        out = out.drop(c, f"_rv_{c}").withColumnRenamed(f"_rk_{c}", c)
    return out


def _spearman_pairs_expanded(x: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    recs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                              F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for i, j in pairs])
    long = x.select(F.inline(recs)).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    rx = average_ranks(long, ["i", "j"], "x").select("i", "j", "x", F.col("rank").alias("rx"))
    ry = average_ranks(long, ["i", "j"], "y").select("i", "j", "y", F.col("rank").alias("ry"))
    ranked = long.join(rx, ["i", "j", "x"]).join(ry, ["i", "j", "y"])
    m = ranked.groupBy("i", "j").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("rx").alias("sx"), F.sum("ry").alias("sy"),
        F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy"),
        F.sum(F.col("rx") * F.col("ry")).alias("sxy"))
    return _corr_from_moments(m)


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman = Pearson of average ranks, ranked per pair over the rows where
    both values are present (pandas' pairwise-complete rule).

    Columns without NULLs share one ranking: each is ranked once with the
    distributed rank and its rank replaces the value (k joins), then the
    partial-moment Pearson runs on the ranks.  Pairs that involve a column
    with NULLs are expanded to one record per (row, pair), both sides are
    ranked within the pair and joined back on (pair, value) — no row id and
    no single-partition window."""
    cols = list(columns)
    k = len(cols)
    x = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}")
                    for i, c in enumerate(cols)])
    nulls = x.agg(*[F.count_if(F.col(f"c{i}").isNull()) for i in range(k)]).first()
    full = [i for i in range(k) if nulls[i] == 0]
    parts = []
    if full:
        ranked = _rank_columns(x.select(*[f"c{i}" for i in full]), [f"c{i}" for i in full])
        sub = pearson_pairs(ranked, [f"c{i}" for i in full])
        remap = F.create_map(*[v for a, i in enumerate(full) for v in (F.lit(a), F.lit(i))])
        parts.append(sub.select(remap[F.col("i")].alias("i"), remap[F.col("j")].alias("j"), "n", "corr"))
    rest = [(i, j) for i in range(k) for j in range(i, k) if not (i in full and j in full)]
    if rest:
        parts.append(_spearman_pairs_expanded(x, rest))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlation_long(df: DataFrame, columns: Sequence[str] | None = None,
                     method: str = "pearson") -> DataFrame | None:
    """Full k×k matrix as ``var1, var2, corr`` rows (both orders and the
    diagonal).  ``None`` when fewer than 2 numeric columns are given."""
    cols = numeric_columns(df, columns)
    if len(cols) < 2:
        return None
    if method == "pearson":
        up = pearson_pairs(df, cols)
    elif method == "spearman":
        up = spearman_pairs(df, cols)
    elif method == "kendall":
        from tabprobe.operators.kendall import kendall_pairs
        up = kendall_pairs(df, cols)
    else:
        raise ValueError(f"unknown method {method!r}")
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "idx int, name string")
    names = broadcast_if_small(names, n_rows=len(cols))
    both = up.unionByName(up.filter(F.col("i") != F.col("j"))
                          .select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "corr"))
    return (both.join(names.select(F.col("idx").alias("i"), F.col("name").alias("var1")), "i")
            .join(names.select(F.col("idx").alias("j"), F.col("name").alias("var2")), "j")
            .select("var1", "var2", "corr"))


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10,
                     method: str = "pearson") -> DataFrame | None:
    """Top ``n`` distinct pairs by |r| (each unordered pair once, ties broken by
    names, NULL correlations last)."""
    m = correlation_long(df, columns, method)
    if m is None:
        return None
    cols = numeric_columns(df, columns)
    order = {c: i for i, c in enumerate(cols)}
    pos = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    return (m.filter(pos[F.col("var1")] < pos[F.col("var2")])
            .orderBy(F.abs("corr").desc_nulls_last(), "var1", "var2").limit(n))
