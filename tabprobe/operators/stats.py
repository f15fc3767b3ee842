"""Descriptive statistics, histograms and box summaries for numeric columns.

Moments come from one aggregate over the unpivoted values (map-side partial
aggregation, one shuffle of a few numbers per partition); exact quartiles
come from :mod:`tabprobe.operators.quantiles`.  Results are long tables with
one row per (group…, column).  NaN counts as missing and NULL group keys belong
to no group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.operators.quantiles import QUARTILES, frame_and_quartiles, quantile_wide
from tabprobe.operators._util import broadcast_if_small, numeric_frame, numeric_long, persist
from tabprobe.sources.io import col


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Requested names that exist and are numeric (others silently skipped)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = list(types) if columns is None else list(columns)
    return [c for c in names if c in types and isinstance(types[c], T.NumericType)]


def _skew_corrected(g1, n):
    """Bias-corrected sample skewness G1 from population g1 (n >= 3)."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def _kurt_corrected(g2, n):
    """Bias-corrected excess kurtosis G2 from population excess g2 (n >= 4)."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (ddof 1), min, max, skew (G1), kurtosis (G2) per column, aggregated over the unpivoted values
    (one small aggregate per (group, column), combined map side). Without groups every column has its row, also on
    an empty frame.

    Constant columns give skew/kurtosis 0 (pandas), not NULL."""
    by = list(by)
    x = F.col("_x")
    m = numeric_long(df, columns, by, "_x").groupBy(*by, "column").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"))
    if not by:
        names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
        m = names.join(m, "column", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    n = F.col("count").cast("double")
    const = F.col("min") == F.col("max")
    skew = F.when(const & (n >= 3), F.lit(0.0)).otherwise(_skew_corrected(F.col("_g1"), n))
    kurt = F.when(const & (n >= 4), F.lit(0.0)).otherwise(_kurt_corrected(F.col("_g2"), n))
    return m.select(*by, "column", "count", "mean", "std", "min", "max", skew.alias("skew"), kurt.alias("kurtosis"))


def descriptive_stats(df: DataFrame, columns: Sequence[str] | None = None,
                      by: Sequence[str] = (), quartiles: DataFrame | None = None, **qkw) -> DataFrame | None:
    """count, mean, std, min, p25, median, p75, max, skew, kurtosis per column.

    Moments come from one aggregate over the unpivoted values, quartiles from the
    exact-quantile engine, or from ``quartiles`` (:func:`column_quartiles` of these
    columns or more).  Returns ``None`` when no requested column is numeric."""
    cols = numeric_columns(df, columns)
    if not cols:
        return None
    by = list(by)
    df, quartiles = frame_and_quartiles(df, cols, by, quartiles, **qkw)
    m = moments(df, cols, by)
    qs = quantile_wide(quartiles, by + ["column"], QUARTILES, ["p25", "median", "p75"])
    out = m.join(qs, by + ["column"], "left")
    return out.select(*by, "column", "count", "mean", "std", "min", "p25", "median", "p75", "max",
                      "skew", "kurtosis")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 40, by: Sequence[str] = (),
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram per column (optionally split by group columns).

    Edges span the finite [min, max] of the whole frame (shared by all groups, as
    for an overlay), or [lo, hi] when given; values outside, so also infinities,
    are dropped; the last bin is closed.  Empty bins are emitted with count 0.
    Output: ``by…, column, bin, bin_lo, bin_hi, count``.
    """
    cols = numeric_columns(df, columns)
    by = list(by)
    long = numeric_long(df, cols, by).filter(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    # edges: 2 numbers per column, the only values brought to the driver
    seen = {r["column"]: (r["a"], r["b"]) for r in
            long.groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect()}
    edges = {}
    for c in cols:
        a, b = seen.get(c, (None, None))
        edges[c] = (a if lo is None else float(lo), b if hi is None else float(hi))
    first, last = (F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(edges[c][k]).cast("double"))])[F.col("column")]
                   for k in (0, 1))
    width = (last - first) / F.lit(float(bins))
    idx = F.when(last == first, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - first) / width), F.lit(bins - 1))).cast("int")
    counts = (long.filter(F.col("value").between(first, last))
              .groupBy(*by, "column", idx.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    # grid of every (group, column, bin): observed groups × literal bin sequence
    groups = long.select(*by, "column").distinct() if by else \
        df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, by + ["column", "bin"], "left").fillna(0, ["count"])
    return out.select(*by, "column", "bin", (first + F.col("bin") * width).alias("bin_lo"),
                      (first + (F.col("bin") + 1) * width).alias("bin_hi"), F.col("count").cast("long").alias("count"))


def box_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                whisker: float = 1.5, quartiles: DataFrame | None = None, **qkw) -> DataFrame:
    """Box-plot numbers per column: q1, median, q3, fences, whiskers (most
    extreme values inside the fences), mean, std, outlier count."""
    cols = numeric_columns(df, columns)
    by = list(by)
    df, quartiles = frame_and_quartiles(df, cols, by, quartiles, **qkw)
    qs = quantile_wide(quartiles.filter(F.col("column").isin(cols)), by + ["column"], QUARTILES, ["q1", "median", "q3"])
    qs = (qs.withColumn("lower_fence", F.col("q1") - whisker * (F.col("q3") - F.col("q1")))
            .withColumn("upper_fence", F.col("q3") + whisker * (F.col("q3") - F.col("q1"))))
    long = numeric_long(df, cols, by)
    # quantile table has one row per (group, column): bounded by the output size
    qs = persist(qs)
    j = long.filter(F.col("value").isNotNull()).join(broadcast_if_small(qs), by + ["column"])
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    agg = j.groupBy(*by, "column").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.count_if(~inside).alias("outliers"))
    return qs.join(agg, by + ["column"], "left").select(
        *by, "column", "q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high",
        "mean", "std", "outliers")


def scatter_bins(df: DataFrame, x: str, y: str, x_bins: int = 50, y_bins: int = 50, by: Sequence[str] = (),
                 means: Sequence[str] = ()) -> DataFrame:
    """2-D equal-width bin counts of (x, y) — the scale-safe form of a scatter
    plot, whose output is bounded by ``x_bins × y_bins`` per group whatever the
    row count.  ``by`` adds the plot's colour or facet columns; edges are shared by
    all groups.  ``means`` adds the mean of columns that stand for a continuous
    colour or a size, as ``mean_<column>``.  Rows whose x or y is missing or infinite have no
    point."""
    by = list(by)
    finite = F.abs(F.col("_x")) < float("inf"), F.abs(F.col("_y")) < float("inf")
    points = (numeric_frame(df.withColumns({"_x": col(x), "_y": col(y)}), ["_x", "_y", *means], by)
              .filter(F.col("_x").isNotNull() & F.col("_y").isNotNull() & finite[0] & finite[1]))
    r = points.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    xa, xb, ya, yb = [float(v) if v is not None else 0.0 for v in r]

    def idx(c, a, b, n):
        if a == b:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - F.lit(a)) / ((F.lit(b) - F.lit(a)) / F.lit(float(n)))), F.lit(n - 1)).cast("int")

    return (points.groupBy(*by, idx("_x", xa, xb, x_bins).alias("x_bin"), idx("_y", ya, yb, y_bins).alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("count"), *[F.avg(col(c)).alias(f"mean_{c}") for c in means]))


def scatter_matrix(df: DataFrame, columns: Sequence[str] = (), bins: int = 20, vector: str | None = None) -> DataFrame:
    """``x, y, x_bin, y_bin, count``: the 2-D bins of every pair of columns (x before y), from one pass after the one for the
    ranges. With ``vector``, the columns are the places (from 0) of an array column; its rows of another length than the
    longest have no points. A point counts where both values are finite; tasks emit count arrays, at most
    ``bins ** 2`` rows a pair."""
    if vector is not None:
        source = df.select(F.transform(col(vector), lambda c: c.cast("double")).alias("v")).filter("v is not null")
        width = source.agg(F.max(F.size("v"))).first()[0] or 0
        source = source.filter(F.size("v") == width)
        names = [str(i) for i in range(width)]
    else:
        names = numeric_columns(df, columns or None)
        frame = numeric_frame(df, names)
        source = frame.select(F.array(*[col(c) for c in names]).alias("v"))
        width = len(names)
    finite = F.abs("x") < float("inf")
    ranges = {r["i"]: (r["a"], r["b"]) for r in source.select(F.posexplode("v").alias("i", "x")).filter(F.col("x").isNotNull() & finite)
              .groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()}  # one row a column
    low = np.array([ranges.get(i, (0.0, 0.0))[0] for i in range(width)])
    high = np.array([ranges.get(i, (0.0, 0.0))[1] for i in range(width)])
    step = (high - low) / float(bins)

    def count(batches):
        grids = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            fits = np.isfinite(x)
            with np.errstate(all="ignore"):
                place = np.where(fits & (step > 0), np.minimum(np.floor((x - low) / step), bins - 1), 0).astype(np.int64)
            for i in range(width):
                for j in range(i + 1, width):
                    both = fits[:, i] & fits[:, j]
                    grids[i, j] = grids.get((i, j), 0) + np.bincount(place[both, i] * bins + place[both, j], minlength=bins * bins)
        for (i, j), grid in grids.items():
            at = np.flatnonzero(grid)
            yield pa.record_batch({"i": pa.array(np.full(len(at), i, np.int32)), "j": pa.array(np.full(len(at), j, np.int32)),
                                   "x_bin": pa.array((at // bins).astype(np.int32)), "y_bin": pa.array((at % bins).astype(np.int32)),
                                   "count": pa.array(grid[at])})

    counts = (source.mapInArrow(count, "i int, j int, x_bin int, y_bin int, count long")
              .groupBy("i", "j", "x_bin", "y_bin").agg(F.sum("count").alias("count")))
    label = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return counts.select(F.get(label, "i").alias("x"), F.get(label, "j").alias("y"), "x_bin", "y_bin", "count")


def nice_step(low: float, high: float, most_bins: int) -> float:
    """The smallest 1, 2 or 5 times a power of ten that cuts [low, high] into at most ``most_bins`` parts; 1 for a single point."""
    raw = (high / 2 - low / 2) / most_bins * 2
    if not raw > 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(raw))
    return next(m * power for m in (1.0, 2.0, 5.0, 10.0) if raw <= m * power * (1 + 1e-12))


def histogram_nice(df: DataFrame, columns: Sequence[str], most_bins: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """Histogram whose bins are whole multiples of a step of 1, 2 or 5 times a power of ten: ``most_bins`` is an upper bound of the
    step's choice (one more bin may be needed at an edge). All groups share the edges; bins are closed on the left;
    infinities are dropped; empty bins between the ends count 0. Output: ``by…, column, bin_lo, bin_hi, count``."""
    by = list(by)
    cols = numeric_columns(df, columns)
    long = numeric_long(df, cols, by).filter(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    ends = {r["column"]: (r["a"], r["b"]) for r in
            long.groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect()}  # one row a column
    steps = {c: nice_step(a, b, most_bins) for c, (a, b) in ends.items()}

    def of(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("column")] if values else F.lit(None).cast("double")

    step = of(steps)
    place = F.floor(F.col("value") / step)
    counts = long.groupBy(*[col(b) for b in by], "column", place.alias("place")).agg(F.count(F.lit(1)).alias("count"))
    first, last = (of({c: math.floor(e[k] / steps[c]) for c, e in ends.items()}).cast("long") for k in (0, 1))
    groups = long.select(*[col(b) for b in by], "column").distinct()
    grid = groups.select("*", F.explode(F.sequence(first, last)).alias("place"))
    out = grid.join(counts, [*by, "column", "place"], "left")
    return out.select(*[col(b) for b in by], "column", (F.col("place") * step).alias("bin_lo"), ((F.col("place") + 1) * step).alias("bin_hi"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))
