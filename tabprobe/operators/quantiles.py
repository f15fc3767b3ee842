"""Exact quantiles (linear interpolation) without holding a group in memory.

Spark's exact ``percentile`` keeps a value→count map per group, which does not
fit once a column (or a hot group) has billions of distinct values.  This
module finds the exact order statistics with a few distributed passes over
the values and small per-target tables (target = group keys × probability):

1. one aggregate per group: ``n``, min, max and — when asked — a
   ``percentile_approx`` bracket around each target rank ``(n-1)p``;
2. each target gets a bracket ``[lo, hi]`` that must hold few rows:
   ``[min, max]`` when the group is small, the sketch bracket when the
   sketch's rank error guarantees a small bracket, otherwise histogram
   refinement: a pass splits the bracket into ``bins`` equal-width buckets
   (``(target, bucket)`` counts, combined map side) and keeps the bucket(s)
   holding ranks ``floor(h)`` and ``ceil(h)``, until at most
   ``max_bracket`` rows remain;
3. the final pass maps each value to (below | inside | above) its bracket,
   counts ``(target, side, value)`` (ties collapse map side) and walks a
   window over at most ``max_bracket + 2`` rows per target.  If a sketch
   bracket turns out not to contain the rank, that target is refined and
   selected again.

Target tables are checkpointed into the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.operators._util import broadcast_if_small, numeric_long, stored_frame
from tabprobe.operators._util import persist as _persist
from tabprobe.sources.io import col


_LARGEST = 1.7976931348623157e308  # the largest finite double


def _refine(base: DataFrame, t: DataFrame, keys: list[str], max_bracket: int, bins: int,
            max_rounds: int) -> DataFrame:
    """Shrink ``[_lo, _hi]`` (with exact ``_below``/``_inside``) of targets in
    ``t`` until each holds at most ``max_bracket`` rows."""
    if "_stuck" not in t.columns:
        t = t.withColumn("_stuck", F.lit(False))
    for _ in range(max_rounds):
        big = t.filter((F.col("_inside") > max_bracket) & (F.col("_lo") < F.col("_hi")) & ~F.col("_stuck"))
        n_big = big.count()
        if n_big == 0:
            break
        bsel = big.select(*keys, "p", "_lo", "_hi", "_below", "_klo", "_khi")
        # halves, since the difference of two large numbers may be infinite
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        b = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        hist = (base.join(broadcast_if_small(bsel.select(*keys, "p", "_lo", "_hi"), n_rows=n_big), keys)
                .filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
                .groupBy(*keys, "p", b.alias("_b"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax")))
        hist = hist.join(bsel.select(*keys, "p", "_below", "_klo", "_khi"), keys + ["p"])
        w = Window.partitionBy(*keys, "p").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("_end", F.col("_below") + F.sum("_c").over(w))
        hist = hist.withColumn("_start", F.col("_end") - F.col("_c"))
        # bucket index is monotone in the value, so [min of first kept bucket,
        # max of last kept bucket] holds exactly those buckets' rows
        sel = (hist.groupBy(*keys, "p").agg(
            F.min(F.when(F.col("_end") > F.col("_klo"), F.col("_bmin"))).alias("_nlo"),
            F.min(F.when(F.col("_end") > F.col("_klo"), F.col("_start"))).alias("_nbelow"),
            F.max(F.when(F.col("_start") <= F.col("_khi"), F.col("_bmax"))).alias("_nhi"),
            F.max(F.when(F.col("_start") <= F.col("_khi"), F.col("_end"))).alias("_nend")))
        t2 = t.join(sel, keys + ["p"], "left")
        refined = F.col("_nlo").isNotNull()
        # a bracket whose two ranks sit on two tied values cannot shrink: stop it
        no_gain = refined & ((F.col("_nend") - F.col("_nbelow")) >= F.col("_inside"))
        t = _persist(t2.select(
            *[c for c in t.columns if c not in ("_lo", "_hi", "_below", "_inside", "_stuck")],
            (F.col("_stuck") | no_gain).alias("_stuck"),
            F.when(refined, F.col("_nlo")).otherwise(F.col("_lo")).alias("_lo"),
            F.when(refined, F.col("_nhi")).otherwise(F.col("_hi")).alias("_hi"),
            F.when(refined, F.col("_nbelow")).otherwise(F.col("_below")).alias("_below"),
            F.when(refined, F.col("_nend") - F.col("_nbelow")).otherwise(F.col("_inside")).alias("_inside"),
        ))
    else:
        raise RuntimeError(f"quantile brackets did not shrink in {max_rounds} rounds")
    return t


def _select(base: DataFrame, t: DataFrame, keys: list[str], n_targets: int) -> DataFrame:
    """Final pass: exact order statistics inside each target's bracket.

    Returns ``keys, p, _xlo, _xhi, _ok`` (``_ok`` false when a rank fell
    outside the bracket)."""
    tsel = t.select(*keys, "p", "_lo", "_hi")
    j = base.join(broadcast_if_small(tsel, n_rows=n_targets), keys)
    side = F.when(F.col("_v") < F.col("_lo"), F.lit(-1)).when(F.col("_v") > F.col("_hi"), F.lit(1)).otherwise(F.lit(0))
    vals = (j.groupBy(*keys, "p", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_x"))
            .agg(F.count(F.lit(1)).alias("_c")))
    vals = vals.join(t.select(*keys, "p", "_klo", "_khi"), keys + ["p"])
    w = (Window.partitionBy(*keys, "p").orderBy("_side", "_x")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    vals = vals.withColumn("_end", F.sum("_c").over(w))
    first_lo = F.min(F.when(F.col("_end") > F.col("_klo"), F.struct("_end", "_side", "_x")))
    first_hi = F.min(F.when(F.col("_end") > F.col("_khi"), F.struct("_end", "_side", "_x")))
    picked = vals.groupBy(*keys, "p").agg(first_lo.alias("_a"), first_hi.alias("_b"))
    return picked.select(*keys, "p", F.col("_a._x").alias("_xlo"), F.col("_b._x").alias("_xhi"),
                         ((F.col("_a._side") == 0) & (F.col("_b._side") == 0)).alias("_ok"))


def exact_quantiles(long_df: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], accuracy: int = 10_000,
                    max_bracket: int = 10_000, bins: int = 1024,
                    max_rounds: int = 40, approx_start: bool = True, approx: bool = False) -> DataFrame:
    """Quantiles of ``value`` per ``keys`` group.

    Returns ``keys…, p, n, q`` (``n`` non-null values; ``q`` NULL when n = 0),
    with pandas/DuckDB linear interpolation: ``h=(n-1)p``,
    ``q = x[floor h] + (h - floor h)(x[ceil h] - x[floor h])``.
    ``approx_start`` seeds brackets from ``percentile_approx`` (use it when
    groups are few; for many small groups plain refinement is cheaper).
    ``approx=True`` gives the quantiles of KLL sketches instead, from one pass.
    """
    keys = list(keys)
    if approx:
        from tabprobe.operators.sketches import approx_quantiles
        return approx_quantiles(long_df, keys, value, probs)
    v = col(value).cast("double")
    # infinities rank as the largest finite numbers, so that bucket widths stay finite, and come back at the end
    v = F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), F.nanvl(v, F.lit(None).cast("double"))))
    allv = long_df.select(*[col(k) for k in keys], F.when(col(value).isNotNull(), v).alias("_v"))
    base = allv.filter(F.col("_v").isNotNull())
    probs = [float(p) for p in probs]
    margin = 3.0 / accuracy
    plist = F.array(*[F.lit(p) for p in probs])

    aggs = [F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    if approx_start:
        br = []
        for p in probs:
            br += [max(0.0, p - margin), min(1.0, p + margin)]
        aggs.append(F.percentile_approx("_v", br, accuracy).alias("_br"))
    # groups with only NULL values still get rows (n = 0, q NULL)
    stats = _persist(allv.groupBy(*keys).agg(*aggs))
    t = stats.select("*", F.posexplode(plist).alias("_i", "p"))
    h = (F.col("_n") - 1) * F.col("p")
    small = F.col("_n") <= max_bracket
    # the sketch's rank error is at most n/accuracy on each side of the bracket
    sketch_ok = F.lit(approx_start) & (F.col("_n") * (2 * margin + 2.0 / accuracy) <= max_bracket)
    if approx_start:
        slo = F.element_at("_br", F.col("_i") * 2 + 1)
        shi = F.element_at("_br", F.col("_i") * 2 + 2)
    else:
        slo = shi = F.lit(None).cast("double")
    t = t.select(*keys, "p", "_n", "_min", "_max",
                 F.floor(h).cast("long").alias("_klo"), F.ceil(h).cast("long").alias("_khi"),
                 (h - F.floor(h)).alias("_frac"),
                 F.when(small, F.lit("exact")).when(sketch_ok, F.lit("sketch")).otherwise(F.lit("refine")).alias("_mode"),
                 F.when(small | ~sketch_ok, F.col("_min")).otherwise(slo).alias("_lo"),
                 F.when(small | ~sketch_ok, F.col("_max")).otherwise(shi).alias("_hi"),
                 F.lit(0).cast("long").alias("_below"),
                 # only "refine" targets carry an exact in-bracket count to shrink
                 F.when(small | ~sketch_ok, F.col("_n")).otherwise(F.lit(0)).cast("long").alias("_inside"))
    t = t.filter(F.col("_n") > 0)  # a projection of the stored statistics
    n_targets, n_refine = t.agg(F.count(F.lit(1)), F.count_if(F.col("_mode") == "refine")).first()
    if n_refine:
        t = _refine(base, t, keys, max_bracket, bins, max_rounds)

    res = _persist(_select(base, t, keys, n_targets))
    n_bad = res.filter(~F.col("_ok")).count()
    if n_bad:
        # a sketch bracket missed its rank: refine those targets from [min, max]
        bad = t.join(res.filter(~F.col("_ok")).select(*keys, "p"), keys + ["p"], "left_semi")
        bad = _persist(bad.withColumn("_lo", F.col("_min")).withColumn("_hi", F.col("_max"))
                       .withColumn("_below", F.lit(0).cast("long")).withColumn("_inside", F.col("_n"))
                       .withColumn("_stuck", F.lit(False)))
        bad = _refine(base, bad, keys, max_bracket, bins, max_rounds)
        redo = _select(base, bad, keys, n_bad)
        res = _persist(res.filter(F.col("_ok")).unionByName(redo))

    # groups whose values are all NULL keep a row with n = 0 and q NULL
    allp = stats.select(*keys, "_n", F.explode(plist).alias("p"))
    frac = t.select(*keys, "p", "_frac")
    out = allp.join(frac, keys + ["p"], "left").join(res, keys + ["p"], "left")
    low, high = (F.when(F.col(c) >= _LARGEST, F.lit(float("inf"))).when(F.col(c) <= -_LARGEST, F.lit(float("-inf")))
                 .otherwise(F.col(c)) for c in ("_xlo", "_xhi"))
    qv = F.when((F.col("_frac") == 0) | (low == high), low).otherwise(low + F.col("_frac") * (high - low))
    return out.select(*keys, "p", F.col("_n").alias("n"), qv.alias("q"))  # of stored tables


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     by: Sequence[str] = (), **kw) -> DataFrame:
    """Quantiles of several numeric columns (optionally per group) in one set of
    passes over the stored columns, unpivoted to ``(column, value)``."""
    by = list(by)
    frame = df if kw.get("approx") else stored_frame(df, columns, by)
    return stored_quantiles(frame, columns, probs, by, **kw)


def stored_quantiles(frame: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     by: Sequence[str] = (), **kw) -> DataFrame:
    """:func:`column_quantiles` of a frame that is cheap to read again."""
    by = list(by)
    long = numeric_long(frame, columns, by)
    return exact_quantiles(long, by + ["column"], "value", probs, **kw)


QUARTILES = (0.25, 0.5, 0.75)


def column_quartiles(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """``by…, column, p, n, q`` of the three quartiles: compute once, hand to statistics, outliers and boxes."""
    return column_quantiles(df, columns, QUARTILES, by=by, **kw)


def frame_and_quartiles(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                        quartiles: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """A frame with the columns and their quartiles (computed where not given, from the columns stored once)."""
    if quartiles is not None:
        return df, quartiles
    frame = df if kw.get("approx") else stored_frame(df, columns, by)
    return frame, stored_quantiles(frame, columns, QUARTILES, by, **kw)


def quantile_wide(qdf: DataFrame, keys: Sequence[str], probs: Sequence[float],
                  names: Sequence[str]) -> DataFrame:
    """Turn ``keys…, p, q`` rows into one column per probability."""
    return (qdf.groupBy(*keys)
            .agg(*[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(nm) for p, nm in zip(probs, names)]))
