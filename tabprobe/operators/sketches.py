"""Mergeable summaries: KLL quantile sketches and exact distinct counts by bitmaps.

Both are kept as tables of small binary states, one per group and part (a file, a day), which can be stored, added to
when new parts arrive, and merged by any coarser key without reading the data again.

Quantile sketches are approximate: a quantile's rank is off by ``rank_error(k)`` or less of all rows (with 99 % confidence for each).
Bitmaps are exact: a value's bit lies in the bitmap of its range of 32,768 whole numbers, so that a hot key spreads over the
ranges of its values, and merging is a bitwise or.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.operators._util import numeric_long
from tabprobe.sources.io import col

SKETCH_K = 800
BITS = 32_768


def rank_error(k: int = SKETCH_K) -> float:
    """The published error of a KLL sketch's ranks, as a share of all rows (99 % confidence)."""
    return 2.296 / k ** 0.9723


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K,
                      part: Column | None = None) -> DataFrame:
    """``by…, column, part, n, sketch`` of the columns' non-missing values, one row a group and part; parts are the files read, or the
    values of ``part``."""
    by = list(by)
    part = F.input_file_name() if part is None else part
    long = numeric_long(df.withColumn("_part", part), columns, [*by, "_part"])
    return (long.groupBy(*[col(b) for b in by], "column", F.col("_part").alias("part"))
            .agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch")))


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys…, n, sketch`` over all parts."""
    return (sketches.groupBy(*[col(c) for c in keys])
            .agg(F.sum("n").alias("n"), F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("sketch")))


def sketch_quantiles(merged: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``keys…, p, n, q``: the sketches' quantiles; NULL for a group without values."""
    each = [F.struct(F.lit(float(p)).alias("p"), F.col("n").alias("n"),
                     F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias("q")) for p in probs]
    return merged.select(*[col(c) for c in keys], F.inline(F.array(*each)))


def approx_quantiles(long_df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], k: int = SKETCH_K) -> DataFrame:
    """``keys…, p, n, q`` like ``exact_quantiles`` from one pass, without interpolation between values."""
    keys = list(keys)
    v = F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))
    found = (long_df.select(*[col(c) for c in keys], v.alias("_v")).groupBy(*[col(c) for c in keys])
             .agg(F.count("_v").alias("n"), F.kll_sketch_agg_double("_v", k).alias("sketch")))
    return sketch_quantiles(found, keys, probs)


def distinct_bitmaps(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys…, bucket, bits``: the set of non-null whole numbers of each group, NULL keys left out."""
    kind = df.schema[value].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"bitmaps hold whole numbers; {value} is {kind.simpleString()}")
    v = col(value).cast("long")
    some = df.dropna(subset=[*keys, value])
    return (some.groupBy(*[col(c) for c in keys], F.bitmap_bucket_number(v).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits")))


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys…, bucket, bits`` of the sets' unions by fewer or coarser keys."""
    return bitmaps.groupBy(*[col(c) for c in keys], "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, keys: Sequence[str], name: str = "distinct_values") -> DataFrame:
    """``keys…, name``: the sizes of the sets; one row a bucket is summed, so a hot key is shared by many tasks."""
    return bitmaps.groupBy(*[col(c) for c in keys]).agg(F.sum(F.bitmap_count("bits")).alias(name))
