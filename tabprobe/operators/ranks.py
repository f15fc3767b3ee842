"""Distributed ranks and row indexes without a single-partition window.

``Window.partitionBy(g).orderBy(v)`` puts a whole group in one task.  Here a
group's values are range-partitioned first; each range partition computes
local running counts and adds the total of the partitions before it (a
small ``(group, partition)`` table), so no task holds more than one range
partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.operators._util import broadcast_if_small, persist
from tabprobe.sources.io import col, q


def _offsets(part: DataFrame, keys: list[str], weight: str) -> DataFrame:
    tot = part.groupBy(*keys, "_pid").agg(F.sum(weight).alias("_ptot"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return persist(tot.select(*keys, "_pid", F.coalesce(F.sum("_ptot").over(w), F.lit(0)).alias("_off")))


def average_ranks(long_df: DataFrame, keys: Sequence[str], value: str,
                  partitions: int | None = None) -> DataFrame:
    """Average rank (1-based, ties share the mean rank, as pandas ``rank()``)
    of every distinct non-null ``value`` within ``keys``.

    Output: ``keys…, value, count, rank``.  Ties are collapsed map-side first,
    so a hot value costs one row.
    """
    keys = list(keys)
    spark = long_df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = (long_df.select(*[col(k) for k in keys], col(value).alias("_v"))
         .filter(F.col("_v").isNotNull())
         .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    part = d.repartitionByRange(p, *keys, "_v").withColumn("_pid", F.spark_partition_id())
    part = persist(part)
    off = _offsets(part, keys, "_c")
    w = Window.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    out = local.join(broadcast_if_small(off), keys + ["_pid"])
    rank = F.col("_off") + F.col("_before") + (F.col("_c") + 1) / 2.0
    return out.select(*keys, F.col("_v").alias(value), F.col("_c").alias("count"), rank.alias("rank"))


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              partitions: int | None = None, name: str = "row_idx") -> DataFrame:
    """0-based position of each row within ``keys`` in ``order`` (order must be
    unique within a group).  Same range-partition + offset scheme."""
    keys = list(keys)
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = (df.repartitionByRange(p, *[col(k) for k in keys], *[col(o) for o in order])
            .withColumn("_pid", F.spark_partition_id()).withColumn("_one", F.lit(1)))
    part = persist(part)
    off = _offsets(part, keys, "_one")
    w = Window.partitionBy(*keys, "_pid").orderBy(*[col(o) for o in order])
    local = part.withColumn("_local", F.row_number().over(w) - 1)
    # NULL keys are a group of their own: compare them null-safely
    off = off.select("_off", F.col("_pid").alias("_opid"), *[col(k).alias(f"_o_{i}") for i, k in enumerate(keys)])
    same = F.col("_pid") == F.col("_opid")
    for i, k in enumerate(keys):
        same = same & local[q(k)].eqNullSafe(F.col(f"_o_{i}"))
    out = local.join(broadcast_if_small(off), same).drop("_opid", *[f"_o_{i}" for i in range(len(keys))])
    return out.withColumn(name, F.col("_off") + F.col("_local")).drop("_pid", "_one", "_off", "_local")
