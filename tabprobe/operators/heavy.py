"""The most frequent values, counted exactly, without shuffling all values.

Each task keeps at most ``counters`` counters (Misra and Gries): when there are more, the largest count that does not fit is
taken off all. A counter is too low by at most what was taken off in its task, so a value's true count is at most the
sum of its counters plus ``slack``, the sum of all tasks' losses. Values whose bound reaches the k-th best sum
are counted exactly in a second pass. If the k-th exact count is larger than ``slack``, no value without counters
can belong to the top: the answer is proven. Otherwise the passes are run again with four times the counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.operators._util import broadcast_if_small, persist
from tabprobe.sources.io import col

COUNTERS = 2048
MOST_COUNTERS = 1 << 24
HELD = 1 << 18  # values held in a task before they are counted into its counters


def _summaries(values: DataFrame, counters: int) -> DataFrame:
    """(v, c, loss): each task's counters, and in one row without a value what was taken off them."""
    kind = values.schema["v"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        total, size = 0, 0

        def fold() -> pa.Table:
            nonlocal total
            merged = pa.concat_tables(parts).group_by("v").aggregate([("c", "sum")]).rename_columns(["v", "c"])
            if merged.num_rows > counters:
                counts = merged.column("c").to_numpy()
                off = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
                total += off
                merged = merged.set_column(1, "c", pa.array(counts - off)).filter(pa.array(counts > off))
            return merged

        for batch in batches:
            found = pc.value_counts(batch.column("v"))
            parts.append(pa.table({"v": found.field("values"), "c": found.field("counts")}))
            size += len(found)
            if size >= max(HELD, 4 * counters):
                parts = [fold()]
                size = parts[0].num_rows
        if parts:
            merged = fold().combine_chunks()
            for b in merged.to_batches(max_chunksize=10_000):
                yield pa.record_batch([b.column("v"), b.column("c"), pa.nulls(b.num_rows, pa.int64())], names=["v", "c", "loss"])
            yield pa.record_batch([pa.nulls(1, merged.schema.field("v").type), pa.nulls(1, pa.int64()), pa.array([total])], names=["v", "c", "loss"])

    return values.mapInArrow(count, f"v {kind}, c long, loss long")


def heavy_hitters(df: DataFrame, value: str, k: int, *, counters: int = COUNTERS, count_name: str = "count") -> DataFrame:
    """The k most frequent non-null values and their exact counts, ties to the smaller value: the rows of a full count, without one."""
    values = df.select(col(value).alias("v")).filter("v is not null")
    while True:
        parts = persist(_summaries(values, counters))
        slack = parts.agg(F.coalesce(F.sum("loss"), F.lit(0))).first()[0]
        sums = persist(parts.filter("v is not null").groupBy("v").agg(F.sum("c").alias("c")))
        least = sums.orderBy(F.desc("c")).limit(k).agg(F.min("c"), F.count(F.lit(1))).first()
        floor = least[0] if least[1] == k else 0
        candidates = sums.filter(F.col("c") + slack >= floor).select("v")
        exact = sums  # nothing was taken off: the counters are the counts
        if slack:
            exact = values.join(broadcast_if_small(candidates), "v", "left_semi").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        top = persist(exact.orderBy(F.desc("c"), "v").limit(k))
        rows, worst = top.agg(F.count(F.lit(1)), F.min("c")).first()
        if slack == 0 or (rows == k and worst > slack):
            return top.select(F.col("v").alias(value), F.col("c").alias(count_name))
        if counters >= MOST_COUNTERS:  # so flat that counters do not help: a full count
            full = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "v").limit(k)
            return full.select(F.col("v").alias(value), F.col("c").alias(count_name))
        counters *= 4
