"""Per-entity time-series features: returns, rolling volatility, rebasing and
period returns.

Input is a series unique on ``(entity, time)`` (e.g. one close per ticker per
day; raw events are aggregated to that grain first).  Rows get a distributed
position (range partitioning, no single-partition window), are cut into blocks
of ``block_rows`` and each block carries a halo of the ``window`` rows before
it, so no task holds more than ``block_rows + window`` rows of one entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.operators._util import broadcast_if_small
from tabprobe.operators.co_moments import long_returns
from tabprobe.operators.ranks import row_index
from tabprobe.sources.io import col

BLOCK_ROWS = 1 << 17


def _features(df: DataFrame, part: list, order, value: str, window: int,
              ret: str, logret: str, vol: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(order)
    prev = F.lag(col(value)).over(w)
    ratio = F.try_divide(col(value), prev)
    out = (df.withColumn(ret, (ratio - 1) * 100)
             .withColumn(logret, F.when(ratio > 0, F.ln(ratio))))
    wr = w.rowsBetween(-(window - 1), 0)
    return out.withColumn(vol, F.when(F.count(F.col(ret)).over(wr) == window,
                                      F.stddev_samp(F.col(ret)).over(wr)))


def series_features(df: DataFrame, entity: str, time: str, value: str, window: int = 20,
                    block_rows: int = BLOCK_ROWS, ret: str = "daily_return",
                    logret: str = "log_return", vol: str | None = None,
                    norm: str = "normalized") -> DataFrame:
    """Adds percent change (×100), log return, rolling sample std of the percent
    change over ``window`` rows (only when all ``window`` values exist) and the
    value rebased to 100 at the entity's first row.

    The rows do not depend on ``block_rows``; rows without an entity form a series of
    their own, which is not rebased."""
    vol = vol or f"volatility_{window}"
    first = (df.filter(col(entity).isNotNull())
             .groupBy(col(entity)).agg(F.min_by(col(value), col(time)).alias("_first")))
    idx = row_index(df, [entity], [time], name="_idx")
    blk = F.floor(F.col("_idx") / block_rows)
    own = idx.withColumn("_blk", blk).withColumn("_halo", F.lit(False))
    # a row is halo for every later block whose first ``window`` predecessors include it
    last = F.floor((F.col("_idx") + window) / block_rows)
    nxt = (idx.filter(last > blk)
           .withColumn("_blk", F.explode(F.sequence((blk + 1).cast("long"), last.cast("long"))))
           .withColumn("_halo", F.lit(True)))
    both = own.unionByName(nxt)
    out = _features(both, [col(entity), F.col("_blk")], F.col("_idx"), value, window, ret, logret, vol)
    out = out.filter(~F.col("_halo")).drop("_idx", "_blk", "_halo")
    out = out.join(broadcast_if_small(first), entity, "left")
    return out.withColumn(norm, F.try_divide(col(value), F.col("_first")) * 100).drop("_first")


def period_return(df: DataFrame, entity: str, time: str, value: str, days: int = 365) -> DataFrame:
    """last value ÷ first value on/after (global max time − ``days``) − 1, per
    entity; NULL values are skipped; entities with no row in the period give
    NULL (outer alignment)."""
    cutoff = df.select(F.max(col(time)) - F.make_interval(days=F.lit(days))).scalar()
    has = col(value).isNotNull()
    g = df.filter(col(entity).isNotNull()).groupBy(col(entity)).agg(
        F.max_by(col(value), F.when(has, col(time))).alias("last_value"),
        F.min_by(col(value), F.when(has & (col(time) >= cutoff), col(time))).alias("first_in_period"))
    return g.withColumn("period_return", F.try_divide(F.col("last_value"), F.col("first_in_period")) - 1)


def pivot_returns(df: DataFrame, entity: str, time: str, value: str,
                  entities: Sequence[str]) -> DataFrame:
    """Wide table of consecutive-row percent changes of the (time × entity)
    pivot of mean values; rows with any NULL dropped (pandas
    ``pivot_table().pct_change().dropna()``)."""
    ents = list(entities)
    returns = long_returns(df.filter(col(entity).isin(ents)), entity, time, value)
    wide = returns.groupBy(col(time)).pivot(entity, ents).agg(F.first("ret"))
    return wide.dropna(subset=ents)
