"""Grouped aggregates: rates, level grids, shares, top-k, rollups, class balance.

pandas ``groupby`` drops NULL keys and sorts keys; Spark keeps a NULL group,
so every grouped operator here filters NULL keys unless told otherwise.
Shares use a scalar subquery for the grand total (one extra aggregate, no
single-partition window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.sources.io import col


def _nonnull_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)


def group_agg(df: DataFrame, keys: Sequence[str], *aggs: Column, dropna: bool = True) -> DataFrame:
    keys = list(keys)
    src = _nonnull_keys(df, keys) if dropna else df
    return src.groupBy(*[col(k) for k in keys]).agg(*aggs)


def rate_by_key(df: DataFrame, keys: Sequence[str], target: str,
                rate_name: str = "rate", count_name: str = "count") -> DataFrame:
    """Mean of a 0/1 (or numeric) target and its non-null count per key."""
    return group_agg(df, keys, F.avg(col(target)).alias(rate_name), F.count(col(target)).alias(count_name))


def rate_by_levels(df: DataFrame, key: str, levels: Sequence[str], target: str,
                   rate_name: str = "rate", count_name: str = "count", by: Sequence[str] = ()) -> DataFrame:
    """Like :func:`rate_by_key` but every category level appears (pandas
    ``observed=False``): empty levels get NULL mean and count 0.

    With ``by`` the grid is levels × observed values of the ``by`` keys; it
    is generated by exploding a literal level array, not by a join."""
    agg = df.groupBy(*[col(k) for k in [*by, key]]).agg(F.avg(col(target)).alias(rate_name), F.count(col(target)).alias(count_name))
    return fill_levels(agg, key, levels, by, count_name)


def fill_levels(agg: DataFrame, key: str, levels: Sequence[str], by: Sequence[str] = (), count_name: str = "count") -> DataFrame:
    """An aggregated table (keys ``by`` and ``key``, groups with NULL keys included) with a row for every level, per
    observed ``by`` keys: missing ones get NULLs and the count 0."""
    by = list(by)
    lv = F.explode(F.array(*[F.lit(x) for x in levels])).alias(key)
    if by:
        grid = _nonnull_keys(agg, by).select(*[col(b) for b in by]).distinct().select("*", lv)
    else:
        grid = agg.sparkSession.range(1).select(lv)
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), col(key))
    out = grid.join(_nonnull_keys(agg, by + [key]), by + [key], "left").fillna(0, [count_name])
    others = [c for c in agg.columns if c not in {*by, key, count_name}]
    return out.select(*by, key, (pos - 1).cast("int").alias(f"{key}_ord"), *others,
                      F.col(count_name).cast("long").alias(count_name))


def count_by_levels(df: DataFrame, key: str, levels: Sequence[str], value: str | None = None,
                    count_name: str = "count") -> DataFrame:
    """Non-null count of ``value`` (rows when None) per category level, empty
    levels included with count 0."""
    c = F.count(col(value)) if value else F.count(F.lit(1))
    agg = group_agg(df, [key], c.alias(count_name))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in levels])).alias(key))
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), col(key))
    out = grid.join(agg, [key], "left").fillna(0, [count_name])
    return out.select(key, (pos - 1).cast("int").alias(f"{key}_ord"), F.col(count_name).cast("long").alias(count_name))


def share_of_total(agg_df: DataFrame, value: str, name: str = "share", scale: float = 1.0) -> DataFrame:
    """value / Σ value over the whole (aggregated) table, via a scalar subquery."""
    total = agg_df.select(F.sum(col(value))).scalar()
    return agg_df.withColumn(name, F.try_divide(col(value) * F.lit(scale), total))


def value_counts(df: DataFrame, key: str, count_name: str = "count") -> DataFrame:
    """Count per distinct non-null value, most frequent first."""
    return (group_agg(df, [key], F.count(F.lit(1)).alias(count_name))
            .orderBy(F.desc(count_name), col(key)))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """class, count, percent of non-null rows (most frequent first)."""
    vc = group_agg(df, [target], F.count(F.lit(1)).alias("count"))
    return share_of_total(vc, "count", "percent", 100.0).orderBy(F.desc("count"), col(target))


def top_k(df: DataFrame, metric: str, k: int, tiebreak: Sequence[str]) -> DataFrame:
    """Largest ``k`` rows by metric; ties broken by the key (deterministic).
    Planned as TakeOrderedAndProject — per-partition top-k, no global sort."""
    return df.orderBy(F.desc(metric), *[col(t) for t in tiebreak]).limit(k)


def sort_by_levels(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Sort by a custom category order; values outside the order last."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), col(key))
    return df.withColumn(f"{key}_ord", F.when(pos > 0, pos - 1).cast("int")).orderBy(
        F.col(f"{key}_ord").asc_nulls_last(), col(key))


def describe_by_class(df: DataFrame, column: str, by: str, **qkw) -> DataFrame:
    """count, mean, std, min, quartiles, max of ``column`` per class."""
    from tabprobe.operators.stats import descriptive_stats
    src = _nonnull_keys(df, [by])
    out = descriptive_stats(src, [column], by=[by], **qkw)
    return out.select(by, "count", "mean", "std", "min", "p25", "median", "p75", "max")


def median_by(df: DataFrame, keys: Sequence[str], value: str, **qkw) -> DataFrame:
    """Exact median per group (linear interpolation), groups of any size."""
    from tabprobe.operators.quantiles import exact_quantiles
    keys = list(keys)
    src = _nonnull_keys(df, keys).select(*[col(k) for k in keys], col(value).alias("_val"))
    # low-accuracy sketches keep per-group state small when groups are many
    qkw.setdefault("accuracy", 1000)
    q = exact_quantiles(src, keys, "_val", [0.5], **qkw)
    return q.select(*keys, F.col("q").alias("median"))


def quantile_scalar(df: DataFrame, value: str, p: float, **qkw) -> DataFrame:
    """One exact quantile of one column as a one-row table (``n``, ``q``)."""
    from tabprobe.operators.quantiles import exact_quantiles
    src = df.select(F.lit(value).alias("column"), col(value).alias("_val"))
    return exact_quantiles(src, ["column"], "_val", [p], **qkw).select("n", "q")


def span_by_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Distinct days, first and last timestamp per key."""
    return group_agg(df, [key], F.count_distinct(F.to_date(col(ts))).alias("days"),
                     F.min(col(ts)).alias("first"), F.max(col(ts)).alias("last"))


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    return df.select(col(key)).filter(col(key).isNotNull()).distinct().orderBy(col(key))


def distinct_tokens(df: DataFrame, text: str, sep: str = ",", name: str = "token") -> DataFrame:
    """All distinct trimmed tokens of a delimited text column."""
    tok = df.select(F.explode(F.split(col(text), sep)).alias(name))
    return tok.select(F.trim(name).alias(name)).filter(F.col(name) != "").distinct().orderBy(name)


def nested_mean(df: DataFrame, inner_keys: Sequence[str], value: str, how: str = "sum") -> DataFrame:
    """Mean over groups of a per-group aggregate (e.g. mean order value)."""
    inner = {"sum": F.sum, "avg": F.avg}[how](col(value)).alias("_inner")
    return group_agg(df, inner_keys, inner).agg(F.avg("_inner").alias(f"mean_{how}_per_group"))
