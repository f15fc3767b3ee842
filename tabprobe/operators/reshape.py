"""Reshape: melt (unpivot), pivot table, explode delimited lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.sources.io import col


def melt(df: DataFrame, ids: Sequence[str] = (), values: Sequence[str] | None = None,
         var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide → long; default value columns are all non-id columns.
    Row-local (Expand), no shuffle."""
    ids = list(ids)
    values = [c for c in df.columns if c not in ids] if values is None else list(values)
    return df.unpivot([col(i) for i in ids], [col(v) for v in values], var_name, value_name)


def pivot_table(df: DataFrame, index: Sequence[str], columns: str, values: str,
                levels: Sequence | None = None, aggfunc: str = "mean") -> DataFrame:
    """Long → wide with one column per level of ``columns``.

    Passing ``levels`` avoids the extra job Spark runs to find them.  NULL
    index/column keys are dropped (pandas ``pivot_table``)."""
    fn = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[aggfunc]
    src = df
    for k in list(index) + [columns]:
        src = src.filter(col(k).isNotNull())
    g = src.groupBy(*[col(i) for i in index])
    g = g.pivot(columns, list(levels)) if levels is not None else g.pivot(columns)
    return g.agg(fn(col(values)))


def explode_tokens(df: DataFrame, text: str, pattern: str = r",\s*", name: str = "token",
                   keep: Sequence[str] = (), trim: bool = True) -> DataFrame:
    """One row per list element; a NULL list yields one NULL row (pandas
    ``explode``), dropped later as a NULL group key."""
    tok = F.explode_outer(F.split(col(text), pattern))
    out = df.select(*[col(k) for k in keep], tok.alias(name))
    return out.withColumn(name, F.trim(F.col(name))) if trim else out
