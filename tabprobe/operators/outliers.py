"""IQR outlier report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.operators.quantiles import frame_and_quartiles, quantile_wide
from tabprobe.operators.stats import numeric_columns
from tabprobe.operators._util import broadcast_if_small, numeric_long, persist


def outlier_report_iqr(df: DataFrame, columns: Sequence[str] | None = None,
                       multiplier: float = 1.5, by: Sequence[str] = (), quartiles: DataFrame | None = None,
                       **qkw) -> DataFrame | None:
    """Per column: outliers strictly outside ``[q1 - k·iqr, q3 + k·iqr]``, their
    share of **all** rows (missing values included, NULL groups not), the bounds,
    min and max.  NaN counts as missing.

    Quartiles are exact (or given, :func:`column_quartiles`); the counting pass joins the per-(group, column)
    bounds (one row per output row) to the unpivoted values."""
    cols = numeric_columns(df, columns)
    if not cols:
        return None
    by = list(by)
    df, quartiles = frame_and_quartiles(df, cols, by, quartiles, **qkw)
    qs = quantile_wide(quartiles.filter(F.col("column").isin(cols)), by + ["column"], [0.25, 0.75], ["q1", "q3"])
    bounds = qs.select(*by, "column",
                       (F.col("q1") - multiplier * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
                       (F.col("q3") + multiplier * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    long = numeric_long(df, cols, by)
    if by:
        bounds = persist(bounds)
        j = long.join(broadcast_if_small(bounds), by + ["column"], "left")
    else:
        # one row per column: inline the bounds as literal maps (no join)
        b = {r["column"]: (r["lower_bound"], r["upper_bound"]) for r in bounds.collect()}
        lo = F.create_map(*[x for c, (a, _) in b.items() for x in (F.lit(c), F.lit(a).cast("double"))])
        hi = F.create_map(*[x for c, (_, z) in b.items() for x in (F.lit(c), F.lit(z).cast("double"))])
        j = long.withColumn("lower_bound", lo[F.col("column")]).withColumn("upper_bound", hi[F.col("column")])
    out = j.groupBy(*by, "column").agg(
        F.count_if((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))).alias("outliers"),
        F.count(F.lit(1)).alias("_rows"),
        F.max("lower_bound").alias("lower_bound"), F.max("upper_bound").alias("upper_bound"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return out.select(*by, "column", "outliers",
                      F.try_divide(F.col("outliers") * F.lit(100.0), F.col("_rows")).alias("outlier_pct"),
                      "lower_bound", "upper_bound", "min", "max")
