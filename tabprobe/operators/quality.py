"""Data-quality operators: column report, duplicates, missing values.

All three produce small result tables (one row per column, or one row), but
their inputs are scanned in a bounded number of distributed passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.operators._util import BROADCAST_ROWS, persist
from tabprobe.sources.io import col

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def hashable_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be compared for equality row-wise (no nested types)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]


def _distinct_counts(df: DataFrame, fields: list, approx: bool) -> DataFrame:
    """(column, _card, _nn) over the unpivoted values. Exact counts shuffle 128-bit hashes of the values, combined
    map side, so that long texts stay where they are."""
    recs = []
    for f in fields:
        c = _value(f)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c)  # -0.0 equals 0.0
        recs.append(F.struct(F.lit(f.name).alias("column"), F.when(c.isNotNull(), F.xxhash64(c)).alias("h1"),
                             F.when(c.isNotNull(), F.xxhash64(F.lit("second"), c)).alias("h2")))
    long = df.select(F.inline(F.array(*recs))).filter(F.col("h1").isNotNull())
    if approx:
        return long.groupBy("column").agg(F.approx_count_distinct("h1").alias("_card"), F.count(F.lit(1)).alias("_nn"))
    per_value = long.groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("_k"))
    return per_value.groupBy("column").agg(F.count(F.lit(1)).alias("_card"), F.sum("_k").alias("_nn"))


def _value(f: T.StructField):
    """Column value with NaN read as missing (pandas ``isna``)."""
    c = col(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None).cast(f.dataType))
    return c


def data_quality_report(df: DataFrame, approx: bool = False, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per column: column, dtype, non_null, nulls, null_pct, cardinality, sample.

    * NaN counts as missing;
    * cardinality = distinct non-null values (NULL for nested columns, which
      cannot be counted; ``approx=True`` uses HyperLogLog sketches);
    * sample = the first non-null value in the order ``order_by`` (columns that order the
      rows), else the smallest one, as text; '' when the column is empty or nested.

    Samples come from one aggregate, counts and distinct counts from one unpivoted
    two-stage aggregation (map-side de-duplication of (column, value hash)).
    """
    fields = df.schema.fields
    countable = [f for f in fields if not isinstance(f.dataType, _NESTED)]
    aggs = [F.count(F.lit(1)).alias("_rows")]

    def sample(f: T.StructField):
        if not order_by:
            return F.min(_value(f))
        return F.min_by(_value(f), F.when(_value(f).isNotNull(), F.struct(*[col(c) for c in order_by])))

    for i, f in enumerate(fields):
        nested = isinstance(f.dataType, _NESTED)
        aggs.append((F.count(col(f.name)) if nested else F.lit(None).cast("long")).alias(f"_nn{i}"))
        aggs.append((F.lit("") if nested else sample(f).cast("string")).alias(f"_s{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f"_nn{i}").alias("_known"), F.lit(isinstance(f.dataType, _NESTED)).alias("_nested"),
                 F.coalesce(F.col(f"_s{i}"), F.lit("")).alias("sample"), F.col("_rows").alias("_rows"))
        for i, f in enumerate(fields)])
    out = one.select(F.inline(rows))
    if countable:
        cards = _distinct_counts(df, countable, approx)  # one row per column
        out = out.join(cards, "column", "left")
    else:
        out = out.withColumns({"_card": F.lit(None).cast("long"), "_nn": F.lit(None).cast("long")})
    nn = F.when(F.col("_nested"), F.col("_known")).otherwise(F.coalesce("_nn", F.lit(0))).cast("long")
    card = F.when(~F.col("_nested"), F.coalesce("_card", F.lit(0))).cast("long")
    return out.select("column", "dtype", nn.alias("non_null"), (F.col("_rows") - nn).alias("nulls"),
                      F.try_divide((F.col("_rows") - nn) * F.lit(100.0), F.col("_rows")).alias("null_pct"),
                      card.alias("cardinality"), "sample")


def missing_values(report: DataFrame) -> DataFrame:
    """Columns with missing values, worst first (input: :func:`data_quality_report`)."""
    return (report.filter(F.col("null_pct") > 0)
            .select("column", "null_pct").orderBy(F.desc("null_pct"), "column"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """total_rows, duplicate_rows (rows minus distinct rows), duplicate_pct.

    Nested columns are ignored.  64-bit row hashes are counted first (8-byte
    shuffle keys, combined map side).  If few enough repeat to be broadcast, only
    rows with a repeated hash are grouped on their full values, which separates real
    duplicates from hash collisions.  Otherwise rows are counted by 128 bits of hashes,
    so that not even then whole rows are moved.
    """
    spark = df.sparkSession
    cols = hashable_columns(df)
    schema = "total_rows long, duplicate_rows long, duplicate_pct double"
    if not cols:
        return spark.createDataFrame([(df.count(), 0, 0.0)], schema)
    h = F.xxhash64(*[col(c) for c in cols])
    repeated = persist(df.select(h.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_h"))
    if repeated.count() <= BROADCAST_ROWS:
        rows = df.select(*[col(c) for c in cols], h.alias("_h"))
        groups = rows.join(F.broadcast(repeated), "_h", "left_semi").groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    else:
        second = F.xxhash64(F.lit("second"), *[col(c) for c in cols])
        groups = df.select(h.alias("_h"), second.alias("_g")).groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"))
    dups = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d")).select("d").scalar()
    total = df.select(F.count(F.lit(1)).alias("t")).scalar()
    return spark.range(1).select(total.alias("total_rows"), dups.alias("duplicate_rows"),
                                 F.coalesce(F.try_divide(dups * F.lit(100.0), total), F.lit(0.0)).alias("duplicate_pct"))
