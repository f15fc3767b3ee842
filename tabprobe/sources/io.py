"""Table sources: Parquet tables, typed CSV ingest, audits, previews, samples.

CSV is only an ingest format.  A gzip CSV is not splittable, so the typed
frame is repartitioned and written once as Parquet; every later job scans
the Parquet copy (column pruning, pushed filters, parallel splits).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens pandas ``read_csv`` reads as missing by default.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def q(name: str) -> str:
    """Back-tick quote a column name (dotted names such as ``emp.var.rate``)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one driver table (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas treats NaN as missing; Spark counts it as a value.  Map NaN to NULL
    in every floating column so aggregates skip it."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.nanvl(col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            exprs.append(col(f.name))
    return df.select(*exprs)


def _typed(c: Column, dtype: T.DataType, ts_format: str | None) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.try_to_timestamp(c, F.lit(ts_format)) if ts_format else F.try_to_timestamp(c)
    if isinstance(dtype, T.DateType):
        return F.to_date(F.try_to_timestamp(c, F.lit(ts_format)) if ts_format else F.try_to_timestamp(c))
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType)):
        # "3.0" style integers (pandas float columns written back) stay readable
        return F.coalesce(c.try_cast(dtype), c.try_cast("double").try_cast(dtype))
    return c.try_cast(dtype)


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType,
                   timestamp_format: str | None = None,
                   missing_tokens: list[str] | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Headered (optionally gzip) CSV → typed DataFrame with pandas missing rules.

    Every field is read as text, missing tokens become NULL, then each value is
    cast with ``try_cast`` (bad values → NULL) and NaN is mapped to NULL.
    """
    tokens = MISSING_TOKENS if missing_tokens is None else missing_tokens
    text_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = (spark.read.schema(text_schema)
           .option("header", True).option("multiLine", False)
           .option("escape", '"').option("mode", "PERMISSIVE")
           .csv(path))
    out = raw.select(*[
        _typed(F.when(~col(f.name).isin(tokens), col(f.name)), f.dataType, timestamp_format).alias(f.name)
        for f in schema.fields
    ])
    out = nan_to_null(out)
    if partitions:
        out = out.repartition(partitions)
    return out


def ingest_csv_to_parquet(spark: SparkSession, csv_path: str, schema: T.StructType,
                          out_path: str, partitions: int = 64,
                          partition_by: list[str] | None = None,
                          timestamp_format: str | None = None) -> DataFrame:
    """One-time conversion of a raw CSV to a typed Parquet table."""
    df = read_csv_typed(spark, csv_path, schema, timestamp_format, partitions=partitions)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(out_path)
    return spark.read.parquet(out_path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """Result sink: write a result table as Parquet (optionally partitioned,
    e.g. by month, so later reads prune partitions).  Rows are not shuffled
    by the partition key (a hot key would land in one task); file size is
    bounded by ``max_records_per_file`` instead."""
    w = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column], mode: str = "overwrite",
                   max_records_per_file: int = 5_000_000) -> DataFrame:
    """Write ``df`` as Parquet and return ``metrics`` (plain aggregates, by name) over the rows written as one row: both come
    from the same scan. The aggregates run in the writing stage itself, whose tasks count once even when they are
    run again."""
    seen = Observation(f"write-{uuid.uuid4().hex}")
    (df.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode(mode)
     .option("maxRecordsPerFile", max_records_per_file).parquet(path))
    kinds = df.agg(*[c.alias(n) for n, c in metrics.items()]).schema
    return df.sparkSession.createDataFrame([tuple(seen.get[n] for n in metrics)], kinds)


def dataset_audit(spark: SparkSession, sf_dir: str,
                  declared: dict[str, int] | None = None,
                  names: list[str] | None = None) -> DataFrame:
    """Row count of every table, optionally against a declared size.

    Counts of Parquet scans are answered from file footers, so the audit is
    cheap even for very large tables.
    """
    names = names or DRIVER_TABLES
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("actual_rows"))
             for n in names]
    out = reduce(DataFrame.unionByName, parts)
    if declared:
        decl = spark.createDataFrame(list(declared.items()), "table_name string, declared_rows long")
        out = (out.join(F.broadcast(decl), "table_name", "left")
               .withColumn("matches", F.col("actual_rows") == F.col("declared_rows")))
    return out


def preview(df: DataFrame, order_by: list[str], n: int = 1000) -> DataFrame:
    """First ``n`` rows in a stated order (TakeOrdered: no global sort)."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """Deterministic fixed-size sample without replacement.

    The ``n`` rows with the smallest MD5 of seed and key are kept (ties by key).
    The digest is close to uniform, so a filter ``digest < threshold`` chosen
    for about ``3n`` rows keeps the candidates (a per-partition filter);
    only those go through the final ordered ``limit``, instead of every
    partition sending its own top ``n``.  The threshold is widened until at
    least ``n`` rows pass, so the result equals the plain top-``n``.  Frames
    with fewer than ``n`` rows come back whole.
    """
    keys = [F.coalesce(col(c).cast("string"), F.lit("")) for c in key_cols]
    keyed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary")))
    total = df.count()
    if total > n:
        frac = min(1.0, 3.0 * n / total)
        while frac < 1.0:
            thr = format(int(frac * 2 ** 64), "016x")
            cand = keyed.filter(F.col("_h") < F.lit(thr))
            if cand.count() >= n:
                keyed = cand
                break
            frac = min(1.0, frac * 2)
    return keyed.orderBy("_h", *[col(c) for c in key_cols]).limit(n).drop("_h")
