"""A table sink whose files can be skipped by ranges of several columns.

Rows are sorted along a Z-order curve: every clustering column is cut into ranges of about equal counts, and the bits of
the range numbers are interleaved, so that a file holds a narrow range of each column, not only of the first. Files are
cut by range partitioning on the curve and, for rows at one point of it, on a hash of the row, so that no hot value
makes a file (or task) of its own size. Parquet writes minima, maxima and, where asked, Bloom filters per row group,
which Spark's pushed filters use; a side table with the minima and maxima of every file lets ``read_clustered`` leave
out files before they are opened.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.sources.io import col

ZONES = "_zones"
MOST_BITS = 6  # ranges per column: 2 ** bits
ACCURACY = 10_000


def _ordinal(c: Column, kind: T.DataType) -> Column:
    """A number that orders values as the column does (texts: by their first six bytes)."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.substring(c.cast("binary"), 1, 6)
        return F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double")
    return F.nanvl(c.cast("double"), F.lit(float("inf")))


def _curve(df: DataFrame, by: Sequence[str]) -> tuple[Column, int]:
    """The Z-order place of a row, and the number of rows. NULLs come first."""
    kinds = {n: df.schema[n].dataType for n in by}
    bits = max(1, min(MOST_BITS, 62 // len(by)))
    shares = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    cuts = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.percentile_approx(_ordinal(col(n), kinds[n]), shares, ACCURACY).alias(f"c{i}") for i, n in enumerate(by)]).first()
    place = F.lit(0).cast("long")
    for i, n in enumerate(by):
        edges = F.array(*[F.lit(x) for x in sorted(set(cuts[f"c{i}"] or []))]).cast("array<double>")
        own = _ordinal(col(n), kinds[n])
        number = F.coalesce(F.size(F.filter(edges, lambda e: e <= own)), F.lit(0)).cast("long")
        for b in range(bits):
            place = place + F.shiftleft(F.shiftright(number, b).bitwiseAND(F.lit(1).cast("long")), b * len(by) + i)
    return place, cuts["rows"]


def write_clustered(df: DataFrame, path: str, by: Sequence[str], *, rows_per_file: int = 5_000_000, row_group_bytes: int = 64 << 20,
                    bloom: Sequence[str] = ()) -> None:
    """Write ``df`` as Parquet under ``path``, clustered by the columns ``by``, with Bloom filters on ``bloom``, and the side table of
    file ranges."""
    spark = df.sparkSession
    place, rows = _curve(df, by)
    files = max(1, -(-rows // rows_per_file))
    tie = F.xxhash64(*[col(c) for c in df.columns])
    taken, names = {c.lower() for c in df.columns}, []
    for n in ("place", "tie"):  # names of our own that clash with none of the table's
        while n in taken:
            n = "_" + n
        names.append(n)
    sorted_rows = (df.withColumn(names[0], place).withColumn(names[1], tie).repartitionByRange(files, *names)
                   .sortWithinPartitions(names[0], *[col(c) for c in by]).drop(*names))
    w = sorted_rows.write.option("parquet.block.size", row_group_bytes)
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", min(max(rows // files, 1), 1_000_000))
    w.parquet(path)
    zones(spark.read.schema(df.schema).parquet(path), by).write.parquet(f"{path}/{ZONES}")


def zones(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a file of ``table``: ``file`` (its name), ``rows`` and the minimum and maximum of every column, as Spark orders
    values (NaN last)."""
    return (table.groupBy(F.substring_index("_metadata.file_path", "/", -1).alias("file"))
            .agg(F.count(F.lit(1)).alias("rows"), *[f(col(n)).alias(f"{s}{i}") for i, n in enumerate(columns) for s, f in (("min", F.min), ("max", F.max))]))


def read_clustered(spark: SparkSession, path: str, by: Sequence[str], *, ranges: Mapping[str, tuple] | None = None,
                   values: Mapping[str, Sequence] | None = None) -> DataFrame:
    """The rows whose columns lie within all ``ranges`` (bounds included, None: open) and among all ``values`` (an empty list keeps all,
    as in ``filter_isin``). Files whose ranges exclude them are not opened; of the others, Parquet skips row groups."""
    ranges, values = dict(ranges or {}), {c: list(v) for c, v in (values or {}).items() if v}
    schema = spark.read.parquet(path).schema

    def within(c: Column, bounds: tuple) -> Column:
        low, high = bounds
        keep = F.lit(True)
        if low is not None:
            keep = keep & (c >= F.lit(low))
        return keep & (c <= F.lit(high)) if high is not None else keep

    useful = F.lit(True)
    for i, c in enumerate(by):
        least, most = F.col(f"min{i}"), F.col(f"max{i}")
        if c in ranges:
            low, high = ranges[c]
            useful = useful & (most >= F.lit(low) if low is not None else F.lit(True)) & (least <= F.lit(high) if high is not None else F.lit(True))
        if c in values:
            useful = useful & F.exists(F.array(*[F.lit(v) for v in values[c]]), lambda v: (v >= least) & (v <= most))
    # names of files, as Spark lists them on the driver as well
    files = [f"{path}/{r['file']}" for r in spark.read.parquet(f"{path}/{ZONES}").filter(useful).select("file").collect()]
    found = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    for c, bounds in ranges.items():
        found = found.filter(within(col(c), bounds))
    for c, some in values.items():
        found = found.filter(col(c).isin(some))
    return found
