"""Types of CSV columns inferred from all rows, with the rules of pandas.

Each value belongs to one class: missing token, whole number of 64 signed bits, whole number of 64 unsigned bits, larger
whole number, other number, truth value, text. The classes seen, joined over all rows of a column, decide its type;
the join is a count per class, so that it is combined on the map side and needs one small row a column. Dates are only
looked for in columns that are named: every format of ``DATE_FORMATS`` that reads all values is known after one pass.

Where pandas' result depends on the order of rows (a number beyond 64 bits beside a fraction), the column is
``double`` here. Whole numbers with missing values stay whole and nullable, where pandas turns to floating point; the
report names both types.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.sources.csv_records import CHUNK_BYTES, csv_chunks, csv_records
from tabprobe.sources.io import MISSING_TOKENS

CLASSES = ["n_missing", "n_int", "n_uint", "n_huge", "n_float", "n_bool", "n_text"]
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITE = r"^(?i)[+-]?inf(inity)?$"
TRUTH = r"^(?i)(true|false)$"
TYPES = {"int64": "bigint", "uint64": "decimal(20,0)", "float64": "double", "bool": "boolean", "object": "string", "datetime64[ns]": "timestamp"}

# Date formats tried in this order.
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss",
    "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "d.M.yyyy", "yyyyMMdd",
]


def date_shape(pattern: str) -> str:
    """A regular expression that every text read by a date format fits: digits (with a sign) for numbers, anything for names and
    offsets, the format's own marks between them. A text that fails to be read costs an exception, one that does not fit, nothing."""
    parts = re.findall(r"'([^']*)'|([A-Za-z])(\2*)|([^A-Za-z'])", pattern)
    shape = "".join(re.escape(quoted or mark) if quoted or mark else ".+" if letter in "XVzOZx" or (letter in "ML" and len(more) > 1)
                    else r"[+-]?\d*" for quoted, letter, more, mark in parts)
    return rf"^(?is)\s*{shape}\s*$"


def read_date(v: Column, pattern: str) -> Column:
    """The time a format reads in a text, else NULL."""
    return F.when(v.rlike(date_shape(pattern)), F.try_to_timestamp(v, F.lit(pattern)))


def value_class(v: Column, missing_tokens: list[str] | None = None) -> Column:
    """The class of a text value: a place in ``CLASSES``."""
    tokens = MISSING_TOKENS if missing_tokens is None else missing_tokens
    number = F.trim(v).try_cast("decimal(38,0)")
    whole = (F.when(v.try_cast("long").isNotNull(), 1)
             .when((number >= 0) & (number <= F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")), 2).otherwise(3))
    finite = F.abs(v.try_cast("double")) < float("inf")
    return (F.when(v.isNull() | v.isin(tokens), 0).when(v.rlike(WHOLE), whole)
            .when(v.rlike(NUMBER) & finite, 4).when(v.rlike(INFINITE), 4).when(v.rlike(TRUTH), 5).otherwise(6))


def infer_types(records: DataFrame, names: list[str], parse_dates: list[str] | None = None,
                missing_tokens: list[str] | None = None) -> DataFrame:
    """One row a column of ``records`` (``fields``: array of texts): ``position``, ``column``, ``n_rows``, a count per class,
    ``pandas_type`` and ``spark_type``; for columns in ``parse_dates``, ``date_formats`` lists the formats that read every value."""
    dated = F.array(*[F.lit(i) for i, n in enumerate(names) if n in (parse_dates or [])]).cast("array<int>")
    cells = records.select(F.posexplode(F.slice(F.concat("fields", F.array_repeat(F.lit(None).cast("string"), len(names))), 1, len(names)))
                           .alias("position", "v"))
    kind = value_class(F.col("v"), missing_tokens)
    asked = F.array_contains(dated, F.col("position"))
    classed = cells.withColumn("kind", kind).withColumn("negative", F.col("v").rlike(r"^\s*-"))
    formats = DATE_FORMATS if parse_dates else []
    reads = F.array(*[read_date(F.col("v"), f).isNotNull() for f in formats]).cast("array<boolean>")  # once a value
    classed = classed.withColumn("reads", F.when(asked & (F.col("kind") > 0), reads))
    fails = [F.count_if(~F.get("reads", F.lit(i))) == 0 for i in range(len(formats))]
    seen = classed.groupBy("position").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("kind") == i).alias(c) for i, c in enumerate(CLASSES)],
        F.count_if((F.col("kind") == 1) & F.col("negative")).alias("n_negative"),
        (F.count_if(~F.array_contains("reads", True)) == 0).alias("any_format"),
        F.array_compact(F.array(*[F.when(ok, F.lit(f)) for ok, f in zip(fails, formats)])).cast("array<string>").alias("formats"))
    has = {c: F.col(c) > 0 for c in CLASSES}
    numeric = ~has["n_text"] & ~has["n_bool"]
    some = F.col("n_missing") < F.col("n_rows")
    pandas_type = (
        F.when(F.array_contains(dated, F.col("position")) & some & F.col("any_format"), "datetime64[ns]")
        .when(has["n_text"], "object")
        .when(has["n_bool"], F.when(F.col("n_bool") == F.col("n_rows"), "bool").otherwise("object"))
        .when(numeric & has["n_float"], "float64")
        .when(has["n_huge"], "object")
        .when(has["n_uint"], F.when(has["n_missing"] | (F.col("n_negative") > 0), "object").otherwise("uint64"))
        .when(has["n_int"] & ~has["n_missing"], "int64").otherwise("float64"))
    kept_whole = (F.col("pandas_type") == "float64") & has["n_int"] & ~has["n_float"]
    spark_type = F.when(kept_whole, "bigint").otherwise(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[F.col("pandas_type")])
    return (seen.withColumn("pandas_type", pandas_type).withColumn("spark_type", spark_type)
            .select("position", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1).alias("column"), "n_rows", *CLASSES,
                    "pandas_type", "spark_type", F.when(F.col("pandas_type") == "datetime64[ns]", F.col("formats")).alias("date_formats")))


def typed(v: Column, spark_type: str, formats: list[str] | None = None, missing_tokens: list[str] | None = None) -> Column:
    """A text value in the type inferred for its column."""
    tokens = MISSING_TOKENS if missing_tokens is None else missing_tokens
    v = F.when(~v.isin(tokens), v)
    if spark_type == "timestamp":
        return F.coalesce(*[read_date(v, f) for f in (formats or DATE_FORMATS)])
    if spark_type == "string":
        return v
    return F.trim(v).try_cast(spark_type) if spark_type.startswith("decimal") else v.try_cast(spark_type)


def column_names(header: list[str]) -> list[str]:
    """Names of a header record: empty ones numbered, repeated ones with a number after them."""
    names: list[str] = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        found, n = name, 0
        while found in names:
            n += 1
            found = f"{name}.{n}"
        names.append(found)
    return names


def open_csv(spark: SparkSession, path: str | list[str], *, sep: str = ",", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, list[str]]:
    """(records without headers, names) of headered CSV files: each file's first record is a header (within its first chunk),
    names are those of the first file."""
    chunks = csv_chunks(spark, path, sep=sep, chunk_bytes=chunk_bytes)
    first = csv_records(chunks.filter("block = 0 and chunk = 0"), sep=sep).orderBy("place").first()
    if first is None:
        raise ValueError("no columns: the files are empty")
    is_header = (F.col("place.block") == 0) & (F.col("place.chunk") == 0) & (F.col("place.row") == 1)
    return csv_records(chunks, sep=sep).filter(~is_header), column_names(first["fields"])


def read_csv(spark: SparkSession, path: str | list[str], *, parse_dates: list[str] | None = None, sep: str = ",",
             missing_tokens: list[str] | None = None, long_rows: str = "error", place: str | None = None,
             chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Headered (optionally gzip) CSV with types inferred from all rows and quoted line breaks kept.

    ``parse_dates`` names date columns: the first format that reads all their values is used, else, value by value, the first
    that reads it; a column with a value that no format reads stays text. Rows with fewer fields than the header end in NULLs;
    rows with more raise an error, or with ``long_rows="skip"`` are left out. ``place`` names a column for (file, block,
    chunk, row), which orders rows as in the files."""
    if long_rows not in ("error", "skip"):
        raise ValueError(f"long_rows: {long_rows}")
    records, names = open_csv(spark, path, sep=sep, chunk_bytes=chunk_bytes)
    longer = F.size("fields") > len(names)
    if long_rows == "skip":
        records = records.filter(~longer)
    else:
        said = F.concat(F.lit(f"expected {len(names)} fields, saw "), F.size("fields"), F.lit(" in "), F.to_json("place"))
        records = records.withColumn("fields", F.when(longer, F.raise_error(said).cast("array<string>")).otherwise(F.col("fields")))
    report = {r["position"]: r for r in infer_types(records, names, parse_dates, missing_tokens).collect()}  # one row a column
    columns = []
    for i, name in enumerate(names):
        kind, formats = (report[i]["spark_type"], report[i]["date_formats"]) if i in report else ("double", None)
        columns.append(typed(F.get("fields", F.lit(i)), kind, formats[:1] if formats else None, missing_tokens).alias(name))
    return records.select(*([F.col("place").alias(place)] if place else []), *columns)


def csv_schema(spark: SparkSession, path: str | list[str], **options) -> T.StructType:
    """The schema ``read_csv`` infers."""
    return read_csv(spark, path, **options).schema
