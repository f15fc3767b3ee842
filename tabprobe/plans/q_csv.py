"""CSV queries (S1, S2): orders written as CSV text with quoted line breaks, missing tokens and a late non-number, and read
back with inferred types."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabprobe.plans.registry import query
from tabprobe.session import ensure_checkpoint_dir
from tabprobe.sources.csv_types import infer_types, open_csv, read_csv
from tabprobe.sources.io import table


def orders_csv(spark, d) -> str:
    """The folder of a CSV copy of ``orders`` in the shared folder."""
    key = F.col("o_orderkey")
    text = table(spark, d, "orders").select(
        key.alias("order"),
        F.when(key % 7 == 0, "NA").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.col("o_totalprice").alias("price"),
        F.when(key % 1000 == 999, "n/k").otherwise((key % 50).cast("string")).alias("shelf"),
        F.when(F.col("o_orderstatus") == "O", "True").otherwise("FALSE").alias("open"),
        (F.lit("18446744073709551615").cast("decimal(20,0)") - key).alias("serial"),
        F.date_format("o_orderdate", "M/d/yyyy H:mm").alias("ordered"),
        F.concat(F.lit('say "'), "o_orderpriority", F.lit('",\n'), F.when(key % 3 == 0, F.repeat(F.lit("\n"), 3)).otherwise(F.lit("")), "o_orderstatus").alias("note"),
        F.lit(None).cast("string").alias("nothing"))
    path = f"{ensure_checkpoint_dir(spark)}/orders-csv-{uuid.uuid4().hex}"
    text.write.option("header", True).option("escape", '"').csv(path)
    return path


_ORDERED = "CAST(date_trunc('minute', CAST(o_orderdate AS TIMESTAMP)) AS TIMESTAMP)"
_NOTE = """'say "' || o_orderpriority || '",' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN repeat(chr(10), 3) ELSE '' END || o_orderstatus"""


@query("csv_orders", f"""
SELECT o_orderkey AS "order", CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS customer, o_totalprice AS price,
       CASE WHEN o_orderkey % 1000 <> 999 THEN CAST(o_orderkey % 50 AS VARCHAR) ELSE 'n/k' END AS shelf, o_orderstatus = 'O' AS open,
       CAST(18446744073709551615 - CAST(o_orderkey AS DECIMAL(20, 0)) AS VARCHAR) AS serial, {_ORDERED} AS ordered,
       {_NOTE} AS note, CAST(NULL AS DOUBLE) AS nothing
FROM orders
""")
def q_csv_orders(spark, d):
    df = read_csv(spark, orders_csv(spark, d), parse_dates=["ordered"])
    return df.withColumn("serial", F.col("serial").cast("string"))


@query("csv_types", """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS na, count(*) FILTER (WHERE o_orderkey % 1000 = 999) AS nk FROM orders)
SELECT position, "column", n_rows, n_missing, n_int, n_uint, n_huge, n_float, n_bool, n_text, pandas_type, spark_type FROM (
  SELECT 0 AS position, 'order' AS "column", n AS n_rows, 0 AS n_missing, n AS n_int, 0 AS n_uint, CAST(0 AS BIGINT) AS n_huge, 0 AS n_float, 0 AS n_bool, 0 AS n_text, 'int64' AS pandas_type, 'bigint' AS spark_type FROM o
  UNION ALL SELECT 1, 'customer', n, na, n - na, 0, 0, 0, 0, 0, 'float64', 'bigint' FROM o
  UNION ALL SELECT 2, 'price', n, 0, 0, 0, 0, n, 0, 0, 'float64', 'double' FROM o
  UNION ALL SELECT 3, 'shelf', n, 0, n - nk, 0, 0, 0, 0, nk, CASE WHEN nk > 0 THEN 'object' ELSE 'int64' END, CASE WHEN nk > 0 THEN 'string' ELSE 'bigint' END FROM o
  UNION ALL SELECT 4, 'open', n, 0, 0, 0, 0, 0, n, 0, 'bool', 'boolean' FROM o
  UNION ALL SELECT 5, 'serial', n, 0, 0, n, 0, 0, 0, 0, 'uint64', 'decimal(20,0)' FROM o
  UNION ALL SELECT 6, 'ordered', n, 0, 0, 0, 0, 0, 0, n, 'datetime64[ns]', 'timestamp' FROM o
  UNION ALL SELECT 7, 'note', n, 0, 0, 0, 0, 0, 0, n, 'object', 'string' FROM o
  UNION ALL SELECT 8, 'nothing', n, n, 0, 0, 0, 0, 0, 0, 'float64', 'double' FROM o)
""")
def q_csv_types(spark, d):
    records, names = open_csv(spark, orders_csv(spark, d))
    return infer_types(records, names, ["ordered"]).drop("date_formats")
