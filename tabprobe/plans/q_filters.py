"""Filter queries (F*) on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabprobe.functions import filters as fl
from tabprobe.plans.registry import query
from tabprobe.session import ensure_checkpoint_dir
from tabprobe.sources.clustered import read_clustered, write_clustered
from tabprobe.sources.io import table

# Characters Python's str.strip() removes in ASCII text.
WHITESPACE = " \t\n\r\x0b\x0c"
_WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


_CLUSTERED = ["l_extendedprice", "l_quantity", "l_partkey"]


@query("filter_positive", """
SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0
""")
def q_filter_positive(spark, d):
    return table(spark, d, "customer").filter(F.col("c_acctbal") > 0).select("c_custkey", "c_acctbal")


@query("filter_range", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice >= 10000 AND l_extendedprice <= 20000 AND l_quantity >= 10 AND l_quantity <= 30
""")
def q_filter_range(spark, d):
    li = table(spark, d, "lineitem")
    li = fl.filter_range(li, "l_extendedprice", 10000, 20000)
    li = fl.filter_range(li, "l_quantity", 10, 30)
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice")


def _clustered_lineitem(spark, d) -> str:
    """The folder of a copy of ``lineitem`` clustered by price, quantity and part."""
    path = f"{ensure_checkpoint_dir(spark)}/lineitem-{uuid.uuid4().hex}"
    write_clustered(table(spark, d, "lineitem"), path, _CLUSTERED, bloom=["l_partkey"])
    return path


@query("clustered_filter_range", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice >= 10000 AND l_extendedprice <= 20000 AND l_quantity >= 10 AND l_quantity <= 30
""")
def q_clustered_filter_range(spark, d):
    li = read_clustered(spark, _clustered_lineitem(spark, d), _CLUSTERED, ranges={"l_extendedprice": (10000, 20000), "l_quantity": (10, 30)})
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("clustered_lookup", """
SELECT * FROM lineitem WHERE l_partkey IN (7, 77, 777, 1500) AND l_quantity >= 5
""")
def q_clustered_lookup(spark, d):
    return read_clustered(spark, _clustered_lineitem(spark, d), _CLUSTERED, ranges={"l_quantity": (5, None)},
                          values={"l_partkey": [7, 77, 777, 1500], "l_returnflag": []})


@query("filter_derived_cap", """
SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price
FROM lineitem WHERE l_quantity > 0 AND l_extendedprice / l_quantity <= 1500
""")
def q_filter_derived_cap(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_quantity") > 0)
    li = li.withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity"))
    return li.filter(F.col("unit_price") <= 1500).select(
        "l_orderkey", "l_linenumber", "unit_price")


@query("dropna_subset", """
SELECT o_orderkey, prio, status FROM (
  SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio, nullif(o_orderstatus, 'P') AS status FROM orders)
WHERE prio IS NOT NULL AND status IS NOT NULL
""")
def q_dropna_subset(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("prio"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return fl.dropna_subset(o, ["prio", "status"])


@query("filter_blank", f"""
SELECT doc_id, n_chars FROM documents WHERE trim(text, {_WS_SQL}) <> ''
""")
def q_filter_blank(spark, d):
    return fl.filter_blank(table(spark, d, "documents"), "text").select("doc_id", "n_chars")


@query("filter_blank_tabs", f"""
SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0
""")
def q_filter_blank_tabs(spark, d):
    """Every third name is tabs and line ends only, every fifth is missing."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lit("\t \r\n"))
                                       .when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"))
    return fl.filter_blank(p, "name").select("p_partkey")


@query("filter_isin", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
""")
def q_filter_isin(spark, d):
    c = table(spark, d, "customer")
    c = fl.filter_isin(c, "c_mktsegment", ["BUILDING", "MACHINERY"])
    c = fl.filter_isin(c, "c_nationkey", [])  # empty selection: no filter
    return c.select("c_custkey", "c_mktsegment")


@query("filter_optional_eq", """
SELECT p_partkey, p_type FROM part WHERE p_type = 'PROMO'
""")
def q_filter_optional_eq(spark, d):
    p = table(spark, d, "part")
    p = fl.filter_optional_eq(p, "p_brand", "All")  # sentinel: no filter
    p = fl.filter_optional_eq(p, "p_type", "PROMO")
    return p.select("p_partkey", "p_type")


@query("filter_rlike", """
SELECT doc_id, lang FROM documents WHERE coalesce(regexp_matches(text, 'licen[cs]e|copyright', 'i'), false)
""")
def q_filter_rlike(spark, d):
    doc = table(spark, d, "documents")
    return fl.filter_rlike_ci(doc, "text", "licen[cs]e|copyright").select("doc_id", "lang")


@query("split_counts", """
SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS flagged_rows,
       count(*) FILTER (WHERE NOT coalesce(l_returnflag = 'R', false)) AS other_rows,
       round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 4) AS flagged_amount
FROM lineitem
""")
def q_split_counts(spark, d):
    # one grouped pass over the flag instead of two filtered scans
    li = table(spark, d, "lineitem")
    is_r = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    return li.agg(F.count_if(is_r).alias("flagged_rows"), F.count_if(~is_r).alias("other_rows"),
                  F.round(F.sum(F.when(is_r, F.col("l_extendedprice"))), 4).alias("flagged_amount"))


@query("missing_key_audit", """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE nullif(o_orderpriority, '5-LOW') IS NULL) AS missing_rows,
       round(count(*) FILTER (WHERE nullif(o_orderpriority, '5-LOW') IS NULL) * 100.0 / count(*), 6) AS missing_pct
FROM orders
""")
def q_missing_key_audit(spark, d):
    o = table(spark, d, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("prio"))
    a = fl.missing_key_audit(o, "prio")
    return a.select("total_rows", "missing_rows", F.round("missing_pct", 6).alias("missing_pct"))
