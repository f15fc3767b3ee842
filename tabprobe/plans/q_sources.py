"""Source queries (S*): audit, preview, sample, timestamp cast; and the
flagship multi-table revenue report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.operators._util import broadcast_if_small
from tabprobe.operators.groups import top_k
from tabprobe.plans.registry import query
from tabprobe.sources.io import DRIVER_TABLES, dataset_audit, preview, sample_n, table

_AUDIT_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS actual_rows FROM {t}" for t in DRIVER_TABLES)


@query("dataset_audit", _AUDIT_SQL)
def q_dataset_audit(spark, d):
    return dataset_audit(spark, d)


@query("preview_topn", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000
""")
def q_preview_topn(spark, d):
    return preview(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 1000)


@query("sample_n", """
SELECT * FROM lineitem ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT 5000
""")
def q_sample_n(spark, d):
    # fixed-size deterministic sample of 5,000 rows (the feature is sampling)
    return sample_n(table(spark, d, "lineitem"), 5000, ["l_orderkey", "l_linenumber"])


@query("cast_timestamp", """
SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts_parsed
FROM events
""")
def q_cast_timestamp(spark, d):
    ev = table(spark, d, "events")
    txt = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return ev.select("event_id", F.to_timestamp(txt, "yyyy-MM-dd HH:mm:ss").alias("ts_parsed"))


def revenue_by_nation(spark, d, k: int = 15):
    """Revenue and distinct orders per customer nation, top ``k``.

    lineitem is pre-aggregated to one row per order before any join (its
    hash partitioning on the order key is reused by the orders join), so the
    distinct-order count becomes a plain count and hot orders collapse map
    side.  customer⋈nation is broadcast only when its row count allows."""
    li = table(spark, d, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    cust_nat = cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    o = orders.join(broadcast_if_small(cust_nat, n_rows=cust.count()), orders.o_custkey == cust_nat.c_custkey)
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey)
    agg = j.groupBy("n_name").agg(F.round(F.sum("revenue"), 4).alias("revenue"),
                                  F.count(F.lit(1)).alias("orders"))
    return top_k(agg, "revenue", k, ["n_name"])


@query("revenue_by_nation", """
WITH per_order AS (
  SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_orderkey)
SELECT n_name, round(sum(revenue), 4) AS revenue, count(*) AS orders
FROM per_order JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 15
""")
def q_revenue_by_nation(spark, d):
    return revenue_by_nation(spark, d)
