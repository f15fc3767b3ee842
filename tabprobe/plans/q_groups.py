"""Aggregation, top-k, reshape and join queries (A*, O*, R*, J1, W6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.operators import groups as gp
from tabprobe.operators import reshape as rs
from tabprobe.operators._util import broadcast_if_small, persist
from tabprobe.plans.registry import query
from tabprobe.sources.io import table

# Order total-price buckets (right-closed); the last level is
# above every price so it is always empty (kept by the all-levels rule).
PRICE_EDGES = [0, 50_000, 100_000, 200_000, 300_000, 400_000, 10_000_000, 20_000_000]
PRICE_LABELS = ["<50k", "50-100k", "100-200k", "200-300k", "300-400k", "400k+", "20M"]
# Display order of months (january and february absent).
MONTH_ORDER = ["03", "04", "05", "06", "07", "08", "09", "10", "11", "12"]


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _is_final():
    return cx.flag(F.col("o_orderstatus") == "F")


@query("kpi_orders", """
SELECT count(*) AS contacts, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS subscriptions,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 9) AS conversion_rate,
  round(avg(o_totalprice), 6) AS mean_totalprice, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers
FROM orders
""")
def q_kpi_orders(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.count(F.lit(1)).alias("contacts"), F.sum(_is_final()).cast("long").alias("subscriptions"),
                 F.round(F.avg(_is_final()), 9).alias("conversion_rate"),
                 F.round(F.avg("o_totalprice"), 6).alias("mean_totalprice"),
                 F.count_distinct("o_custkey").alias("customers"))


@query("kpi_returns", """
SELECT count(*) AS transactions, count(*) FILTER (WHERE l_returnflag = 'R') AS flagged,
  round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 9) AS flagged_rate,
  round(coalesce(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0), 6) AS mean_flagged_amount
FROM lineitem WHERE l_extendedprice <= 50000
""")
def q_kpi_returns(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_extendedprice") <= 50000)
    is_r = F.col("l_returnflag") == "R"
    return li.agg(F.count(F.lit(1)).alias("transactions"), F.count_if(is_r).alias("flagged"),
                  F.round(F.try_divide(F.count_if(is_r), F.count(F.lit(1))), 9).alias("flagged_rate"),
                  F.round(F.coalesce(F.avg(F.when(is_r, F.col("l_extendedprice"))), F.lit(0.0)), 6)
                  .alias("mean_flagged_amount"))


@query("kpi_median", """
SELECT count(*) AS rows, round(avg(l_extendedprice), 6) AS mean_price,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median_price, round(stddev_samp(l_extendedprice), 6) AS std_price
FROM lineitem
""")
def q_kpi_median(spark, d):
    li = table(spark, d, "lineitem")
    k = li.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("l_extendedprice"), 6).alias("mean_price"),
               F.round(F.stddev_samp("l_extendedprice"), 6).alias("std_price"))
    med = gp.quantile_scalar(li, "l_extendedprice", 0.5).select(F.round("q", 6).alias("median_price"))
    return k.select("rows", "mean_price", med.select("median_price").scalar().alias("median_price"), "std_price")


@query("kpi_sales", """
WITH per_order AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS orders, round(sum(rev), 4) AS revenue, round(avg(rev), 6) AS mean_order_value,
  count(DISTINCT o_custkey) AS customers
FROM per_order JOIN orders ON l_orderkey = o_orderkey
""")
def q_kpi_sales(spark, d):
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(_revenue()).alias("rev"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey)
    return j.agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("rev"), 4).alias("revenue"),
                 F.round(F.avg("rev"), 6).alias("mean_order_value"), F.count_distinct("o_custkey").alias("customers"))


@query("rate_by_key", """
SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 9) AS rate, count(*) AS count
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
""")
def q_rate_by_key(spark, d):
    o = table(spark, d, "orders").withColumn("is_final", _is_final())
    r = gp.rate_by_key(o, ["o_orderpriority"], "is_final")
    return r.select("o_orderpriority", F.round("rate", 9).alias("rate"), "count")


_PRICE_CASE = " ".join(
    f"WHEN o_totalprice > {lo} AND o_totalprice <= {hi} THEN '{lab}'"
    for lo, hi, lab in zip(PRICE_EDGES[:-1], PRICE_EDGES[1:], PRICE_LABELS))
_LEVELS_SQL = ", ".join(f"('{lab}', {i})" for i, lab in enumerate(PRICE_LABELS))


@query("rate_by_bucket_all_levels", f"""
WITH b AS (SELECT CASE {_PRICE_CASE} END AS price_bucket,
                  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_final FROM orders),
     agg AS (SELECT price_bucket, avg(is_final) AS rate, count(is_final) AS count FROM b
             WHERE price_bucket IS NOT NULL GROUP BY price_bucket),
     lv(price_bucket, price_bucket_ord) AS (VALUES {_LEVELS_SQL})
SELECT lv.price_bucket, CAST(lv.price_bucket_ord AS INTEGER) AS price_bucket_ord, round(rate, 9) AS rate,
       CAST(coalesce(count, 0) AS BIGINT) AS count
FROM lv LEFT JOIN agg ON lv.price_bucket = agg.price_bucket
""")
def q_rate_by_bucket_all_levels(spark, d):
    o = table(spark, d, "orders").select(cx.cut("o_totalprice", PRICE_EDGES, PRICE_LABELS).alias("price_bucket"),
                                         _is_final().alias("is_final"))
    r = gp.rate_by_levels(o, "price_bucket", PRICE_LABELS, "is_final")
    return r.select("price_bucket", "price_bucket_ord", F.round("rate", 9).alias("rate"), "count")


@query("agg_two_keys", """
SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS mean_price, count(*) AS count,
  round(sum(l_quantity), 4) AS sum_qty
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def q_agg_two_keys(spark, d):
    li = table(spark, d, "lineitem")
    return gp.group_agg(li, ["l_returnflag", "l_linestatus"], F.round(F.avg("l_extendedprice"), 6).alias("mean_price"),
                        F.count(F.lit(1)).alias("count"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"))


_GRID_EDGES = [0, 10, 20, 30, 40, 50, 60]
_GRID_LABELS = ["tiny", "small", "medium", "large", "huge", "giant"]
_GRID_CASE = " ".join(f"WHEN p_size > {lo} AND p_size <= {hi} THEN '{lab}'"
                      for lo, hi, lab in zip(_GRID_EDGES[:-1], _GRID_EDGES[1:], _GRID_LABELS))
_GRID_LV = ", ".join(f"('{lab}', {i})" for i, lab in enumerate(_GRID_LABELS))


@query("agg_grid", f"""
WITH b AS (SELECT p_type, CASE {_GRID_CASE} END AS size_bucket, p_retailprice FROM part),
     agg AS (SELECT p_type, size_bucket, avg(p_retailprice) AS mean_price, count(p_retailprice) AS count
             FROM b WHERE p_type IS NOT NULL AND size_bucket IS NOT NULL GROUP BY p_type, size_bucket),
     lv(size_bucket, size_bucket_ord) AS (VALUES {_GRID_LV}),
     grid AS (SELECT t.p_type, lv.size_bucket, lv.size_bucket_ord FROM (SELECT DISTINCT p_type FROM part
              WHERE p_type IS NOT NULL) t, lv)
SELECT grid.p_type, grid.size_bucket, CAST(grid.size_bucket_ord AS INTEGER) AS size_bucket_ord,
       round(mean_price, 6) AS mean_price, CAST(coalesce(count, 0) AS BIGINT) AS count
FROM grid LEFT JOIN agg ON grid.p_type = agg.p_type AND grid.size_bucket = agg.size_bucket
""")
def q_agg_grid(spark, d):
    p = table(spark, d, "part").select("p_type", cx.cut("p_size", _GRID_EDGES, _GRID_LABELS).alias("size_bucket"),
                                       "p_retailprice")
    r = gp.rate_by_levels(p, "size_bucket", _GRID_LABELS, "p_retailprice", rate_name="mean_price", by=["p_type"])
    return r.select("p_type", "size_bucket", "size_bucket_ord", F.round("mean_price", 6).alias("mean_price"), "count")


@query("agg_median", """
SELECT l_linestatus, round(avg(l_extendedprice), 6) AS mean_price,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median_price, count(l_extendedprice) AS count
FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY l_linestatus
""")
def q_agg_median(spark, d):
    li = table(spark, d, "lineitem")
    m = gp.group_agg(li, ["l_linestatus"], F.avg("l_extendedprice").alias("mean_price"),
                     F.count("l_extendedprice").alias("count"))
    med = gp.median_by(li, ["l_linestatus"], "l_extendedprice")
    return m.join(med, "l_linestatus").select("l_linestatus", F.round("mean_price", 6).alias("mean_price"),
                                              F.round("median", 6).alias("median_price"), "count")


@query("agg_sum_count", """
SELECT p_brand, round(sum(p_retailprice), 4) AS total_price, count(*) AS count
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
""")
def q_agg_sum_count(spark, d):
    p = table(spark, d, "part")
    return gp.group_agg(p, ["p_brand"], F.round(F.sum("p_retailprice"), 4).alias("total_price"),
                        F.count(F.lit(1)).alias("count"))


@query("agg_sum_distinct", """
WITH per_order AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY l_orderkey)
SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(rev), 4) AS revenue, count(*) AS orders
FROM per_order JOIN orders ON l_orderkey = o_orderkey GROUP BY month
""")
def q_agg_sum_distinct(spark, d):
    # distinct orders per month: lineitem pre-aggregated per order, so the
    # distinct count becomes a count of order rows
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(_revenue()).alias("rev"))
    o = table(spark, d, "orders").select("o_orderkey", cx.month_period("o_orderdate").alias("month"))
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey)
    return gp.group_agg(j, ["month"], F.round(F.sum("rev"), 4).alias("revenue"), F.count(F.lit(1)).alias("orders"))


@query("agg_multi_sum", """
SELECT l_returnflag, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_price,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_revenue
FROM lineitem GROUP BY l_returnflag
""")
def q_agg_multi_sum(spark, d):
    li = table(spark, d, "lineitem")
    return gp.group_agg(li, ["l_returnflag"], F.round(F.sum("l_quantity"), 4).alias("sum_qty"),
                        F.round(F.sum("l_extendedprice"), 4).alias("sum_price"),
                        F.round(F.sum(_revenue()), 4).alias("sum_revenue"))


@query("agg_distinct_mean", """
SELECT p_brand, count(DISTINCT p_name) AS titles, round(avg(p_retailprice), 6) AS mean_price
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
""")
def q_agg_distinct_mean(spark, d):
    p = table(spark, d, "part")
    return gp.group_agg(p, ["p_brand"], F.count_distinct("p_name").alias("titles"),
                        F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query("group_size", """
SELECT o_custkey, count(*) AS size, count(nullif(o_orderpriority, '5-LOW')) AS non_null_priority
FROM orders GROUP BY o_custkey
""")
def q_group_size(spark, d):
    o = table(spark, d, "orders")
    return gp.group_agg(o, ["o_custkey"], F.count(F.lit(1)).alias("size"),
                        F.count(F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("non_null_priority"))


@query("agg_of_agg", """
SELECT round(avg(s), 6) AS mean_sum_per_group FROM (
  SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY l_orderkey)
""")
def q_agg_of_agg(spark, d):
    r = gp.nested_mean(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", "sum")
    return r.select(F.round("mean_sum_per_group", 6).alias("mean_sum_per_group"))


@query("entity_rollup", """
WITH li AS (SELECT l_orderkey,
  CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT) AS rev4 FROM lineitem)
SELECT o_custkey, CAST(sum(rev4) AS DOUBLE) / 10000 AS spend, count(DISTINCT o_orderkey) AS orders,
  CAST(sum(rev4) AS DOUBLE) / count(*) / 10000 AS mean_line_value
FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey
""")
def q_entity_rollup(spark, d):
    # money in exact fixed point (1e-4 units): sums are exact, so the result
    # does not depend on the summation order of the partitions
    rev4 = (F.round(F.col("l_extendedprice") * 100).cast("long")
            * F.round((1 - F.col("l_discount")) * 100).cast("long"))
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(rev4).alias("rev4"), F.count(F.lit(1)).alias("lines"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey)
    g = gp.group_agg(j, ["o_custkey"], F.sum("rev4").alias("rev4"), F.count(F.lit(1)).alias("orders"),
                     F.sum("lines").alias("lines"))
    return g.select("o_custkey", (F.col("rev4").cast("double") / 10000).alias("spend"), "orders",
                    (F.col("rev4").cast("double") / F.col("lines") / 10000).alias("mean_line_value"))


@query("span_by_key", """
SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, min(ts) AS first, max(ts) AS last
FROM events WHERE event_type IS NOT NULL GROUP BY event_type
""")
def q_span_by_key(spark, d):
    return gp.span_by_key(table(spark, d, "events"), "event_type", "ts")


@query("value_counts", """
SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY event_type
""")
def q_value_counts(spark, d):
    return gp.value_counts(table(spark, d, "events"), "event_type")


@query("p95", """
SELECT count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.95), 6) AS q FROM orders
""")
def q_p95(spark, d):
    r = gp.quantile_scalar(table(spark, d, "orders"), "o_totalprice", 0.95)
    return r.select("n", F.round("q", 6).alias("q"))


@query("distinct_values", """
SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL
""")
def q_distinct_values(spark, d):
    return gp.distinct_values(table(spark, d, "customer"), "c_mktsegment")


@query("distinct_tokens", """
SELECT DISTINCT trim(tok) AS token FROM (SELECT unnest(string_split(p_name, ' ')) AS tok FROM part)
WHERE trim(tok) <> ''
""")
def q_distinct_tokens(spark, d):
    return gp.distinct_tokens(table(spark, d, "part"), "p_name", sep=" ")


@query("rate_of_counts", """
SELECT round(count(*) FILTER (WHERE l_returnflag = 'R') * 100.0 / count(*), 9) AS flagged_pct FROM lineitem
""")
def q_rate_of_counts(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(F.round(F.try_divide(F.count_if(F.col("l_returnflag") == "R") * 100.0, F.count(F.lit(1))), 9)
                  .alias("flagged_pct"))


@query("topk_products", """
SELECT l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_quantity), 4) AS quantity
FROM lineitem GROUP BY l_partkey ORDER BY revenue DESC, l_partkey LIMIT 20
""")
def q_topk_products(spark, d):
    li = table(spark, d, "lineitem")
    g = gp.group_agg(li, ["l_partkey"], F.round(F.sum(_revenue()), 4).alias("revenue"),
                     F.round(F.sum("l_quantity"), 4).alias("quantity"))
    return gp.top_k(g, "revenue", 20, ["l_partkey"])


@query("topk_customers", """
SELECT o_custkey, round(sum(o_totalprice), 4) AS spend FROM orders
GROUP BY o_custkey ORDER BY spend DESC, o_custkey LIMIT 10
""")
def q_topk_customers(spark, d):
    g = gp.group_agg(table(spark, d, "orders"), ["o_custkey"], F.round(F.sum("o_totalprice"), 4).alias("spend"))
    return gp.top_k(g, "spend", 10, ["o_custkey"])


@query("topk_returns_by_nation", """
SELECT n_name, count(*) AS returned_lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R'
GROUP BY n_name ORDER BY returned_lines DESC, n_name LIMIT 10
""")
def q_topk_returns_by_nation(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R").select("l_suppkey")
    # pre-aggregate per supplier before joining the dimension tables
    per_supp = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, d, "nation").select("n_nationkey", "n_name")
    j = (per_supp.join(broadcast_if_small(sup), per_supp.l_suppkey == sup.s_suppkey)
         .join(F.broadcast(nat), F.col("s_nationkey") == nat.n_nationkey))
    g = gp.group_agg(j, ["n_name"], F.sum("n").alias("returned_lines"))
    return gp.top_k(g, "returned_lines", 10, ["n_name"])


_MONTH_LIST = ", ".join(f"'{m}'" for m in MONTH_ORDER)


@query("ordered_category", f"""
SELECT strftime(o_orderdate, '%m') AS month, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 9) AS rate,
  count(*) AS contacts,
  CAST(CASE WHEN list_position([{_MONTH_LIST}], strftime(o_orderdate, '%m')) > 0
       THEN list_position([{_MONTH_LIST}], strftime(o_orderdate, '%m')) - 1 END AS INTEGER) AS month_ord
FROM orders GROUP BY month
""")
def q_ordered_category(spark, d):
    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "MM").alias("month"), _is_final().alias("f"))
    g = gp.group_agg(o, ["month"], F.round(F.avg("f"), 9).alias("rate"), F.count(F.lit(1)).alias("contacts"))
    return gp.sort_by_levels(g, "month", MONTH_ORDER)


@query("unpivot_sum", """
SELECT variable, round(sum(value), 4) AS total, count(value) AS count FROM (
  UNPIVOT (SELECT l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_extendedprice, l_discount, l_tax INTO NAME variable VALUE value)
GROUP BY variable
""")
def q_unpivot_sum(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice", "l_discount", "l_tax")
    long = rs.melt(li, var_name="variable", value_name="value")
    return gp.group_agg(long, ["variable"], F.round(F.sum("value"), 4).alias("total"),
                        F.count("value").alias("count"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_PIVOT_SQL = ",\n  ".join(f"round(sum(c_acctbal) FILTER (WHERE c_mktsegment = '{s}'), 4) AS \"{s}\"" for s in _SEGMENTS)


@query("pivot_sum", f"""
SELECT r_name, {_PIVOT_SQL}
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
""")
def q_pivot_sum(spark, d):
    c = table(spark, d, "customer")
    nat = table(spark, d, "nation")
    reg = table(spark, d, "region")
    j = (c.join(F.broadcast(nat), c.c_nationkey == nat.n_nationkey)
         .join(F.broadcast(reg), nat.n_regionkey == reg.r_regionkey))
    p = rs.pivot_table(j, ["r_name"], "c_mktsegment", "c_acctbal", levels=_SEGMENTS, aggfunc="sum")
    return p.select("r_name", *[F.round(F.col(s), 4).alias(s) for s in _SEGMENTS])


@query("explode_tokens", """
SELECT token, count(*) AS count FROM (SELECT trim(unnest(string_split_regex(p_name, ',\\s*|\\s+'))) AS token FROM part)
WHERE token IS NOT NULL GROUP BY token
""")
def q_explode_tokens(spark, d):
    t = rs.explode_tokens(table(spark, d, "part"), "p_name", pattern=r",\s*|\s+")
    return gp.group_agg(t, ["token"], F.count(F.lit(1)).alias("count"))


@query("join_group_count", """
WITH c AS (SELECT l_suppkey AS k, count(*) AS supp_lines FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey)
SELECT l_orderkey, l_linenumber, l_suppkey, supp_lines FROM lineitem LEFT JOIN c ON l_suppkey = c.k
""")
def q_join_group_count(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    counts = gp.group_agg(li, ["l_suppkey"], F.count(F.lit(1)).alias("supp_lines"))
    # written once, so that the join sees its true size: AQE broadcasts it if small and else splits hot suppliers
    return li.join(persist(counts), "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", "supp_lines")


@query("share_of_total", """
SELECT l_linenumber, count(*) AS lines, round(avg(l_extendedprice), 6) AS mean_price,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS share
FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY l_linenumber
""")
def q_share_of_total(spark, d):
    li = table(spark, d, "lineitem")
    g = gp.group_agg(li, ["l_linenumber"], F.count(F.lit(1)).alias("lines"),
                     F.round(F.avg("l_extendedprice"), 6).alias("mean_price"))
    s = gp.share_of_total(g, "lines", "share", 100.0)
    return s.select("l_linenumber", "lines", "mean_price", F.round("share", 9).alias("share"))
