"""Derived-column queries (E*) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.plans.q_filters import _WS_SQL, WHITESPACE
from tabprobe.plans.registry import query
from tabprobe.sources.io import table

# Order-priority recode used by the recode queries.
PRIORITY_RANK = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}
# Part-size buckets (right-closed) and their labels.
SIZE_EDGES = [0, 10, 20, 30, 40, 50]
SIZE_LABELS = ["tiny", "small", "medium", "large", "huge"]


@query("flag_columns", """
SELECT o_orderkey,
       CAST(coalesce(o_orderstatus = 'F', false) AS INTEGER) AS is_final,
       CAST(coalesce(nullif(o_orderpriority, '1-URGENT') LIKE '%HIGH%', false) AS INTEGER) AS is_high
FROM orders
""")
def q_flag_columns(spark, d):
    o = table(spark, d, "orders")
    prio = F.nullif("o_orderpriority", F.lit("1-URGENT"))
    return o.select("o_orderkey", cx.flag(F.col("o_orderstatus") == "F").alias("is_final"),
                    cx.flag(prio.like("%HIGH%")).alias("is_high"))


@query("recode_map", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
  WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS prio_rank
FROM orders
""")
def q_recode_map(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", cx.recode("o_orderpriority", PRIORITY_RANK).alias("prio_rank"))


@query("recode_default", """
SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'BUILDING' THEN 'construction'
  WHEN 'MACHINERY' THEN 'industry' END, 'Other') AS sector
FROM customer
""")
def q_recode_default(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", cx.recode("c_mktsegment", {"BUILDING": "construction", "MACHINERY": "industry"},
                                           default="Other").alias("sector"))


@query("fillna_const", """
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'Unknown') AS priority FROM orders
""")
def q_fillna_const(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return o.fillna("Unknown", ["priority"])


@query("bin_labelled", """
SELECT p_partkey,
  CASE WHEN p_size > 0 AND p_size <= 10 THEN 'tiny' WHEN p_size > 10 AND p_size <= 20 THEN 'small'
       WHEN p_size > 20 AND p_size <= 30 THEN 'medium' WHEN p_size > 30 AND p_size <= 40 THEN 'large'
       WHEN p_size > 40 AND p_size <= 50 THEN 'huge' END AS size_bucket,
  CASE WHEN p_size > 0 AND p_size <= 10 THEN 0 WHEN p_size > 10 AND p_size <= 20 THEN 1
       WHEN p_size > 20 AND p_size <= 30 THEN 2 WHEN p_size > 30 AND p_size <= 40 THEN 3
       WHEN p_size > 40 AND p_size <= 50 THEN 4 END AS size_bucket_ord
FROM part
""")
def q_bin_labelled(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", cx.cut("p_size", SIZE_EDGES, SIZE_LABELS).alias("size_bucket"),
                    cx.cut_ordinal("p_size", SIZE_EDGES).alias("size_bucket_ord"))


@query("bin_regular", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity > 0 AND l_quantity <= 5 THEN '(0, 5]' WHEN l_quantity > 5 AND l_quantity <= 10 THEN '(5, 10]'
       WHEN l_quantity > 10 AND l_quantity <= 15 THEN '(10, 15]' WHEN l_quantity > 15 AND l_quantity <= 20 THEN '(15, 20]'
       WHEN l_quantity > 20 AND l_quantity <= 25 THEN '(20, 25]' WHEN l_quantity > 25 AND l_quantity <= 30 THEN '(25, 30]'
       WHEN l_quantity > 30 AND l_quantity <= 35 THEN '(30, 35]' WHEN l_quantity > 35 AND l_quantity <= 40 THEN '(35, 40]'
  END AS qty_bin
FROM lineitem
""")
def q_bin_regular(spark, d):
    li = table(spark, d, "lineitem")
    edges = cx.regular_edges(0, 45, 5)
    return li.select("l_orderkey", "l_linenumber", cx.cut("l_quantity", edges).alias("qty_bin"))


@query("ratio_columns", """
SELECT l_orderkey, l_linenumber,
  l_extendedprice / (l_quantity + 1) AS price_per_qty1,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS tax_to_discount
FROM lineitem
""")
def q_ratio_columns(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     cx.ratio("l_extendedprice", "l_quantity", 1.0).alias("price_per_qty1"),
                     cx.ratio("l_tax", "l_discount").alias("tax_to_discount"))


@query("product_diff", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue,
  CAST(2026 - year(l_shipdate) AS INTEGER) AS age_years
FROM lineitem
""")
def q_product_diff(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"),
                     cx.years_since(F.year("l_shipdate"), 2026).alias("age_years"))


@query("log1p_guarded", """
SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) ELSE 0 END, 9) AS log_acctbal
FROM customer
""")
def q_log1p_guarded(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.round(cx.log1p_guarded("c_acctbal"), 9).alias("log_acctbal"))


@query("concat_key", """
SELECT o_orderkey, o_orderstatus || '_' || coalesce(nullif(o_orderpriority, '5-LOW'), 'nan') AS status_priority
FROM orders
""")
def q_concat_key(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", cx.concat_key("o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")))
                    .alias("status_priority"))


@query("date_parts", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  CAST(day(ts) AS INTEGER) AS day, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month
FROM events
""")
def q_date_parts(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", *cx.date_parts("ts"))


@query("month_period", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders
""")
def q_month_period(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", cx.month_period("o_orderdate").alias("month"))


@query("duration_minutes", """
SELECT l_orderkey, l_linenumber,
  round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60000000.0, 6) AS ship_delay_min
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def q_duration_minutes(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber",
                    F.round(cx.duration_minutes("o_orderdate", "l_shipdate"), 6).alias("ship_delay_min"))


@query("hour_of_day", """
SELECT event_id,
  round(((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 3600.0) % 24, 6) AS hour_frac,
  CAST(floor(((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 3600.0) % 24) AS INTEGER) AS hour_whole
FROM events
""")
def q_hour_of_day(spark, d):
    ev = table(spark, d, "events")
    secs = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    return ev.select("event_id", F.round(cx.hour_of_day(secs), 6).alias("hour_frac"),
                     cx.hour_of_day(secs, whole=True).alias("hour_whole"))


@query("decade_label", """
SELECT o_orderkey, CAST(CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT) AS VARCHAR) || 's' AS decade FROM orders
""")
def q_decade_label(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", cx.decade_label(F.year("o_orderdate")).alias("decade"))


def _price_text(p):
    k = F.col("p_partkey") % 6
    return (F.when(k == 0, F.lit("Free")).when(k == 1, F.lit(" Free to Play "))
            .when(k == 2, F.element_at(F.array(F.lit("tbd"), F.lit("12d"), F.lit("$5f")), F.col("p_partkey").cast("int") % 3 + 1))
            .when(k == 3, F.concat(F.lit("$1,"), (F.col("p_partkey") % 900 + 100).cast("string")))
            .otherwise(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"))))


_PRICE_TEXT_SQL = """CASE p_partkey % 6 WHEN 0 THEN 'Free' WHEN 1 THEN ' Free to Play ' WHEN 2 THEN CASE p_partkey % 3 WHEN 0 THEN 'tbd' WHEN 1 THEN '12d' ELSE '$5f' END
  WHEN 3 THEN '$1,' || CAST(p_partkey % 900 + 100 AS VARCHAR) ELSE '$' || CAST(p_retailprice AS VARCHAR) END"""


@query("clean_money_text", f"""
SELECT p_partkey, CASE WHEN lower(trim(t)) IN ('free', 'free to play', 'play for free!') THEN 0.0
  ELSE TRY_CAST(replace(replace(lower(trim(t)), '$', ''), ',', '') AS DOUBLE) END AS price
FROM (SELECT p_partkey, {_PRICE_TEXT_SQL} AS t FROM part)
""")
def q_clean_money_text(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", cx.clean_money_text(_price_text(p)).alias("price"))


def _date_text():
    k = F.col("o_orderkey") % 6
    t = F.col("o_orderdate")
    return (F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy/M/d"))
            .when(k == 2, F.date_format(t, "d MMM, yyyy")).when(k == 3, F.date_format(t, "MMM d, yyyy"))
            .when(k == 4, F.date_format(t, "yyyy")).otherwise(F.lit("Coming soon")))


@query("clean_date_text", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS release_year
FROM orders
""")
def q_clean_date_text(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", cx.clean_date_text_year(_date_text()).alias("release_year"))


@query("clean_leading_int", """
SELECT l_orderkey, l_linenumber,
  CAST(CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 1000 WHEN l_linenumber = 3 THEN 99999999999
       ELSE l_quantity END AS BIGINT) AS achievements
FROM lineitem
""")
def q_clean_leading_int(spark, d):
    li = table(spark, d, "lineitem")
    txt = (F.when(F.col("l_linenumber") == 1, F.lit("no achievements"))
           .when(F.col("l_linenumber") == 2, F.lit("1_000 achievements"))
           .when(F.col("l_linenumber") == 3, F.lit("99999999999 x"))
           .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" achievements"))))
    return li.select("l_orderkey", "l_linenumber", cx.clean_leading_int(txt).alias("achievements"))


@query("text_normalise", f"""
SELECT p_partkey, lower(trim(p_name, {_WS_SQL})) AS name_norm, replace(p_brand, 'Brand#', '') AS brand_no
FROM part
""")
def q_text_normalise(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.lower(F.trim("p_name", F.lit(WHITESPACE))).alias("name_norm"),
                    F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand_no"))


@query("rate_label", """
SELECT o_orderpriority, printf('%.1f%%', avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 100) AS rate_label
FROM orders GROUP BY o_orderpriority
""")
def q_rate_label(spark, d):
    o = table(spark, d, "orders")
    g = o.groupBy("o_orderpriority").agg(F.avg(cx.flag(F.col("o_orderstatus") == "F")).alias("rate"))
    return g.select("o_orderpriority", cx.percent_label("rate").alias("rate_label"))
