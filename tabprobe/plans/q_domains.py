"""Domain-page result tables run on the driver tables (D*).

Each ``*_view`` maps driver columns onto a domain schema (derived by Spark
from the driver tables, so the work grows with them) and the registered
query runs the domain pipeline itself.  The oracle SQL builds the same
view in DuckDB and computes the page's table independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.plans.domains import (bank_marketing, bank_stocks, card_fraud, game_catalogue, loan_default,
                                    medical_cost, online_retail, taxi_trips, video_game_sales)
from tabprobe.plans.q_columns import _PRICE_TEXT_SQL, _price_text
from tabprobe.plans.registry import query
from tabprobe.sources.io import table


def _round(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


# ── online retail ← lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part ─────────

def retail_view(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey))
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int")
    return j.select(
        F.col("o_orderkey").cast("string").alias("InvoiceNo"), F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"), qty.alias("Quantity"),
        F.col("o_orderdate").cast("timestamp").alias("InvoiceDate"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitPrice"),
        F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("CustomerID"),
        F.col("n_name").alias("Country"))


_RETAIL_SQL = """retail AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS InvoiceNo, p_name AS Description,
    CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS INTEGER) AS Quantity,
    o_orderdate AS InvoiceDate, l_extendedprice / l_quantity AS UnitPrice,
    CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS CustomerID, n_name AS Country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
sales AS (SELECT * FROM retail WHERE NOT coalesce(Quantity < 0, false)),
clean AS (SELECT *, Quantity * UnitPrice AS Revenue, strftime(InvoiceDate, '%Y-%m') AS Month FROM sales
  WHERE CustomerID IS NOT NULL AND Description IS NOT NULL AND trim(Description) <> ''
    AND UnitPrice > 0 AND UnitPrice < 10000)"""


def _retail(spark, d):
    canc, sales = online_retail.split_cancellations(retail_view(spark, d))
    clean = online_retail.features(online_retail.clean(sales))
    return canc, sales, clean


@query("retail_revenue_by_country", f"""
WITH {_RETAIL_SQL}
SELECT Country, round(sum(Revenue), 2) AS revenue, count(DISTINCT InvoiceNo) AS orders FROM clean
GROUP BY Country ORDER BY sum(Revenue) DESC, Country LIMIT 15
""")
def q_retail_revenue_by_country(spark, d):
    _, _, clean = _retail(spark, d)
    return _round(online_retail.revenue_by(clean, "Country", 15), {"revenue": 2})


@query("retail_top_products", f"""
WITH {_RETAIL_SQL}
SELECT Description, round(sum(Revenue), 2) AS revenue, CAST(sum(Quantity) AS BIGINT) AS qty FROM clean
GROUP BY Description ORDER BY sum(Revenue) DESC, Description LIMIT 20
""")
def q_retail_top_products(spark, d):
    canc, sales, clean = _retail(spark, d)
    r = online_retail.results(clean, canc, sales)["top_products"]
    return _round(r, {"revenue": 2})


@query("retail_monthly", f"""
WITH {_RETAIL_SQL}
SELECT Month, round(sum(Revenue), 2) AS revenue, count(DISTINCT InvoiceNo) AS orders FROM clean GROUP BY Month
""")
def q_retail_monthly(spark, d):
    _, _, clean = _retail(spark, d)
    return _round(online_retail.revenue_by(clean, "Month"), {"revenue": 2})


@query("retail_cancellations_by_country", f"""
WITH {_RETAIL_SQL}
SELECT Country, count(*) AS cancellations FROM retail WHERE Quantity < 0 AND Country IS NOT NULL
GROUP BY Country ORDER BY cancellations DESC, Country LIMIT 10
""")
def q_retail_cancellations_by_country(spark, d):
    canc, sales, clean = _retail(spark, d)
    return online_retail.results(clean, canc, sales)["cancellations_by_country"]


@query("retail_kpis", f"""
WITH {_RETAIL_SQL}
SELECT count(DISTINCT InvoiceNo) AS orders, round(sum(Revenue), 2) AS revenue,
  count(DISTINCT CustomerID) AS customers,
  round((SELECT avg(r) FROM (SELECT sum(Revenue) AS r FROM clean GROUP BY InvoiceNo)), 6) AS mean_order_value,
  (SELECT count(*) FILTER (WHERE Quantity < 0) * 1.0 / count(*) FROM retail)::DOUBLE AS cancellation_rate
FROM clean
""")
def q_retail_kpis(spark, d):
    canc, sales, clean = _retail(spark, d)
    res = online_retail.results(clean, canc, sales)
    k = res["kpis"]
    rate = res["cancellation_rate"].select("cancellation_rate").scalar()
    return k.select("orders", F.round("revenue", 2).alias("revenue"), "customers",
                    F.round("mean_order_value", 6).alias("mean_order_value"), rate.alias("cancellation_rate"))


@query("retail_missing_customer", f"""
WITH {_RETAIL_SQL}
SELECT count(*) AS total_rows, count(*) FILTER (WHERE CustomerID IS NULL) AS missing_rows,
  round(count(*) FILTER (WHERE CustomerID IS NULL) * 100.0 / count(*), 6)::DOUBLE AS missing_pct FROM sales
""")
def q_retail_missing_customer(spark, d):
    canc, sales, clean = _retail(spark, d)
    r = online_retail.results(clean, canc, sales)["missing_customer"]
    return _round(r, {"missing_pct": 6})


# ── bank stocks ← events (daily OHLC-like values per event type) ─────────

def stocks_view(spark, d) -> DataFrame:
    ev = table(spark, d, "events").filter(F.col("event_type").isNotNull())
    g = ev.groupBy(F.to_date("ts").cast("timestamp").alias("Date"), F.col("event_type").alias("Ticker")).agg(
        F.min("value").alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"),
        F.sum("value").alias("Close"), F.count(F.lit(1)).alias("Volume"))
    return g.select("Date", "Ticker", "Open", "High", "Low", "Close", "Volume")


_STOCKS_SQL = """stocks AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS Date, event_type AS Ticker, min(value) AS Open,
  max(value) AS High, min(value) AS Low, sum(value) AS Close, count(*) AS Volume FROM events
  WHERE event_type IS NOT NULL GROUP BY ALL)"""


@query("stocks_trading_days", f"""
WITH {_STOCKS_SQL}
SELECT Ticker, count(DISTINCT CAST(Date AS DATE)) AS days, min(Date) AS first, max(Date) AS last FROM stocks
GROUP BY Ticker
""")
def q_stocks_trading_days(spark, d):
    feat = bank_stocks.features(bank_stocks.clean(stocks_view(spark, d)))
    return bank_stocks.results(feat, ["click", "error"])["trading_days"]


@query("stocks_mean_volume", f"""
WITH {_STOCKS_SQL}
SELECT Ticker, avg(Volume) AS avg_volume FROM stocks GROUP BY Ticker
""")
def q_stocks_mean_volume(spark, d):
    feat = bank_stocks.features(bank_stocks.clean(stocks_view(spark, d)))
    return bank_stocks.results(feat, ["click", "error"])["mean_volume"]


@query("stocks_period_return", f"""
WITH {_STOCKS_SQL}
SELECT Ticker, round(arg_max(Close, Date), 6) AS last_value,
  round(arg_min(Close, Date) FILTER (WHERE Date >= (SELECT max(Date) - INTERVAL 10 DAY FROM stocks)), 6)
    AS first_in_period,
  round(arg_max(Close, Date) / arg_min(Close, Date) FILTER (WHERE Date >= (SELECT max(Date) - INTERVAL 10 DAY
    FROM stocks)) - 1, 9) AS period_return
FROM stocks GROUP BY Ticker
""")
def q_stocks_period_return(spark, d):
    feat = bank_stocks.features(bank_stocks.clean(stocks_view(spark, d)))
    r = bank_stocks.results(feat, ["click", "error"], days=10)["period_return"]
    return _round(r, {"last_value": 6, "first_in_period": 6, "period_return": 9})


# ── card fraud ← lineitem (returned lines as the positive class) ─────────

def fraud_view(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    secs = (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.lit(788918400)
            + F.col("l_linenumber") * 3600 + F.col("l_orderkey") % 3600)
    comps = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber").cast("double")]
    cols = [secs.cast("double").alias("Time")]
    cols += [(comps[i - 1] if i <= 4 else F.lit(None).cast("double")).alias(f"V{i}") for i in range(1, 29)]
    cols += [(F.col("l_extendedprice") / 10).alias("Amount"),
             F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("Class")]
    return li.select(*cols)


_FRAUD_SQL = """fraud AS (SELECT CAST(epoch(l_shipdate) - 788918400 + l_linenumber * 3600 + l_orderkey % 3600 AS DOUBLE)
  AS Time, l_extendedprice / 10 AS Amount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS Class,
  l_quantity AS V1, l_discount AS V2, l_tax AS V3, CAST(l_linenumber AS DOUBLE) AS V4 FROM lineitem),
f AS (SELECT * FROM fraud WHERE Amount <= 5000)"""


@query("fraud_kpis", f"""
WITH {_FRAUD_SQL}
SELECT count(*) AS transactions, count(*) FILTER (WHERE Class = 1) AS fraud_cases,
  round(count(*) FILTER (WHERE Class = 1) / count(*), 9) AS fraud_rate,
  round(coalesce(avg(Amount) FILTER (WHERE Class = 1), 0), 6) AS mean_fraud_amount FROM f
""")
def q_fraud_kpis(spark, d):
    df = card_fraud.apply_filters(card_fraud.features(fraud_view(spark, d)))
    return _round(card_fraud.kpis(df), {"fraud_rate": 9, "mean_fraud_amount": 6})


@query("fraud_rate_by_hour", f"""
WITH {_FRAUD_SQL}
SELECT CAST(floor((Time / 3600.0) % 24) AS INTEGER) AS hour, round(avg(Class), 9) AS fraud_rate,
  count(Class) AS transactions FROM f GROUP BY hour
""")
def q_fraud_rate_by_hour(spark, d):
    df = card_fraud.apply_filters(card_fraud.features(fraud_view(spark, d)))
    r = card_fraud.results(df, components=4)["fraud_rate_by_hour"]
    return _round(r, {"fraud_rate": 9})


# ── bank marketing ← orders ───────────────────────────────────────────────

def bank_view(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        (F.lit(18) + F.col("o_custkey") % 90).cast("int").alias("age"), F.col("o_orderpriority").alias("job"),
        F.lower(F.date_format("o_orderdate", "MMM")).alias("month"),
        (F.col("o_totalprice") / 1000).cast("int").alias("duration"),
        (F.lit(1) + F.col("o_orderkey") % 10).cast("int").alias("campaign"),
        F.lit(999).alias("pdays"), (F.col("o_orderkey") % 3).cast("int").alias("previous"),
        ((F.col("o_orderkey") % 50) / 10 - 2.5).alias("emp.var.rate"),
        (F.lit(92.0) + (F.col("o_custkey") % 300) / 100).alias("cons.price.idx"),
        (F.lit(-50.0) + (F.col("o_orderkey") % 250) / 10).alias("cons.conf.idx"),
        ((F.col("o_totalprice") % 500) / 100).alias("euribor3m"),
        (F.lit(4900.0) + F.col("o_custkey") % 300).alias("nr.employed"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("y"))


_BANK_SQL = """bank AS (SELECT CAST(18 + o_custkey % 90 AS INTEGER) AS age, o_orderpriority AS job,
  lower(strftime(o_orderdate, '%b')) AS month, CAST(trunc(o_totalprice / 1000) AS INTEGER) AS duration,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_binary, (o_totalprice % 500) / 100 AS euribor3m,
  92.0 + (o_custkey % 300) / 100 AS cons_price FROM orders),
b AS (SELECT *, CASE WHEN age > 0 AND age <= 25 THEN '<25' WHEN age > 25 AND age <= 35 THEN '25-34'
  WHEN age > 35 AND age <= 45 THEN '35-44' WHEN age > 45 AND age <= 55 THEN '45-54'
  WHEN age > 55 AND age <= 65 THEN '55-64' WHEN age > 65 AND age <= 100 THEN '65+' END AS age_group
  FROM bank WHERE duration > 0)"""
_AGE_LV = (
    "('<25', 0), ('25-34', 1), ('35-44', 2), ('45-54', 3), ('55-64', 4), ('65+', 5)")


def _bank(spark, d):
    return bank_marketing.features(bank_marketing.clean(bank_view(spark, d)))


@query("bank_conversion_by_job", f"""
WITH {_BANK_SQL}
SELECT job, round(avg(y_binary), 9) AS rate, count(y_binary) AS count FROM b WHERE job IS NOT NULL GROUP BY job
""")
def q_bank_conversion_by_job(spark, d):
    return _round(bank_marketing.results(_bank(spark, d))["by_job"], {"rate": 9})


@query("bank_conversion_by_age_group", f"""
WITH {_BANK_SQL}, lv(age_group, age_group_ord) AS (VALUES {_AGE_LV}),
agg AS (SELECT age_group, avg(y_binary) AS rate, count(y_binary) AS count FROM b WHERE age_group IS NOT NULL
        GROUP BY age_group)
SELECT lv.age_group, CAST(age_group_ord AS INTEGER) AS age_group_ord, round(rate, 9) AS rate,
  CAST(coalesce(count, 0) AS BIGINT) AS count FROM lv LEFT JOIN agg USING (age_group)
""")
def q_bank_conversion_by_age_group(spark, d):
    return _round(bank_marketing.results(_bank(spark, d))["by_age_group"], {"rate": 9})


@query("bank_conversion_by_month", f"""
WITH {_BANK_SQL}
SELECT month, round(avg(y_binary), 9) AS rate, count(y_binary) AS contacts,
  CAST(list_position({bank_marketing.MONTH_ORDER!r}, month) - 1 AS INTEGER) AS month_ord
FROM b WHERE month IS NOT NULL GROUP BY month
""")
def q_bank_conversion_by_month(spark, d):
    return _round(bank_marketing.results(_bank(spark, d))["by_month"], {"rate": 9})


# ── medical cost ← customer ⋈ nation ⋈ region ────────────────────────────

def medical_view(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.select(
        (F.lit(18) + F.col("c_custkey") % 50).cast("int").alias("age"),
        F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male").alias("sex"),
        (F.lit(15.0) + (F.col("c_acctbal") + 1000) / 250).alias("bmi"),
        (F.col("c_custkey") % 4).cast("int").alias("children"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "yes").otherwise("no").alias("smoker"),
        F.col("r_name").alias("region"), (F.col("c_acctbal") + 1000).alias("charges"))


_MED_SQL = """med AS (SELECT CAST(18 + c_custkey % 50 AS INTEGER) AS age, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex,
  CASE WHEN c_custkey % 4 > 0 THEN 1 ELSE 0 END AS has_children, 15.0 + (c_acctbal + 1000) / 250 AS bmi,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'yes' ELSE 'no' END AS smoker, r_name AS region,
  c_acctbal + 1000 AS charges
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT *, CASE WHEN bmi > 0 AND bmi <= 18.5 THEN 'Underweight' WHEN bmi > 18.5 AND bmi <= 25 THEN 'Normal'
  WHEN bmi > 25 AND bmi <= 30 THEN 'Overweight' WHEN bmi > 30 AND bmi <= 60 THEN 'Obese' END AS bmi_category
  FROM med WHERE charges > 0)"""
_BMI_LV = (
    "('Underweight', 0), ('Normal', 1), ('Overweight', 2), ('Obese', 3)")


def _medical(spark, d):
    return medical_cost.features(medical_cost.clean(medical_view(spark, d)))


@query("medical_bmi_x_smoker", f"""
WITH {_MED_SQL}, lv(bmi_category, bmi_category_ord) AS (VALUES {_BMI_LV}),
agg AS (SELECT smoker, bmi_category, avg(charges) AS cost, count(charges) AS count FROM m
        WHERE bmi_category IS NOT NULL AND smoker IS NOT NULL GROUP BY ALL),
grid AS (SELECT s.smoker, lv.* FROM (SELECT DISTINCT smoker FROM m WHERE smoker IS NOT NULL) s, lv)
SELECT grid.smoker, grid.bmi_category, CAST(bmi_category_ord AS INTEGER) AS bmi_category_ord,
  round(cost, 6) AS cost, CAST(coalesce(count, 0) AS BIGINT) AS count
FROM grid LEFT JOIN agg ON grid.smoker = agg.smoker AND grid.bmi_category = agg.bmi_category
""")
def q_medical_bmi_x_smoker(spark, d):
    return _round(medical_cost.results(_medical(spark, d))["bmi_x_smoker"], {"cost": 6})


@query("medical_by_smoker", f"""
WITH {_MED_SQL}
SELECT smoker, round(avg(charges), 6) AS avg_charge, count(charges) AS count,
  round(quantile_cont(charges, 0.5), 6) AS median FROM m GROUP BY smoker
""")
def q_medical_by_smoker(spark, d):
    return _round(medical_cost.results(_medical(spark, d))["by_smoker"], {"avg_charge": 6, "median": 6})


@query("medical_region_x_smoker", f"""
WITH {_MED_SQL}
SELECT region, smoker, round(avg(charges), 6) AS avg_charge, count(charges) AS count FROM m GROUP BY ALL
""")
def q_medical_region_x_smoker(spark, d):
    return _round(medical_cost.results(_medical(spark, d))["region_x_smoker"], {"avg_charge": 6})


# ── taxi trips ← orders ⋈ lineitem ───────────────────────────────────────

def taxi_view(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    pick = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
    drop = pick + F.make_interval(mins=(F.col("l_quantity") * 3).cast("int"))
    fare = F.col("l_extendedprice") / 1000
    tip = fare * F.col("l_tax") * 10
    return j.select(pick.alias("tpep_pickup_datetime"), drop.alias("tpep_dropoff_datetime"),
                    F.col("l_linenumber").cast("double").alias("passenger_count"),
                    (F.col("l_quantity") / 5).alias("trip_distance"),
                    (F.col("l_orderkey") % 7).cast("int").alias("payment_type"),
                    fare.alias("fare_amount"), tip.alias("tip_amount"), (fare + tip).alias("total_amount"))


_TAXI_SQL = """taxi AS (SELECT o_orderdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS pick,
  CAST(l_quantity * 3 AS INTEGER) AS mins, CAST(l_linenumber AS DOUBLE) AS pax, l_quantity / 5 AS dist,
  CAST(l_orderkey % 7 AS INTEGER) AS pay, l_extendedprice / 1000 AS fare,
  l_extendedprice / 1000 * l_tax * 10 AS tip
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT *, tip / fare * 100 AS tip_pct, mins * 1.0 AS dur FROM taxi
  WHERE fare > 0 AND dist > 0 AND pax > 0 AND fare + tip > 0),
t2 AS (SELECT *, hour(pick) AS hour, CASE WHEN tip > 0 THEN 1 ELSE 0 END AS tipped,
  coalesce(CASE pay WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Cash' WHEN 3 THEN 'No Charge' WHEN 4 THEN 'Dispute'
  WHEN 5 THEN 'Unknown' END, 'Other') AS payment_label, fare / dist AS fare_per_mile
  FROM t WHERE tip_pct <= 100 AND dur BETWEEN 1 AND 360 AND dist / (dur / 60) <= 80 AND dist >= 0 AND fare <= 200)"""


def _taxi(spark, d):
    return taxi_trips.apply_filters(taxi_trips.features(taxi_trips.clean(taxi_view(spark, d))))


@query("taxi_by_hour", f"""
WITH {_TAXI_SQL}
SELECT CAST(hour AS INTEGER) AS hour, count(fare) AS trips, round(avg(fare), 6) AS avg_fare FROM t2 GROUP BY hour
""")
def q_taxi_by_hour(spark, d):
    return _round(taxi_trips.results(_taxi(spark, d))["by_hour"], {"avg_fare": 6})


@query("taxi_by_payment", f"""
WITH {_TAXI_SQL}
SELECT payment_label, round(avg(tipped), 9) AS tip_rate, round(avg(tip), 6) AS avg_tip, count(tipped) AS count
FROM t2 GROUP BY payment_label
""")
def q_taxi_by_payment(spark, d):
    return _round(taxi_trips.results(_taxi(spark, d))["by_payment"], {"tip_rate": 9, "avg_tip": 6})


# ── game catalogue ← part ─────────────────────────────────────────────────

def games_view(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 5
    rel = (F.when(k == 0, F.concat((F.lit(2000) + F.col("p_size") % 20).cast("string"), F.lit("-3-5")))
           .when(k == 1, F.concat(F.lit("5 Jan, "), (F.lit(2000) + F.col("p_size") % 20).cast("string")))
           .when(k == 2, F.lit("Coming soon")).otherwise((F.lit(2000) + F.col("p_size") % 20).cast("string")))
    return p.select(
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("name"),
        _price_text(p).alias("original_price"), rel.alias("release_date"),
        F.concat((F.col("p_size") * 3).cast("string"), F.lit(" achievements")).alias("achievements"),
        F.concat(F.col("p_type"), F.lit(", "), F.col("p_brand")).alias("genre"),
        F.regexp_replace("p_name", " ", ",").alias("popular_tags"),
        F.when(F.col("p_partkey") % 40 != 0, F.col("p_brand")).alias("developer"))


_GAMES_SQL = f"""g0 AS (SELECT p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name, {_PRICE_TEXT_SQL} AS t,
  p_partkey % 5 AS k, p_size, p_type || ', ' || p_brand AS genre, replace(p_name, ' ', ',') AS popular_tags,
  CASE WHEN p_partkey % 40 <> 0 THEN p_brand END AS developer FROM part),
g1 AS (SELECT *, CASE WHEN lower(trim(t)) IN ('free', 'free to play', 'play for free!') THEN 0.0
  ELSE TRY_CAST(replace(replace(lower(trim(t)), '$', ''), ',', '') AS DOUBLE) END AS price FROM g0),
g AS (SELECT * FROM g1 WHERE price IS NOT NULL AND k <> 2 AND price <= 60)"""


def _games(spark, d):
    return game_catalogue.apply_filters(game_catalogue.features(game_catalogue.clean(games_view(spark, d))))


_TIER_CASE = (
    "WHEN price > -1 AND price <= 0 THEN 'Free' WHEN price > 0 AND price <= 5 THEN 'Budget (<$5)' WHEN price > "
    "5 AND price <= 15 THEN 'Low ($5-15)' WHEN price > 15 AND price <= 30 THEN 'Mid ($15-30)' WHEN price > 30 "
    "AND price <= 60 THEN 'Premium ($30-60)' WHEN price > 60 AND price <= 200 THEN 'Ultra ($60+)'")
_TIER_LV = (
    "('Free', 0), ('Budget (<$5)', 1), ('Low ($5-15)', 2), ('Mid ($15-30)', 3), ('Premium ($30-60)', 4), "
    "('Ultra ($60+)', 5)")


@query("games_price_tiers", f"""
WITH {_GAMES_SQL}, lv(price_tier, price_tier_ord) AS (VALUES {_TIER_LV}),
agg AS (SELECT CASE {_TIER_CASE} END AS price_tier, count(name) AS n FROM g GROUP BY 1)
SELECT lv.price_tier, CAST(price_tier_ord AS INTEGER) AS price_tier_ord, CAST(coalesce(n, 0) AS BIGINT) AS count,
  round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 9) AS share
FROM lv LEFT JOIN agg USING (price_tier)
""")
def q_games_price_tiers(spark, d):
    return _round(game_catalogue.results(_games(spark, d))["price_tiers"], {"share": 9})


@query("games_tags_top20", f"""
WITH {_GAMES_SQL}
SELECT trim(tag) AS tag, count(*) AS count FROM (SELECT unnest(string_split(popular_tags, ',')) AS tag FROM g
  WHERE popular_tags IS NOT NULL) GROUP BY 1 ORDER BY count DESC, tag LIMIT 20
""")
def q_games_tags_top20(spark, d):
    return game_catalogue.results(_games(spark, d))["tags_top20"]


@query("games_developers_top15", f"""
WITH {_GAMES_SQL}
SELECT developer, count(DISTINCT name) AS games, round(avg(price), 6) AS avg_price FROM g
WHERE developer IS NOT NULL GROUP BY developer ORDER BY games DESC, developer LIMIT 15
""")
def q_games_developers_top15(spark, d):
    return _round(game_catalogue.results(_games(spark, d))["developers_top15"], {"avg_price": 6})


# ── video game sales ← lineitem ⋈ part ───────────────────────────────────

_PLATFORMS = list(video_game_sales.GENERATION) + ["ZZZ"]


def vgs_view(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey)
    plat = F.element_at(F.array(*[F.lit(x) for x in _PLATFORMS]), (F.col("l_partkey") % len(_PLATFORMS) + 1).cast("int"))
    na = F.col("l_extendedprice") / 100000
    eu = F.col("l_quantity") / 100
    return j.select(F.col("l_orderkey").cast("int").alias("Rank"), F.col("p_name").alias("Name"), plat.alias("Platform"),
                    F.year(F.col("l_shipdate")).cast("double").alias("Year"), F.col("p_type").alias("Genre"),
                    F.when(F.col("l_suppkey") % 9 != 0, F.col("p_brand")).alias("Publisher"),
                    na.alias("NA_Sales"), eu.alias("EU_Sales"), F.col("l_discount").alias("JP_Sales"),
                    F.col("l_tax").alias("Other_Sales"),
                    (na + eu + F.col("l_discount") + F.col("l_tax")).alias("Global_Sales"))


_PLAT_SQL = "[" + ", ".join(f"'{x}'" for x in _PLATFORMS) + "]"
_GEN_CASE = (
    "WHEN 'PS1' THEN 'Gen5' WHEN 'PS2' THEN 'Gen6' WHEN 'PS3' THEN 'Gen7' WHEN 'PS4' THEN 'Gen8' WHEN 'NES' "
    "THEN 'Gen3' WHEN 'SNES' THEN 'Gen4' WHEN 'N64' THEN 'Gen5' WHEN 'GC' THEN 'Gen6' WHEN 'Wii' THEN 'Gen7' "
    "WHEN 'WiiU' THEN 'Gen8' WHEN 'Switch' THEN 'Gen8' WHEN 'GB' THEN 'Gen4' WHEN 'GBA' THEN 'Gen5' WHEN 'DS' "
    "THEN 'Gen7' WHEN '3DS' THEN 'Gen8' WHEN '2600' THEN 'Gen2' WHEN 'GEN' THEN 'Gen4' WHEN 'DC' THEN 'Gen6' "
    "WHEN 'SAT' THEN 'Gen5' WHEN 'X360' THEN 'Gen7' WHEN 'XB' THEN 'Gen6' WHEN 'XOne' THEN 'Gen8' WHEN 'PSP' "
    "THEN 'Gen7' WHEN 'PSV' THEN 'Gen8' WHEN 'PC' THEN 'PC'")
_VGS_SQL = f"""v0 AS (SELECT {_PLAT_SQL}[CAST(l_partkey % {len(_PLATFORMS)} + 1 AS INTEGER)] AS Platform,
  year(l_shipdate) AS Year, p_type AS Genre, p_name AS Name,
  l_extendedprice / 100000 + l_quantity / 100 + l_discount + l_tax AS Global_Sales,
  l_extendedprice / 100000 AS NA_Sales, l_quantity / 100 AS EU_Sales, l_discount AS JP_Sales, l_tax AS Other_Sales,
  CASE WHEN l_suppkey % 9 <> 0 THEN p_brand ELSE 'Unknown' END AS Publisher
  FROM lineitem JOIN part ON l_partkey = p_partkey),
v AS (SELECT *, coalesce(CASE Platform {_GEN_CASE} END, 'Other') AS Generation FROM v0
  WHERE Global_Sales > 0 AND Year BETWEEN 2000 AND 2020)"""


def _vgs(spark, d):
    return video_game_sales.apply_filters(video_game_sales.features(video_game_sales.clean(vgs_view(spark, d))))


@query("vgs_platform_top15", f"""
WITH {_VGS_SQL}
SELECT Platform, round(sum(Global_Sales), 6) AS sales, count(Name) AS games FROM v GROUP BY Platform
ORDER BY sum(Global_Sales) DESC, Platform LIMIT 15
""")
def q_vgs_platform_top15(spark, d):
    return _round(video_game_sales.results(_vgs(spark, d))["platform_top15"], {"sales": 6})


@query("vgs_by_generation", f"""
WITH {_VGS_SQL}
SELECT Generation, round(sum(Global_Sales), 6) AS sales, count(Name) AS games FROM v GROUP BY Generation
""")
def q_vgs_by_generation(spark, d):
    return _round(video_game_sales.results(_vgs(spark, d))["by_generation"], {"sales": 6})


@query("vgs_by_region", f"""
WITH {_VGS_SQL}
SELECT 'NA' AS Region, round(sum(NA_Sales), 6) AS sales FROM v UNION ALL
SELECT 'EU', round(sum(EU_Sales), 6) FROM v UNION ALL SELECT 'JP', round(sum(JP_Sales), 6) FROM v UNION ALL
SELECT 'Other', round(sum(Other_Sales), 6) FROM v
""")
def q_vgs_by_region(spark, d):
    return _round(video_game_sales.results(_vgs(spark, d))["by_region"], {"sales": 6})


# ── loan default ← orders ⋈ customer ─────────────────────────────────────

_EMP_CODES = list(loan_default.EMP_YEARS) + ["n/a"]


def loan_view(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey)
    emp = F.element_at(F.array(*[F.lit(x) for x in _EMP_CODES]), (F.col("o_custkey") % len(_EMP_CODES) + 1).cast("int"))
    return j.select(
        (F.col("o_totalprice") / 10).alias("loan_amnt"),
        F.when(F.col("o_orderkey") % 2 == 0, "36 months").otherwise("60 months").alias("term"),
        (F.lit(5.0) + (F.col("o_orderkey") % 260) / 10).alias("int_rate"),
        (F.col("o_totalprice") / 360).alias("installment"),
        F.element_at(F.array(*[F.lit(x) for x in "ABCDEFG"]), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("grade"),
        emp.alias("emp_length"), F.lit("RENT").alias("home_ownership"),
        (F.col("c_acctbal") * 50 + 60000).alias("annual_inc"), F.col("o_orderpriority").alias("purpose"),
        (F.col("o_orderkey") % 50).cast("double").alias("dti"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("default"))


_LOAN_SQL = f"""l0 AS (SELECT ['A','B','C','D','E','F','G'][CAST(o_orderkey % 7 + 1 AS INTEGER)] AS grade,
  {[*_EMP_CODES]!r}[CAST(o_custkey % {len(_EMP_CODES)} + 1 AS INTEGER)] AS emp_length,
  5.0 + (o_orderkey % 260) / 10 AS int_rate, o_orderpriority AS purpose, CAST(o_orderkey % 50 AS DOUBLE) AS dti,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "default", o_totalprice / 10 AS loan_amnt,
  CASE WHEN o_orderkey % 2 = 0 THEN '36 months' ELSE '60 months' END AS term, c_acctbal * 50 + 60000 AS annual_inc
  FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT * FROM l0 WHERE emp_length <> 'n/a' AND dti IS NOT NULL)"""


def _loans(spark, d):
    return loan_default.features(loan_default.clean(loan_view(spark, d)))


@query("loan_by_grade", f"""
WITH {_LOAN_SQL}
SELECT grade, round(avg("default"), 9) AS default_rate, count("default") AS count FROM l GROUP BY grade
""")
def q_loan_by_grade(spark, d):
    return _round(loan_default.results(_loans(spark, d))["by_grade"], {"default_rate": 9})


_DTI_LABELS = [f"({a}, {a + 5}]" for a in range(0, 40, 5)]
_DTI_CASE = " ".join(f"WHEN dti > {a} AND dti <= {a + 5} THEN '({a}, {a + 5}]'" for a in range(0, 40, 5))
_DTI_LV = ", ".join(f"('{lab}', {i})" for i, lab in enumerate(_DTI_LABELS))


@query("loan_by_dti_bin", f"""
WITH {_LOAN_SQL}, lv(dti_bin, dti_bin_ord) AS (VALUES {_DTI_LV}),
agg AS (SELECT CASE {_DTI_CASE} END AS dti_bin, avg("default") AS rate, count("default") AS n FROM l GROUP BY 1)
SELECT lv.dti_bin, CAST(dti_bin_ord AS INTEGER) AS dti_bin_ord, round(rate, 9) AS rate,
  CAST(coalesce(n, 0) AS BIGINT) AS count FROM lv LEFT JOIN agg USING (dti_bin)
""")
def q_loan_by_dti_bin(spark, d):
    return _round(loan_default.results(_loans(spark, d))["by_dti_bin"], {"rate": 9})


@query("loan_by_purpose", f"""
WITH {_LOAN_SQL}
SELECT purpose, round(avg(int_rate), 6) AS avg_rate, round(avg("default"), 9) AS default_rate FROM l
WHERE purpose IS NOT NULL GROUP BY purpose
""")
def q_loan_by_purpose(spark, d):
    return _round(loan_default.results(_loans(spark, d))["by_purpose"], {"avg_rate": 6, "default_rate": 9})
