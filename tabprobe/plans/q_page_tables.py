"""The pages' other result tables on the driver tables (D1-D9): grouped tables, KPI rows, 2-D bins and samples.

Each query takes its table from the page's ``results`` on the page's view (``q_domains``); the SQL computes it anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.plans import q_domains as qd
from tabprobe.plans.domains import (bank_marketing, bank_stocks, card_fraud, game_catalogue, loan_default,
                                    medical_cost, online_retail, taxi_trips, video_game_sales)
from tabprobe.plans.q_pages import _RETAIL_SQL_CUSTOMERS, _STOCKS, _fraud, _page_table, _stocks, box_sql


OFF_TIE = 3.7e-10  # means of a few short decimals lie on rounding ties, which engines round differently


def scatter_sql(cte: str, rel: str, x: str, y: str, by: tuple[str, ...] = (), means: dict[str, str] | None = None) -> str:
    keys = "".join(f"{k}, " for k in by)
    more = "".join(f", round(avg({e}) + {OFF_TIE}, 6) AS {n}" for n, e in (means or {}).items())
    return f"""WITH {cte}, e AS (SELECT min({x}) AS xa, max({x}) AS xb, min({y}) AS ya, max({y}) AS yb FROM {rel})
SELECT {keys}CAST(least(floor(({x} - xa) / ((xb - xa) / 50.0)), 49) AS INTEGER) AS x_bin,
  CAST(least(floor(({y} - ya) / ((yb - ya) / 50.0)), 49) AS INTEGER) AS y_bin, count(*) AS count{more} FROM {rel}, e GROUP BY ALL"""


def levels_sql(cte: str, rel: str, key: str, case: str, levels: list[str], value: str, name: str, by: str | None = None) -> str:
    lv = ", ".join(f"('{x}', {i})" for i, x in enumerate(levels))
    keys, on = (f"{by}, ", f"{by}, {key}") if by else ("", key)
    grid = f"SELECT * FROM (SELECT DISTINCT {by} FROM {rel}), lv" if by else "SELECT * FROM lv"
    return f"""WITH {cte}, lv({key}, o) AS (VALUES {lv}), grid AS ({grid}),
agg AS (SELECT {keys}{case} AS {key}, avg({value}) AS a, count({value}) AS n FROM {rel} GROUP BY ALL)
SELECT {keys}{key}, CAST(o AS INTEGER) AS {key}_ord, round(a, 6) AS {name}, coalesce(n, 0) AS count FROM grid LEFT JOIN agg USING ({on})"""


def _cases(x: str, edges: list, labels: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {a} AND {x} <= {b} THEN '{t}'" for a, b, t in zip(edges, edges[1:], labels)) + " END"


# ── bank marketing ────────────────────────────────────────────────────────
_YES = ", bb AS (SELECT *, CASE y_binary WHEN 1 THEN 'yes' ELSE 'no' END AS y FROM b)"
_page_table("page_bank_kpis", f"""WITH {qd._BANK_SQL} SELECT count(*) AS contacts, CAST(sum(y_binary) AS BIGINT) AS subscriptions,
  round(avg(y_binary), 6) AS conversion_rate, round(avg(duration), 6) AS mean_duration,
  round((SELECT avg(1 + o_orderkey % 10) FROM orders WHERE trunc(o_totalprice / 1000) > 0), 6) AS mean_campaign FROM b""",
            lambda s, d: bank_marketing.results(qd._bank(s, d))["kpis"])
_page_table("page_bank_econ", scatter_sql(qd._BANK_SQL + _YES, "bb", "euribor3m", "cons_price", ("y",)),
            lambda s, d: bank_marketing.results(qd._bank(s, d))["econ_scatter"])

# ── card fraud ────────────────────────────────────────────────────────────
_COMPONENTS = ["V1", "V2", "V3", "V4", "Amount", "Class"]
_page_table("page_fraud_component_corr", f"WITH {qd._FRAUD_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS corr FROM f" for a in _COMPONENTS for b in _COMPONENTS),
            lambda s, d: card_fraud.results(_fraud(s, d), components=4)["component_corr"])
# a double's text: Spark writes 10,000,000 and more with an exponent
_TIME_TEXT = """CASE WHEN Time >= 1e7 THEN substr(t, 1, 1) || '.' || coalesce(nullif(rtrim(substr(t, 2), '0'), ''), '0') || 'E' || (length(t) - 1)
  ELSE t || '.0' END"""
_page_table("page_fraud_component_sample", f"""WITH {qd._FRAUD_SQL},
s AS (SELECT *, CASE Class WHEN 1 THEN 'Fraud' ELSE 'Legit' END AS Class_Label, CAST(CAST(Time AS BIGINT) AS VARCHAR) AS t FROM f)
SELECT round(V1, 6) AS V1, round(V2, 6) AS V2, round(V3, 6) AS V3, round(V4, 6) AS V4, Class_Label, round(Time, 6) AS Time, round(Amount, 6) AS Amount FROM s
ORDER BY md5(concat_ws('|', '42', V1, V2, V3, V4, Class_Label, {_TIME_TEXT}, Amount)), V1, V2, V3, V4, Class_Label, Time, Amount LIMIT 5000""",
            lambda s, d: card_fraud.results(_fraud(s, d), components=4)["component_sample"])

# ── loans ─────────────────────────────────────────────────────────────────
_page_table("page_loan_kpis", f"""WITH {qd._LOAN_SQL} SELECT count(*) AS loans, round(avg("default"), 6) AS default_rate,
  round(avg(loan_amnt), 6) AS mean_loan, round(avg(int_rate), 6) AS mean_rate, round(avg(dti), 6) AS mean_dti FROM l""",
            lambda s, d: loan_default.results(qd._loans(s, d))["kpis"])
_page_table("page_loan_by_term", f'WITH {qd._LOAN_SQL} SELECT term, round(avg("default"), 6) AS rate FROM l GROUP BY term',
            lambda s, d: loan_default.results(qd._loans(s, d))["by_term"])
_page_table("page_loan_income_loan", scatter_sql(qd._LOAN_SQL, "l", "annual_inc", "loan_amnt", ('"default"',)),
            lambda s, d: loan_default.results(qd._loans(s, d))["income_loan_bins"])
_page_table("page_loan_lti_box", box_sql(qd._LOAN_SQL, "l", "loan_to_income", "loan_amnt / (annual_inc + 1)", '"default"'),
            lambda s, d: loan_default.results(qd._loans(s, d))["lti_box_by_default"])

# ── medical cost ──────────────────────────────────────────────────────────
_page_table("page_medical_smoker_children", f"""WITH {qd._MED_SQL} SELECT smoker, has_children, round(avg(charges), 6) AS cost FROM m GROUP BY ALL""",
            lambda s, d: medical_cost.results(qd._medical(s, d))["by_smoker_children"])
_page_table("page_medical_age_x_smoker", levels_sql(qd._MED_SQL, "m", "age_group", _cases("age", medical_cost.AGE_EDGES, medical_cost.AGE_LABELS),
                                                    medical_cost.AGE_LABELS, "charges", "cost", "smoker"),
            lambda s, d: medical_cost.results(qd._medical(s, d))["age_group_x_smoker"])
_page_table("page_medical_bmi_charges", scatter_sql(qd._MED_SQL, "m", "bmi", "charges", ("smoker", "sex")),
            lambda s, d: medical_cost.results(qd._medical(s, d))["bmi_charges_bins"])

# ── taxi ──────────────────────────────────────────────────────────────────
_page_table("page_taxi_distance_fare", scatter_sql(qd._TAXI_SQL, "t2", "dist", "fare", (), {"mean_tip_amount": "tip"}),
            lambda s, d: taxi_trips.results(qd._taxi(s, d))["distance_fare_bins"].withColumn("mean_tip_amount", F.col("mean_tip_amount") + OFF_TIE))
_page_table("page_taxi_fare_per_mile", levels_sql(qd._TAXI_SQL, "t2", "dist_bin", _cases("dist", taxi_trips.DIST_EDGES, taxi_trips.DIST_LABELS),
                                                  taxi_trips.DIST_LABELS, "fare_per_mile", "fare_per_mile"),
            lambda s, d: taxi_trips.results(qd._taxi(s, d))["fare_per_mile_by_distance"])
_page_table("page_taxi_passengers", f"""WITH {qd._TAXI_SQL} SELECT pax AS passenger_count, count(fare) AS trips, round(avg(fare), 6) AS avg_fare,
  round(count(fare) / (SELECT count(fare) FROM t2), 6) AS share FROM t2 GROUP BY pax""",
            lambda s, d: taxi_trips.results(qd._taxi(s, d))["by_passengers"])
_page_table("page_taxi_weekend", f"""WITH {qd._TAXI_SQL} SELECT CASE WHEN isodow(pick) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS weekend, count(fare) AS trips
  FROM t2 GROUP BY 1""", lambda s, d: taxi_trips.results(qd._taxi(s, d))["weekday_weekend"])


# ── retail ────────────────────────────────────────────────────────────────
def _retail(name):
    def tables(s, d):
        canc, sales, clean = qd._retail(s, d)
        return online_retail.results(clean, canc, sales)[name]
    return tables


def _retail_customers(name):
    return lambda s, d: _retail(name)(s, d).withColumn("avg_order", F.col("avg_order") + OFF_TIE)


_page_table("page_retail_month_of_year", f"""WITH {qd._RETAIL_SQL} SELECT CAST(month(InvoiceDate) AS INTEGER) AS Month_of_Year, round(sum(Revenue), 6) AS revenue,
  strftime(any_value(InvoiceDate), '%b') AS Month_Name FROM clean GROUP BY 1""", _retail("month_of_year"))
_CUSTOMERS = f"SELECT CustomerID, round(total_spend, 6) AS total_spend, orders, round(avg_order + {OFF_TIE}, 6) AS avg_order FROM cu"
_page_table("page_retail_customers", f"WITH {_RETAIL_SQL_CUSTOMERS} {_CUSTOMERS}", _retail_customers("customers"))
_page_table("page_retail_top_customers", f"WITH {_RETAIL_SQL_CUSTOMERS} {_CUSTOMERS} ORDER BY cu.total_spend DESC, CustomerID LIMIT 10", _retail_customers("top_customers"))
_page_table("page_retail_spend_axis", f"WITH {_RETAIL_SQL_CUSTOMERS} SELECT count(*) AS n, round(quantile_cont(total_spend, 0.95), 6) AS q FROM cu",
            _retail("spend_hist_axis"))

# ── bank stocks ───────────────────────────────────────────────────────────
_page_table("page_stocks_kpis", f"""WITH {_STOCKS} SELECT min(Date) AS first_date, max(Date) AS last_date, count(DISTINCT Ticker) AS tickers, count(*) AS rows,
  round((SELECT avg(a) FROM (SELECT avg(Daily_Return) AS a FROM sf GROUP BY Ticker)), 6) AS mean_daily_return FROM sf""",
            lambda s, d: bank_stocks.results(_stocks(s, d))["kpis"])
_page_table("page_stocks_series", f"""WITH {_STOCKS} SELECT Ticker, Date, round(Close, 6) AS Close, round(Close / first_value(Close) OVER w * 100, 6) AS Normalized,
  round(CASE WHEN count(Daily_Return) OVER v = 20 THEN stddev_samp(Daily_Return) OVER v END, 6) AS Volatility_20d, Volume FROM sf
  WINDOW w AS (PARTITION BY Ticker ORDER BY Date), v AS (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
            lambda s, d: bank_stocks.results(_stocks(s, d))["series"])
_page_table("page_stocks_return_correlation", f"""WITH {qd._STOCKS_SQL},
t AS (SELECT Date, row_number() OVER (ORDER BY Date) AS p FROM (SELECT DISTINCT Date FROM stocks)),
x AS (SELECT Ticker AS e, p, avg(Close) AS c FROM stocks JOIN t USING (Date) GROUP BY ALL),
r AS (SELECT b.e, b.p, b.c / a.c - 1 AS r FROM x b LEFT JOIN x a ON a.e = b.e AND a.p = b.p - 1),
k AS (SELECT p FROM r GROUP BY p HAVING count(r) = (SELECT count(DISTINCT e) FROM x))
SELECT a.e AS var1, b.e AS var2, round(corr(a.r, b.r), 6) AS corr FROM r a JOIN r b USING (p) WHERE p IN (FROM k) GROUP BY ALL""",
            lambda s, d: bank_stocks.results(_stocks(s, d))["return_correlation"])

# ── games ─────────────────────────────────────────────────────────────────
_GAMES = qd._GAMES_SQL + ", gy AS (SELECT *, CAST(2000 + p_size % 20 AS INTEGER) AS release_year FROM g)"
_page_table("page_games_kpis", f"""WITH {_GAMES} SELECT count(*) AS games, round(avg(price), 6) AS mean_price, count(*) FILTER (WHERE price = 0) AS free_games,
  round(avg(p_size * 3), 6) AS mean_achievements, round(quantile_cont(price, 0.5), 6) AS median_price FROM gy""",
            lambda s, d: game_catalogue.results(qd._games(s, d))["kpis"])
_page_table("page_games_genres_top20", f"""WITH {_GAMES} SELECT trim(genre_item) AS genre_item, count(DISTINCT name) AS count, round(avg(price), 6) AS avg_price
  FROM (SELECT name, price, unnest(string_split(genre, ',')) AS genre_item FROM gy) GROUP BY 1 ORDER BY count DESC, genre_item LIMIT 20""",
            lambda s, d: game_catalogue.results(qd._games(s, d))["genres_top20"])
_page_table("page_games_by_year", f"""WITH {_GAMES} SELECT release_year, count(DISTINCT name) AS games, round(avg(price), 6) AS avg_price FROM gy GROUP BY 1""",
            lambda s, d: game_catalogue.results(qd._games(s, d))["by_release_year"])
_page_table("page_games_all_genres", f"WITH {_GAMES} SELECT DISTINCT trim(token) AS token FROM (SELECT unnest(string_split(genre, ',')) AS token FROM gy)",
            lambda s, d: game_catalogue.results(qd._games(s, d))["all_genres"])

# ── video games ───────────────────────────────────────────────────────────
_GENRES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_page_table("page_vgs_kpis", f"""WITH {qd._VGS_SQL} SELECT count(*) AS games, round(sum(Global_Sales), 6) AS sales, round(avg(Global_Sales), 6) AS mean_sales,
  count(DISTINCT Platform) AS platforms, count(DISTINCT Publisher) AS publishers FROM v""", lambda s, d: video_game_sales.results(qd._vgs(s, d))["kpis"])
_page_table("page_vgs_genre_share", f"""WITH {qd._VGS_SQL} SELECT Genre, round(sum(Global_Sales), 6) AS sales, count(Name) AS games,
  round(sum(Global_Sales) / (SELECT sum(Global_Sales) FROM v), 6) AS share FROM v GROUP BY Genre""",
            lambda s, d: video_game_sales.results(qd._vgs(s, d))["genre_share"])
_page_table("page_vgs_generation_x_genre", f"WITH {qd._VGS_SQL} SELECT Generation, " + ", ".join(
    f"round(sum(Global_Sales) FILTER (WHERE Genre = '{g}'), 6) AS {g}" for g in _GENRES) + " FROM v GROUP BY Generation",
            lambda s, d: video_game_sales.results(qd._vgs(s, d), genres=_GENRES)["generation_x_genre"])
_page_table("page_vgs_genre_x_region", f"WITH {qd._VGS_SQL} " + " UNION ALL ".join(
    f"SELECT Genre, '{r}' AS Region, round(sum({r}_Sales), 6) AS Sales FROM v GROUP BY Genre" for r in ("NA", "EU", "JP")),
            lambda s, d: video_game_sales.results(qd._vgs(s, d))["genre_x_region"])
_page_table("page_vgs_sales_axis", f"WITH {qd._VGS_SQL} SELECT count(Global_Sales) AS n, round(quantile_cont(Global_Sales, 0.95), 6) AS q FROM v",
            lambda s, d: video_game_sales.results(qd._vgs(s, d))["sales_hist_axis"])
