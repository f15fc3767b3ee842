"""Page result tables on the driver tables: KPI rows, profile tables, histograms and boxes.

Each query calls the page's own function on the page's view (``q_domains``); the SQL computes the table from
the view's SQL with constants written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabprobe.operators import stats as st
from tabprobe.operators.outliers import outlier_report_iqr
from tabprobe.plans import q_domains as qd
from tabprobe.plans.domains import (bank_marketing, bank_stocks, card_fraud, game_catalogue, loan_default,
                                    medical_cost, online_retail, taxi_trips, video_game_sales)
from tabprobe.plans.registry import query

DIGITS = 6


def _r(df: DataFrame) -> DataFrame:
    return qd._round(df, {c: DIGITS for c, t in df.dtypes if t == "double"})


def _by(by: str | None, prefix: str = "") -> str:
    return f"{prefix}{by}, " if by else ""


def stats_sql(cte: str, rel: str, columns: dict[str, str]) -> str:
    one = " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, "
        f"quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS p75, max(x) AS max, "
        f"CASE WHEN min(x) = max(x) AND count(x) >= 3 THEN 0 ELSE skewness(x) END AS skew, "
        f"CASE WHEN min(x) = max(x) AND count(x) >= 4 THEN 0 ELSE kurtosis(x) END AS kurtosis "
        f"FROM (SELECT CAST({e} AS DOUBLE) AS x FROM {rel})" for name, e in columns.items())
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in "mean std min p25 median p75 max skew kurtosis".split())
    return f"WITH {cte} SELECT \"column\", count, {rounded} FROM ({one})"


def outlier_sql(cte: str, rel: str, columns: dict[str, str]) -> str:
    one = " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", count(*) FILTER (WHERE x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS outliers, "
        f"count(*) AS n, any_value(a - 1.5 * (b - a)) AS lower_bound, any_value(b + 1.5 * (b - a)) AS upper_bound, min(x) AS min, max(x) AS max "
        f"FROM (SELECT x, quantile_cont(x, 0.25) OVER () AS a, quantile_cont(x, 0.75) OVER () AS b FROM (SELECT CAST({e} AS DOUBLE) AS x FROM {rel}))"
        for name, e in columns.items())
    return (f"WITH {cte} SELECT \"column\", outliers, round(outliers * 100.0 / n, 6) AS outlier_pct, round(lower_bound, 6) AS lower_bound, "
            f"round(upper_bound, 6) AS upper_bound, round(min, 6) AS min, round(max, 6) AS max FROM ({one})")


def histogram_sql(cte: str, rel: str, column: str, expr: str, bins: int, by: str | None = None, by_expr: str | None = None) -> str:
    key = f"{by_expr or by} AS {by}, " if by else ""
    on = f"USING ({_by(by)}bin)"
    return f"""WITH {cte}, hx AS (SELECT {key}CAST({expr} AS DOUBLE) AS x FROM {rel}),
he AS (SELECT min(x) AS a, max(x) AS b FROM hx),
hc AS (SELECT {_by(by)}CASE WHEN a = b THEN 0 ELSE CAST(least(floor((x - a) / ((b - a) / {bins}.0)), {bins - 1}) AS INTEGER) END AS bin, count(*) AS c FROM hx, he WHERE x IS NOT NULL GROUP BY ALL),
hg AS (SELECT * FROM {f'(SELECT DISTINCT {by} FROM hx),' if by else ''} (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})))
SELECT {_by(by)}'{column}' AS "column", bin, round(a + bin * ((b - a) / {bins}.0), 6) AS bin_lo, round(a + (bin + 1) * ((b - a) / {bins}.0), 6) AS bin_hi,
  coalesce(c, 0) AS count FROM hg LEFT JOIN hc {on}, he"""


def box_sql(cte: str, rel: str, column: str, expr: str, by: str | None = None) -> str:
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    return f"""WITH {cte}, bx AS (SELECT {_by(by)}CAST({expr} AS DOUBLE) AS x FROM {rel}),
bq AS (SELECT *, quantile_cont(x, 0.25) {over} AS q1, quantile_cont(x, 0.5) {over} AS median, quantile_cont(x, 0.75) {over} AS q3 FROM bx),
bf AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM bq)
SELECT {_by(by)}'{column}' AS "column", round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(any_value(lo), 6) AS lower_fence, round(any_value(hi), 6) AS upper_fence, round(min(x) FILTER (WHERE x BETWEEN lo AND hi), 6) AS whisker_low,
  round(max(x) FILTER (WHERE x BETWEEN lo AND hi), 6) AS whisker_high, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std,
  count(*) FILTER (WHERE NOT x BETWEEN lo AND hi) AS outliers FROM bf {f'GROUP BY {by}' if by else ''}"""


def _page_table(name: str, sql: str, table):
    @query(name, sql)
    def run(spark, d):
        return _r(table(spark, d))
    return run


# ── bank marketing ────────────────────────────────────────────────────────
_page_table("page_bank_age_hist", histogram_sql(qd._BANK_SQL, "b", "age", "age", 40, "y", "CASE y_binary WHEN 1 THEN 'yes' ELSE 'no' END"),
            lambda s, d: bank_marketing.results(qd._bank(s, d))["age_hist_by_y"])

# ── card fraud ────────────────────────────────────────────────────────────
_LABEL = "CASE Class WHEN 1 THEN 'Fraud' ELSE 'Legit' END"


def _fraud(s, d):
    return card_fraud.apply_filters(card_fraud.features(qd.fraud_view(s, d)))


_page_table("page_fraud_amount_zoom", histogram_sql(qd._FRAUD_SQL + ", z AS (SELECT * FROM f WHERE Amount <= 500)", "z", "Amount", "Amount", 50,
                                                    "Class_Label", _LABEL), lambda s, d: card_fraud.results(_fraud(s, d))["amount_zoom_by_class"])
_page_table("page_fraud_amount_hist", histogram_sql(qd._FRAUD_SQL, "f", "Amount", "Amount", 80, "Class_Label", _LABEL),
            lambda s, d: card_fraud.results(_fraud(s, d))["amount_hist_by_class"])
_page_table("page_fraud_amount_by_class", f"""WITH {qd._FRAUD_SQL} SELECT {_LABEL} AS Class_Label, count(Amount) AS count, round(avg(Amount), 6) AS mean,
  round(stddev_samp(Amount), 6) AS std, round(min(Amount), 6) AS min, round(quantile_cont(Amount, 0.25), 6) AS p25,
  round(quantile_cont(Amount, 0.5), 6) AS median, round(quantile_cont(Amount, 0.75), 6) AS p75, round(max(Amount), 6) AS max FROM f GROUP BY 1""",
            lambda s, d: card_fraud.results(_fraud(s, d))["amount_by_class"])

# ── loans ─────────────────────────────────────────────────────────────────
_page_table("page_loan_dti_hist", histogram_sql(qd._LOAN_SQL, "l", "dti", "dti", 40, '"default"'),
            lambda s, d: loan_default.results(qd._loans(s, d))["dti_hist_by_default"])
_page_table("page_loan_by_purpose", f"""WITH {qd._LOAN_SQL} SELECT purpose, round(avg(int_rate), 6) AS avg_rate, round(avg("default"), 6) AS default_rate
  FROM l GROUP BY purpose""", lambda s, d: loan_default.results(qd._loans(s, d))["by_purpose"])

# ── medical cost ──────────────────────────────────────────────────────────
_page_table("page_medical_kpis", f"""WITH {qd._MED_SQL} SELECT count(*) AS patients, round(avg(charges), 6) AS mean_cost, round(avg(age), 6) AS mean_age,
  round(avg(bmi), 6) AS mean_bmi, round(quantile_cont(charges, 0.5), 6) AS median_cost FROM m""",
            lambda s, d: medical_cost.results(qd._medical(s, d))["kpis"])
_page_table("page_medical_charges_hist", histogram_sql(qd._MED_SQL, "m", "charges", "charges", 50, "smoker"),
            lambda s, d: medical_cost.results(qd._medical(s, d))["charges_hist_by_smoker"])
_page_table("page_medical_charges_box", box_sql(qd._MED_SQL, "m", "charges", "charges", "smoker"),
            lambda s, d: medical_cost.results(qd._medical(s, d))["charges_box_by_smoker"])

_page_table("page_medical_age_charges", f"""WITH {qd._MED_SQL}, e AS (SELECT min(age) AS xa, max(age) AS xb, min(charges) AS ya, max(charges) AS yb FROM m)
SELECT smoker, CAST(least(floor((age - xa) / ((xb - xa) / 50.0)), 49) AS INTEGER) AS x_bin,
  CAST(least(floor((charges - ya) / ((yb - ya) / 50.0)), 49) AS INTEGER) AS y_bin, count(*) AS count, round(avg(bmi), 6) AS mean_bmi
FROM m, e GROUP BY ALL""", lambda s, d: medical_cost.results(qd._medical(s, d))["age_charges_bins"])

# ── taxi ──────────────────────────────────────────────────────────────────
_TAXI = {"fare_amount": "fare", "tip_amount": "tip", "trip_distance": "dist", "trip_duration_min": "dur", "speed_mph": "dist / (dur / 60)",
         "passenger_count": "pax", "total_amount": "fare + tip"}
_page_table("page_taxi_stats", stats_sql(qd._TAXI_SQL, "t2", _TAXI), lambda s, d: st.descriptive_stats(qd._taxi(s, d), taxi_trips.NUM_COLS))
_page_table("page_taxi_outliers", outlier_sql(qd._TAXI_SQL, "t2", {k: _TAXI[k] for k in list(_TAXI)[:5]}),
            lambda s, d: outlier_report_iqr(qd._taxi(s, d), taxi_trips.OUTLIER_COLS))
_page_table("page_taxi_kpis", f"""WITH {qd._TAXI_SQL} SELECT count(*) AS trips, round(avg(fare), 6) AS mean_fare, round(avg(tip), 6) AS mean_tip,
  round(avg(dist), 6) AS mean_distance, round(avg(tipped), 6) AS tip_rate FROM t2""", lambda s, d: taxi_trips.results(qd._taxi(s, d))["kpis"])
_page_table("page_taxi_tip_hist", histogram_sql(qd._TAXI_SQL, "t2", "tip_pct", "tip_pct", 50), lambda s, d: taxi_trips.results(qd._taxi(s, d))["tip_pct_hist"])

# ── retail ────────────────────────────────────────────────────────────────
_RETAIL_SQL_CUSTOMERS = qd._RETAIL_SQL + """, cu AS (SELECT CustomerID, sum(Revenue) AS total_spend, count(DISTINCT InvoiceNo) AS orders,
  avg(Revenue) AS avg_order FROM clean GROUP BY 1)"""
_RETAIL = {"Quantity": "Quantity", "UnitPrice": "UnitPrice", "Revenue": "Revenue"}
_page_table("page_retail_stats", stats_sql(qd._RETAIL_SQL, "clean", _RETAIL), lambda s, d: st.descriptive_stats(qd._retail(s, d)[2], online_retail.NUM_COLS))
_page_table("page_retail_outliers", outlier_sql(qd._RETAIL_SQL, "clean", _RETAIL), lambda s, d: outlier_report_iqr(qd._retail(s, d)[2], online_retail.NUM_COLS))
_page_table("page_retail_spend_hist", histogram_sql(qd._RETAIL_SQL + ", cu AS (SELECT CustomerID, sum(Revenue) AS total_spend FROM clean GROUP BY 1)", "cu",
                                                    "total_spend", "total_spend", 50),
            lambda s, d: (lambda t: online_retail.results(t[2], t[0], t[1])["spend_hist"])(qd._retail(s, d)))

# ── bank stocks ───────────────────────────────────────────────────────────
_STOCKS = qd._STOCKS_SQL + """, sf AS (SELECT *, (Close / lag(Close) OVER w - 1) * 100 AS Daily_Return, High - Low AS Day_Range FROM stocks
  WINDOW w AS (PARTITION BY Ticker ORDER BY Date))"""


def _stocks(s, d):
    return bank_stocks.features(bank_stocks.clean(qd.stocks_view(s, d)))


_page_table("page_stocks_stats", stats_sql(_STOCKS, "sf", {c: c for c in "Open High Low Close Volume Daily_Return".split()}),
            lambda s, d: st.descriptive_stats(_stocks(s, d), bank_stocks.NUM_COLS))
_page_table("page_stocks_outliers", outlier_sql(_STOCKS, "sf", {c: c for c in "Daily_Return Volume Day_Range".split()}),
            lambda s, d: outlier_report_iqr(_stocks(s, d), bank_stocks.OUTLIER_COLS))
_page_table("page_stocks_return_hist", histogram_sql(_STOCKS, "sf", "Daily_Return", "Daily_Return", 80, "Ticker"),
            lambda s, d: bank_stocks.results(_stocks(s, d), [])["return_hist_by_ticker"])

# ── games ─────────────────────────────────────────────────────────────────
_page_table("page_games_price_hist", histogram_sql(qd._GAMES_SQL, "g", "original_price", "price", 50),
            lambda s, d: game_catalogue.results(qd._games(s, d))["price_hist"])
_page_table("page_games_price_box", box_sql(qd._GAMES_SQL, "g", "original_price", "price"), lambda s, d: game_catalogue.results(qd._games(s, d))["price_box"])

# ── video games ───────────────────────────────────────────────────────────
_VGS = {c: c for c in "Year Global_Sales NA_Sales EU_Sales JP_Sales Other_Sales".split()}
_page_table("page_vgs_stats", stats_sql(qd._VGS_SQL, "v", _VGS), lambda s, d: st.descriptive_stats(qd._vgs(s, d), video_game_sales.NUM_COLS))
_page_table("page_vgs_outliers", outlier_sql(qd._VGS_SQL, "v", {k: k for k in list(_VGS)[1:5]}),
            lambda s, d: outlier_report_iqr(qd._vgs(s, d), video_game_sales.OUTLIER_COLS))
_page_table("page_vgs_sales_hist", histogram_sql(qd._VGS_SQL, "v", "Global_Sales", "Global_Sales", 50),
            lambda s, d: video_game_sales.results(qd._vgs(s, d))["sales_hist"])
_page_table("page_vgs_by_year", f"WITH {qd._VGS_SQL} SELECT CAST(Year AS INTEGER) AS Year, round(sum(Global_Sales), 6) AS sales, count(Name) AS games FROM v GROUP BY 1",
            lambda s, d: video_game_sales.results(qd._vgs(s, d))["by_year"])
