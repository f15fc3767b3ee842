"""Bank stocks page: per-ticker returns, volatility, rebasing, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import filters as fl
from tabprobe.operators import co_moments as cm
from tabprobe.operators import groups as gp
from tabprobe.operators import series as se
from tabprobe.operators import stats as st
from tabprobe.plans.domains.common import LazyTables

NUM_COLS = ["Open", "High", "Low", "Close", "Volume", "Daily_Return"]
OUTLIER_COLS = ["Daily_Return", "Volume", "Day_Range"]


def clean(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["Close", "Open", "High", "Low", "Volume"])


def features(df: DataFrame, window: int = 20, block_rows: int = se.BLOCK_ROWS) -> DataFrame:
    out = se.series_features(df, "Ticker", "Date", "Close", window=window, block_rows=block_rows,
                             ret="Daily_Return", logret="Log_Return", vol=f"Volatility_{window}d",
                             norm="Normalized")
    return out.withColumn("Day_Range", F.col("High") - F.col("Low"))


def apply_filters(df: DataFrame, tickers=None) -> DataFrame:
    return fl.filter_isin(df, "Ticker", tickers)


def results(df: DataFrame, tickers: list[str] | None = None, days: int = 365, window: int = 20) -> dict[str, DataFrame]:
    mean_ret = gp.nested_mean(df, ["Ticker"], "Daily_Return", "avg")
    kpis = df.agg(F.min("Date").alias("first_date"), F.max("Date").alias("last_date"),
                  F.count_distinct("Ticker").alias("tickers"), F.count(F.lit(1)).alias("rows"))
    few = tickers is not None and len(tickers) < 2
    return LazyTables({
        "kpis": lambda: kpis.withColumn("mean_daily_return", mean_ret.select("mean_avg_per_group").scalar()),
        "trading_days": lambda: gp.span_by_key(df, "Ticker", "Date"),
        "return_hist_by_ticker": lambda: st.histogram(df, ["Daily_Return"], bins=80, by=["Ticker"]),
        "series": lambda: df.select("Ticker", "Date", "Close", "Normalized", f"Volatility_{window}d", "Volume"),
        "period_return": lambda: se.period_return(df, "Ticker", "Date", "Close", days=days),
        "return_correlation": lambda: None if few else cm.return_correlation(apply_filters(df, tickers), "Ticker", "Date", "Close").drop("n"),
        "mean_volume": lambda: gp.group_agg(df, ["Ticker"], F.avg("Volume").alias("avg_volume")),
    })


def run(df: DataFrame, tickers=None) -> dict[str, DataFrame]:
    from tabprobe.plans.domains.common import profile_tables
    feat = features(clean(df))
    sel = apply_filters(feat, tickers)
    out = results(sel, tickers)
    out.update(profile_tables(sel, NUM_COLS, OUTLIER_COLS))
    return out
