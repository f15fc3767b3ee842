"""Bank marketing campaign page (target ``y``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.functions import filters as fl
from tabprobe.operators import groups as gp
from tabprobe.operators import stats as st
from tabprobe.operators.grouping import GroupedTables
from tabprobe.plans.domains.common import LazyTables
from tabprobe.sources.io import col

# Age groups, month numbers and the display month order.
AGE_EDGES = [0, 25, 35, 45, 55, 65, 100]
AGE_LABELS = ["<25", "25-34", "35-44", "45-54", "55-64", "65+"]
MONTH_NUM = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
             "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
MONTH_ORDER = ["mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NUM_COLS = ["age", "duration", "campaign", "pdays", "previous",
            "emp.var.rate", "cons.price.idx", "cons.conf.idx", "euribor3m", "nr.employed"]
OUTLIER_COLS = ["age", "duration", "campaign", "pdays", "previous", "euribor3m"]
ECON_COLS = ["emp.var.rate", "cons.price.idx", "cons.conf.idx", "euribor3m", "nr.employed", "y_binary"]


def clean(df: DataFrame) -> DataFrame:
    df = df.withColumn("y_binary", cx.flag(F.col("y") == "yes"))
    return df.filter(F.col("duration") > 0)


def features(df: DataFrame) -> DataFrame:
    return (df.withColumn("age_group", cx.cut("age", AGE_EDGES, AGE_LABELS))
              .withColumn("month_num", cx.recode("month", MONTH_NUM))
              .withColumn("prev_contact_ratio", cx.ratio("previous", "campaign", 1.0)))


def apply_filters(df: DataFrame, jobs=None, months=None) -> DataFrame:
    return fl.filter_isin(fl.filter_isin(df, "job", jobs), "month", months)


def kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("contacts"), F.sum("y_binary").alias("subscriptions"),
                  F.avg("y_binary").alias("conversion_rate"), F.avg("duration").alias("mean_duration"),
                  F.avg("campaign").alias("mean_campaign"))


def results(df: DataFrame) -> dict[str, DataFrame]:
    rate = {"rate": ("avg", "y_binary"), "count": ("count", "y_binary")}
    grouped = GroupedTables(df, {
        "kpis": ((), {"contacts": ("count", "*"), "subscriptions": ("sum", "y_binary"), "conversion_rate": ("avg", "y_binary"),
                      "mean_duration": ("avg", "duration"), "mean_campaign": ("avg", "campaign")}),
        "job": (["job"], rate), "age": (["age_group"], rate),
        "month": (["month"], {"rate": ("avg", "y_binary"), "contacts": ("count", "y_binary")})})
    return LazyTables({
        "kpis": lambda: grouped["kpis"],
        "by_job": lambda: grouped["job"],
        "age_hist_by_y": lambda: st.histogram(df, ["age"], bins=40, by=["y"]),
        "by_age_group": lambda: gp.fill_levels(grouped.rows("age"), "age_group", AGE_LABELS),
        "by_month": lambda: gp.sort_by_levels(grouped["month"], "month", MONTH_ORDER),
        "econ_scatter": lambda: st.scatter_bins(df, "euribor3m", "cons.price.idx", by=["y"]),
    })


def run(df: DataFrame, **filters) -> dict[str, DataFrame]:
    from tabprobe.plans.domains.common import profile_tables
    df = apply_filters(features(clean(df)), **filters)
    out = results(df)
    out.update(profile_tables(df, NUM_COLS, OUTLIER_COLS, target="y", corr_cols=ECON_COLS))
    return out
