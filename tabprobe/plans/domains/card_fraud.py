"""Card fraud page (target ``Class``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.functions import filters as fl
from tabprobe.operators import correlation as cr
from tabprobe.operators import groups as gp
from tabprobe.operators import stats as st
from tabprobe.plans.domains.common import LazyTables
from tabprobe.sources.io import sample_n

# Class labels.
CLASS_LABELS = {0: "Legit", 1: "Fraud"}


def features(df: DataFrame) -> DataFrame:
    return (df.withColumn("Time_Hour", cx.hour_of_day("Time"))
              .withColumn("Log_Amount", cx.log1p_guarded("Amount"))
              .withColumn("Class_Label", cx.recode("Class", CLASS_LABELS)))


def apply_filters(df: DataFrame, amount_max: float = 5000) -> DataFrame:
    return fl.filter_range(df, "Amount", None, amount_max)


def kpis(df: DataFrame) -> DataFrame:
    fraud = F.col("Class") == 1
    return df.agg(F.count(F.lit(1)).alias("transactions"), F.count_if(fraud).alias("fraud_cases"),
                  F.try_divide(F.count_if(fraud), F.count(F.lit(1))).alias("fraud_rate"),
                  F.coalesce(F.avg(F.when(fraud, F.col("Amount"))), F.lit(0.0)).alias("mean_fraud_amount"))


def results(df: DataFrame, components: int = 10) -> dict[str, DataFrame]:
    comps = [f"V{i}" for i in range(1, components + 1)]
    hourly = df.withColumn("hour", cx.hour_of_day("Time", whole=True))
    return LazyTables({
        "kpis": lambda: kpis(df),
        "amount_hist_by_class": lambda: st.histogram(df, ["Amount"], bins=80, by=["Class_Label"]),
        "amount_zoom_by_class": lambda: st.histogram(df.filter(F.col("Amount") <= 500), ["Amount"], bins=50, by=["Class_Label"]),
        "amount_by_class": lambda: gp.describe_by_class(df, "Amount", "Class_Label"),
        "fraud_rate_by_hour": lambda: gp.group_agg(hourly, ["hour"], F.avg("Class").alias("fraud_rate"),
                                           F.count("Class").alias("transactions")),
        "component_sample": lambda: sample_n(df.select(*comps, "Class_Label", "Time", "Amount"), 5000, [*comps, "Class_Label", "Time", "Amount"]),
        "component_corr": lambda: cr.correlation_long(df, comps + ["Amount", "Class"]),
    })


def run(df: DataFrame, **filters) -> dict[str, DataFrame]:
    from tabprobe.plans.domains.common import profile_tables
    df = apply_filters(features(df), **filters)
    out = results(df)
    num = ["Time", "Amount"] + [f"V{i}" for i in range(1, 29)]
    out.update(profile_tables(df, num, num, target="Class", box_cols=["Amount", "Time"] + [f"V{i}" for i in range(1, 7)]))
    return out
