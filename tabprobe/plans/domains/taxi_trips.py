"""Taxi trips page (fares, tips, time patterns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.functions import filters as fl
from tabprobe.operators import groups as gp
from tabprobe.operators import stats as st
from tabprobe.operators.grouping import GroupedTables
from tabprobe.plans.domains.common import LazyTables

# Payment codes and trip-distance bins.
PAYMENT_LABELS = {1: "Credit Card", 2: "Cash", 3: "No Charge", 4: "Dispute", 5: "Unknown"}
DIST_EDGES = [0, 1, 2, 5, 10, 50]
DIST_LABELS = ["<1", "1-2", "2-5", "5-10", "10+"]
WEEKEND_LABELS = {0: "Weekday", 1: "Weekend"}
NUM_COLS = ["fare_amount", "tip_amount", "trip_distance", "trip_duration_min", "speed_mph", "passenger_count", "total_amount"]
OUTLIER_COLS = ["fare_amount", "tip_amount", "trip_distance", "trip_duration_min", "speed_mph"]


def clean(df: DataFrame) -> DataFrame:
    df = df.filter((F.col("fare_amount") > 0) & (F.col("trip_distance") > 0) & (F.col("passenger_count") > 0)
                   & (F.col("total_amount") > 0))
    df = df.withColumn("tip_pct", F.col("tip_amount") / F.col("fare_amount") * 100)
    return df.filter(F.col("tip_pct") <= 100)


def features(df: DataFrame) -> DataFrame:
    t = "tpep_pickup_datetime"
    df = (df.withColumn("hour", F.hour(t)).withColumn("day_of_week", cx.weekday_mon0(t))
            .withColumn("weekend", cx.flag(F.col("day_of_week") >= 5)).withColumn("month_day", F.dayofmonth(t))
            .withColumn("trip_duration_min", cx.duration_minutes(t, "tpep_dropoff_datetime")))
    df = df.filter(F.col("trip_duration_min").between(1, 360))
    df = df.withColumn("speed_mph", F.col("trip_distance") / (F.col("trip_duration_min") / 60))
    df = df.filter(F.col("speed_mph") <= 80)
    return (df.withColumn("fare_per_mile", F.col("fare_amount") / F.col("trip_distance"))
              .withColumn("payment_label", cx.recode("payment_type", PAYMENT_LABELS, default="Other"))
              .withColumn("tipped", cx.flag(F.col("tip_amount") > 0)))


def apply_filters(df: DataFrame, min_dist: float = 0.0, max_fare: float = 200) -> DataFrame:
    return df.filter((F.col("trip_distance") >= min_dist) & (F.col("fare_amount") <= max_fare))


def results(df: DataFrame) -> dict[str, DataFrame]:
    dist = df.withColumn("dist_bin", cx.cut("trip_distance", DIST_EDGES, DIST_LABELS))
    fares = {"trips": ("count", "fare_amount"), "avg_fare": ("avg", "fare_amount")}
    grouped = GroupedTables(dist, {
        "kpis": ((), {"trips": ("count", "*"), "mean_fare": ("avg", "fare_amount"), "mean_tip": ("avg", "tip_amount"),
                      "mean_distance": ("avg", "trip_distance"), "tip_rate": ("avg", "tipped")}),
        "hour": (["hour"], fares), "passengers": (["passenger_count"], fares), "weekend": (["weekend"], {"trips": ("count", "fare_amount")}),
        "distance": (["dist_bin"], {"fare_per_mile": ("avg", "fare_per_mile"), "count": ("count", "fare_per_mile")}),
        "payment": (["payment_label"], {"tip_rate": ("avg", "tipped"), "avg_tip": ("avg", "tip_amount"), "count": ("count", "tipped")})})
    return LazyTables({
        "kpis": lambda: grouped["kpis"],
        "by_hour": lambda: grouped["hour"],
        "distance_fare_bins": lambda: st.scatter_bins(df, "trip_distance", "fare_amount", means=["tip_amount"]),
        "fare_per_mile_by_distance": lambda: gp.fill_levels(grouped.rows("distance"), "dist_bin", DIST_LABELS),
        "tip_pct_hist": lambda: st.histogram(df, ["tip_pct"], bins=50),
        "by_payment": lambda: grouped["payment"],
        "by_passengers": lambda: gp.share_of_total(grouped["passengers"], "trips", "share"),
        "weekday_weekend": lambda: grouped["weekend"].withColumn("weekend", cx.recode("weekend", WEEKEND_LABELS)),
    })


def run(df: DataFrame, **filters) -> dict[str, DataFrame]:
    from tabprobe.plans.domains.common import profile_tables
    df = apply_filters(features(clean(df)), **filters)
    out = results(df)
    out.update(profile_tables(df, NUM_COLS, OUTLIER_COLS))
    return out
