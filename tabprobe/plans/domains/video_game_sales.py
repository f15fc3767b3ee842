"""Video game sales page: platform generations, genres, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.functions import filters as fl
from tabprobe.operators import groups as gp
from tabprobe.operators import reshape as rs
from tabprobe.operators import stats as st
from tabprobe.operators.grouping import GroupedTables
from tabprobe.plans.domains.common import LazyTables

# Platform → console generation.
GENERATION = {
    "PS1": "Gen5", "PS2": "Gen6", "PS3": "Gen7", "PS4": "Gen8",
    "NES": "Gen3", "SNES": "Gen4", "N64": "Gen5", "GC": "Gen6",
    "Wii": "Gen7", "WiiU": "Gen8", "Switch": "Gen8",
    "GB": "Gen4", "GBA": "Gen5", "DS": "Gen7", "3DS": "Gen8",
    "2600": "Gen2", "GEN": "Gen4", "DC": "Gen6", "SAT": "Gen5",
    "X360": "Gen7", "XB": "Gen6", "XOne": "Gen8",
    "PSP": "Gen7", "PSV": "Gen8",
    "PC": "PC",
}
# Sales tiers (millions, right-closed bins).
TIER_EDGES = [0, 0.1, 0.5, 1, 5, 10, 100]
TIER_LABELS = ["<0.1M", "0.1-0.5M", "0.5-1M", "1-5M", "5-10M", "10M+"]
REGIONS = ["NA_Sales", "EU_Sales", "JP_Sales", "Other_Sales"]
NUM_COLS = ["Year", "Global_Sales", "NA_Sales", "EU_Sales", "JP_Sales", "Other_Sales"]
OUTLIER_COLS = ["Global_Sales", "NA_Sales", "EU_Sales", "JP_Sales"]


def clean(df: DataFrame) -> DataFrame:
    df = df.dropna(subset=["Year", "Global_Sales"]).withColumn("Year", F.col("Year").cast("int"))
    return df.filter(F.col("Global_Sales") > 0).fillna("Unknown", ["Publisher"])


def features(df: DataFrame) -> DataFrame:
    return (df.withColumn("Generation", cx.recode("Platform", GENERATION, default="Other"))
              .withColumn("NA_Share", F.try_divide("NA_Sales", "Global_Sales"))
              .withColumn("JP_vs_NA_Ratio", (F.col("JP_Sales") + 1) / (F.col("NA_Sales") + 1))
              .withColumn("Decade", cx.decade_label("Year"))
              .withColumn("Sales_Tier", cx.cut("Global_Sales", TIER_EDGES, TIER_LABELS)))


def apply_filters(df: DataFrame, platforms=None, genres=None, year_range=(2000, 2020)) -> DataFrame:
    df = fl.filter_isin(fl.filter_isin(df, "Platform", platforms), "Genre", genres)
    return fl.filter_range(df, "Year", year_range[0], year_range[1])


def results(df: DataFrame, genres: list[str] | None = None) -> dict[str, DataFrame]:
    sales = {"sales": ("sum", "Global_Sales"), "games": ("count", "Name")}
    by_region = {r.removesuffix("_Sales"): ("sum", r) for r in REGIONS}
    grouped = GroupedTables(df, {
        "Platform": (["Platform"], sales), "Generation": (["Generation"], sales), "Genre": (["Genre"], sales), "Year": (["Year"], sales),
        "generation_genre": (["Generation", "Genre"], {"sales": ("sum", "Global_Sales")}),
        "region": ((), by_region), "genre_region": (["Genre"], {r: by_region[r] for r in ("NA", "EU", "JP")})})

    return LazyTables({
        "kpis": lambda: df.agg(F.count(F.lit(1)).alias("games"), F.sum("Global_Sales").alias("sales"),
                       F.avg("Global_Sales").alias("mean_sales"), F.count_distinct("Platform").alias("platforms"),
                       F.count_distinct("Publisher").alias("publishers")),
        "platform_top15": lambda: gp.top_k(grouped["Platform"], "sales", 15, ["Platform"]),
        "by_generation": lambda: grouped["Generation"].orderBy(F.desc("sales"), "Generation"),
        "genre_share": lambda: gp.share_of_total(grouped["Genre"], "sales", "share"),
        "generation_x_genre": lambda: rs.pivot_table(grouped["generation_genre"], ["Generation"], "Genre", "sales", levels=genres,
                                             aggfunc="sum"),
        "by_year": lambda: grouped["Year"],
        "by_region": lambda: rs.melt(grouped.rows("region"), var_name="Region", value_name="sales"),
        "genre_x_region": lambda: rs.melt(grouped["genre_region"], ["Genre"], var_name="Region", value_name="Sales"),
        "sales_hist": lambda: st.histogram(df, ["Global_Sales"], bins=50),
        "sales_hist_axis": lambda: gp.quantile_scalar(df, "Global_Sales", 0.95),  # where the plot's axis ends
    })


def run(df: DataFrame, **filters) -> dict[str, DataFrame]:
    from tabprobe.plans.domains.common import profile_tables
    df = apply_filters(features(clean(df)), **filters)
    out = results(df)
    out.update(profile_tables(df, NUM_COLS, OUTLIER_COLS))
    return out
