"""Game store catalogue page: text cleaning, price tiers, genres, developers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.functions import filters as fl
from tabprobe.operators import groups as gp
from tabprobe.operators import reshape as rs
from tabprobe.operators import stats as st
from tabprobe.plans.domains.common import LazyTables

# Price tiers (right-closed bins).
TIER_EDGES = [-1, 0, 5, 15, 30, 60, 200]
TIER_LABELS = ["Free", "Budget (<$5)", "Low ($5-15)", "Mid ($15-30)", "Premium ($30-60)", "Ultra ($60+)"]


def clean(df: DataFrame) -> DataFrame:
    df = df.withColumn("original_price", cx.clean_money_text("original_price")).dropna(subset=["original_price"])
    df = df.withColumn("release_year", cx.clean_date_text_year("release_date")).dropna(subset=["release_year"])
    return (df.withColumn("achievements_count", cx.clean_leading_int("achievements"))
              .withColumn("genre_list", cx.split_list("genre")))


def features(df: DataFrame, as_of_year: int = 2026) -> DataFrame:
    df = (df.withColumn("price_tier", cx.cut("original_price", TIER_EDGES, TIER_LABELS))
            .withColumn("is_free", cx.flag(F.col("original_price") == 0))
            .withColumn("age_years", cx.years_since("release_year", as_of_year)))
    # games per developer: one row per developer, joined back (NULL developer → NULL count)
    counts = gp.group_agg(df, ["developer"], F.count(F.lit(1)).alias("dev_game_count"))
    return df.join(counts, "developer", "left")  # AQE broadcasts the counts if they are small


def apply_filters(df: DataFrame, genre: str = "All", price_max: float = 60) -> DataFrame:
    return fl.filter_rlike_ci(fl.filter_range(df, "original_price", None, price_max), "genre", genre)


def results(df: DataFrame) -> dict[str, DataFrame]:
    tiers = gp.count_by_levels(df, "price_tier", TIER_LABELS, "name")
    genres = rs.explode_tokens(df, "genre", keep=["name", "original_price"], name="genre_item")
    tags = rs.explode_tokens(df.filter(F.col("popular_tags").isNotNull()), "popular_tags", pattern=",", name="tag")

    def median_price():
        return gp.quantile_scalar(df, "original_price", 0.5).select("q").scalar()
    return LazyTables({
        "kpis": lambda: df.agg(F.count(F.lit(1)).alias("games"), F.avg("original_price").alias("mean_price"),
                       F.count_if(F.col("is_free") == 1).alias("free_games"),
                       F.avg("achievements_count").alias("mean_achievements")).withColumn("median_price", median_price()),
        "price_hist": lambda: st.histogram(df, ["original_price"], bins=50),
        "price_box": lambda: st.box_summary(df, ["original_price"]),
        "price_tiers": lambda: gp.share_of_total(tiers, "count", "share"),
        "genres_top20": lambda: gp.top_k(gp.group_agg(genres, ["genre_item"], F.count_distinct("name").alias("count"),
                                              F.avg("original_price").alias("avg_price")), "count", 20, ["genre_item"]),
        "developers_top15": lambda: gp.top_k(gp.group_agg(df, ["developer"], F.count_distinct("name").alias("games"),
                                                  F.avg("original_price").alias("avg_price")), "games", 15, ["developer"]),
        "by_release_year": lambda: gp.group_agg(df, ["release_year"], F.count_distinct("name").alias("games"),
                                        F.avg("original_price").alias("avg_price")),
        "tags_top20": lambda: gp.top_k(gp.group_agg(tags, ["tag"], F.count(F.lit(1)).alias("count")), "count", 20, ["tag"]),
        "all_genres": lambda: gp.distinct_tokens(df, "genre"),
    })


def run(df: DataFrame, **filters) -> dict[str, DataFrame]:
    from tabprobe.plans.domains.common import profile_tables
    df = apply_filters(features(clean(df)), **filters)
    out = results(df)
    num = ["original_price", "release_year", "achievements_count", "age_years"]
    out.update(profile_tables(df, num, ["original_price", "achievements_count", "age_years"]))
    return out
