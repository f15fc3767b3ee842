"""Medical cost page (charges drivers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.functions import filters as fl
from tabprobe.operators import groups as gp
from tabprobe.operators import stats as st
from tabprobe.operators.grouping import GroupedTables
from tabprobe.plans.domains.common import LazyTables

# BMI categories and age groups (right-closed bins).
BMI_EDGES = [0, 18.5, 25, 30, 60]
BMI_LABELS = ["Underweight", "Normal", "Overweight", "Obese"]
AGE_EDGES = [0, 25, 35, 45, 55, 65, 100]
AGE_LABELS = ["<25", "25-34", "35-44", "45-54", "55-64", "65+"]
NUM_COLS = ["age", "bmi", "children", "charges"]


def clean(df: DataFrame) -> DataFrame:
    return df.filter(F.col("charges") > 0).withColumn("bmi_category", cx.cut("bmi", BMI_EDGES, BMI_LABELS))


def features(df: DataFrame) -> DataFrame:
    return (df.withColumn("age_group", cx.cut("age", AGE_EDGES, AGE_LABELS))
              .withColumn("smoker_bmi", cx.concat_key("smoker", "bmi_category"))
              .withColumn("log_charges", F.log1p("charges"))
              .withColumn("has_children", cx.flag(F.col("children") > 0)))


def apply_filters(df: DataFrame, regions=None, smoker: str = "All") -> DataFrame:
    return fl.filter_optional_eq(fl.filter_isin(df, "region", regions), "smoker", smoker)


def results(df: DataFrame) -> dict[str, DataFrame]:
    cost = {"cost": ("avg", "charges"), "count": ("count", "charges")}
    charge = {"avg_charge": ("avg", "charges"), "count": ("count", "charges")}
    grouped = GroupedTables(df, {
        "kpis": ((), {"patients": ("count", "*"), "mean_cost": ("avg", "charges"), "mean_age": ("avg", "age"), "mean_bmi": ("avg", "bmi")}),
        "smoker": (["smoker"], charge), "children": (["smoker", "has_children"], {"cost": ("avg", "charges")}),
        "age": (["smoker", "age_group"], cost), "bmi": (["smoker", "bmi_category"], cost), "region": (["region", "smoker"], charge)})

    def by_smoker():
        return grouped["smoker"].join(gp.median_by(df, ["smoker"], "charges"), "smoker")

    def median_cost():
        return gp.quantile_scalar(df, "charges", 0.5).select("q").scalar()
    return LazyTables({
        "kpis": lambda: grouped["kpis"].withColumn("median_cost", median_cost()),
        "charges_hist_by_smoker": lambda: st.histogram(df, ["charges"], bins=50, by=["smoker"]),
        "charges_box_by_smoker": lambda: st.box_summary(df, ["charges"], by=["smoker"]),
        "by_smoker": by_smoker,
        "by_smoker_children": lambda: grouped["children"],
        "age_group_x_smoker": lambda: gp.fill_levels(grouped.rows("age"), "age_group", AGE_LABELS, ["smoker"]),
        "bmi_x_smoker": lambda: gp.fill_levels(grouped.rows("bmi"), "bmi_category", BMI_LABELS, ["smoker"]),
        "region_x_smoker": lambda: grouped["region"],
        "age_charges_bins": lambda: st.scatter_bins(df, "age", "charges", by=["smoker"], means=["bmi"]),
        "bmi_charges_bins": lambda: st.scatter_bins(df, "bmi", "charges", by=["smoker", "sex"]),
    })


def run(df: DataFrame, **filters) -> dict[str, DataFrame]:
    from tabprobe.plans.domains.common import profile_tables
    df = apply_filters(features(clean(df)), **filters)
    out = results(df)
    out.update(profile_tables(df, NUM_COLS, NUM_COLS, corr_cols=["age", "bmi", "children", "charges"]))
    return out
