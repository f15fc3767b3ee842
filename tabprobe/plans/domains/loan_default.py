"""Loan default page (target ``default``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.functions import filters as fl
from tabprobe.operators import groups as gp
from tabprobe.operators import stats as st
from tabprobe.operators.grouping import GroupedTables
from tabprobe.plans.domains.common import LazyTables

# Employment-length codes, grade order, interest-rate brackets.
EMP_YEARS = {"<1": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9, "10+": 10}
GRADE_NUM = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7}
RATE_EDGES = [0, 8, 12, 16, 20, 30]
RATE_LABELS = ["<8%", "8-12%", "12-16%", "16-20%", "20%+"]
DTI_EDGES = list(range(0, 45, 5))
NUM_COLS = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "emp_years", "loan_to_income"]
OUTLIER_COLS = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "emp_years"]


def clean(df: DataFrame) -> DataFrame:
    df = df.withColumn("emp_years", cx.recode("emp_length", EMP_YEARS))
    return df.dropna(subset=["emp_years", "dti"])


def features(df: DataFrame) -> DataFrame:
    return (df.withColumn("loan_to_income", cx.ratio("loan_amnt", "annual_inc", 1.0))
              .withColumn("grade_num", cx.recode("grade", GRADE_NUM))
              .withColumn("int_rate_bin", cx.cut("int_rate", RATE_EDGES, RATE_LABELS))
              .withColumn("has_mortgage", cx.flag(F.col("home_ownership") == "MORTGAGE")))


def apply_filters(df: DataFrame, grades=None, purposes=None) -> DataFrame:
    return fl.filter_isin(fl.filter_isin(df, "grade", grades), "purpose", purposes)


def results(df: DataFrame) -> dict[str, DataFrame]:
    dti = df.withColumn("dti_bin", cx.cut("dti", DTI_EDGES))
    grouped = GroupedTables(dti, {
        "kpis": ((), {"loans": ("count", "*"), "default_rate": ("avg", "default"), "mean_loan": ("avg", "loan_amnt"),
                      "mean_rate": ("avg", "int_rate"), "mean_dti": ("avg", "dti")}),
        "grade": (["grade"], {"default_rate": ("avg", "default"), "count": ("count", "default")}),
        "term": (["term"], {"rate": ("avg", "default")}),
        "purpose": (["purpose"], {"avg_rate": ("avg", "int_rate"), "default_rate": ("avg", "default")}),
        "dti": (["dti_bin"], {"rate": ("avg", "default"), "count": ("count", "default")})})
    return LazyTables({
        "kpis": lambda: grouped["kpis"],
        "by_grade": lambda: grouped["grade"],
        "by_term": lambda: grouped["term"],
        "income_loan_bins": lambda: st.scatter_bins(df, "annual_inc", "loan_amnt", by=["default"]),
        "lti_box_by_default": lambda: st.box_summary(df, ["loan_to_income"], by=["default"]),
        "by_purpose": lambda: grouped["purpose"].orderBy("avg_rate", "purpose"),
        "dti_hist_by_default": lambda: st.histogram(df, ["dti"], bins=40, by=["default"]),
        "by_dti_bin": lambda: gp.fill_levels(grouped.rows("dti"), "dti_bin", cx.interval_labels(DTI_EDGES)),
    })


def run(df: DataFrame, **filters) -> dict[str, DataFrame]:
    from tabprobe.plans.domains.common import profile_tables
    df = apply_filters(features(clean(df)), **filters)
    out = results(df)
    out.update(profile_tables(df, NUM_COLS, OUTLIER_COLS, target="default"))
    return out
