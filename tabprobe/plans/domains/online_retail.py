"""Online retail page (revenue, products, customers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.functions import columns as cx
from tabprobe.functions import filters as fl
from tabprobe.operators import groups as gp
from tabprobe.operators import stats as st
from tabprobe.operators.grouping import GroupedTables
from tabprobe.plans.domains.common import LazyTables

# Month names for the month-of-year table.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
NUM_COLS = ["Quantity", "UnitPrice", "Revenue"]


def split_cancellations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cancellations, sales): a NULL quantity counts as a sale."""
    return fl.split_by(df, F.col("Quantity") < 0)


def clean(sales: DataFrame) -> DataFrame:
    df = sales.dropna(subset=["CustomerID", "Description"])
    df = fl.filter_blank(df, "Description")
    return df.filter((F.col("UnitPrice") > 0) & (F.col("UnitPrice") < 10000))


def features(df: DataFrame) -> DataFrame:
    t = "InvoiceDate"
    return (df.withColumn("Revenue", F.col("Quantity") * F.col("UnitPrice"))
              .withColumn("Month", cx.month_period(t)).withColumn("Year", F.year(t))
              .withColumn("Month_of_Year", F.month(t)).withColumn("Day_of_Week", cx.weekday_mon0(t))
              .withColumn("Hour", F.hour(t)))


def apply_filters(df: DataFrame, countries=None) -> DataFrame:
    return fl.filter_isin(df, "Country", countries)


def revenue_by(df: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Revenue and distinct invoices per key (top ``k`` by revenue)."""
    per_inv = gp.group_agg(df, [key, "InvoiceNo"], F.sum("Revenue").alias("rev"))
    g = gp.group_agg(per_inv, [key], F.sum("rev").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return gp.top_k(g, "revenue", k, [key]) if k else g


def results(df: DataFrame, cancellations: DataFrame, sales_rows: DataFrame) -> dict[str, DataFrame]:
    per_inv = gp.group_agg(df, ["InvoiceNo"], F.sum("Revenue").alias("rev"))
    kpis = df.agg(F.count_distinct("InvoiceNo").alias("orders"), F.sum("Revenue").alias("revenue"),
                  F.count_distinct("CustomerID").alias("customers"))
    n_canc = cancellations.select(F.count(F.lit(1))).scalar()
    n_sales = sales_rows.select(F.count(F.lit(1))).scalar()
    cust = gp.group_agg(df, ["CustomerID"], F.sum("Revenue").alias("total_spend"),
                        F.count_distinct("InvoiceNo").alias("orders"), F.avg("Revenue").alias("avg_order"))

    grouped = GroupedTables(df, {
        "month": (["Month_of_Year"], {"revenue": ("sum", "Revenue")}),
        "product": (["Description"], {"revenue": ("sum", "Revenue"), "qty": ("sum", "Quantity")})})
    return LazyTables({
        "kpis": lambda: kpis.withColumn("mean_order_value", per_inv.select(F.avg("rev")).scalar()),
        "missing_customer": lambda: fl.missing_key_audit(sales_rows, "CustomerID"),
        "cancellation_rate": lambda: df.sparkSession.range(1).select(
            F.try_divide(n_canc, n_canc + n_sales).alias("cancellation_rate")),
        "cancellations_by_country": lambda: gp.top_k(gp.group_agg(cancellations, ["Country"],
                                                          F.count(F.lit(1)).alias("cancellations")),
                                             "cancellations", 10, ["Country"]),
        "revenue_by_country": lambda: revenue_by(df, "Country", 15),
        "top_products": lambda: gp.top_k(grouped["product"], "revenue", 20, ["Description"]),
        "monthly": lambda: revenue_by(df, "Month"),
        "month_of_year": lambda: grouped["month"].withColumn("Month_Name", F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]),
                                                                   F.col("Month_of_Year"))),
        "customers": lambda: cust,
        "spend_hist": lambda: st.histogram(cust, ["total_spend"], bins=50),
        "spend_hist_axis": lambda: gp.quantile_scalar(cust, "total_spend", 0.95),  # where the plot's axis ends
        "top_customers": lambda: gp.top_k(cust, "total_spend", 10, ["CustomerID"]),
    })


def run(df: DataFrame, **filters) -> dict[str, DataFrame]:
    from tabprobe.plans.domains.common import profile_tables
    canc, sales = split_cancellations(df)
    clean_df = apply_filters(features(clean(sales)), **filters)
    out = results(clean_df, canc, sales)
    out.update(profile_tables(clean_df, NUM_COLS, NUM_COLS))
    return out
