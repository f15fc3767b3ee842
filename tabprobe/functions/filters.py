"""Row filters with the dashboard's parameter conventions.

An empty selection means "no filter", the sentinel ``"All"`` disables an
equality filter, and a comparison with NULL drops the row.  All filters are
plain ``DataFrame.filter`` calls so Catalyst pushes them into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.sources.io import col


def filter_isin(df: DataFrame, name: str, values: Sequence | None) -> DataFrame:
    if not values:
        return df
    return df.filter(col(name).isin(list(values)))


def filter_optional_eq(df: DataFrame, name: str, value, all_token: str = "All") -> DataFrame:
    if value is None or value == all_token:
        return df
    return df.filter(col(name) == F.lit(value))


def filter_range(df: DataFrame, name: str, lo=None, hi=None) -> DataFrame:
    """Inclusive bounds; ``None`` leaves a side open."""
    if lo is not None:
        df = df.filter(col(name) >= F.lit(lo))
    if hi is not None:
        df = df.filter(col(name) <= F.lit(hi))
    return df


def filter_rlike_ci(df: DataFrame, name: str, pattern: str | None, all_token: str = "All") -> DataFrame:
    """Case-insensitive regex search; NULL text never matches."""
    if pattern is None or pattern == all_token:
        return df
    return df.filter(F.coalesce(col(name).rlike("(?i)" + pattern), F.lit(False)))


def dropna_subset(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


# The characters Python's str.strip() removes.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def filter_blank(df: DataFrame, name: str) -> DataFrame:
    """Keep rows whose text holds more than white space (NULL dropped)."""
    return df.filter(F.trim(col(name), F.lit(WHITESPACE)) != "")


def split_by(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Two complementary frames; rows where ``cond`` is NULL go to the second."""
    c = F.coalesce(cond, F.lit(False))
    return df.filter(c), df.filter(~c)


def missing_key_audit(df: DataFrame, name: str) -> DataFrame:
    """Rows lost when dropping NULL ``name``: count and share of all rows."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(col(name).isNull()).alias("missing_rows"),
        F.try_divide(F.count_if(col(name).isNull()) * F.lit(100.0), F.count(F.lit(1))).alias("missing_pct"),
    )
