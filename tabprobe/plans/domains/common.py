"""Generic profile tables every page shows (quality, duplicates, statistics,
outliers, box summaries, class balance, correlation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tabprobe.operators import correlation as cr
from tabprobe.operators import groups as gp
from tabprobe.operators import quality as qa
from tabprobe.operators import stats as st
from tabprobe.operators.outliers import outlier_report_iqr
from tabprobe.operators.quantiles import column_quartiles


class LazyTables(dict):
    """Result tables built on first access (values given as callables), so a
    caller that needs one table does not run the jobs behind the others."""

    def __getitem__(self, key):
        v = super().__getitem__(key)
        if callable(v):
            v = v()
            super().__setitem__(key, v)
        return v

    def items(self):
        return [(k, self[k]) for k in self.keys()]

    def values(self):
        return [self[k] for k in self.keys()]


def profile_tables(df: DataFrame, stat_cols: Sequence[str], outlier_cols: Sequence[str],
                   target: str | None = None, corr_cols: Sequence[str] | None = None,
                   box_cols: Sequence[str] | None = None) -> LazyTables:
    """The page's profile tables, each built on first access; the quartiles behind statistics, outliers and boxes are
    computed once."""
    names = st.numeric_columns(df, list(dict.fromkeys([*stat_cols, *outlier_cols, *(box_cols or ())])))
    shared = LazyTables({"quartiles": lambda: column_quartiles(df, names), "quality": lambda: qa.data_quality_report(df)})
    out = {
        "duplicates": lambda: qa.duplicate_summary(df),
        "quality": lambda: shared["quality"],
        "missing": lambda: qa.missing_values(shared["quality"]),
        "stats": lambda: st.descriptive_stats(df, stat_cols, quartiles=shared["quartiles"]),
        "outliers": lambda: outlier_report_iqr(df, outlier_cols, quartiles=shared["quartiles"]),
        "boxes": lambda: st.box_summary(df, box_cols or outlier_cols, quartiles=shared["quartiles"]),
    }
    if target:
        out["class_balance"] = lambda: gp.class_balance(df, target)
    if corr_cols:
        out["correlation"] = lambda: cr.correlation_long(df, corr_cols)
    return LazyTables(out)
