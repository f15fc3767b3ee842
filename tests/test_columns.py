"""Column builders: pandas semantics on golden micro-tables."""

import math

import pandas as pd
from pyspark.sql import functions as F

from tabprobe.functions import columns as cx


def _col(spark, values, typ="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_cut_is_right_closed_and_null_outside(spark):
    edges = [0, 25, 35, 45, 55, 65, 100]
    labels = ["<25", "25-34", "35-44", "45-54", "55-64", "65+"]
    vals = [0, 1, 25, 26, 35, 100, 101, None]
    got = [r[0] for r in _col(spark, vals, "int").select(cx.cut("x", edges, labels)).collect()]
    exp = pd.cut(pd.Series(vals, dtype="float"), bins=edges, labels=labels)
    assert got == [None if pd.isna(e) else e for e in exp]


def test_interval_labels_match_pandas_text():
    edges = list(range(0, 45, 5))
    exp = [str(i) for i in pd.cut(pd.Series([1.0]), bins=edges).cat.categories]
    assert cx.interval_labels(edges) == exp


def test_cut_ordinal(spark):
    got = [r[0] for r in _col(spark, [5.0, 10.0, 11.0, 60.0]).select(cx.cut_ordinal("x", [0, 10, 20, 50])).collect()]
    assert got == [0, 0, 1, None]


def test_flag_null_is_zero(spark):
    df = spark.createDataFrame([("yes",), ("no",), (None,)], "y string")
    assert [r[0] for r in df.select(cx.flag(F.col("y") == "yes")).collect()] == [1, 0, 0]


def test_recode_and_default(spark):
    df = spark.createDataFrame([("jan",), ("dec",), ("xyz",), (None,)], "m string")
    m = {"jan": 1, "dec": 12}
    assert [r[0] for r in df.select(cx.recode("m", m)).collect()] == [1, 12, None, None]
    assert [r[0] for r in df.select(cx.recode("m", m, default=0)).collect()] == [1, 12, 0, 0]


def test_log1p_guarded_negative_and_null_give_zero(spark):
    got = [r[0] for r in _col(spark, [0.0, 1.0, -5.0, None]).select(cx.log1p_guarded("x")).collect()]
    assert got == [0.0, math.log1p(1.0), 0.0, 0.0]


def test_concat_key_null_text(spark):
    df = spark.createDataFrame([("yes", "Obese"), ("no", None)], "a string, b string")
    assert [r[0] for r in df.select(cx.concat_key("a", "b")).collect()] == ["yes_Obese", "no_nan"]


def test_hour_of_day_fractional_and_whole(spark):
    got = _col(spark, [0.0, 5400.0, 90000.0]).select(cx.hour_of_day("x"), cx.hour_of_day("x", whole=True)).collect()
    assert [tuple(r) for r in got] == [(0.0, 0), (1.5, 1), (1.0, 1)]


def test_decade_label(spark):
    got = [r[0] for r in _col(spark, [1999, 2000, 2015], "int").select(cx.decade_label("x")).collect()]
    assert got == ["1990s", "2000s", "2010s"]


def test_clean_money_text(spark):
    vals = ["Free", " free to play ", "Play for Free!", "$1,299.00", "$5", "junk", None, "1_000.5", "nan", "12d", "5f", "1e3", "-.5", "1.", "inf"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "t string")
           .select(cx.clean_money_text("t")).collect()]
    assert got == [0.0, 0.0, 0.0, 1299.0, 5.0, None, None, 1000.5, None, None, None, 1000.0, -0.5, 1.0, float("inf")]


def test_clean_date_text_year(spark):
    vals = ["2019-3-5", "2019/03/05", "5 Jan, 2018", "Jan 5, 2018", "2017", "Coming soon", None, " 2016-12-31 "]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "t string")
           .select(cx.clean_date_text_year("t")).collect()]
    assert got == [2019, 2019, 2018, 2018, 2017, None, None, 2016]


def test_clean_leading_int(spark):
    vals = ["12 achievements", "  7", "none", None, "1_000 achievements", "", "99999999999 x", "12d"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "t string")
           .select(cx.clean_leading_int("t")).collect()]
    assert got == [12, 7, 0, 0, 1000, 0, 99999999999, 0]


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",)], "d string").select(F.to_date("d").alias("d"))
    assert [r[0] for r in df.select(cx.weekday_mon0("d")).collect()] == [0, 6]


def test_duration_minutes(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00' AS a, TIMESTAMP'2024-01-01 01:30:30' AS b")
    assert df.select(cx.duration_minutes("a", "b")).first()[0] == 90.5
