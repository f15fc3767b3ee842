from pyspark.sql import functions as F

from tabprobe.functions import filters as fl


def _df(spark):
    return spark.createDataFrame([(1, "a", "Action, RPG"), (2, "b", None), (3, None, "rpg")],
                                 "id int, k string, g string")


def test_isin_empty_means_all(spark):
    assert fl.filter_isin(_df(spark), "k", []).count() == 3
    assert fl.filter_isin(_df(spark), "k", ["a"]).count() == 1


def test_optional_eq_all_token(spark):
    assert fl.filter_optional_eq(_df(spark), "k", "All").count() == 3
    assert fl.filter_optional_eq(_df(spark), "k", "b").count() == 1


def test_rlike_case_insensitive_null_false(spark):
    ids = sorted(r.id for r in fl.filter_rlike_ci(_df(spark), "g", "RPG").collect())
    assert ids == [1, 3]


def test_split_by_null_goes_to_rest(spark):
    a, b = fl.split_by(_df(spark), F.col("k") == "a")
    assert a.count() == 1 and b.count() == 2


def test_range_and_blank(spark):
    df = spark.createDataFrame([(1, " "), (5, "x"), (9, None)], "v int, t string")
    assert fl.filter_range(df, "v", 2, 9).count() == 2
    assert fl.filter_blank(df, "t").count() == 1


def test_missing_key_audit(spark):
    r = fl.missing_key_audit(_df(spark), "k").first()
    assert (r.total_rows, r.missing_rows) == (3, 1)
    assert abs(r.missing_pct - 100 / 3) < 1e-12
