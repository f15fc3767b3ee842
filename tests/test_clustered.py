import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabprobe.functions import filters as fl
from tabprobe.sources.clustered import ZONES, read_clustered, write_clustered

from conftest import SF_ORACLE

BY = ["l_extendedprice", "l_shipdate", "l_partkey"]


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF_ORACLE}/lineitem.parquet")


@pytest.fixture(scope="module")
def clustered(spark, lineitem, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "lineitem")
    write_clustered(lineitem, path, BY, rows_per_file=4000, row_group_bytes=1 << 15, bloom=["l_orderkey"])
    return path


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


def scanned(df):
    """Files and rows that the scan of a plan without exchanges has read."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return tuple(scan.metrics().get(k).get().value() for k in ("numFiles", "numOutputRows"))


def groups_in_reach(path, name, low, high):
    """Row groups whose statistics overlap a range, and all row groups."""
    hit = total = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(name)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            total, hit = total + 1, hit + (s.min <= high and s.max >= low)
    return hit, total


def test_rows_equal_filter_range(spark, lineitem, clustered):
    got = read_clustered(spark, clustered, BY, ranges={"l_extendedprice": (10000, 12000), "l_partkey": (100, 300)}, values={"l_returnflag": ["A", "R"]})
    want = fl.filter_isin(fl.filter_range(fl.filter_range(lineitem, "l_extendedprice", 10000, 12000), "l_partkey", 100, 300), "l_returnflag", ["A", "R"])
    assert rows(got) == rows(want) and got.count() > 20
    assert rows(read_clustered(spark, clustered, BY)) == rows(lineitem)
    assert read_clustered(spark, clustered, BY, ranges={"l_partkey": (-5, -1)}).count() == 0
    some = [1, 500, 10 ** 9]
    assert rows(read_clustered(spark, clustered, BY, values={"l_partkey": some})) == rows(lineitem.filter(F.col("l_partkey").isin(some)))


def test_fewer_files_and_row_groups_are_read_for_every_column(spark, lineitem, clustered, tmp_path):
    plain = str(tmp_path / "plain")
    lineitem.repartition(15, "l_orderkey").write.option("parquet.block.size", 1 << 15).parquet(plain)
    for name, low, high in (("l_extendedprice", 20000.0, 22000.0), ("l_partkey", 700, 760)):
        hit, total = groups_in_reach(clustered, name, low, high)
        assert total > 30 and hit < 0.5 * total and groups_in_reach(plain, name, low, high)[0] == groups_in_reach(plain, name, low, high)[1]
        files, read = scanned(read_clustered(spark, clustered, BY, ranges={name: (low, high)}))
        plain_files, plain_read = scanned(fl.filter_range(spark.read.parquet(plain), name, low, high))
        assert files < 0.7 * plain_files and read < 0.5 * plain_read, (name, files, read)


def test_bloom_filters_skip_row_groups(spark, lineitem, clustered):
    present = {r[0] for r in lineitem.select("l_orderkey").distinct().collect()}
    absent = next(k for k in range(5000) if k not in present) if len(present) < 5000 else None
    key = min(present)
    files, read = scanned(spark.read.parquet(clustered).filter(F.col("l_orderkey") == key))
    assert read < 0.5 * lineitem.count()
    if absent is not None:
        assert scanned(spark.read.parquet(clustered).filter(F.col("l_orderkey") == absent))[1] < 0.2 * lineitem.count()


def test_hot_values_nulls_and_clashing_names(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan"))
                                  .otherwise(F.col("id").cast("double")).alias("place"),
                                  F.when(F.col("id") % 5 > 0, F.concat(F.lit("näme"), F.col("id") % 97)).alias("tie"), F.lit("x").alias("_place"), "id")
    path = str(tmp_path / "t")
    write_clustered(df, path, ["place", "tie"], rows_per_file=300)
    sizes = [r.rows for r in spark.read.parquet(f"{path}/{ZONES}").collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 8 and max(sizes) < 900  # a third of the rows share one value
    assert rows(spark.read.parquet(path)) == rows(df)
    for bounds in ((None, 10.0), (2990.0, None), (5.0, 5.0)):
        low, high = bounds
        want = df.filter((F.col("place") >= low if low is not None else F.lit(True)) & (F.col("place") <= high if high is not None else F.lit(True)))
        assert rows(read_clustered(spark, path, ["place", "tie"], ranges={"place": bounds})) == rows(want)
    some = ["näme3", "nothing"]
    assert rows(read_clustered(spark, path, ["place", "tie"], values={"tie": some})) == rows(df.filter(F.col("tie").isin(some)))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write_clustered(spark.createDataFrame([], "a int, b string"), path, ["a", "b"])
    assert read_clustered(spark, path, ["a", "b"], ranges={"a": (1, 2)}).count() == 0
