import gzip
import os
import random
import tempfile

import pandas as pd
from pyspark.sql import types as T

from tabprobe.operators import quality as qa
from tabprobe.operators.quantiles import exact_quantiles
from tabprobe.sources.catalog import DATASETS
from tabprobe.sources.io import dataset_audit, ingest_csv_to_parquet, read_csv_typed, sample_n

from conftest import SF_SMALL


def _write_gz(text):
    d = tempfile.mkdtemp(prefix="tp-csv-")
    path = os.path.join(d, "data.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write(text)
    return path


def test_read_csv_typed_missing_tokens_and_dotted_names(spark):
    text = ("age,emp.var.rate,y,when\n"
            "30,1.1,yes,2024-01-02 10:00:00\n"
            "NA,N/A,no,\n"
            "41,nan,,bad-date\n"
            "7.0,-0.5,null,2024-03-04 00:00:00\n")
    schema = T.StructType([T.StructField("age", T.IntegerType()), T.StructField("emp.var.rate", T.DoubleType()),
                           T.StructField("y", T.StringType()), T.StructField("when", T.TimestampType())])
    df = read_csv_typed(spark, _write_gz(text), schema, timestamp_format="yyyy-MM-dd HH:mm:ss")
    rows = df.collect()
    assert [r["age"] for r in rows] == [30, None, 41, 7]
    assert [r["emp.var.rate"] for r in rows] == [1.1, None, None, -0.5]
    assert [r["y"] for r in rows] == ["yes", "no", None, None]
    assert [r["when"] is None for r in rows] == [False, True, True, False]
    rep = {r.column: r.nulls for r in qa.data_quality_report(df).collect()}
    assert rep == {"age": 1, "emp.var.rate": 2, "y": 2, "when": 2}


def test_ingest_to_parquet_roundtrip(spark):
    text = "Date,Ticker,Open,High,Low,Close,Volume\n2024-01-02,JPM,1,2,0.5,1.5,100\n2024-01-03,JPM,1,2,0.5,NA,200\n"
    out = tempfile.mkdtemp(prefix="tp-pq-") + "/stocks"
    df = ingest_csv_to_parquet(spark, _write_gz(text), DATASETS["bank_stocks"].schema, out, partitions=2,
                               timestamp_format="yyyy-MM-dd")
    assert df.count() == 2 and df.filter("Close IS NULL").count() == 1


def test_dataset_audit_and_declared(spark):
    rows = {r.table_name: r for r in dataset_audit(spark, SF_SMALL, declared={"region": 5, "nation": 26}).collect()}
    assert rows["region"].actual_rows == 5 and rows["region"].matches
    assert rows["nation"].matches is False


def test_sample_n_returns_all_when_fewer(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert sample_n(df, 5000, ["k"]).count() == 10
    assert sample_n(df, 3, ["k"]).count() == 3


def test_hot_group_quantiles_exact(spark):
    # one key holds a third of all rows; the bracket path must stay exact
    rnd = random.Random(1)
    rows = [("hot", float(rnd.randint(0, 5000))) for _ in range(1500)] + \
           [(f"k{i % 40}", rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99], max_bracket=50,
                                                    approx_start=False).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    for g, s in pdf.groupby("g")["v"]:
        for p in [0.1, 0.5, 0.99]:
            assert abs(got[(g, p)] - s.quantile(p)) < 1e-9


def test_duplicates_with_hot_row(spark):
    rows = [(1, "x")] * 400 + [(i, "y") for i in range(800)] + [(5, "y")] * 3
    r = qa.duplicate_summary(spark.createDataFrame(rows, "a int, b string").repartition(5)).first()
    assert (r.total_rows, r.duplicate_rows) == (1203, 399 + 3)


def test_write_table_partitioned(spark):
    from tabprobe.sources.io import write_table
    out = tempfile.mkdtemp(prefix="tp-out-") + "/t"
    df = spark.createDataFrame([("2024-01", 1.0), ("2024-02", 2.0)], "month string, v double")
    write_table(df, out, partition_by=["month"])
    back = spark.read.parquet(out)
    assert back.filter("month = '2024-02'").count() == 1


def test_sample_n_equals_plain_top_n(spark):
    import hashlib
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber"]
    got = sorted(tuple(r) for r in sample_n(li, 700, keys).collect())
    rows = sorted(li.collect(), key=lambda r: (hashlib.md5(f"42|{r.l_orderkey}|{r.l_linenumber}".encode()).hexdigest(), r.l_orderkey, r.l_linenumber))
    assert got == sorted(tuple(r) for r in rows[:700])
