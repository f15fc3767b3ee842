import gzip
import io
import itertools
import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabprobe.sources import csv_records as R
from tabprobe.sources import csv_types as C

VALUES = ["1", "-7", "+5", " 12", "3 ", "9223372036854775807", "9223372036854775808", "18446744073709551615", "18446744073709551616",
          "-9223372036854775809", "1.5", ".5", "2.", " 1e5 ", "1e400", "inf", "-Infinity", " inf", "1e", "1d5", "0x1", "1_0", "--1", "- 1", ".",
          "True", "FALSE", "tRue", "yes", "NA", "", "nan", "null", "-nan", "<NA>", "None", "x", " ", "٣"]


def state(value):
    """The parser state after a text, letter by letter: the rules written out."""
    inside, start, after = False, True, False
    for c in value:
        if inside:
            if c == '"':
                inside, after = False, True
        elif after and c == '"':
            inside, after = True, False
        elif start and c == '"':
            inside, start = True, False
        else:
            after, start = False, c in ",\n"
    return inside


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n', max_size=30).map(lambda t: t + "\n"), st.booleans())
def test_scan_equals_the_rules_letter_by_letter(text, inside):
    prefix = '"' if inside else ""
    end, head, start = R.scan(text, inside)
    assert end == state(prefix + text)
    breaks = [i + 1 for i, c in enumerate(text) if c == "\n" and not state(prefix + text[:i])]
    if inside:
        assert head == (breaks[0] if breaks else len(text))
    else:
        assert head == 0
    if end and (breaks or not inside):
        assert start == (breaks[-1] if breaks else 0)
    else:
        assert start == len(text)


def in_file(tmp_path, text, gz=False, name="data.csv"):
    path = tmp_path / (name + ".gz" * gz)
    (gzip.open(path, "wt", newline="") if gz else open(path, "w", newline="")).write(text) if not gz else path.write_bytes(gzip.compress(text.encode()))
    return str(path)


def same(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return a == b


def rows_of(df):
    names = [c for c in df.columns if c != "at"]
    return [tuple(r[c] for c in names) for r in sorted(df.collect(), key=lambda r: tuple(r["at"]))]


def test_types_equal_pandas_for_all_pairs_of_values(spark, tmp_path):
    """A column for each pair of values, a third of them with a late value after many whole numbers."""
    pairs = list(itertools.product(VALUES, VALUES))
    lines = [",".join(f"c{i}" for i in range(len(pairs))), ",".join(a for a, _ in pairs), ",".join(["1"] * 0 + [b for _, b in pairs])]
    text = "\n".join(lines) + "\n"
    records, names = C.open_csv(spark, in_file(tmp_path, text))
    got = {r.column: r.pandas_type for r in C.infer_types(records, names).collect()}
    want = pd.read_csv(io.StringIO(text), low_memory=False)
    big = {"9223372036854775808", "18446744073709551615", "18446744073709551616", "-9223372036854775809"}
    fraction = {"1.5", ".5", "2.", " 1e5 ", "inf", "-Infinity"}
    differ = [(p, got[f"c{i}"], str(want[f"c{i}"].dtype)) for i, p in enumerate(pairs) if got[f"c{i}"] != str(want[f"c{i}"].dtype)]
    # the order of rows decides in pandas where a number beyond 64 bits meets a fraction
    assert [d for d in differ if not (set(d[0]) & big and set(d[0]) & fraction)] == []


FIXTURE = ('id,name,note,price,flag,late,when,when,,small\n'
           '1,"Smith, J.","two\nlines ""quoted""",1.5,True,1,2024-01-02,1/2/2024,x,7\n'
           '2,5" disk,"a\n\nb,c",NA,false,2,2024-02-03,12/31/2024 8:05,y,NA\n'
           '\n'
           '3,"x"y"z,,2,TRUE,3,2024-03-04,3/4/2024,,8\n'
           '   \n'
           '4,"",plain,inf,False,n/a,,,"",9\n'
           '5,last,"open, ""so\n\n\nfar"" it\ngoes",-0.25,True,late text,2024-05-06,5/6/2024\n')


@pytest.mark.parametrize("gz,chunk", [(False, 64), (False, 200), (True, 90), (True, 1 << 20)])
def test_read_equals_pandas(spark, tmp_path, gz, chunk):
    text = FIXTURE + "".join(f'{i},"n{i}\n{"z" * (i % 50)}""","{"k,\n" * (i % 7)}",{i / 4},True,{i},2024-01-{1 + i % 28:02d},1/{1 + i % 28}/2023,w,{i}\n' for i in range(6, 400))
    path = in_file(tmp_path, text, gz)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = C.read_csv(spark, path, parse_dates=["when", "when.1"], place="at", chunk_bytes=chunk)
        got = rows_of(df)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = pd.read_csv(io.StringIO(text), low_memory=False, parse_dates=["when"])
    assert df.columns[1:] == list(want.columns) == ["id", "name", "note", "price", "flag", "late", "when", "when.1", "Unnamed: 8", "small"]
    assert dict(df.dtypes) | {"at": 0} == {"at": 0, "id": "bigint", "name": "string", "note": "string", "price": "double", "flag": "boolean", "late": "string",
                                           "when": "timestamp", "when.1": "timestamp", "Unnamed: 8": "string", "small": "bigint"}
    want["when.1"] = pd.to_datetime(want["when.1"], format="mixed")
    assert len(got) == len(want) == 399
    for g, w in zip(got, want.itertuples(index=False)):
        w = [None if x is pd.NaT else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in w]
        assert all(same(a, b) for a, b in zip(g, w)), (g, w)


def test_several_files_long_rows_and_odd_files(spark, tmp_path):
    one = in_file(tmp_path, "a,b\n1,2\n3\n", name="1.csv")
    two = in_file(tmp_path, "a,b\r\n5,\"x\r\ny\"\r\n", name="2.csv")
    assert rows_of(C.read_csv(spark, [one, two], place="at")) == [(1, "2"), (3, None), (5, "x\ny")]
    long = in_file(tmp_path, "a,b\n1,2\n3,4,5\n6,7\n", name="3.csv")
    with pytest.raises(Exception, match="expected 2 fields, saw 3"):
        C.read_csv(spark, long).collect()
    assert rows_of(C.read_csv(spark, long, long_rows="skip", place="at")) == [(1, 2), (6, 7)]
    with pytest.raises(ValueError):
        C.read_csv(spark, long, long_rows="keep")
    only = in_file(tmp_path, "a,b\n", name="4.csv")
    assert C.read_csv(spark, only).dtypes == [("a", "double"), ("b", "double")] and C.read_csv(spark, only).count() == 0
    with pytest.raises(ValueError, match="no columns"):
        C.read_csv(spark, in_file(tmp_path, "", name="5.csv"))
    unclosed = in_file(tmp_path, 'a;b\n1;"x\ny\n', name="6.csv")
    assert rows_of(C.read_csv(spark, unclosed, sep=";", place="at")) == [(1, "x\ny\n")]
    tokens = in_file(tmp_path, "a,b\n-,NA\n1,2\n", name="7.csv")
    assert rows_of(C.read_csv(spark, tokens, missing_tokens=["-"], place="at")) == [(None, "NA"), (1, "2")]


def test_dates_that_do_not_all_parse_stay_text(spark, tmp_path):
    path = in_file(tmp_path, "d,e\n2024-01-02,2024-01-02\nsoon,NA\n")
    df = C.read_csv(spark, path, parse_dates=["d", "e"])
    assert df.dtypes == [("d", "string"), ("e", "timestamp")]


def test_date_formats_are_tried_only_on_texts_of_their_shape(spark):
    """A guarded format reads what the format reads, and most formats are not tried on a text (each failure is an exception)."""
    from pyspark.sql import functions as F
    texts = ["2020-01-02", "+2020-01-02", " 2020-01-02", "2020-01-02 03:04", "2020-01-02T03:04:05.12", "2020-01-02T03:04:05Z", "2020-01-02t03:04:05",
             "1/2/2020", "001/2/2020", "1/2/2020 3:04", "1/2/2020 3:04:05", "01-jan-2020", "1 Jan 2020", "jan 01, 2020", "1.2.2020", "20200102", "x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    both = [F.struct(F.try_to_timestamp("v", F.lit(f)).cast("string").alias("a"), C.read_date(F.col("v"), f).cast("string").alias("b"),
                     F.col("v").rlike(C.date_shape(f)).alias("tried")) for f in C.DATE_FORMATS]
    rows = df.select("v", F.array(*both).alias("reads")).collect()
    assert all(x.a == x.b for r in rows for x in r.reads)
    assert {r.v: sum(x.tried for x in r.reads) for r in rows}["1/2/2020 3:04"] == 1
