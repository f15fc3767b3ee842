"""The stages' decisions against brute force over what each stage was given."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tabprobe.llm import quality, toxicity
from tabprobe.llm._common import stored
from tabprobe.llm.queries import held_out

from .test_joins import classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    found = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in C.STAGES:
        found.append(stored(stage(spark, found[-1], SF), name))
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_filters(spark, tables):
    docs, tame, good, distinct, classes_kept, packed = tables
    assert all(t.columns == docs.columns for t in tables[:5])
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~held_out()))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert set(rows(tame)) == {i for i, s in scores.items() if s < 0.5}
    scores = {r.doc_id: r.score for r in quality.score(tame, quality.fit(tame)).collect()}
    assert set(rows(good)) == {i for i, s in scores.items() if s >= 0.5}


def test_copies_and_classes(tables):
    good, distinct, kept = (rows(t) for t in tables[2:5])
    largest = {}
    for i, r in good.items():
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        largest[text] = max(largest.get(text, i), i)
    assert set(distinct) == set(largest.values())
    sets = {}
    for i, r in distinct.items():
        w = (r.text or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else {i}
    pairs = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert set(kept) == set(classes(sets, pairs).values())
    assert all(kept[i] == distinct[i] == good[i] for i in kept)


def test_packed_documents_and_run(spark, tables):
    packed = tables[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in packed} == set(rows(tables[4])) and all(r.n == r["all"] for r in packed)
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in C.run(spark, SF).collect()) == sorted((r.doc_id, r.start, bytes(r.ids)) for r in tables[5].collect())


def test_queries_are_registered_and_sql_matches(spark):
    import duckdb
    import __spark_entry__ as E
    names = [q for q in E.queries() if q.startswith("op") and "_" in q and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in E.queries()
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in [q for q in names if q in E.oracle_sql()]:
        got = E.queries()[name](spark, SF)
        cur = con.execute(E.oracle_sql()[name])
        order = [[d[0] for d in cur.description].index(c) for c in got.columns]
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in cur.fetchall()), name
