import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.llm import multi_index as M

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("cell", T.StringType())])


def brute(rows, k, asks):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and len(v) == 4
              and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for i, q in usable:
        if asks(i):
            near = sorted((math.sqrt(((q - v) ** 2).sum()), j) for j, v in usable if j != i)[:k]
            out[i] = [(n + 1, j, s) for n, (s, j) in enumerate(near)]
    return out


def test_exact_when_all_cells_are_visited_and_bad_vectors_take_no_part(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).astype("f4").tolist()) for i in range(300)]
    rows += [(400, [1.0, 0.0, 0.0, 0.0]), (401, [1.0, 0.0, 0.0, 0.0]), (402, [1.0, 0.0, 0.0, 0.0]), (500, None), (501, [0.0] * 4), (502, [1.0, None, 0.0, 0.0]),
             (503, [float("nan"), 1.0, 1.0, 1.0]), (504, [float("inf"), 1.0, 1.0, 1.0]), (505, [1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(*x, "c") for x in rows], SCHEMA)
    for k, limit in ((10, 3), (1000, 7)):
        got = {}
        for x in M.search(df, F.col("vec_id") % 100 == 0, k=k, visit=1.0, centroids=limit).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
        assert {q: sorted(v) for q, v in got.items()} == brute(rows, k, lambda i: i % 100 == 0)


def test_recall_of_the_registered_query(spark):
    from tabprobe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    got = QUERIES["op3_multi_index"](spark, sf).collect()
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & {r.vec_id for r in got if r.query_id == q})
    assert hits >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_walk_goes_by_rising_sums():
    r = np.random.default_rng(2)
    a, b = r.random(6), r.random(5)
    cells = M.walk(a, b, np.ones((6, 5), int), 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert len(set(cells)) == 30 and sums == sorted(sums)


def test_empty_table(spark):
    assert M.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
