import math

import numpy as np
import pytest
from pyspark.sql import types as T

from tabprobe.llm import vector_cells as V

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("cell", T.StringType()), T.StructField("n", T.StringType()), T.StructField("h", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], "c", "n", "h") for i, v in rows], SCHEMA)


def brute(rows, dim, t=0.9):
    """(id, links, component, kept) of each row, comparing all pairs."""
    good = [i is not None and v is not None and len(v) == dim and None not in v and all(map(math.isfinite, v)) and any(v) for i, v in rows]
    x = [np.array(v, np.float32).astype(float) if g else None for g, (_, v) in zip(good, rows)]
    x = [a / math.sqrt((a ** 2).sum()) if a is not None else a for a in x]
    links = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and x[i] @ x[j] >= t] for i in range(len(rows))]
    root = {i: i for i, _ in rows if i is not None}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a
    for i, near in enumerate(links):
        for j in near:
            a, b = sorted((top(rows[i][0]), top(rows[j][0])))
            root[b] = a
    return sorted(((i, len(near), None if i is None else top(i), i is None or top(i) == i) for (i, _), near in zip(rows, links)), key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def clustered(seed, n, dim, noise):
    """Groups of two to many near vectors among lone ones; a third of all rows in one group."""
    r = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        size = n // 3 if not rows else int(r.choice([1, 1, 2, 5, 20]))
        centre = r.normal(size=dim)
        rows += [(centre + noise * r.normal(size=dim) * np.linalg.norm(centre) / math.sqrt(dim)) * r.uniform(0.5, 3) for _ in range(size)]
    ids = r.permutation(10 * n)[:len(rows)].tolist()
    return [(i, v.astype("f4").tolist()) for i, v in zip(ids, rows)]


ODD = [(900_000, None), (900_001, [0.0] * 6), (900_002, [1.0, None, 0, 0, 0, 0]), (900_003, [float("nan")] + [1.0] * 5),
       (900_004, [float("inf")] + [1.0] * 5), (900_005, [1.0, 2.0]), (900_005, [1.0, 2.0]), (None, [1.0] * 6), (900_006, []),
       (900_010, [1.0] * 6), (900_011, [2.0] * 6), (900_012, [1.0] * 6), (900_012, [1.0] * 6),   # copies, also scaled
       (900_013, [3e38, -3e38, 3e38, -3e38, 3e38, -3e38]), (900_014, [1e-40, -1e-40, 1e-40, -1e-40, 1e-40, -1e-40]),
       (900_020, [5.0, -4, 3, -2, 1, 0]), (900_020, [0.0, 0, 0, 0, 1, -1]), (900_021, [0.0, 0, 0, 0, 2, -2])]  # one id on two vectors


@pytest.mark.parametrize("cells,block", [(None, 1024), (7, 16)])
def test_equals_brute_force_with_all_cells_in_reach(spark, cells, block):
    rows = clustered(1, 400, 6, 0.35) + ODD
    df = table(spark, rows)
    assert got(V.near_vectors(df, spread=math.inf, cells=cells, block=block)) == brute(rows, 6)


def test_groups_chained_over_cells(spark):
    """Each vector is linked with the next few only, and the chain crosses all cells."""
    rows = [(i, [math.cos(i / 100), math.sin(i / 100)]) for i in range(600)]
    assert got(V.near_vectors(table(spark, rows), cells=16, block=32)) == brute(rows, 2)


def test_recall_at_the_default_reach(spark):
    rows = clustered(2, 1200, 64, 0.28)
    found, true = V.near_vectors(table(spark, rows), cells=60).collect(), brute(rows, 64)
    links = {i: n for i, n, _, _ in true}
    assert all(r.n_links <= links[r.vec_id] for r in found)
    assert sum(r.n_links for r in found) >= 0.97 * sum(links.values()) > 10_000


def test_registered_query(spark):
    from tabprobe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(QUERIES["op12_vector_cells"](spark, sf)) == brute(rows, 64)


def test_empty_table(spark):
    assert V.near_vectors(table(spark, [])).count() == 0
    assert got(V.near_vectors(table(spark, [(1, None), (2, [0.0])]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_spherical_k_means_finds_directions():
    r = np.random.default_rng(4)
    centres = np.eye(5)
    u = np.repeat(centres, 50, axis=0) + 0.02 * r.normal(size=(250, 5))
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = V.spherical_k_means(u, 12)
    kept = V.far_apart(c, 0.95)
    cosines = kept @ kept.T - 2 * np.eye(len(kept))
    assert 5 <= len(kept) < 12 and cosines.max() < 0.95 and ((c @ kept.T).max(axis=1) >= 0.95).all()
    assert len(c) == 12 and np.allclose(np.linalg.norm(c, axis=1), 1) and ((u @ c.T).max(axis=1) > 0.99).all()
