import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from tabprobe.llm import whitening as W

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("n", T.StringType()), T.StructField("component", T.StringType()), T.StructField("v", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], "n", "c", "v") for i, v in rows], SCHEMA)


def whole(rows, dim):
    keep = [(i, v) for i, v in rows if v is not None and len(v) == dim and None not in v and all(map(math.isfinite, v)) and max(map(abs, v)) < 1e9]
    return [i for i, _ in keep], [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in keep]


def compare(found, ids, x, components=8, close=1e-9):
    """Against numpy's eigenvectors of the exact covariance; rows that share an id are told apart by their values."""
    n, dim = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dim)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, int((e > 1e-14 * e[0]).sum()) if e[0] > 0 else 0, dim)
    assert len(found) == n * k
    if not k:
        return
    want = centred @ axes[:, :k] / np.sqrt(e[:k])
    order = {}
    for place, i in enumerate(ids):
        order.setdefault(i, []).append(place)
    for c in range(k):
        rows = sorted((r for r in found if r.component == c + 1), key=lambda r: (str(r.vec_id), r.whitened))
        a = np.array([r.whitened for r in rows])
        by_sign = []
        for sign in (1, -1):
            expect = sorted(((str(ids[p]), sign * want[p, c]) for p in range(n)))
            by_sign.append(np.abs(a - np.array([b for _, b in expect])).max())
        assert min(by_sign) < close, (c, by_sign)
        assert all(abs(r.explained - e[c] / e.sum()) < 1e-10 and r.identity_error < 1e-9 and r.n == n for r in rows)
    exact = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(r, sums))) for i, r in zip(ids, x))
    assert sorted((str(r.vec_id), int(r.deviation)) for r in found if r.component == 1) == exact


def vectors(seed, n, dim, spectrum):
    r = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(r.normal(size=(dim, dim)))
    return [(i, v.astype("f4").tolist()) for i, v in enumerate(r.normal(size=(n, dim)) * spectrum(np.arange(dim)) @ turn.T + 3)]


ODD = [(900, None), (901, [float("nan")] * 12), (902, [1.0] * 11 + [None]), (903, [float("inf")] + [0.0] * 11), (904, [1.0] * 5), (905, []),
       (906, [1e12] + [0.0] * 11), (907, [0.0] * 12), (None, [2.0] * 12), (908, [-3.25] * 12), (908, [-3.25] * 12)]


@pytest.mark.parametrize("width", [1, 3, 8])
def test_equals_eigenvectors_of_the_covariance(spark, width):
    rows = vectors(1, 300, 12, lambda j: 1.3 ** -j) + ODD
    compare(W.whiten(table(spark, rows), width=width).collect(), *whole(rows, 12))


def test_scalar_recurrence_gives_a_bidiagonal_projection(spark):
    """With width 1 and no early end the projection has V as long as there are dimensions, and deviations are right."""
    rows = vectors(2, 200, 6, lambda j: 2.0 ** -j)
    ids, x = whole(rows, 6)
    data = W.Rows(table(spark, rows).select("vec_id", "embedding").withColumnRenamed("embedding", "v"), 6, 1024, 100_000)
    sigma, axes = W.bidiagonalise(data, 6, 1)
    centred = np.array(x, float) - np.mean(x, axis=0)
    assert np.allclose(sigma, np.linalg.svd(centred, compute_uv=False), rtol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(6), atol=1e-13)


def test_flat_and_repeated_deviations(spark):
    """Equal deviations: any orthonormal choice whitens; every copy must be found."""
    base = np.concatenate([np.eye(10), -np.eye(10)]) * 4
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for width in (1, 4, 8):
        found = W.whiten(table(spark, rows), width=width).collect()
        white = np.zeros((20, 8))
        for r in found:
            white[r.vec_id, r.component - 1] = r.whitened
        assert len(found) == 160 and np.abs(white.T @ white / 20 - np.eye(8)).max() < 1e-12
        assert all(abs(r.explained - 0.1) < 1e-12 and r.identity_error < 1e-12 for r in found)


def test_low_rank_and_few_rows(spark):
    r = np.random.default_rng(3)
    low = r.integers(-3, 4, (50, 2)) @ r.integers(-3, 4, (2, 9))
    rows = [(i, v.tolist()) for i, v in enumerate(low)]
    compare(W.whiten(table(spark, rows)).collect(), *whole(rows, 9))
    few = [(1, [1, 2, 3]), (2, [2, 2, 4]), (3, [0, 5, 3])]
    compare(W.whiten(table(spark, few)).collect(), *whole(few, 3))


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])]):
        assert W.whiten(table(spark, rows)).count() == 0


def test_many_rows_of_large_numbers_stay_exact():
    data = W.Centre(2, 1, 0)
    data.n = 10 ** 9
    data.base, data.rest, data.fraction = np.array([5, 7]), np.array([3, 10 ** 9 - 1], object), np.array([3e-9, 1.0])
    x = np.array([[1 << 42, 7], [5, -(1 << 42)]])
    want = [(10 ** 9 * ((1 << 42) - 5) - 3) ** 2 + (10 ** 9 - 1) ** 2, 9 + (10 ** 9 * ((1 << 42) + 7) + 10 ** 9 - 1) ** 2]
    assert data.deviations(x) == want


def test_registered_query(spark):
    from tabprobe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = QUERIES["op11_whitening"](spark, sf)
    assert dict(df.dtypes)["deviation"] == "bigint"
    compare(df.collect(), *whole(rows, 64), close=1e-8)
