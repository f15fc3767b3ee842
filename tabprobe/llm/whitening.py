"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

X holds the centred rows, one vector a row; it is never built, and neither is its covariance. Each step multiplies
``X V`` and then ``X' U`` in a distributed pass of its own and keeps both families orthogonal by full
reorthogonalisation, done twice:

- ``W = X V_j`` is freed of all earlier U (first pass: the coefficients ``U' W``; second pass: what is left of them,
  and ``W' W``), and ``W = U_j R_j`` gives the diagonal block of the projection (third pass: ``U_j`` to full
  precision, and ``X' U_j``);
- ``X' U_j`` is freed of all V so far, and ``X' U_j = V_(j+1) Q_j`` gives the block above the diagonal.

A step takes ``width`` vectors at once (with ``width=1`` it is the scalar recurrence and the projection is
bidiagonal; else block bidiagonal, as by Golub, Luk and Overton, 1981), so that the rows are read 3 dimensions / width
times at most and not 3 dimensions times, and so that equal deviations are found. Steps go on until the wanted components
have settled to rounding, or V spans all dimensions. The singular values and right vectors of the small projection
give deviations and components.

A column of U has one entry a row of the table. It is a fixed combination of X's columns, ``U = X P``, so a pass
computes it anew from P (dimensions x steps, on the driver) and the rows it reads: no long vector is stored, and a
lost executor costs only its tasks. Passes return sums, a few numbers a task, combined by Spark.

Entries c become whole numbers ``floor(scale * c) + shift`` first; sums, and each row's squared deviation, are exact.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, as are vectors of
another length than most (ties: the longer) and such with an entry whose whole number has 2 ** 43 or more as its
size; null ids and repeated rows are rows like others; components whose deviation is zero (to 1e-9 of the largest)
are not returned, so that equal rows, a single row or an empty table give an empty result; other columns are not read.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS = 4096
SETTLED = 1e-14
SEED = 5
MOST = 1 << 43


class Centre:
    """Entries as whole numbers about their exact mean; what tasks need of it."""

    def __init__(self, dim: int, scale: float, shift: int):
        self.dim, self.scale, self.shift = dim, scale, shift

    def settle(self, n: int, sums: list[int]) -> None:
        self.n, many = n, max(n, 1)
        self.base = np.array([s // many for s in sums], np.int64)  # mean = base + rest / n
        self.rest = np.array([s % many for s in sums], object)
        self.fraction = np.array([(s % many) / many for s in sums])

    def whole(self, column: pa.Array) -> np.ndarray:
        return np.floor(self.scale * np.asarray(column.flatten()).astype(float)).astype(np.int64).reshape(-1, self.dim) + self.shift

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) ** 2, exactly."""
        d = x - self.base
        if (self.n * (int(np.abs(d).max(initial=0)) + 1)) ** 2 * self.dim < 1 << 63:
            d = self.n * d - self.rest.astype(np.int64)
        else:
            d = self.n * d.astype(object) - self.rest
        return (d ** 2).sum(axis=1).tolist()


class Rows:
    """The vectors, their centre, and what a pass over them sums up."""

    def __init__(self, table: DataFrame, dim: int, scale: float, shift: int):
        self.table, self.dim = table, dim
        self.centre = centre = Centre(dim, scale, shift)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = centre.whole(batch.column("v").slice(at, ROWS))
                    yield pa.record_batch([pa.array(np.arange(-1, dim), pa.int32()), pa.array(np.append(len(x), x.sum(axis=0)))], names=["at", "x"])

        sums = {r["at"]: int(r["x"]) for r in table.select("v").mapInArrow(add, "at int, x long")
                .groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}  # one row a dimension
        centre.settle(sums.pop(-1, 0), [sums.get(i, 0) for i in range(dim)])

    def products(self, right: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, ...]:
        """One pass: with W = X ``right`` and U = X ``basis``, the sums U' W, W' W, X' W, the columns of W and the squares of X."""
        dim, k, b = self.dim, basis.shape[1], right.shape[1]
        shapes = [(k, b), (b, b), (dim, b), (1, b), (1, 1)]
        centre = self.centre

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(r * c for r, c in shapes))
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = centre.centred(centre.whole(batch.column("v").slice(at, ROWS)))
                    w = x @ right
                    parts = (x @ basis).T @ w, w.T @ w, x.T @ w, w.sum(axis=0), np.array([(x ** 2).sum()])
                    total += np.concatenate([p.ravel() for p in parts])
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "x"])

        sums = (self.table.select("v").mapInArrow(multiply, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow())
        flat = np.zeros(sum(r * c for r, c in shapes))
        flat[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
        ends = np.cumsum([r * c for r, c in shapes])
        return tuple(part.reshape(shape) for part, shape in zip(np.split(flat, ends[:-1]), shapes))


def _orthogonal(y: np.ndarray, basis: np.ndarray, width: int, random: np.random.Generator, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(Q, R) with y = Q R + (part within ``basis``), Q orthogonal to ``basis``. Where y gives fewer than ``width``
    columns, random ones that stand for nothing of y (rows of zeros in R) fill up while there are dimensions left."""
    for _ in range(2):
        y = y - basis @ (basis.T @ y)
    u, s, vt = np.linalg.svd(y, full_matrices=False)
    some = s > 1e-13 * scale
    q, r = u[:, some], s[some, None] * vt[some]
    while q.shape[1] < min(width, len(y) - basis.shape[1]):
        extra = random.normal(size=(len(y), 1))
        for _ in range(3):
            have = np.concatenate([basis, q], axis=1)
            extra = extra - have @ (have.T @ extra)
            extra /= np.linalg.norm(extra)
        q, r = np.concatenate([q, extra], axis=1), np.concatenate([r, np.zeros((1, r.shape[1]))])
    have = np.concatenate([basis, q], axis=1)
    return q - basis @ (basis.T @ q) if have.shape[1] else q, r


def bidiagonalise(rows: Rows, components: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of the centred rows, falling; at least ``components``, if there are."""
    random = np.random.default_rng(SEED)
    dim = rows.dim
    none = np.empty((dim, 0))
    v, _ = _orthogonal(none, none, width, random, 1.0)
    all_v, p, xu = none, none, none      # V; U = X p; X' U
    blocks: list[tuple[np.ndarray, np.ndarray]] = []  # (rows of V's block, its diagonal block), and the block above
    above: list[np.ndarray] = []
    scale = 0.0
    while True:
        first = all_v.shape[1]
        all_v = np.concatenate([all_v, v], axis=1)
        inner, *_ = rows.products(v, p)
        left = v - p @ inner
        inner, gram, x_w, _, squares = rows.products(left, p)
        scale = scale or float(np.sqrt(squares[0, 0]))
        gram = gram - inner.T @ inner
        left, x_w = left - p @ inner, x_w - xu @ inner
        # W = U R from W' W; directions that the rows do not have are left out
        size, turn = np.linalg.eigh((gram + gram.T) / 2)
        some = size > (1e-12 * scale) ** 2
        root, turn = np.sqrt(size[some]), turn[:, some]
        u, x_u, r = left @ (turn / root), x_w @ (turn / root), root[:, None] * turn.T
        if some.any():  # once more, as the Gram matrix only tells half the digits
            inner, gram, x_w, *_ = rows.products(u, p)
            low = np.linalg.cholesky(gram - inner.T @ inner)
            back = np.linalg.inv(low).T
            u, x_u, r = (u - p @ inner) @ back, (x_w - xu @ inner) @ back, low.T @ r
        blocks.append((first, p.shape[1], r))
        p, xu = np.concatenate([p, u], axis=1), np.concatenate([xu, x_u], axis=1)
        v, beta = _orthogonal(x_u, all_v, width, random, scale)
        projected = np.zeros((p.shape[1], all_v.shape[1]))
        for n, (column, row, diagonal) in enumerate(blocks):
            projected[row:row + len(diagonal), column:column + diagonal.shape[1]] = diagonal
            if n:
                over = above[n - 1].T
                projected[row - len(over):row, column:column + over.shape[1]] = over
        above.append(beta)
        a, sigma, bt = np.linalg.svd(projected, full_matrices=False)
        if v.shape[1] == 0:
            break
        left_over = np.linalg.norm(beta @ a[p.shape[1] - len(r):, :components], axis=0) if len(r) else np.zeros(1)
        if len(sigma) >= components and (left_over <= SETTLED * sigma[0]).all() and width >= components:
            break
    return sigma, all_v @ bt.T


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           width: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per remaining row and component: ``id_col``, ``component`` (from 1, by falling deviation), ``n`` (rows),
    ``deviation`` (decimal: sum over dimensions of (n x - S) ** 2), ``whitened``, ``explained`` (the component's share of the total
    variance), ``identity_error`` (largest entry by which the whitened rows' covariance differs from the identity)."""
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    whole = F.transform("v", lambda c: F.abs(c.cast("double") * scale))
    fits = F.forall(whole, lambda c: F.coalesce(~F.isnan(c) & (c < MOST - abs(shift)), F.lit(False)))
    usable = base.filter(F.coalesce((F.size("v") > 0) & fits, F.lit(False)))
    common = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 1
    rows = Rows(stored(usable.filter(F.size("v") == dim), "whitening"), dim, scale, shift)
    kind = base.schema["id"].dataType.simpleString()
    centre = rows.centre
    n = centre.n
    deviation, to_white, explained, error = np.empty(0), np.empty((dim, 0)), np.empty(0), 0.0
    if n:
        sigma, axes = bidiagonalise(rows, min(components, dim), min(width, dim))
        some = np.flatnonzero(sigma > 1e-9 * sigma.max(initial=1e-300))[:components]
        deviation = sigma[some] / np.sqrt(n)
        to_white = axes[:, some] / deviation
        _, gram, _, total, squares = rows.products(to_white, np.empty((dim, 0)))
        explained = deviation ** 2 / (squares[0, 0] / n) if len(some) else deviation
        mean = total[0] / n
        error = float(np.abs(gram / n - np.outer(mean, mean) - np.eye(len(some))).max(initial=0))
    k = len(deviation)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                x = centre.whole(batch.column("v"))
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                exact = pa.array([decimal.Decimal(d) for d in centre.deviations(x)], pa.decimal128(38, 0))
                yield pa.record_batch([batch.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                                       pa.array(np.full(m * k, n)), exact.take(each), pa.array((centre.centred(x) @ to_white).ravel()),
                                       pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                                      names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.table.mapInArrow(project, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                     "explained double, identity_error double").withColumnRenamed("id", id_col)
