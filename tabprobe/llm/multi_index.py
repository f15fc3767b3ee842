"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each by ``CENTROIDS`` centroids, so that a row lies in one of
``CENTROIDS`` ** 2 cells. A query walks the cells by rising sum of its two centroid distances, with a heap over
centroid pairs, until the cells seen hold the share ``VISIT`` of all rows, and the rows in them are ranked by
their true distance. A share, not a number, so that recall is alike at every size; README has the recall measured.

Centroids are fitted on a bounded sample (``SAMPLE`` rows, smallest id hashes first); every row is indexed. Cells
are laid end to end and cut into bins of ``BIN_ROWS`` rows, so that a hot cell spreads over bins and small cells
share one. Bins meet at most ``QUERY_ROWS`` queries at a time; what leaves a bin is k rows a query.

Defined cases: vectors that are null, zero, of another length than most of the sample or hold null or
non-finite components take no part, nor do rows without an id; rows with the query's id are its own and no
candidates; ties go to the smaller id; repeated rows are candidates each; with fewer than k candidates all are
returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm._common import stored

CENTROIDS = 64
SAMPLE = 16_384
VISIT = 0.5
BIN_ROWS = 4096
QUERY_ROWS = 2048
ROUNDS = 15
SEED = 7


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(-1, dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None] - 2 * a @ b.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's centroids from distinct rows; a centroid that loses all its rows stays where it is."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(SEED).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin(_squares(x, c), axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, need: int) -> list[int]:
    """Cells (i * len(second) + j) by rising ``first[i] + second[j]`` until they hold ``need`` rows: the pairs of
    sorted distances are a grid, and a pair enters the heap once both its smaller neighbours have left it."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, rows = first[a].tolist(), second[b].tolist(), sizes[a][:, b].tolist()
    heap, reached, found, seen = [(x[0] + y[0], 0, 0)], [0] * len(x), [], 0
    while heap and seen < need:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1  # row i has given its pairs up to j
        if rows[i][j]:
            found.append(int(a[i]) * len(y) + int(b[j]))
            seen += rows[i][j]
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return found


def _usable(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(d, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
           visit: float = VISIT, centroids: int = CENTROIDS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, ``id_col``, score): the k rows found nearest (Euclidean, in double precision) to each row of
    ``vectors`` for which the condition ``queries`` holds."""
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("asks"))
    usable = base.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    taken = usable.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    lengths = [len(r["v"]) for r in taken]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n)) if taken else 0
    half = dim // 2
    points = np.array([r["v"] for r in taken if len(r["v"]) == dim], float).reshape(-1, max(dim, 1))
    books = [k_means(p, centroids) if p.shape[1] and len(p) else np.zeros((1, p.shape[1])) for p in (points[:, :half], points[:, half:])]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            near = [np.argmin(_squares(p, c), axis=1) for p, c in zip((x[:, :half], x[:, half:]), books)]
            yield pa.record_batch([*batch.columns, pa.array(near[0] * len(books[1]) + near[1], pa.int32())],
                                  names=["id", "v", "asks", "cell"])

    kind = usable.schema["v"].dataType.simpleString()
    rows = stored(usable.filter(F.size("v") == dim).mapInArrow(assign, f"id long, v {kind}, asks boolean, cell int"), "cells")

    # at most centroids ** 2 rows, whatever the input
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    asked = 0
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks")).collect():
        sizes[r["cell"]] = r["n"]
        asked += r["asks"]
    start = np.concatenate([[0], np.cumsum(sizes)])
    need = max(int(np.ceil(visit * start[-1])), min(int(start[-1]), 8 * k))
    parts = max(1, -(-asked // QUERY_ROWS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = sizes.reshape(len(books[0]), len(books[1]))
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            d = [_squares(p, c) for p, c in zip((x[:, :half], x[:, half:]), books)]
            for n in range(batch.num_rows):
                cells = np.array(walk(d[0][n], d[1][n], grid, need), np.int64)
                first, last = start[cells] // BIN_ROWS, (start[cells + 1] - 1) // BIN_ROWS
                spread = np.repeat(cells, last - first + 1)
                bins = np.repeat(first, last - first + 1) + np.concatenate([np.arange(m) for m in last - first + 1])
                order = np.argsort(bins, kind="stable")
                named, cut = np.unique(bins[order], return_index=True)
                where = pa.array(np.full(len(named), n))
                yield pa.record_batch([batch.column("id").take(where), batch.column("v").take(where), pa.array(named, pa.int64()),
                                       pa.ListArray.from_arrays(np.append(cut, len(bins)).astype(np.int32), pa.array(spread[order], pa.int32()))],
                                      names=["id", "v", "bin", "cells"])

    layout = rows.sparkSession.createDataFrame(
        [(int(c), int(start[c]), int(sizes[c])) for c in np.flatnonzero(sizes)], "cell int, first long, n long")
    entries = (rows.join(F.broadcast(layout), "cell")
               .withColumn("bin", F.floor((F.col("first") + F.pmod(F.xxhash64("id"), "n")) / BIN_ROWS).cast("long"))
               .select("id", "v", "cell", "bin", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")))
    asking = (rows.filter("asks").select("id", "v").mapInArrow(ask, f"id long, v {kind}, bin long, cells array<int>")
              .withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")))

    def rank(found: pa.Table, posed: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if found.num_rows and posed.num_rows:
            x, q = _matrix(found.column("v").combine_chunks(), dim), _matrix(posed.column("v").combine_chunks(), dim)
            ids, cells = found.column("id").to_numpy(), found.column("cell").to_numpy()
            lists = posed.column("cells").combine_chunks()
            cut, flat = np.asarray(lists.offsets) - lists.offsets[0].as_py(), np.asarray(lists.flatten())
            for n, own in enumerate(posed.column("id").to_numpy()):
                near = np.flatnonzero(np.isin(cells, flat[cut[n]:cut[n + 1]]) & (ids != own))
                if not len(near):
                    continue
                score = np.sqrt(((x[near] - q[n]) ** 2).sum(axis=1))
                best = near_k(score, ids[near], k)
                out["query_id"].append(np.full(len(best), own))
                out["id"].append(ids[near][best])
                out["score"].append(score[best])
        kinds = {"query_id": np.int64, "id": np.int64, "score": float}
        return pa.table({c: np.concatenate(v) if v else np.empty(0, kinds[c]) for c, v in out.items()})

    local = (entries.groupBy("bin", "part").cogroup(asking.groupBy("bin", "part"))
             .applyInArrow(rank, "query_id long, id long, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")


def near_k(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties by id."""
    some = np.arange(len(score))
    if len(score) > k:
        some = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
    return some[np.lexsort((ids[some], score[some]))][:k]
