"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are put together first. Spherical k-means, fitted on a bounded sample (``SAMPLE`` vectors, smallest id
hashes first), assigns every vector to the cell of the centroid with the largest cosine; the number of cells grows
with the square root of the number of vectors, and of centroids whose cosine is ``sqrt(t)`` or more one is kept, so
that a group of near vectors is not cut up. Two unit vectors of cosine t or more are at most
``d = sqrt(2 - 2t)`` apart, so a vector's partner in another cell lies within d of the plane between the two
centroids, and so does the vector itself. A vector therefore also visits each lower-numbered cell whose plane is
within ``reach = d * min(1, spread / sqrt(dimensions))``: a difference of length d in no special direction leans by
``d / sqrt(dimensions)`` (one standard deviation) towards a plane. With ``spread`` infinite no pair is lost;
README has the recall measured at the default.

A cell's own vectors and its visitors are cut into blocks of about ``BLOCK`` rows; a task multiplies two blocks
(own with own, or own with visitors; a pair of visitors is no business of the cell). What leaves a task is one row a
vector: the number of its links and a node of its group within the blocks, never pairs. Sums of the links and
connected components of the (vector, group) rows give the result. A hot cell spreads over its pairs of blocks.

Defined cases: vectors that are null, zero, of another length than most (ties: the longer) or hold null or
non-finite components link with nothing, nor do rows without an id (their component is null); they are kept.
Equal vectors are linked, repeated rows too. Rows that share an id are one node: a link of either joins
both, ``n_links`` is each row's own. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import stored
from tabprobe.llm.graph import connected_components
from tabprobe.llm.multi_index import _usable
from tabprobe.llm.verify import components_of

THRESHOLD = 0.9
SPREAD = 2.0
SAMPLE = 16_384
MOST_CELLS = SAMPLE // 8
BLOCK = 1024
ROUNDS = 10
SEED = 11


def unit_rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors as rows of length 1, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten()).astype(float).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # squares neither overflow nor vanish
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def spherical_k_means(u: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows: rows go to the largest cosine, centroids to their rows' mean direction. A
    centroid without rows, or whose rows cancel out, stays where it is."""
    u = np.unique(u, axis=0)
    if not len(u):
        return u
    c = u[np.random.default_rng(SEED).permutation(len(u))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(u[i:i + BLOCK] @ c.T, axis=1) for i in range(0, len(u), BLOCK)])
        total = np.stack([np.bincount(near, weights=u[:, j], minlength=len(c)) for j in range(u.shape[1])], axis=1)
        size = np.sqrt((total ** 2).sum(axis=1))
        some = size > 1e-9
        c[some] = total[some] / size[some, None]
    return c


def far_apart(c: np.ndarray, near: float) -> np.ndarray:
    """The centroids, in order, without those whose cosine with one that stays is ``near`` or more."""
    stays = np.ones(len(c), bool)
    for i in range(len(c)):
        if stays[i]:
            stays[i + 1:] &= c[i + 1:] @ c[i] < near
    return c[stays]


def cells_of(u: np.ndarray, c: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell, row, visited cell): each row's cell, and the lower-numbered cells whose plane is within reach."""
    s = u @ c.T
    home = np.argmax(s, axis=1)
    own = s[np.arange(len(u)), home]
    near = own[:, None] - s <= reach * apart[home] + 1e-12
    near &= np.arange(len(c))[None] < home[:, None]
    return home, *np.nonzero(near)


def forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's group; ``hits[i, j]`` links the nodes ``left[i]`` and ``right[j]``. Each round,
    every row and column with a partner outside its group takes the first one."""
    root, a, b = np.arange(n), np.empty(0, np.int64), np.empty(0, np.int64)
    while True:
        out = hits & (root[left][:, None] != root[right][None])
        rows, cols = np.flatnonzero(out.any(axis=1)), np.flatnonzero(out.any(axis=0))
        if not len(rows):
            return root
        a = np.concatenate([a, left[rows], right[cols]])
        b = np.concatenate([b, right[out[rows].argmax(axis=1)], left[out[:, cols].argmax(axis=0)]])
        root = components_of(a, b, n)


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 spread: float = SPREAD, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, ``n_links`` (other rows found with a cosine of ``threshold`` or more),
    ``component_id`` (smallest id reachable by links, its own included) and ``kept`` (whether that is its own)."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    usable = base.filter(F.col("id").isNotNull() & F.coalesce(_usable(F.col("v")), F.lit(False)))
    common = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 1
    usable = usable.filter(F.size("v") == dim)
    classes = stored(usable.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("v")), "vectors")
    total = classes.count()
    taken = classes.orderBy(F.xxhash64("id"), "id", "h").limit(sample).select("v").toArrow()
    points = unit_rows(taken.column("v"), dim)
    wanted = cells or min(max(1, math.ceil(math.sqrt(total) / 2)), MOST_CELLS)
    centroids = far_apart(spherical_k_means(points, wanted), math.sqrt(threshold))
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))  # at most MOST_CELLS squared
    reach = math.sqrt(2 - 2 * threshold) * min(1.0, spread / math.sqrt(dim))
    kind, id_kind = base.schema["v"].dataType.simpleString(), base.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                home, row, cell = cells_of(unit_rows(batch.column("v"), dim), centroids, apart, reach)
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([*batch.columns, pa.array(home.astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(cell.astype(np.int32)))],
                                      names=["id", "h", "n", "v", "home", "visits"])

    placed = stored(classes.select("id", "h", "n", "v").mapInArrow(
        assign, f"id {id_kind}, h long, n long, v {kind}, home int, visits array<int>"), "cells")

    # own and visiting blocks of each cell: at most MOST_CELLS rows
    parts = {"own": {}, "visiting": {}}
    at = {"own": placed.groupBy(F.col("home").alias("cell")).count(),
          "visiting": placed.select(F.explode("visits").alias("cell")).groupBy("cell").count()}
    for side, counts in at.items():
        parts[side] = {r["cell"]: -(-r["count"] // block) for r in counts.collect()}
    layout = spark.createDataFrame([(c, own, parts["visiting"].get(c, 0)) for c, own in parts["own"].items()],
                                   "cell int, own int, visiting int")

    own, visiting = F.col("own"), F.col("visiting")
    mine = F.pmod(F.col("h"), own).cast("int")
    as_left = F.transform(F.sequence(mine, own + visiting - 1), lambda b: F.struct(mine.alias("a"), b.alias("b"), F.lit(True).alias("left")))
    as_right = F.when(mine > 0, F.transform(F.sequence(F.lit(0), mine - 1), lambda a: F.struct(a.alias("a"), mine.alias("b"), F.lit(False).alias("left"))))
    as_guest = F.transform(F.sequence(F.lit(0), own - 1), lambda a: F.struct(
        a.alias("a"), (own + F.pmod(F.col("h"), visiting)).cast("int").alias("b"), F.lit(False).alias("left")))
    row = ["id", "h", "n", "v", "cell"]
    homes = placed.withColumnRenamed("home", "cell").join(F.broadcast(layout), "cell").select(
        *row, F.explode(F.concat(as_left, F.coalesce(as_right, F.array().cast("array<struct<a:int,b:int,left:boolean>>")))).alias("t"))
    guests = placed.withColumn("cell", F.explode("visits")).join(F.broadcast(layout), "cell").select(*row, F.explode(as_guest).alias("t"))

    def multiply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        u, n = unit_rows(table.column("v"), dim), table.column("n").to_numpy()
        left = np.flatnonzero(table.column("left").to_numpy())
        same = table.column("a")[0] == table.column("b")[0]
        right = left if same else np.flatnonzero(~table.column("left").to_numpy().astype(bool))
        hits = u[left] @ u[right].T >= threshold
        if same:
            np.fill_diagonal(hits, False)
        links = np.zeros(len(u), np.int64)
        links[left] += hits @ n[right]
        if not same:
            links[right] += hits.T @ n[left]
        some = pa.array(np.flatnonzero(links))
        group = pa.array(forest(hits, left, right, len(u))[links > 0])
        return pa.table({"id": table.column("id").take(some), "h": table.column("h").take(some),
                         "links": pa.array(links[links > 0]), "other": table.column("id").take(group)})

    found = stored(homes.unionByName(guests).select(*row, "t.*").groupBy("cell", "a", "b")
                   .applyInArrow(multiply, f"id {id_kind}, h long, links long, other {id_kind}"), "links")

    links = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    # stored, so that the join reads both sides anew and the rows of a hot vector can be split over tasks
    known = stored(classes.join(links, ["id", "h"], "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
                   .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                           F.coalesce("root", "id").alias("component_id")), "known")
    with_links = usable.join(known, "v").select("id", "n_links", "component_id")
    takes_part = F.col("id").isNotNull() & F.coalesce(_usable(F.col("v")), F.lit(False)) & (F.size("v") == dim)
    alone = base.filter(~F.coalesce(takes_part, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return with_links.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                                F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
