"""Correlation of the returns of many entities, without entities as columns.

The (time x entity) grid stays long: one row per value. A value's predecessor is the value of the same entity at the
grid time before, found by grouping on (entity, time position), so that no window holds an entity's whole series.

Correlations come from block pairs: positions in the grid are cut into spans of ``TIME_ROWS``, entities into blocks of
``ENTITIES`` (fewer if their matrix had more than ``CELLS`` cells), and an entity's values in a span are one row; a task
builds the two matrices of (span, block, block) and goes over them in tiles of ``TILE`` by ``TILE`` pairs: the sums of both
entities and of their products over the rows where both have a value. So a block may be large: no task holds more than its
two matrices and one tile, and a series is copied once per block, which is what the shuffle writes. Values are moved by
their entity's mean first, so that these sums can be added over spans without loss. The driver only learns how many
entities and spans there are. With one span the sums of a pair are whole in their task, which emits the finished rows in
both directions; with more they are added by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.operators._util import broadcast_if_small, persist
from tabprobe.operators.ranks import row_index
from tabprobe.sources.io import col

TIME_ROWS = 4096
ENTITIES = 8192
CELLS = 2**22
TILE = 256
LEAST_BLOCKS = 8  # few entities are cut into smaller blocks, so that several tasks share the pairs
_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _present(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def long_returns(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """(``entity``, ``time``, position, ret): relative change of an entity's mean value since the grid time before, over
    the sorted distinct times of all rows; NULL where either value is missing. Rows without entity or time take no part."""
    values = (df.filter(col(entity).isNotNull() & col(time).isNotNull())
              .groupBy(col(entity).alias("e"), col(time).alias("t")).agg(F.avg(_present(col(value))).alias("x")))
    values = persist(values)
    times = row_index(values.select("t").distinct(), [], ["t"], name="position")
    placed = values.join(broadcast_if_small(times), "t").select("e", "t", "position", "x")
    # every value is its own row's and the next row's predecessor
    after = placed.select("e", F.lit(None).cast(placed.schema["t"].dataType).alias("t"), (F.col("position") + 1).alias("position"),
                          F.lit(None).cast("double").alias("x"), F.col("x").alias("before"))
    both = placed.withColumn("before", F.lit(None).cast("double")).unionByName(after)
    pairs = both.groupBy("e", "position").agg(F.max("t").alias("t"), F.max("x").alias("x"), F.max("before").alias("before"))
    return pairs.filter("t is not null").select(F.col("e").alias(entity), F.col("t").alias(time), "position",
                                                _present(F.try_divide("x", "before") - 1).alias("ret"))


def complete_rows(returns: DataFrame, entities: int) -> DataFrame:
    """The returns of times at which every entity has one."""
    some = returns.filter("ret is not null")
    full = some.groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    return some.join(full.filter(F.col("n") == entities).select("position"), "position", "left_semi")


def long_correlation(returns: DataFrame, entity: str, *, names: DataFrame | None = None, entities: int = ENTITIES,
                     time_rows: int = TIME_ROWS, digits: int | None = None, tile: int = TILE) -> DataFrame:
    """``var1, var2, n, corr`` for all ordered pairs of entities from rows (``entity``, position, ret), over the positions where
    both have a value; NULL for fewer than two such positions or a constant side. ``digits`` rounds, once a pair."""
    spark = returns.sparkSession
    some = returns.filter("ret is not null").select(col(entity).alias("e"), "position", "ret")
    named = (names.select(col(entity).alias("e")) if names is not None else some.select("e")).distinct()
    index = persist(row_index(named, [], ["e"], name="id").withColumn("id", F.col("id").cast("int")))
    count = index.count()
    last = some.agg(F.max("position")).first()[0] or 0
    spans, depth = last // time_rows + 1, min(time_rows, last + 1)
    entities = max(1, min(entities, CELLS // depth, -(-count // LEAST_BLOCKS)))
    blocks = max(1, -(-count // entities))
    means = some.groupBy("e").agg(F.avg("ret").alias("mean"))
    index = persist(index.join(means, "e", "left"))
    place = F.struct((F.col("position") % time_rows).cast("int").alias("at"), (F.col("ret") - F.col("mean")).alias("x"))
    span = [] if spans == 1 else [F.floor(F.col("position") / time_rows).alias("span")]
    series = (some.join(broadcast_if_small(index, n_rows=count), "e")
              .groupBy("id", *span).agg(F.collect_list(place).alias("cells"))
              .withColumns({"at": F.col("cells.at"), "x": F.col("cells.x")}).drop("cells"))
    # with one span, the task needs names and means, and entities without a value have pairs too
    series = index.join(series, "id", "left") if spans == 1 else series
    cells = (series.withColumn("block", F.floor(F.col("id") / entities).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("block", "other"))

    # what tasks call is defined here, so that workers need not have this module
    def terms(n, sx, sy, sxx, syy, sxy, mean1, mean2):
        """Whether a pair has no correlation (fewer than two rows or a constant side), its covariance and variances, all times
        ``n``; of columns or of arrays."""
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        noise = 1e-28  # of the squared mean: what rounding leaves of a constant series
        flat = (n < 2) | (vx <= n * noise * (mean1 + sx / n) ** 2) | (vy <= n * noise * (mean2 + sy / n) ** 2)
        return flat, sxy - sx * sy / n, vx, vy

    def finished(sums: list[np.ndarray], mean1: np.ndarray, mean2: np.ndarray) -> np.ndarray:
        """Correlations of a tile, NaN where there is none; ``digits`` rounds halves away from zero."""
        with np.errstate(all="ignore"):
            flat, both, vx, vy = terms(*sums, mean1[:, None], mean2)
            r = np.where(flat, np.nan, np.clip(both / (np.sqrt(vx) * np.sqrt(vy)), -1.0, 1.0))
            return r if digits is None else np.copysign(np.floor(np.abs(r) * 10.0**digits + 0.5) / 10.0**digits, r) + 0.0

    def tile_sums(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        hx, hy = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float).T
        x, y = np.nan_to_num(x), np.nan_to_num(y).T
        return [hx @ hy, x @ hy, hx @ y, (x * x) @ hy, hx @ (y * y), x @ y]

    def matrices(a: int, b: int, batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, np.ndarray], pa.Table | None]:
        """The values of both blocks (entity, row), rows without any left out; ids, names and means."""
        held = {k: np.full((min(entities, count - k * entities), depth), np.nan) for k in {a, b}}
        known = []
        for batch in batches:
            ids = batch.column("id").to_numpy()
            of = ids[pc.list_parent_indices(batch.column("at")).to_numpy()]
            at, x = (pc.list_flatten(batch.column(c)).to_numpy() for c in ("at", "x"))
            for k, m in held.items():
                mine = of // entities == k
                m[of[mine] - k * entities, at[mine]] = x[mine]
            if spans == 1:
                known.append(batch.select(["id", "e", "mean"]))
        used = np.logical_or.reduce([~np.isnan(m).all(axis=0) for m in held.values()])
        return {k: m[:, used] for k, m in held.items()}, pa.Table.from_batches(known).sort_by("id") if known else None

    def multiply(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = key[0].as_py(), key[1].as_py()
        held, known = matrices(a, b, batches)
        x, y = held[a], held[b]
        if spans == 1:
            first = known.column("id").to_numpy() // entities == a
            label1, label2 = (known.filter(pa.array(m)).combine_chunks() for m in (first, first if a == b else ~first))
            label1, label2 = ((t.column("e").combine_chunks(), t.column("mean").to_numpy()) for t in (label1, label2))

        def rows(i: int, j: int, names1: pa.Array, names2: pa.Array, n: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
            r = r.ravel()
            return pa.RecordBatch.from_arrays(
                [names1.take(pa.array(np.repeat(np.arange(i, i + n.shape[0]), n.shape[1]))),
                 names2.take(pa.array(np.tile(np.arange(j, j + n.shape[1]), n.shape[0]))),
                 pa.array(n.ravel().astype(np.int64)), pa.array(r, mask=np.isnan(r))], names=["var1", "var2", "n", "corr"])

        for i in range(0, len(x), tile):
            for j in range(i if a == b else 0, len(y), tile):
                sums = tile_sums(x[i:i + tile], y[j:j + tile])
                diagonal = a == b and i == j
                if spans > 1:
                    p, q = np.nonzero(np.triu(sums[0]) > 0 if diagonal else sums[0] > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((p + i + a * entities).astype(np.int32)), pa.array((q + j + b * entities).astype(np.int32)),
                         *[pa.array(m[p, q]) for m in sums]], names=["i", "j", *_SUMS])
                    continue
                r = finished(sums, label1[1][i:i + tile], label2[1][j:j + tile])
                if diagonal:  # both directions of a pair are one computation
                    r = np.where(np.tri(len(r), k=-1, dtype=bool), r.T, r)
                yield rows(i, j, label1[0], label2[0], sums[0], r)
                if not diagonal:
                    yield rows(j, i, label2[0], label1[0], sums[0].T, r.T)

    if spans == 1:
        kind = index.schema["e"].dataType
        result = T.StructType([T.StructField("var1", kind), T.StructField("var2", kind), T.StructField("n", T.LongType()),
                               T.StructField("corr", T.DoubleType())])
        return cells.groupBy("a", "b").applyInArrow(multiply, result)
    part = cells.groupBy("a", "b", "span").applyInArrow(multiply, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    # pairs without a common position keep a row
    ids = spark.range(count).select(F.col("id").cast("int").alias("i"))
    grid = ids.select("i", F.explode(F.sequence("i", F.lit(count - 1))).alias("j"))
    part = grid.join(part.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS]), ["i", "j"], "left")
    known = index.select(F.col("id").alias("i"), F.col("e").alias("var1"), F.col("mean").alias("mean1"))
    joined = (part.join(broadcast_if_small(known, n_rows=count), "i")
              .join(broadcast_if_small(known.toDF("j", "var2", "mean2"), n_rows=count), "j"))
    n = F.col("n")
    flat, xy, vx, vy = terms(*[F.col(s) for s in _SUMS], F.col("mean1"), F.col("mean2"))
    r = F.when(n.isNotNull() & ~flat, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), xy / (F.sqrt(vx) * F.sqrt(vy)))))
    if digits is not None:
        r = F.round(r, digits)
    one, two = F.col("var1"), F.col("var2")
    common = F.coalesce(n, F.lit(0)).cast("long").alias("n"), r.alias("corr")
    upper = joined.select("i", "j", "var1", "var2", *common)
    both = F.array(*[F.struct(a.alias("var1"), b.alias("var2"), "n", "corr") for a, b in ((one, two), (two, one))])
    return upper.select(F.inline(F.when(F.col("i") < F.col("j"), both).otherwise(F.slice(both, 1, 1))))


def return_correlation(df: DataFrame, entity: str, time: str, value: str, complete: bool = True,
                       digits: int | None = None) -> DataFrame:
    """``var1, var2, n, corr``: correlation of the entities' returns over the times at which all entities have one
    (``complete``), or each pair has."""
    returns = persist(long_returns(df, entity, time, value))
    names = returns.select(col(entity)).distinct()
    if complete:
        return long_correlation(complete_rows(returns, names.count()), entity, names=names, digits=digits)
    return long_correlation(returns, entity, names=names, digits=digits)
