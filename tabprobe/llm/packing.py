"""Packing of documents into fixed-length sequences along a space-filling curve.

Each document's words are hashed into a frequency vector, projected to ``AXES`` dimensions by fixed random signs and
placed on a Hilbert curve. Documents are range-partitioned by that key (ties by the id's hash, so that copies of one text
spread over partitions; the ranges come from ``SAMPLE`` documents, which only decides how even they are), sorted,
tokenised where they land, and cut one after the other into sequences of ``LENGTH`` ids. Only the last sequence of a
partition is shorter, which is all the padding there is.

Every id of every document, with the end id behind it, lies in exactly one piece. Sequence numbers are the
partition's number and a count in it; the order in a partition is fixed by key, id and text, so that a task that
runs again cuts alike.

Defined cases: a null text is empty and gives the end id alone; a null id is kept and sorts first; very long texts
give many pieces; repeated rows are packed each for itself; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tabprobe.llm._common import chunks_by_bytes, small_batches, text_array, word_codes, word_hashes
from tabprobe.llm.tokenizing import encoder

LENGTH = 2048
END_ID = 1
AXES = 4
BITS = 15  # AXES * BITS < 64
FEATURES = 1 << 12
SEED = 99
SAMPLE = 20_000


def projected(texts: pa.Array) -> np.ndarray:
    """Texts x AXES: hashed word frequencies, projected on random signs; a text without words is the origin."""
    codes, offsets, dictionary = word_codes(texts)
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (FEATURES, AXES))
    own = signs[(word_hashes(dictionary) % np.uint64(FEATURES)).astype(np.int64)]
    n = np.maximum(np.diff(offsets), 1)
    return np.stack([np.diff(np.concatenate([[0], np.cumsum(own[:, k][codes])])[offsets]) / n for k in range(AXES)], axis=1)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of whole-number points (n x axes, below 2 ** bits): Skilling,
    "Programming the Hilbert curve" (2004), for all points at once."""
    x = points.astype(np.int64).copy()
    axes = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the larger cells
        p = q - 1
        for i in range(axes):
            up = (x[:, i] & q) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(up, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, axes):  # Gray code
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, axes - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    squashed = (1 + np.tanh(4 * projected(texts))) / 2
    return hilbert_keys(np.minimum(squashed * (1 << BITS), (1 << BITS) - 1).astype(np.int64))


def _cuts(keyed: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The (key, tie) pairs at which the partitions after the first begin, for about equal bytes."""
    key, tie, size = (keyed.column(c).to_numpy() for c in ("key", "tie", "size"))
    order = np.lexsort((tie, key))
    total = np.cumsum(size[order] + 1.0)
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts) if len(order) else np.empty(0, np.int64)
    return key[order][at], tie[order][at]


def _partition(key: np.ndarray, tie: np.ndarray, cut_keys: np.ndarray, cut_ties: np.ndarray) -> np.ndarray:
    low, high = (np.searchsorted(cut_keys, key, side) for side in ("left", "right"))
    out = low.copy()
    for row in np.flatnonzero(low < high):  # keys at which a partition begins: the tie decides
        out[row] += np.searchsorted(cut_ties[low[row]:high[row]], tie[row], "right")
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``id_col``, ``start`` (the document's ids before it), ``length``, ``ids`` (binary,
    little-endian unsigned 32 bits), ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence), ``curve_key``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("id"))

    # where partitions begin only decides how even they are: a bounded sample of documents will do
    chosen = texts.select("id").dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)

    @F.arrow_udf(LongType())
    def key_of(column: pa.Array) -> pa.Array:
        return pa.array(curve_keys(text_array(column)))

    # one row an id, so that an id that holds many rows adds one to what the driver gets
    sampled = (texts.join(F.broadcast(chosen), "id", "left_semi").groupBy("id", "tie").agg(F.min("text").alias("text"))
               .select(key_of("text").alias("key"), "tie", F.octet_length("text").alias("size")).toArrow())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(sampled, parts)

    @F.arrow_udf("key long, part int")
    def placed(column: pa.Array, tie: pa.Array) -> pa.Array:
        keys = curve_keys(text_array(column))
        part = _partition(keys, tie.to_numpy(), *cuts)
        return pa.StructArray.from_arrays([pa.array(keys), pa.array(part, pa.int32())], ["key", "part"])

    keyed = texts.withColumn("at", placed("text", "tie")).select("id", "text", F.col("at.key").alias("key"), F.col("at.part").alias("part"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, filled = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                ids, offsets = encoder(tokenizer_path).encode(text_array(batch.column("text")))
                # all documents end to end, each with its end id; pieces end with documents and with sequences
                begin = offsets + np.arange(len(offsets))
                own = np.full(begin[-1], end_id, "<u4")
                inner = np.ones(len(own), bool)
                inner[begin[1:] - 1] = False
                own[inner] = ids
                cut_at = np.unique(np.concatenate([begin, np.arange(length - filled, len(own), length)]))
                at = cut_at[:-1]
                d = np.searchsorted(begin, at, "right") - 1
                pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((4 * cut_at).astype(np.int32)), pa.py_buffer(own)])
                columns = [at - begin[d], np.diff(cut_at), pieces, np.diff(begin)[d], sequence + (filled + at) // length, (filled + at) % length]
                sequence, filled = sequence + (filled + len(own)) // length, (filled + len(own)) % length
                yield pa.record_batch([batch.column("id").take(pa.array(d)), *[pa.array(c) for c in columns], batch.column("key").take(pa.array(d))],
                                      names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve_key"])

    return (keyed.repartitionById(parts, "part").drop("part").sortWithinPartitions("key", "id", "text")
            .mapInArrow(cut, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, "
                             "offset long, curve_key long").withColumnRenamed("id", id_col))
