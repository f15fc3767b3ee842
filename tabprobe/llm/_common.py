"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage
    and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long: hand Python at most ``rows`` at a time, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for texts without multi-byte characters."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_array(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with nulls as empty texts."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    return pc.fill_null(a.cast(pa.large_string()), "")


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """White-space words of each text as (codes, offsets, dictionary): the words of text i
    are ``dictionary[codes[offsets[i]:offsets[i + 1]]]``."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    counts = np.concatenate([[0], np.cumsum(full)])
    starts = np.asarray(lists.offsets).astype(np.int64)
    enc = flat.filter(pa.array(full)).dictionary_encode()
    return enc.indices.to_numpy().astype(np.int64), counts[starts - starts[0]], enc.dictionary


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each word: the mixed sum of mixed (byte, place) pairs, all words at once."""
    if not len(dictionary):
        return np.empty(0, np.uint64)
    words = dictionary.cast(pa.large_binary())
    cut = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[cut[0]:cut[-1]]
    size, start = np.diff(cut), cut[:-1] - cut[0]
    place = (np.arange(len(raw)) - np.repeat(start, size)).astype(np.uint64)
    each = mixed(place * np.uint64(0x9E3779B97F4A7C15) + raw.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(words), np.uint64)
    some = size > 0
    if some.any():
        total[some] = np.add.reduceat(each, start[some])
    return mixed(total + size.astype(np.uint64))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; for whole numbers faster than numpy's hashing ``unique``."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (SplitMix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks_by_bytes(batch: pa.RecordBatch, column: str, most: int = 2_000_000):
    """Slices of a batch whose texts take about ``most`` bytes together; a longer single
    text makes a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
