"""N-gram Jaccard self-join of documents by MinHash banding.

1. Each text becomes its set of hashed n-grams of lower-case words and a MinHash signature, cut into bands.
   Texts with the same words in the same order are copies: only one representative goes on.
2. ``bands_for`` picks bands and rows for a target recall at the threshold. Band hashes are shuffled; each
   representative is tied to the smallest one of its bucket, so that a bucket of m rows gives m - 1 candidate
   ties and not m * m pairs.
3. The representatives of a group of tied ones are compared with each other on their full n-gram sets, block
   against block of bounded size, which finds each link at or above the threshold, also those whose own bands
   missed. A block pair returns link counts and a spanning forest, not its pairs.
4. Connected components of the forests are the classes.

A text of one to ``n - 1`` words is one n-gram of all its words.

Defined cases: null, empty and blank texts have no n-grams and link to nothing, not even to each other; a row
with a null id is a class of its own without links; rows that repeat an id are one document to the graph, and
each of them gets that document's row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import chunks_by_bytes, distinct, mixed, small_batches, stored, text_array, word_codes, word_hashes
from tabprobe.llm.graph import connected_components

N = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 128
BLOCK_ROWS = 256
BLOCK_NGRAMS = 400_000
BUCKETS = 1 << 20
SEED = 20240613


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, for which at most ``most_hashes``
    hashes find a pair at the threshold with probability ``recall``. An error where no choice does."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError(f"threshold {threshold} or recall {recall} is not a share")
    best = None
    for rows in range(1, most_hashes + 1):
        hit = threshold ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-hit))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most_hashes} hashes do not find pairs of similarity {threshold} with probability {recall}")
    return best


def ngrams(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets, digests): text i has the n-grams ``hashes[offsets[i]:offsets[i + 1]]``, in order and
    with repeats; ``digests`` is texts x 2 hashes of the whole word sequence."""
    codes, offsets, dictionary = word_codes(texts)
    h, count = word_hashes(dictionary)[codes], np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(codes)) - offsets[doc]
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), np.uint64)
        for k in range(n):  # positions beyond the text's end stay out, so that short texts give one n-gram
            rolled *= np.uint64(0x9E3779B97F4A7C15)
            ahead = np.zeros(len(h), np.uint64)
            ahead[:max(len(h) - k, 0)] = h[k:]
            rolled += np.where(place + k < count[doc], ahead + np.uint64(k + 1), np.uint64(0))
        starts = np.flatnonzero(place <= np.maximum(count[doc] - n, 0))
        digests = np.zeros((len(texts), 2), np.uint64)
        for j, salt in enumerate((0x632BE59BD9B4E019, 0xD6E8FEB86659FD93)):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h + mixed(place.astype(np.uint64) * np.uint64(salt) + np.uint64(1))))])
            digests[:, j] = total[offsets[1:]] - total[offsets[:-1]]
    return mixed(rolled[starts]), np.concatenate([[0], np.cumsum(np.bincount(doc[starts], minlength=len(texts)))]), digests


def signatures(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Texts x bands hashes of the MinHash signatures of non-empty sets."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    out = np.empty((len(offsets) - 1, bands), np.uint64)
    first = 0
    while first < len(out):  # about 1 MB of n-grams at a time, whole texts
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + 131_072, "right")) - 1)
        x, cut = hashes[offsets[first]:offsets[last]], offsets[first:last] - offsets[first]
        with np.errstate(over="ignore"):
            for band in range(bands):
                key = np.full(last - first, band + 1, np.uint64)
                for k in range(band * rows, (band + 1) * rows):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * a[k] + b[k], cut))
                out[first:last, band] = key
        first = last
    return out


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                hashes, offsets, digests = ngrams(text_array(batch.column("text")), n)
                size = np.diff(offsets)
                some = np.flatnonzero(size)
                keys = signatures(hashes, np.concatenate([[0], np.cumsum(size[some])]), bands, rows).view(np.int64)
                cut = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                yield pa.record_batch({"id": batch.column("id"), "d1": pa.array(digests[:, 0].view(np.int64)),
                                       "d2": pa.array(digests[:, 1].view(np.int64)), "size": pa.array(size, pa.int64()),
                                       "bands": pa.ListArray.from_arrays(cut, pa.array(keys.ravel()))})

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, d1 long, d2 long, size long, bands array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _linked(group: pa.Table, threshold: float) -> tuple[list, list, list]:
    """Rows (a, b, links): a's links in this block pair with b null, and a spanning forest with links 0."""
    ids = group.column("rep").combine_chunks()
    sets = group.column("ngrams").combine_chunks()
    block, copies = group.column("block").to_numpy(), group.column("copies").to_numpy()
    cut = np.asarray(sets.offsets).astype(np.int64)
    size = np.diff(cut)
    order = np.argsort(size, kind="stable")
    _, codes = np.unique(np.asarray(sets.flatten()), return_inverse=True)
    flat = np.concatenate([codes[cut[i] - cut[0]:cut[i + 1] - cut[0]] for i in order])
    size, block, copies = size[order], block[order], copies[order]
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(codes.max() + 1, np.int8)
    links, parent = np.zeros(len(size), np.int64), np.arange(len(size))
    a_out, b_out = [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    across = group.column("i")[0] != group.column("j")[0]
    for i in range(len(size)):
        last = int(np.searchsorted(size, size[i] / threshold + 1e-9, "right"))  # larger sets within the length bound
        if last <= i + 1:
            continue
        own = flat[start[i]:start[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat[start[i + 1]:start[last]]], start[i + 1:last] - start[i + 1], dtype=np.int64)
        mark[own] = 0
        union = size[i] + size[i + 1:last] - shared
        hit = shared >= threshold * union - 1e-9
        if across:  # pairs inside a block belong to that block's own group
            hit &= block[i + 1:last] != block[i]
        near = np.flatnonzero(hit) + i + 1
        links[i] += copies[near].sum()
        links[near] += copies[i]
        for j in near:
            x, y = root(i), root(int(j))
            if x != y:
                parent[x] = y
                a_out.append(i)
                b_out.append(int(j))
    some = np.flatnonzero(links)
    a = np.concatenate([order[some], order[np.array(a_out, int)]])
    b = [None] * len(some) + order[np.array(b_out, int)].tolist()
    return ids.take(pa.array(a)), ids.take(pa.array(b, pa.int64())), np.concatenate([links[some], np.zeros(len(a_out), np.int64)])


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N,
               threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``class_id`` (smallest id of the connected documents),
    ``rep_id`` (smallest id of the texts with the same words), ``n_links`` (other documents whose n-gram sets
    have a Jaccard similarity of ``threshold`` or more, copies included) and ``n_ngrams`` (with repeats)."""
    bands, rows = bands_for(threshold, recall)
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = stored(_signed(texts, n, bands, rows), "signatures")
    reps = stored(signed.filter("size > 0 and id is not null").groupBy("d1", "d2").agg(
        F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.max("size").alias("size"),
        F.count(F.lit(1)).alias("copies")), "reps")

    keys = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    ties = keys.join(buckets, "key").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    tied = connected_components(ties)

    # one row per document to compare, with its group's number of blocks
    members = (reps.groupBy("rep").agg(F.max("size").alias("size"), F.sum("copies").alias("copies"))
               .join(tied.withColumnRenamed("node", "rep"), "rep"))
    members = stored(members, "members")
    blocks = members.groupBy("root").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / BLOCK_ROWS, F.sum("size") / BLOCK_NGRAMS)).cast("int").alias("blocks"))
    placed = members.join(blocks, "root").select(
        "rep", "copies", "root", "blocks", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"))

    # texts of the members only: a fixed number of flags first, so that few others are shuffled
    flag = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).alias("flag")
    flags = members.select(F.col("rep").alias("id")).select(flag).distinct()
    needed = texts.withColumn("flag", flag).join(F.broadcast(flags), "flag", "left_semi").select("id", "text")
    needed = needed.join(placed.withColumnRenamed("rep", "id"), "id")
    kind = docs.schema[id_col].dataType.simpleString()

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                hashes, offsets, _ = ngrams(text_array(batch.column("text")), n)
                sets = [distinct(hashes[a:b]) for a, b in zip(offsets, offsets[1:])]
                cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                yield pa.record_batch([batch.column(c) for c in ("id", "copies", "root", "blocks", "block")]
                                      + [pa.ListArray.from_arrays(cut, pa.array(values))],
                                      names=["rep", "copies", "root", "blocks", "block", "ngrams"])

    sets = needed.mapInArrow(with_sets, f"rep {kind}, copies long, root {kind}, blocks int, block int, ngrams array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = sets.select("rep", "copies", "root", "block", "ngrams", other.alias("other")).select(
        "rep", "copies", "root", "block", "ngrams", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["root", "i", "j"]):
            a, b, links = _linked(group, threshold)
            if len(a):
                yield pa.record_batch({"a": a, "b": b, "links": pa.array(links)})

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(pairs.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
                   .mapInArrow(compare, f"a {kind}, b {kind}, links long"), "links")
    classes = connected_components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = (reps.select("d1", "d2", "rep", "copies").join(links, "rep", "left")
             .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
             .select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "rep", F.coalesce("root", "rep").alias("class"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")))
    known = stored(known, "classes")
    return signed.join(known, (F.col("size") > 0) & F.col("id").isNotNull() & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left").select(
        F.col("id").alias(id_col), F.coalesce("class", "id").alias("class_id"), F.coalesce("rep", "id").alias("rep_id"),
        F.coalesce("n", F.lit(0)).alias("n_links"), F.col("size").alias("n_ngrams"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is their class's smallest, with all their columns. A fixed number of flags
    of the ids to drop is broadcast; only flagged rows are shuffled."""
    drop = stored(ngram_join(docs, id_col=id_col, text_col=text_col, **options)
                  .filter(f"class_id <> `{id_col}`").select(F.col(f"`{id_col}`").alias("drop")).distinct(), "drop")
    flags = drop.select(F.pmod(F.xxhash64("drop"), F.lit(BUCKETS)).alias("flag")).distinct().withColumn("hit", F.lit(True))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    marked = rows.withColumn("flag", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).join(F.broadcast(flags), "flag", "left")
    kept = marked.filter("hit").join(drop, F.col("id") == F.col("drop"), "left_anti")
    return marked.filter("hit is null").select("row").unionByName(kept.select("row")).select("row.*")
