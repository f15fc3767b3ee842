"""Near-duplicate lines by an exact set-similarity self-join.

A line is the set of its lower-case words. Lines with the same set are copies; of the distinct sets, those with a
Jaccard similarity of ``THRESHOLD`` or more are linked, and a line goes if an earlier line (by id, then line number)
has its set or a linked one.

1. One pass gives each line's 128-bit set fingerprint and counts in how many lines each word occurs, in
   ``BUCKETS`` hashed counters. Words are ordered by (counter, hash): collisions only make that order less sharp.
2. A set of n words is posted under its first ``n - ceil(t * n) + 1`` words in that order: two similar sets share one
   of them (prefix filter). In a word's group, pairs pass the length filter, the positional filter and a bound on
   the symmetric difference from 128-bit parity maps; none of them loses a similar pair. What passes is handed on as
   a spanning forest, not as pairs. Groups of frequent words are cut into blocks, pair of blocks by pair. Postings
   are shuffled packed, a row for each bucket of words and hand-out of a task.
3. Sets in one component of these candidates are compared in full, block against block of bounded size.

Words are 64-bit hashes and sets 128-bit sums of them; nothing is dropped, capped or sampled.

Defined cases: null texts and blank lines have no words, link to nothing and stay; rows with a null id take no part
and their lines stay; rows that repeat an id each have their lines, and lines of one id and number do not
remove each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import chunks_by_bytes, mixed, small_batches, stored, text_array
from tabprobe.llm.graph import connected_components
from tabprobe.llm.verify import components_of, groups, links_of

THRESHOLD = 0.8
BUCKETS = 1 << 20
FLAGS = 1 << 20
GROUP_ROWS = 4096
BLOCK_SETS = 256
CHUNK_BYTES = 4_000_000  # of texts at a time: copies within a chunk are posted once
BLOCK_WORDS = 400_000
COMPARED_ROWS = 200_000
SLICE = 4096  # counters in a row
POSTED_ROWS = 500_000  # postings of a task that are dealt at a time
BUCKET_ROWS = 100_000  # word places of all prefixes for each bucket of postings


SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACES = [int.from_bytes(c.encode().ljust(3, b"\0")) for c in SPACES]
PIECES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of a word's next n bytes


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line break between two, a space before and eight behind; and where each text begins."""
    ended = pc.binary_join_element_wise(texts, *(pa.scalar(x, texts.type) for x in ("", "\n")))  # each text and a line break
    cut = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset:ended.offset + len(ended) + 1]
    size = int(cut[-1] - cut[0]) - 1
    raw = np.full(size + 9, 32, np.uint8)
    raw[1:size + 1] = np.frombuffer(ended.buffers()[2], np.uint8)[cut[0]:cut[-1] - 1]
    return raw, cut[:-1] - cut[0] + 1


def _spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes are white space, or part of it."""
    space = (raw <= 32) & (raw >= 9) & ((raw <= 13) | (raw >= 28))
    if raw.max() >= 0xC2:
        for lead, n in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
            at = np.flatnonzero(raw == lead)
            code = raw[at].astype(np.int64) << 16 | raw[at + 1].astype(np.int64) << 8 | (raw[at + 2].astype(np.int64) if n == 3 else 0)
            at = at[np.isin(code, LONG_SPACES)]
            for k in range(n):
                space[at + k] = True
    return space


def _hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A stable 64-bit hash of each word of ``raw``: the mixed sum of its mixed pieces of 8 bytes."""
    piece = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the 8 bytes from each place on
    total = mixed(piece[begin] & PIECES[np.minimum(size, 8)])
    more = np.flatnonzero(size > 8)
    if len(more):
        count = (size[more] - 1) // 8
        first = np.cumsum(count) - count
        of = np.repeat(more, count)
        past = 8 * (np.arange(len(of)) - np.repeat(first, count) + 1)
        rest = piece[begin[of] + past] & PIECES[np.minimum(size[of] - past, 8)]
        total[more] += np.add.reduceat(mixed(rest + past.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    return mixed(total + size.astype(np.uint64))


class Lines:
    """The lines of a batch of texts as sets of words: lower-case, cut at Unicode white space."""

    def __init__(self, texts: pa.Array, ranks: np.ndarray | None = None):
        raw, first = _joined(pc.utf8_lower(texts))
        breaks = np.flatnonzero(raw == 10)
        starts = np.searchsorted(breaks, first)  # the line that each text begins with
        per_text = np.diff(np.append(starts, len(breaks) + 1))
        self.text = np.repeat(np.arange(len(texts)), per_text)
        self.number = np.arange(len(self.text)) - np.repeat(starts, per_text)
        word = ~_spaces(raw)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        begin = edge[::2]
        h = _hashes(raw, begin, edge[1::2] - begin)
        line = np.repeat(np.arange(len(self.text)), np.diff(np.concatenate([[0], np.searchsorted(begin, breaks), [len(begin)]])))
        # sorted by line and hash, with ranks by line, rank of the word's bucket and hash: as much of that as 64 bits hold ...
        left = 64 - len(self.text).bit_length()
        key = line.astype(np.uint64) << np.uint64(left)
        if ranks is not None:
            left -= BUCKETS.bit_length() - 1
            key |= ranks[h & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(left)
        key |= h >> np.uint64(64 - left)
        order = np.argsort(key, kind="stable")
        key, h = key[order], h[order]
        while len(wrong := np.flatnonzero((key[1:] == key[:-1]) & (h[1:] < h[:-1]))):  # ... and the few ties by the rest
            wrong = wrong[np.append(True, np.diff(wrong) > 1)]
            h[wrong], h[wrong + 1] = h[wrong + 1], h[wrong]
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        self.line, self.words = line[new], h[new]
        self.size = np.bincount(self.line, minlength=len(self.text))
        self.start = np.concatenate([[0], np.cumsum(self.size)])

    def _per_line(self, values: np.ndarray, ufunc) -> np.ndarray:
        out, some = np.zeros(len(self.size), np.uint64), self.size > 0
        if some.any():
            out[some] = ufunc.reduceat(values, self.start[:-1][some])
        return out

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self._per_line(mixed(self.words + np.uint64(salt)), np.add).view(np.int64) for salt in (0x51ED270B, 0x2545F4914F6CDD1D))

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        bit = mixed(self.words ^ np.uint64(0xA0761D6478BD642F))
        one = np.uint64(1) << (bit & np.uint64(63))
        high = (bit & np.uint64(64)) != 0
        return tuple(self._per_line(np.where(high == side, one, np.uint64(0)), np.bitwise_xor).view(np.int64) for side in (False, True))


def _split(docs: DataFrame) -> DataFrame:
    """Rows of lines (slice null) and, a few a task, of counters (line null): slices of ``SLICE`` counters."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "line", "f1", "f2", "size", "slice", "counts"]
        counted = np.zeros(BUCKETS, np.int32)
        id_type = None
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text", CHUNK_BYTES):
                id_type = batch.column("id").type
                lines = Lines(text_array(batch.column("text")))
                counted += np.bincount((lines.words & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.int32)
                f1, f2 = lines.fingerprints()
                n = len(lines.size)
                yield pa.record_batch([batch.column("id").take(pa.array(lines.text)), pa.array(lines.number, pa.int32()), pa.array(f1), pa.array(f2),
                                       pa.array(lines.size, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        counted = counted.reshape(-1, SLICE)
        at = np.flatnonzero(counted.any(axis=1))
        if len(at):
            yield pa.record_batch([pa.nulls(len(at), id_type), *[pa.nulls(len(at), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int32())],
                                   pa.array(at, pa.int32()), pa.array([c.tobytes() for c in counted[at]], pa.binary())], names=names)

    return docs.mapInArrow(run, f"id {kind}, line int, f1 long, f2 long, size int, slice int, counts binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice of counters of a partition, at most as many as there are slices."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts")):
            some = np.frombuffer(counts.as_buffer(), np.int32)
            total[k] = np.minimum(total[k] + some.astype(np.int64), np.iinfo(np.int32).max).astype(np.int32) if k in total else some.copy()
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["slice", "counts"])


def _postings(docs: DataFrame, shared, threshold: float, buckets: int) -> DataFrame:
    """A posting for each prefix word of each set (once a batch at least), and block pair of a frequent word: six longs
    (group, f1, f2, b0, b1, size and place), those of one bucket of groups together in a row. A group is the word, or
    a mix of the word and its pair of blocks. Words of one line alone are not posted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, ranks = shared.value
        held: list[np.ndarray] = []
        rows = 0

        def dealt() -> pa.RecordBatch:
            x = np.concatenate(held)
            held.clear()
            bucket = (np.ascontiguousarray(x[:, 0]).view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            count = np.bincount(bucket, minlength=1)
            there = np.flatnonzero(count)
            cut = np.concatenate([[0], np.cumsum(count[there])]) * (8 * x.shape[1])
            x = x[np.argsort(bucket, kind="stable")]
            return pa.record_batch([pa.array(there, pa.int32()), pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(there), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(x)]).cast(pa.binary())], names=["bucket", "rows"])

        for whole in batches:
            for batch in chunks_by_bytes(whole, "text", CHUNK_BYTES):
                lines = Lines(text_array(batch.column("text")), ranks)
                f1, f2 = lines.fingerprints()
                b0, b1 = lines.parities()
                fresh = ~pd.DataFrame({"a": f1, "b": f2}).duplicated().to_numpy()
                place = np.arange(len(lines.words)) - lines.start[lines.line]
                prefix = lines.size - np.ceil(threshold * lines.size - 1e-9).astype(np.int64) + 1
                keep = np.flatnonzero((place < prefix[lines.line]) & fresh[lines.line])
                count = counters[lines.words[keep] & np.uint64(BUCKETS - 1)].astype(np.int64)
                keep, count = keep[count > 1], count[count > 1]
                line, word = lines.line[keep], lines.words[keep]
                blocks = -(-count // GROUP_ROWS)
                own = (f1[line].view(np.uint64) % blocks.astype(np.uint64)).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(np.bincount(np.cumsum(blocks) // POSTED_ROWS))])
                for a, b in zip(edges, edges[1:]):  # frequent words: once for every other block
                    at = np.repeat(np.arange(a, b), blocks[a:b])
                    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks[a:b]) - blocks[a:b], blocks[a:b])
                    pair = np.minimum(own[at], other) << 32 | np.maximum(own[at], other)
                    group = np.where(blocks[at] > 1, mixed(word[at] + mixed(pair.astype(np.uint64) + np.uint64(1))), word[at])
                    row = line[at]
                    x = np.stack([group.view(np.int64), f1[row], f2[row], b0[row], b1[row], lines.size[row] << 32 | place[keep[at]]], axis=1)
                    held.append(x)
                    rows += len(x)
                    if rows >= POSTED_ROWS:
                        yield dealt()
                        rows = 0
        if rows:
            yield dealt()

    return docs.mapInArrow(run, "bucket int, rows binary")


def _similar(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows (the first no larger than the second, and within the length bound) that may be similar:
    positional filter first, then the parity maps."""
    n, m = x["size"][a], x["size"][b]
    least = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)  # overlap of similar sets
    fine = np.minimum(n - x["place"][a], m - x["place"][b]) >= least
    a, b, most = a[fine], b[fine], (n + m - 2 * least)[fine]
    apart = sum(np.bitwise_count((x[c][a] ^ x[c][b]).view(np.uint64)).astype(np.int64) for c in ("b0", "b1"))
    fine = apart <= most
    a, b = a[fine], b[fine]
    fine = (x["f1"][a] != x["f1"][b]) | (x["f2"][a] != x["f2"][b])
    return a[fine], b[fine]


def _candidates(threshold: float, buckets: int):
    def forest(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        used, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        frame = pd.DataFrame({"a": x["f1"][used], "b": x["f2"][used]})
        node = frame.groupby(["a", "b"], sort=False).ngroup().to_numpy()
        first = np.full(node.max(initial=-1) + 1, len(node))
        np.minimum.at(first, node, np.arange(len(node)))
        root = components_of(node[ends[:len(a)]], node[ends[len(a):]], len(first))
        child = np.flatnonzero(root != np.arange(len(root)))
        keys = np.stack([x["f1"][used], x["f2"][used]], axis=1).astype(">i8")

        def binary(rows: np.ndarray) -> pa.Array:
            return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(keys[rows]).tobytes())]).cast(pa.binary())

        return pa.record_batch({"a": binary(first[child]), "b": binary(first[root[child]])})

    def compare(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The candidates among whole groups of postings: sorted by group and size, each row meets the rows 1, 2, ...
        places behind it, until its group ends or the sets become too large for it."""
        group = np.ascontiguousarray(rows[:, 0])
        order = np.argsort(group)
        group = group[order]
        same = group[1:] == group[:-1]
        shared = np.append(False, same) | np.append(same, False)  # a group of one row has no pairs
        order, group = order[shared], group[shared]
        if not len(order):
            return
        run = np.cumsum(np.append(False, group[1:] != group[:-1]))
        rows = rows[order]
        order = np.lexsort((rows[:, 1], run << 32 | rows[:, 5] >> 32))
        rows, run = rows[order], run[order]
        # one row for each set of a group: batches may post a set again
        twin = np.append(False, (run[1:] == run[:-1]) & (rows[1:] == rows[:-1])[:, [1, 2, 5]].all(axis=1))
        rows, run = rows[~twin], run[~twin]
        x = dict(zip(("f1", "f2", "b0", "b1"), np.ascontiguousarray(rows[:, 1:5].T))) | {"size": rows[:, 5] >> 32, "place": rows[:, 5] & 0xFFFFFFFF}
        rows = len(run)
        ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, rows)[run]  # where each row's group ends
        limit = x["size"] / threshold + 1e-9
        at, gap, found_a, found_b, held = np.arange(rows), 1, [], [], 0
        while len(at):
            at = at[at + gap < ends[at]]
            at = at[x["size"][at + gap] <= limit[at]]
            a, b = _similar(x, at, at + gap, threshold)
            if len(a):
                found_a.append(a)
                found_b.append(b)
                held += len(a)
            if held > 4 * rows:  # a forest of the pairs so far, so that they do not pile up
                root = components_of(np.concatenate(found_a), np.concatenate(found_b), rows)
                child = np.flatnonzero(root != np.arange(rows))
                found_a, found_b, held = [child], [root[child]], len(child)
            gap += 1
        if found_a:
            yield forest(x, np.concatenate(found_a), np.concatenate(found_b))

    def bucketful(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The candidates of a bucket, some of its groups at a time if it has many rows."""
        parts = -(-sum(map(len, held)) // COMPARED_ROWS)
        for k in range(parts):
            some = held
            if parts > 1:
                some = [x[np.ascontiguousarray(x[:, 0]).view(np.uint64) // np.uint64(buckets) % np.uint64(parts) == k] for x in held]
            yield from compare(np.concatenate(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        own = None
        for batch in batches:
            bucket, packed = batch.column("bucket").to_numpy(), batch.column("rows").cast(pa.large_binary())
            cut = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1]
            flat = np.frombuffer(packed.buffers()[2], np.uint8)
            new = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
            for a, b in zip(new, np.append(new[1:], len(bucket))):
                if bucket[a] != own:
                    yield from bucketful(held)
                    held, own = [], bucket[a]
                held.append(flat[cut[a]:cut[b]].view(np.int64).reshape(-1, 6))
        yield from bucketful(held)

    return run


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per line of ``docs``: ``id_col``, ``line_no`` (from 0), ``n_words`` (distinct), ``n_links`` (other lines
    with a similarity of ``threshold`` or more, copies included), ``class_id`` and ``class_line`` (first line of the
    connected lines), ``match_id`` and ``match_line`` (first similar earlier line, else null) and ``kept``."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    split = stored(_split(texts), "lines")
    counters = np.zeros((BUCKETS // SLICE, SLICE), np.int32)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = split.filter("slice is not null").select("slice", "counts").mapInArrow(_summed, "slice int, counts binary")
    for row in slices.repartition(min(parts, len(counters)), "slice").mapInArrow(_summed, "slice int, counts binary").collect():  # BUCKETS counters at most
        counters[row["slice"]] = np.frombuffer(row["counts"], np.int32)
    counters = counters.ravel()
    ranks = np.empty(BUCKETS, np.int32)
    ranks[np.argsort(counters, kind="stable")] = np.arange(BUCKETS)
    lines = split.filter("slice is null").select("id", "line", "f1", "f2", "size")
    full = lines.filter("size > 0 and id is not null")

    some = texts.filter("id is not null")
    buckets = max(parts, math.ceil((1 - threshold) * int(counters.sum(dtype=np.int64)) / BUCKET_ROWS))
    postings = _postings(some, spark.sparkContext.broadcast((counters, ranks)), threshold, buckets)
    ties = (postings.repartition(parts, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(_candidates(threshold, buckets), "a binary, b binary"))
    tied = connected_components(ties)

    half = lambda at: F.conv(F.hex(F.substring("node", at, 8)), 16, -10).cast("long")
    tied = tied.select(half(1).alias("f1"), half(9).alias("f2"), "root")
    sets = full.groupBy("f1", "f2").agg(F.min(F.struct("id", "line")).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
    sets = stored(sets.join(tied, ["f1", "f2"], "left").filter("copies > 1 or root is not null"), "sets")  # others are kept, and alone
    members = sets.filter("root is not null")
    blocks = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("size") / BLOCK_WORDS)).cast("int").alias("blocks"))
    placed = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("f1", "f2"), "blocks").cast("int"))

    # the members' words, from their documents only: a fixed number of flags keeps most others from being shuffled
    flag = F.pmod(F.xxhash64("id"), F.lit(FLAGS))
    wanted = members.groupBy(F.col("first.id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("first.line", "f1", "f2"))).alias("wanted"))
    wanted = stored(wanted, "wanted")
    near = some.withColumn("flag", flag).join(F.broadcast(wanted.select(flag.alias("flag")).distinct()), "flag", "left_semi")
    # an id may stand on several texts: each is looked through for the sets it has at their lines
    near = near.select("id", "text").join(wanted, "id")
    kind = docs.schema[id_col].dataType.simpleString()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text", CHUNK_BYTES):
                found = Lines(text_array(batch.column("text")))
                starts = np.searchsorted(found.text, np.arange(batch.num_rows))
                asked = batch.column("wanted")
                doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(asked).to_numpy())
                number, w1, w2 = (np.asarray(asked.flatten().field(k)) for k in range(3))
                row = starts[doc] + number
                there = row < np.append(starts, len(found.text))[doc + 1]
                f1, f2 = found.fingerprints()
                there[there] = (f1[row[there]] == w1[there]) & (f2[row[there]] == w2[there])
                doc, number, row, w1, w2 = doc[there], number[there], row[there], w1[there], w2[there]
                size = found.size[row]
                cut = np.concatenate([[0], np.cumsum(size)])
                values = found.words[np.repeat(found.start[row] - cut[:-1], size) + np.arange(cut[-1])]
                yield pa.record_batch([batch.column("id").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(w1), pa.array(w2),
                                       pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(np.asarray(values).view(np.int64)))], names=["id", "line", "f1", "f2", "items"])

    items = near.select("id", "text", "wanted").mapInArrow(words, f"id {kind}, line int, f1 long, f2 long, items array<long>")
    key = ["id", "line", "f1", "f2"]  # a set: its first line, and its fingerprint, as rows that repeat an id may share a line number
    ready = (placed.select(F.col("first.id").alias("id"), F.col("first.line").alias("line"), "f1", "f2", "copies", "root", "blocks", "block")
             .join(items.dropDuplicates(key), key))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = ready.select(*key, "copies", "root", "block", "items", other.alias("other")).select(
        *key, "copies", "root", "block", "items", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in groups(batches, ["root", "i", "j"]):
            items, block, copies = table.column("items").combine_chunks(), table.column("block").to_numpy(), table.column("copies").to_numpy()
            across = table.column("i").to_numpy() != table.column("j").to_numpy()
            cut, flat = np.asarray(items.offsets).astype(np.int64), np.asarray(items.flatten())
            cut -= cut[0]
            at, to, counts = [], [], []
            for x, y in zip(edges, edges[1:]):
                a, b, links, least = links_of(flat[cut[x]:cut[y]], cut[x:y + 1] - cut[x], block[x:y], copies[x:y], across[x], threshold)
                rows = np.flatnonzero(links)
                at += [rows + x, a + x]
                to += [least[rows] + x, b + x]
                counts += [links[rows], np.zeros(len(a), np.int64)]
            at, to = pa.array(np.concatenate(at)), pa.array(np.concatenate(to))
            if len(at):
                yield pa.record_batch([table.column(c).combine_chunks().take(t) for t in (at, to) for c in key] + [pa.array(np.concatenate(counts))],
                                      names=[*key, *[f"to_{c}" for c in key], "links"])

    found = stored(pairs.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", *key)
                   .mapInArrow(compare, f"id {kind}, line int, f1 long, f2 long, to_id {kind}, to_line int, to_f1 long, to_f2 long, links long"), "links")
    edges = found.filter("links = 0").select(F.struct(*key).alias("a"), F.struct(*[F.col(f"to_{c}").alias(c) for c in key]).alias("b"))
    classes = connected_components(edges).select(F.col("node").alias("set"), F.struct("root.id", "root.line").alias("root"))
    linked = found.filter("links > 0").groupBy(F.struct(*key).alias("set")).agg(
        F.sum("links").alias("links"), F.min(F.struct(F.col("to_id").alias("id"), F.col("to_line").alias("line"))).alias("least"))

    # of the distinct sets only those with copies or links say something about their lines
    known = (sets.drop("root").withColumn("set", F.struct("first.id", "first.line", "f1", "f2"))
             .join(linked, "set", "left").join(classes, "set", "left").filter("copies > 1 or links > 0")
             .select(F.col("f1").alias("e1"), F.col("f2").alias("e2"), "first", "least", F.coalesce("root", "first").alias("class"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    known = stored(known, "known")
    here = F.struct("id", "line")
    out = lines.join(known, (F.col("size") > 0) & F.col("id").isNotNull() & (F.col("f1") == F.col("e1")) & (F.col("f2") == F.col("e2")), "left")
    first = F.least("first", F.coalesce("least", "first"))
    out = out.withColumn("match", F.when(F.col("first").isNotNull() & (first < here), first)).withColumn("class", F.coalesce("class", here))
    return out.select(F.col("id").alias(id_col), F.col("line").cast("long").alias("line_no"), F.col("size").cast("long").alias("n_words"),
                      F.coalesce("links", F.lit(0)).alias("n_links"), F.col("class.id").alias("class_id"), F.col("class.line").cast("long").alias("class_line"),
                      F.col("match.id").alias("match_id"), F.col("match.line").cast("long").alias("match_line"), F.col("match").isNull().alias("kept"))


def remove_lines(docs: DataFrame, lines: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that ``lines`` (of ``line_dedup``) does not keep taken out of their texts. Rows with a
    null id and texts without such lines stay as they are."""
    gone = lines.filter("not kept").groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.collect_set(F.col("line_no").cast("int")).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own"))
    numbered = F.transform(F.split(F.col("row")[text_col], "\n", -1), lambda x, n: F.struct(n.alias("n"), x.alias("x")))
    rest = F.transform(F.filter(numbered, lambda s: ~F.array_contains("gone", s["n"])), lambda s: s["x"])
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(F.array_join(rest, "\n"))
    return rows.join(gone, F.col("own") == F.col("id"), "left").select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
