"""Runs of periodically repeated words, found online by dyadic square catching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at
least ``max(LEAST_LENGTH, LEAST_PERIODS * q)`` that no neighbouring word extends keeping period q.

``SquareCatchers`` reads a text word by word or piece by piece. At level k it keeps catchers for the blocks of
B = 2 ** k words that are completed, one at every B / 2 words. A catcher watches the delays from 2B to 4B - 1: the
B words that end with an appended word are compared, by name, with the blocks of the four catchers whose delays
they meet. Where they agree, the comparison goes on over the words themselves, back from the block and forward
with each word that is appended. A stretch of agreement of q words or more holds a square; squares of one period
whose stretches meet are one stretch, and stretches of four periods or more are runs.

Why no run is lost: a run of smallest period q in [2B, 4B) spans 8B words or more, so whole blocks and their copies
q words later lie in it. A block inside a run of a period of B / 4 or less already found gets no catcher (its
copies would be countless). Were all blocks of the first two periods such, they would share that period, since
neighbours overlap by B / 2; it would then be the run's own smallest period. Any other block recurs at most nine
times in its delays, so that work and memory are O(n log n) and O(n).

Names are 64-bit hashes of windows, doubled from level to level. Equal names are only ever a hint: agreement is
decided on the words. Documents are read as one stream with a mark of its own after each, which agrees with nothing.

Defined cases: words are the pieces of ``[^\\x20\\x09-\\x0D]+``; a null, empty or blank text has no words, no runs and
an empty collapsed text; texts are read whole, in pieces of ``PIECE`` words; repeated rows are rows each; null ids
are kept; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import chunks_by_bytes, mixed, small_batches, text_array

LEAST_PERIODS = 4
LEAST_LENGTH = 6
PIECE = 1 << 18
KEPT_BLOCKS = 8  # names of the last 8B words are kept at the level of B: delays below 4B, and two blocks to the left
COVERED = np.uint64(0xD1CE5EED0BADF00D)


class SquareCatchers:
    """Online search of one stream of words, given as whole numbers; ``longest`` bounds a run's length, if known."""

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self._room = np.empty(1024, np.int64)
        self.size = 0
        self._names: list[tuple[int, np.ndarray]] = []  # by level: first place, names of the windows from there on
        self._open: dict[tuple[int, int], int] = {}     # (period, start) of stretches that reach the last word: end
        self._found: dict[tuple[int, int], int] = {}    # (start, end) of stretches of four periods or more: period

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Take more words; (start, length, period) of each stretch of two periods or more that was caught or grew."""
        before, now = self.size, self.size + len(words)
        if now > len(self._room):
            self._room = np.concatenate([self._room[:before], np.empty(max(now, 2 * before) - before, np.int64)])
        self._room[before:now] = words
        self.size = now
        self._words = w = self._room[:now]
        if now == before:
            return []
        grown = []
        for (q, start), end in sorted(self._open.items()):
            end += self._forward(end - q, end)
            if end > before:
                grown.append((start, end - start, q))
            self._settle(q, start, end)
        self._grown = grown
        self._period_one(before)
        level, block = 0, 1
        while 3 * block <= now and (self.longest is None or 2 * block * LEAST_PERIODS <= self.longest):
            self._catch(level, block, before)
            level, block = level + 1, 2 * block
        return sorted((a, n, q) for a, n, q in grown if n >= 2 * q)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period, as if the text ended here."""
        found = dict(self._found)
        for (q, start), end in self._open.items():
            if end - start >= LEAST_PERIODS * q:
                found[start, end] = min(q, found.get((start, end), q))
        return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= LEAST_LENGTH)

    def _period_one(self, before: int) -> None:
        w, first = self._words, max(before, 1)
        same = w[first:] == w[first - 1:-1]
        starts = same.copy()
        starts[1:] &= ~same[:-1]
        near = np.ones(len(starts), bool)  # a second agreement must follow, unless the text ends here
        near[:-1] = same[1:]
        for at in np.flatnonzero(starts & near).tolist():
            self._stretch(first + at - 1, 1)

    def _catch(self, level: int, block: int, before: int) -> None:
        """Compare the windows completed by the new words with the blocks of this level's catchers."""
        names, first = self._windows(level, block, before)
        new = max(first, before - block + 1)               # windows from here on are new
        step = max(1, block // 2)
        low = -(-first // step) * step                     # first block whose name is kept
        blocks = names[low - first::step]
        covered = self._covered(low, len(blocks), step, block)
        if covered is not None:
            blocks = np.where(covered, COVERED, blocks)
        spread = blocks if step == 1 else np.repeat(blocks, step)
        end = first + len(names)
        seen: dict[int, int] = {}
        for j in range(2 * block // step):
            back = 2 * block + j * step                    # the catcher at or before this distance
            begin = max(new, low + back)
            if begin >= end:
                continue
            hit = np.flatnonzero(names[begin - first:] == spread[begin - back - low:end - back - low])
            if not len(hit):
                continue
            later = begin + hit
            s = (later - back) // step * step
            near = self._goes_on(names, first, s, later, block, 1) | self._goes_on(names, first, s, later, block, -1)
            for a, b in zip(s[near].tolist(), later[near].tolist()):
                if seen.get(b - a, -1) < a + block:        # not within the last stretch of this period
                    seen[b - a] = self._stretch(a, b - a)

    def _goes_on(self, names: np.ndarray, first: int, s: np.ndarray, later: np.ndarray, block: int, side: int) -> np.ndarray:
        """Whether the two blocks to one side agree too, as in any run of four periods they do on one side or the
        other; so does what is not yet there."""
        same = np.ones(len(s), bool)
        for far in (block, 2 * block):
            a, b = s + side * far - first, later + side * far - first
            there = (a >= 0) & (b < len(names))
            if side < 0:
                same &= there
            same[there] &= names[a[there]] == names[b[there]]
        return same

    def _windows(self, level: int, block: int, before: int) -> tuple[np.ndarray, int]:
        """Names of this level's windows, the new ones added, and the place of the first."""
        if level == len(self._names):
            self._names.append((0, np.empty(0, np.uint64)))
        first, names = self._names[level]
        start = first + len(names)
        if level == 0:
            more = mixed(self._words[start:].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        else:
            at, shorter = self._last
            half, count = block // 2, self.size - block + 1 - start
            left, right = shorter[start - at:start - at + count], shorter[start - at + half:start - at + half + count]
            more = mixed(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
        names = np.concatenate([names, more]) if len(names) else more
        self._last = first, names
        cut = max(0, len(names) - KEPT_BLOCKS * block)
        self._names[level] = (first + cut, names[cut:].copy() if cut else names)
        return names, first

    def _covered(self, low: int, count: int, step: int, block: int) -> np.ndarray | None:
        """Which blocks lie in a run of a period of a quarter block or less."""
        some = [(a, b) for (a, b), q in self._found.items() if 4 * q <= block and b > low]
        some += [(a, b) for (q, a), b in self._open.items() if 4 * q <= block and b - a >= LEAST_PERIODS * q]
        if not some:
            return None
        starts, ends = np.array(sorted(some)).T
        ends = np.maximum.accumulate(ends)
        s = low + step * np.arange(count)
        at = np.searchsorted(starts, s, "right") - 1
        return (at >= 0) & (ends[np.maximum(at, 0)] >= s + block)

    def _stretch(self, s: int, q: int) -> int:
        """Settle the stretch of period q around the words s and s + q; its agreeing words end before the result."""
        end = s + q + self._forward(s, s + q)
        if end == s + q:
            return -1
        start = s - self._backward(s, s + q)
        if (q, start) not in self._open:
            self._grown.append((start, end - start, q))
            self._settle(q, start, end)
        return end - q

    def _settle(self, q: int, start: int, end: int) -> None:
        self._open.pop((q, start), None)
        if end == self.size:
            self._open[q, start] = end
        elif end - start >= LEAST_PERIODS * q:
            self._found[start, end] = min(q, self._found.get((start, end), q))

    def _forward(self, i: int, j: int) -> int:
        w, n, m = self._words, 0, 16
        while j + n < len(w):
            differ = w[i + n:min(i + n + m, len(w) - j + i)] != w[j + n:j + n + m]
            at = int(differ.argmax())
            if differ[at]:
                return n + at
            n, m = n + len(differ), min(2 * m, 1 << 16)
        return n

    def _backward(self, i: int, j: int) -> int:
        w, n, m = self._words, 0, 16
        while n < i:
            m = min(m, i - n)
            differ = (w[i - n - m:i - n] != w[j - n - m:j - n])[::-1]
            at = int(differ.argmax())
            if differ[at]:
                return n + at
            n, m = n + m, min(2 * m, 1 << 16)
        return n


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, end to end, and the offsets at which texts begin and end."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    places = np.asarray(lists.offsets).astype(np.int64)
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[places - places[0]]


def runs_of(words: pa.Array, offsets: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs in texts given by ``words_of``, by text, start and period."""
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    texts = len(offsets) - 1
    stream = np.empty(len(codes) + texts, np.int64)
    marks = offsets[1:] + np.arange(texts)
    stream[marks] = -1 - np.arange(texts)
    inner = np.ones(len(stream), bool)
    inner[marks] = False
    stream[inner] = codes
    catchers = SquareCatchers(int(np.diff(offsets).max(initial=0)))
    for at in range(0, len(stream), piece):
        catchers.append(stream[at:at + piece])
    start, length, period = np.array(catchers.runs(), np.int64).reshape(-1, 3).T
    text = np.searchsorted(marks, start)
    return text, start - offsets[text] - text, length, period


def collapsed(words: pa.Array, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray,
              period: np.ndarray) -> pa.Array:
    """Each text's words joined by one space, without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, offsets[text] + start + period, 1)
    np.add.at(drop, offsets[text] + start + length, -1)
    keep = np.cumsum(drop[:-1]) == 0
    cut = np.concatenate([[0], np.cumsum(keep)])[offsets]
    kept = words if keep.all() else words.filter(pa.array(keep))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), kept), pa.scalar(" ", kept.type)).cast(pa.string())


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``runs`` (array of start, length, period, by start and
    period; words are numbered from 0) and ``collapsed`` (the text without repeated periods)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                words, offsets = words_of(text_array(batch.column("text")))
                text, *parts = runs_of(words, offsets)
                cut = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(p) for p in parts], ["start", "length", "period"]))
                yield pa.record_batch([batch.column("id"), pa.array(np.diff(offsets)), runs, collapsed(words, offsets, text, *parts)],
                                      names=["id", "n_words", "runs", "collapsed"])

    return (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(find, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
            .withColumnRenamed("id", id_col))
