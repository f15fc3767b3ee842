"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

A model file's pieces and scores are read as they are; a piece's score counts as its log probability. The best
segmentation of a text is found by Viterbi over all pieces that match, with byte pieces in place of characters that no
piece covers, and a marker in place of each space and before the text.

No piece holds a marker behind another character, so that segmentations of marker-led words do not touch each other.
Each distinct word of a batch is therefore segmented once, all of them together: the trie is walked and the lattice is
filled for all words at a time. Texts are encoded whole, whatever their length. Ties go to the segmentation whose
last piece begins first, as in the sentencepiece library.

The trie has a fixed size given by the model and travels as one broadcast. Rows stay in their partitions.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows each get their row;
null ids are kept; a marker character in a text decodes to a space; ids of control pieces decode to nothing; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import chunks_by_bytes, small_batches, text_array

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 60_000
LATTICE_BYTES = 200_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a Protocol Buffers message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, message[at:at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, message[at:at + n]
            at += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) in id order of a model whose normaliser only puts markers for spaces."""
    pieces, rules = [], b""
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 3:
                rules = value
    spec = dict(_fields(rules))
    if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
        raise ValueError("only models with a marker before the text, all white space kept and no character map are known")
    return pieces


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): from state s, byte b leads to ``base[s] + b`` if ``check`` of it is s; ``value`` is the
    number of the key that ends in a state, else -1. State 0 is the root."""
    base, check, value, free = [0] * 257, [-1] * 257, [-1] * 257, [False] * 257
    low = tail = 257  # below low all is taken, from tail on all is free; low - byte is a base for any byte
    order = sorted(range(len(keys)), key=keys.__getitem__)
    todo = [(0, 0, len(order), 0)]
    while todo:
        state, a, b, depth = todo.pop()
        if a < b and len(keys[order[a]]) == depth:
            value[state] = values[order[a]]
            a += 1
        spans, at = [], a
        while at < b:
            byte, end = keys[order[at]][depth], at
            while end < b and keys[order[end]][depth] == byte:
                end += 1
            spans.append((byte, at, end))
            at = end
        if not spans:
            continue
        room = tail + 512 - len(base)
        if room > 0:
            base += [0] * room
            check += [-1] * room
            value += [-1] * room
            free += [True] * room
        while not free[low]:
            low += 1
        # a lone child goes to the first gap, several to the first fit among the last places
        first = low if len(spans) == 1 else max(low, tail - 256)
        at = first - spans[0][0]
        while not all(free[at + byte] for byte, _, _ in spans):
            at += 1
        base[state] = at
        for byte, x, y in spans:
            check[at + byte], free[at + byte] = state, False
            tail = max(tail, at + byte + 1)
            todo.append((at + byte, x, y, depth + 1))
    spare = 256  # a state's base plus any byte stays inside
    base, check, value = base + [0] * spare, check + [-1] * spare, value + [-1] * spare
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    known: dict[str, bytes] = field(default_factory=dict)  # words of the last batches, a bounded number
    older: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        own = [(p.encode(), i) for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED) and p]
        if any(MARKER in p.lstrip(MARKER) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED)):
            raise ValueError("a piece holds a marker behind another character")
        self.base, self.check, self.value = double_array([k for k, _ in own], [i for _, i in own])
        self.scores = np.array([s for _, s, _ in self.pieces], np.float64)
        normal = [s for _, s, t in self.pieces if t == NORMAL]
        self.unknown_score = min(normal) - UNKNOWN_PENALTY
        best = max(normal)
        for p, i in own:
            if self.pieces[i][2] == USER_DEFINED:
                self.scores[i] = len(p.decode()) * best - 0.1
        self.unknown = next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)
        self.byte = np.full(256, self.unknown, np.int64)
        for i, (p, _, t) in enumerate(self.pieces):
            if t == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.has_bytes = (self.byte != self.unknown).all()
        texts = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN
                 else p.replace(MARKER, " ").encode() for p, _, t in self.pieces]
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "older": {}}

    def segment(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian 32 bits) of each word, all words together."""
        text = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        word = np.repeat(np.arange(len(words)), size)
        stop = begin[1:][word]
        heads = np.flatnonzero((text & 0xC0) != 0x80)  # first bytes of characters
        wide = np.diff(np.append(heads, len(text)))

        found_at, found_end, found_id, alone = [], [], [], np.zeros(len(heads), bool)
        at, state, depth, which = heads, np.zeros(len(heads), np.int64), 0, np.arange(len(heads))
        while len(at):
            go = at + depth < stop[at]
            at, state, which = at[go], state[go], which[go]
            to = self.base[state] + text[at + depth]
            go = self.check[to] == state
            at, state, which = at[go], to[go], which[go]
            depth += 1
            hit = self.value[state] >= 0
            found_at.append(at[hit])
            found_end.append(at[hit] + depth)
            found_id.append(self.value[state[hit]])
            alone[which[hit][wide[which[hit]] == depth]] = True
        missing = heads[~alone]  # no piece is exactly this character
        found_at.append(missing)
        found_end.append(missing + wide[~alone])
        found_id.append(np.full(len(missing), self.unknown))
        a, e, i = np.concatenate(found_at), np.concatenate(found_end), np.concatenate(found_id)
        s = np.where(i == self.unknown, self.unknown_score, self.scores[i])

        # places in the lattice: one more than a word's bytes, so that words do not share one
        a, e = a + word[a], e + word[a]
        first = begin[:-1] + np.arange(len(words))
        offset = a - first[np.searchsorted(first, a, "right") - 1]
        order = np.argsort(offset, kind="stable")
        a, e, i, s, offset = a[order], e[order], i[order], s[order], offset[order]
        best = np.full(len(text) + len(words), -np.inf)
        best[first] = 0
        back, piece = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        edges = np.flatnonzero(np.diff(offset, prepend=-1, append=-1))
        for x, y in zip(edges, edges[1:]):  # words at a time; within one start all ends differ
            total = best[a[x:y]] + s[x:y]
            better = np.flatnonzero(total > best[e[x:y]]) + x
            best[e[better]] = best[a[better]] + s[better]
            back[e[better]], piece[e[better]] = a[better], i[better]

        which, place = np.arange(len(words)), first + size
        steps = []
        while len(which):
            go = place > first[which]
            which, place = which[go], place[go]
            if len(which):
                steps.append((which, piece[place], back[place], place))
                place = back[place]
        if not steps:
            return [b""] * len(words)
        w, ids = np.concatenate([x[0] for x in steps]), np.concatenate([x[1] for x in steps])
        left, right = np.concatenate([x[2] for x in steps]), np.concatenate([x[3] for x in steps])
        order = np.lexsort((left, w))
        w, ids, left, right = w[order], ids[order], left[order], right[order]
        if self.has_bytes and (ids == self.unknown).any():
            n = np.where(ids == self.unknown, right - left, 1)
            at = np.repeat(np.cumsum(n) - n, n)
            within = np.arange(n.sum()) - at
            source = np.repeat(left - w, n) + within
            w, ids = np.repeat(w, n), np.repeat(ids, n)
            ids = np.where(ids == self.unknown, self.byte[text[np.minimum(source, len(text) - 1)]], ids)
        cut = np.searchsorted(w, np.arange(len(words) + 1)) * 4
        raw = ids.astype("<i4").tobytes()
        return [raw[x:y] for x, y in zip(cut, cut[1:])]

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        known.update({w: older[w] for w in words if w not in known and w in older})
        new = [w for w in words if w not in known]
        first = size = 0
        raw = [w.encode() for w in new]
        for n, w in enumerate(raw):  # a lattice of bounded size at a time, whole words
            size += len(w)
            if size >= LATTICE_BYTES or n + 1 == len(raw):
                known.update(zip(new[first:n + 1], self.segment(raw[first:n + 1])))
                first, size = n + 1, 0
        return [known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has the ids ``ids[offsets[i]:offsets[i + 1]]``."""
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        runs = pc.match_substring_regex(texts, f"  | {MARKER}|{MARKER} |{MARKER}{MARKER}|^[ {MARKER}]|[ {MARKER}]$").to_numpy(zero_copy_only=False)
        marked = pc.replace_substring(texts, " ", MARKER)
        lists = pc.split_pattern(pc.if_else(pa.array(runs), pa.scalar("", texts.type), marked), MARKER)
        encoded = lists.flatten().dictionary_encode()
        starts = np.asarray(lists.offsets).astype(np.int64)
        starts -= starts[0]
        codes = encoded.indices.to_numpy().astype(np.int64)
        words = self._words([MARKER + w for w in encoded.dictionary.to_pylist()])
        # texts with runs of markers are cut before each run; empty texts have no ids
        whole = []
        for t in marked.take(pa.array(np.flatnonzero(runs))).to_pylist():
            whole.append(b"".join(self._words(re.findall(f"{MARKER}+[^{MARKER}]*", MARKER + t))))
        codes[starts[:-1][runs]] = len(words) + np.arange(len(whole))
        codes[starts[:-1][empty]] = len(words) + len(whole)
        rows = words + whole + [b""]
        flat = np.frombuffer(b"".join(rows), "<i4")
        n = np.array([len(x) // 4 for x in rows], np.int64)
        at = np.concatenate([[0], np.cumsum(n)])
        each = n[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        return flat[np.repeat(at[codes] - ends[:-1], each) + np.arange(ends[-1])], ends[starts]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids, without the space of the marker before the text."""
        n = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = self.bytes[np.repeat(self.starts[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cut = ends[offsets]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def load(path: str) -> Model:
    return Model(read_pieces(path))


def encode(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and ``ids``, the ids of its whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                ids, offsets = shared.value.encode(text_array(batch.column("text")))
                yield pa.record_batch({"id": batch.column("id"), "ids": pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids, pa.int32()))})

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: Model, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: ``id_col``, ``ids_col`` and ``text``, the text of the ids."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows = batch.slice(first, 1000)
                ids = rows.column("ids")
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = shared.value.decode(np.asarray(ids.flatten()).astype(np.int64), offsets)
                yield pa.record_batch({"id": rows.column("id"), "ids": ids, "text": pa.array(texts, pa.string())})

    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, text string").withColumnsRenamed({"id": id_col, "ids": ids_col})
