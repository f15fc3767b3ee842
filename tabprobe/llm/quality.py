"""Quality classifier from weak labels.

1. Overlapping heuristic labellers look at each whole text and vote junk, fine or nothing. Variety of words
   is the share of distinct words in each of the text's consecutive windows of ``WINDOW`` words, averaged by
   words over all of them, so that it does not depend on length.
2. Expectation-maximisation over the counts of vote patterns (of *all* documents; at most
   3 ** labellers patterns, whatever the input) estimates the share of junk and the accuracy of
   each labeller from how they overlap. That gives each pattern a posterior.
3. The posteriors are the soft targets of a logistic scorer over hashed features of word shapes and
   their neighbours, trained on a bounded sample (``SAMPLE`` documents, smallest id hashes first).

The scorer is one vector of ``DIMENSIONS`` weights; all documents are scored with it.

Defined cases: null and empty texts have no words; a labeller of their own votes junk and their features
say so; repeated rows each get their row; sampling ties are broken by id; an empty table trains a scorer of
zeros that says 0.5; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import chunks_by_bytes, distinct, small_batches, text_array, word_codes, word_hashes

SAMPLE = 20_000
DIMENSIONS = 1 << 14
BINS = 10
ROUNDS = 200
JUNK, FINE, NOTHING = 0, 1, 2

NEVER = np.inf

# labeller: it votes junk from the first value of its measure on, and fine below the second
LABELLERS = {
    "capital_words": (0.30, -NEVER),
    "symbols": (0.05, -NEVER),
    "repeated_words": (0.20, -NEVER),
    "exclamations": (0.30, -NEVER),
    "wordless_tokens": (0.12, -NEVER),
    "repeated_lines": (0.50, -NEVER),
    "no_words": (0.50, -NEVER),
    "odd_words": (0.45, -NEVER),
    "little_variety": (0.60, -NEVER),
    "not_prose": (NEVER, 1.0),
}
LEAST_WORDS = 20  # for the measures that say little about a few words
WINDOW = 200  # words: repeats are counted within windows, as over a whole text their share rises with its length

_BYTES = np.arange(256)
_SYMBOL = np.isin(_BYTES, np.frombuffer(b"*$&%#|<>{}[]=+~^\\_@", np.uint8))
_START = (_BYTES < 0x80) | (_BYTES >= 0xC0)


@dataclass
class Texts:
    """Words, bytes and lines of a batch of texts."""
    count: int
    codes: np.ndarray
    offsets: np.ndarray
    dictionary: pa.Array
    measures: np.ndarray  # texts x labellers

    @staticmethod
    def of(texts: pa.Array) -> "Texts":
        codes, offsets, dictionary = word_codes(texts, lower=False)
        n = np.diff(offsets)
        words = np.maximum(n, 1)

        def per_text(of_word: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(of_word[codes])])[offsets])

        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw, cuts = raw[cuts[0]:cuts[-1]], cuts - cuts[0]

        def per_byte(kind: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])[cuts])

        doc = np.repeat(np.arange(len(texts)), n)
        same = np.zeros(len(codes), np.int64)
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        # all consecutive windows of each text; a window's distinct words count towards its text
        windows = -(-n // WINDOW)
        first = np.cumsum(windows) - windows
        window = first[doc] + (np.arange(len(codes)) - offsets[:-1][doc]) // WINDOW
        kinds = distinct(window * (len(dictionary) or 1) + codes) // (len(dictionary) or 1)
        kinds_of_words = np.bincount(np.repeat(np.arange(len(texts)), windows)[kinds], minlength=len(texts))

        def matching(pattern: str) -> np.ndarray:
            return per_text(pc.match_substring_regex(dictionary, pattern).to_numpy(zero_copy_only=False).astype(np.int64)) / words

        long = n >= LEAST_WORDS
        lines = pc.split_pattern(texts, "\n")
        flat = lines.flatten()
        full = pc.match_substring_regex(flat, r"\S").to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lines.offsets)))[full]
        which = flat.filter(pa.array(full)).dictionary_encode().indices.to_numpy().astype(np.int64)
        of_lines = np.bincount(at, minlength=len(texts))
        kinds = distinct(at * (which.max(initial=0) + 1) + which) // (which.max(initial=0) + 1)
        repeated = np.where(long, np.diff(np.concatenate([[0], np.cumsum(same)])[offsets]) / words, 0)
        symbols = per_byte(_SYMBOL) / np.maximum(per_byte(_START), 1)
        odd = 1 - matching(r"^\p{Lu}?[\p{Ll}\p{Lo}\p{M}'’-]+[.,;:?]?$")
        alike = np.where(long, 1 - kinds_of_words / words, 0)
        # how far the worst of four measures goes towards what prose does not show
        prose = np.stack([odd / 0.30, symbols / 0.02, repeated / 0.10, alike / 0.55]).max(axis=0)
        measures = np.stack([
            matching(r"^\P{Ll}*\p{Lu}\P{Ll}+$"),
            symbols,
            repeated,
            matching(r"!$"),
            matching(r"^[^\p{L}\p{N}]+$"),
            np.where(of_lines >= 3, 1 - np.bincount(kinds, minlength=len(texts)) / np.maximum(of_lines, 1), 0),
            (n == 0).astype(float),
            np.where(long, odd, 0),
            alike,
            np.where(n > 0, prose, 1),
        ], axis=1)
        return Texts(len(texts), codes, offsets, dictionary, measures)

    def votes(self) -> np.ndarray:
        out = np.full(self.measures.shape, NOTHING)
        for j, (junk, fine) in enumerate(LABELLERS.values()):
            out[self.measures[:, j] < fine, j] = FINE
            out[self.measures[:, j] >= junk, j] = JUNK
        return out

    def patterns(self) -> np.ndarray:
        return self.votes() @ (3 ** np.arange(len(LABELLERS)))

    def shapes(self) -> np.ndarray:
        """Hash of each word's shape: runs of capitals, of other letters and of digits become one sign each."""
        s = self.dictionary
        for pattern, to in ((r"\p{Lu}+", "X"), (r"\p{Ll}+|\p{Lo}+|\p{M}+", "x"), (r"\p{N}+", "0")):
            s = pc.replace_substring_regex(s, pattern, to)
        e = s.dictionary_encode()
        return word_hashes(e.dictionary)[e.indices.to_numpy()][self.codes] if len(s) else np.empty(0, np.uint64)

    def features(self, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, feature, value) of shape features, whose values are shares of a text's words, and
        the texts' binned measures as texts x labellers feature numbers."""
        h, n = self.shapes(), np.diff(self.offsets)
        doc = np.repeat(np.arange(self.count), n)
        with np.errstate(over="ignore"):
            pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
        inside = doc[1:] == doc[:-1]
        both = np.concatenate([doc, doc[1:][inside]])
        feature = (np.concatenate([h, pair[inside]]) % np.uint64(dimensions)).astype(np.int64)
        value = 1 / np.maximum(n, 1)[both]
        bins = np.minimum((self.measures * BINS).clip(0), BINS - 1).astype(np.int64)
        names = [[f"{k}={b}" for b in range(BINS)] for k in LABELLERS]
        hashed = (word_hashes(pa.array(sum(names, []))) % np.uint64(dimensions)).astype(np.int64).reshape(-1, BINS)
        return both, feature, value, hashed[np.arange(len(LABELLERS)), bins]


def posteriors(counts: dict[int, int], rounds: int = 500) -> tuple[dict[int, float], dict[str, float], float]:
    """Probability of a fine text for each vote pattern, each labeller's estimated accuracy (share of
    right votes among its votes) and the share of fine texts, by expectation-maximisation over pattern
    counts. A labeller that votes nothing says nothing, so that labellers for one kind of junk need not
    know the others. Accuracies stay at 1/2 or more and their start counts as ten votes."""
    patterns = np.array(sorted(counts), np.int64)
    if not len(patterns):
        return {}, {}, 0.5
    weight = np.array([counts[p] for p in patterns], float)
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    right, prior, fine = np.full(len(LABELLERS), 0.8), 0.5, None
    for _ in range(rounds):
        ratio = np.log(right / (1 - right))
        log = np.log(prior / (1 - prior)) + (votes == FINE) @ ratio - (votes == JUNK) @ ratio
        new = 1 / (1 + np.exp(-log))
        moved, fine = 1.0 if fine is None else np.abs(new - fine).max(), new
        if moved < 1e-10:
            break
        hits = ((weight * fine)[:, None] * (votes == FINE) + (weight * (1 - fine))[:, None] * (votes == JUNK)).sum(axis=0)
        cast = (weight[:, None] * (votes != NOTHING)).sum(axis=0)
        right = np.clip((hits + 8) / (cast + 10), 0.5, 0.999)
        prior = np.clip(((weight * fine).sum() + 1) / (weight.sum() + 2), 0.01, 0.99)
    return dict(zip(patterns.tolist(), fine.tolist())), dict(zip(LABELLERS, right.tolist())), float(prior)


@dataclass
class Model:
    weights: np.ndarray
    shift: float
    posterior: dict[int, float]
    accuracy: dict[str, float]

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each text is fine by the scorer, and its vote pattern."""
        t = Texts.of(texts)
        doc, feature, value, bins = t.features(len(self.weights))
        z = np.bincount(doc, weights=self.weights[feature] * value, minlength=t.count) + self.weights[bins].sum(axis=1) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), t.patterns()


def _train(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, dimensions: int) -> tuple[np.ndarray, float]:
    """Logistic weights by Adam over the whole sample, with weight decay."""
    w, b, n = np.zeros(dimensions), 0.0, len(target)
    m, v = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
    for k in range(1, ROUNDS + 1 if n else 1):
        z = np.bincount(doc, weights=w[feature] * value, minlength=n) + b
        gap = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        g = np.append(np.bincount(feature, weights=gap[doc] * value, minlength=dimensions) / n + 1e-5 * w, gap.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
        dimensions: int = DIMENSIONS) -> Model:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(3 ** len(LABELLERS), np.int64)
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                np.add.at(found, Texts.of(text_array(batch.column("text"))).patterns(), 1)
        at = np.flatnonzero(found)
        yield pa.record_batch({"pattern": pa.array(at, pa.int64()), "n": pa.array(found[at], pa.int64())})

    counts = dict(texts.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n")).collect())
    posterior, accuracy, prior = posteriors(counts)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                t = Texts.of(text_array(batch.column("text")))
                doc, feature, value, bins = t.features(dimensions)
                doc = np.concatenate([doc, np.repeat(np.arange(t.count), bins.shape[1])])
                feature = np.concatenate([feature, bins.ravel()])
                value = np.concatenate([value, np.ones(bins.size)])
                key, back = np.unique(doc * dimensions + feature, return_inverse=True)
                total = np.bincount(back, weights=value, minlength=len(key))
                cut = np.searchsorted(key // dimensions, np.arange(t.count + 1)).astype(np.int32)
                yield pa.record_batch({
                    "pattern": pa.array(t.patterns(), pa.int64()),
                    "feature": pa.ListArray.from_arrays(cut, pa.array(key % dimensions, pa.int32())),
                    "value": pa.ListArray.from_arrays(cut, pa.array(total, pa.float32()))})

    ids = texts.select("id").dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most `sample` rows: of rows that repeat an id, the smallest text
    rows = (texts.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
            .select("text").mapInArrow(featured, "pattern long, feature array<int>, value array<float>").toArrow())
    lists = rows.column("feature").combine_chunks()
    doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False)) if rows.num_rows else np.empty(0, np.int64)
    target = np.array([posterior.get(p, prior) for p in rows.column("pattern").to_pylist()])
    weights, shift = _train(doc, lists.flatten().to_numpy().astype(np.int64),
                            rows.column("value").combine_chunks().flatten().to_numpy().astype(float), target, dimensions)
    return Model(weights, shift, posterior, accuracy)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``score`` (probability of a fine text, by the scorer),
    ``posterior`` (by the labellers' votes) and ``votes`` (one of J, F, - for each labeller)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                s, patterns = shared.value.score(text_array(batch.column("text")))
                kinds, back = np.unique(patterns, return_inverse=True)
                names = np.array(["".join("JF-"[p // 3 ** j % 3] for j in range(len(LABELLERS))) for p in kinds], object)
                belief = np.array([shared.value.posterior.get(int(p), 0.5) for p in kinds])
                yield pa.record_batch({"id": batch.column("id"), "score": pa.array(s), "posterior": pa.array(belief[back]),
                                       "votes": pa.array(names[back], pa.string())})

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, score double, posterior double, votes string").withColumnRenamed("id", id_col)


def score_column(spark, model: Model, text: Column) -> Column:
    """The score as a column expression, for filters that keep all columns."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text_array(texts))[0])

    return scored(text)
