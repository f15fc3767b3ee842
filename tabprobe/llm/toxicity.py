"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fitting, on a bounded sample of the labelled rows (``EXAMPLES``, smallest id hashes first):
terms are words and word prefixes; the ``TERMS`` ones that go most with label 1 (chi-square)
make the vocabulary. Their document frequencies are counted over *all* documents. The
examples' vectors, (1 + ln tf) * ln((N + 1) / (df + 1)) at unit length, make an index cut into blocks
of ``BLOCK`` examples; each block keeps for each term its largest weight.

Scoring a whole text: the sum over its terms of weight times block maximum bounds every cosine
in a block. Blocks are opened by falling bound until the bound is below the k-th cosine
found, so that the ``NEIGHBOURS`` nearest are exact. They vote with their cosines as weights, and a
logistic curve fitted to the examples' own leave-one-out votes turns the vote into a probability.

The model has a fixed size (examples and terms are bounded) and travels as one broadcast.

Defined cases: texts without any term of the vocabulary, so also null and empty ones, get the
share of label 1 among the examples without terms; labels that are null or belong to no document
teach nothing, and of several labels of one id the largest counts; without any labels every score
is 0; equal cosines rank by example id; repeated rows each get their score, and teach once (of different texts of
one id the smallest); ids are whole numbers or texts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import chunks_by_bytes, small_batches, stored, text_array, word_codes

EXAMPLES = 8192
TERMS = 512
PREFIX = 4
BLOCK = 64
NEIGHBOURS = 20
LEAST_DOCUMENTS = 3
LEAST_CHI_SQUARE = 10.83  # p = 0.001
EDGES = " .,;:!?*$&%#|()[]{}\"'"


def _terms(dictionary: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The word and the prefix term of each dictionary word; the prefix is null for short words."""
    word = pc.utf8_trim(dictionary, EDGES)
    prefix = pc.if_else(pc.greater(pc.utf8_length(word), PREFIX),
                        pc.binary_join_element_wise(pc.utf8_slice_codeunits(word, 0, PREFIX), pa.scalar("*", word.type), pa.scalar("", word.type)),
                        pa.scalar(None, word.type))
    return pc.if_else(pc.equal(word, ""), pa.scalar(None, word.type), word), prefix


def _presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct (text number, term number) pairs, and the terms."""
    codes, offsets, dictionary = word_codes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    both = pa.concat_arrays(list(_terms(dictionary))).dictionary_encode()
    to = pc.fill_null(both.indices, -1).to_numpy().astype(np.int64).reshape(2, -1)
    n = len(both.dictionary) or 1
    keys = []
    for t in to:
        term = t[codes]
        keys.append((doc * n + term)[term >= 0])
    seen = np.unique(np.concatenate(keys))
    return seen // n, seen % n, both.dictionary


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks_by_bytes(whole, "text"):
            doc, term, names = _presence(text_array(batch.column("text")))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            n = np.bincount(term, minlength=len(names))
            ones = np.bincount(term, weights=label[doc], minlength=len(names)).astype(np.int64)
            yield pa.record_batch({"term": names.cast(pa.string()), "n": pa.array(n, pa.int64()), "ones": pa.array(ones)})


@dataclass
class Vocabulary:
    terms: list[str]

    def __post_init__(self):
        self.number = pa.array(self.terms, pa.large_string())

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, term number, occurrences) of the terms in whole texts, sorted."""
        codes, offsets, dictionary = word_codes(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        keys = []
        for names in _terms(dictionary):
            to = pc.fill_null(pc.index_in(names, self.number), -1).to_numpy().astype(np.int64)[codes]
            keys.append((doc * len(self.terms) + to)[to >= 0])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return key // len(self.terms), key % len(self.terms), n


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    ids: np.ndarray        # of the examples in the index, by block
    labels: np.ndarray
    weights: np.ndarray    # terms x examples
    bounds: np.ndarray     # terms x blocks: largest weight
    slope: float
    shift: float
    unmarked: float        # probability without any term

    def vectors(self, texts: pa.Array):
        """(text number, terms, unit TF-IDF weights) of the texts that have terms."""
        if not self.vocabulary.terms or not len(self.ids):
            return
        doc, term, n = self.vocabulary.counts(texts)
        w = (1 + np.log(n)) * self.idf[term]
        edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-2)) if len(doc) else []
        for a, b in zip(edges, edges[1:]):
            yield int(doc[a]), term[a:b], w[a:b] / np.sqrt((w[a:b] ** 2).sum())

    def nearest(self, terms: np.ndarray, q: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the nearest examples with a cosine above 0."""
        bound = q @ self.bounds[terms]
        found_i, found_s, least, have = [], [], 0.0, 0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or have >= NEIGHBOURS and bound[b] < least - 1e-12:
                break
            a = b * BLOCK
            s = q @ self.weights[terms, a:a + BLOCK]
            keep = np.flatnonzero(s >= max(least - 1e-12, 1e-300))
            if a <= skip < a + BLOCK:
                keep = keep[keep != skip - a]
            found_i.append(keep + a)
            found_s.append(s[keep])
            have += len(keep)
            if have >= NEIGHBOURS:
                least = np.partition(np.concatenate(found_s), have - NEIGHBOURS)[have - NEIGHBOURS]
        if not found_i:
            return np.empty(0, np.int64), np.empty(0)
        i, s = np.concatenate(found_i), np.concatenate(found_s)
        order = np.lexsort((self.ids[i], -s))[:NEIGHBOURS]
        return i[order], s[order]

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        return float((s * self.labels[i]).sum() / (s.sum() + 0.5))

    def score(self, texts: pa.Array, evidence: bool = False):
        """Probabilities of label 1; with ``evidence`` also each text's nearest examples."""
        out, near = np.full(len(texts), self.unmarked), [[] for _ in range(len(texts))] if evidence else None
        for d, terms, q in self.vectors(texts):
            i, s = self.nearest(terms, q)
            if len(i):
                out[d] = 1 / (1 + np.exp(-(self.slope * self.vote(i, s) + self.shift)))
            if evidence:
                near[d] = [{"example_id": self.ids[k].item(), "cosine": float(c), "label": int(self.labels[k])} for k, c in zip(i, s)]
        return (out, near) if evidence else out


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through votes, with Platt's smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, w = np.column_stack([v, np.ones(len(v))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-6 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", examples: int = EXAMPLES, terms: int = TERMS) -> Model:
    """A model from ``labels`` (``id_col``, ``label_col`` 0 or 1) and the texts of ``docs``."""
    small_batches(docs.sparkSession)
    all_texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = (labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"))
              .dropna().groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(examples))
    # at most `examples` rows: of rows that repeat an id, the smallest text
    sample = stored(all_texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "examples")

    counted = (sample.select("text", "label").mapInArrow(_count_terms, "term string, n long, ones long")
               .groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")))
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    names: list[str] = []
    if 0 < size["ones"] < size["n"]:
        share = size["ones"] / size["n"]
        expected = F.col("n") * share
        chi = F.pow(F.col("ones") - expected, 2) / (expected * (1 - share))
        names = [r["term"] for r in (counted.filter((F.col("n") >= LEAST_DOCUMENTS) & (F.col("ones") > expected))
                                     .withColumn("chi", chi).filter(F.col("chi") > LEAST_CHI_SQUARE)
                                     .orderBy(F.desc("chi"), "term").limit(terms).collect())]
    vocabulary = Vocabulary(sorted(names))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(len(vocabulary.terms), np.int64)
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                total += batch.num_rows
                found += np.bincount(vocabulary.counts(text_array(batch.column("text")))[1], minlength=len(found))
        yield pa.record_batch({"term": pa.array([-1, *range(len(found))], pa.int64()), "n": pa.array([total, *found], pa.int64())})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                doc, term, n = vocabulary.counts(text_array(batch.column("text")))
                cut = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label"),
                                       "terms": pa.ListArray.from_arrays(cut, pa.array(term, pa.int32())),
                                       "n": pa.ListArray.from_arrays(cut, pa.array(n, pa.int32()))})

    if not names:
        rate = size["ones"] / (size["n"] + 1)
        return Model(vocabulary, np.empty(0), np.empty(0, np.int64), np.empty(0), np.empty((0, 0)), np.empty((0, 0)), 0.0, 0.0, rate)
    id_type = all_texts.schema["id"].dataType.simpleString()
    df = dict(all_texts.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    rows = sample.mapInArrow(vectors, f"id {id_type}, label long, terms array<int>, n array<int>").collect()
    idf = np.log((df[-1] + 1) / (np.array([df[t] for t in range(len(names))]) + 1))
    return _index(vocabulary, idf, rows)


def _index(vocabulary: Vocabulary, idf: np.ndarray, rows: list) -> Model:
    marked, bare = [], []
    for r in rows:
        (marked if r["terms"] else bare).append(r)
    unmarked = sum(r["label"] for r in bare) / (len(bare) + 1)
    vectors = []
    for r in marked:
        t = np.array(r["terms"])
        w = (1 + np.log(np.array(r["n"]))) * idf[t]
        norm = np.sqrt((w ** 2).sum())
        vectors.append((t, w / norm if norm > 0 else w))
    # neighbours in the index share their heaviest term, so that few blocks have high bounds
    order = sorted(range(len(marked)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), marked[i]["label"], marked[i]["id"]))
    ids = np.array([marked[i]["id"] for i in order])
    labels = np.array([marked[i]["label"] for i in order], float)
    weights = np.zeros((len(idf), len(order)))
    for j, i in enumerate(order):
        weights[vectors[i][0], j] = vectors[i][1]
    blocks = -(-len(order) // BLOCK)
    bounds = np.stack([weights[:, b * BLOCK:(b + 1) * BLOCK].max(axis=1) for b in range(blocks)], axis=1)
    model = Model(vocabulary, idf, ids, labels, weights, bounds, 0.0, 0.0, unmarked)
    votes = np.array([model.vote(*model.nearest(*vectors[i], skip=j)) for j, i in enumerate(order)])
    model.slope, model.shift = _logistic(votes, labels)
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``score`` (0 to 1) and ``evidence``, the nearest labelled
    examples with cosine and label, nearest first."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()
    text_ids = model.ids.dtype.kind == "U"
    example, example_type = (pa.string(), "string") if text_ids else (pa.int64(), "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("example_id", example), ("cosine", pa.float64()), ("label", pa.int32())]))
        for whole in batches:
            for batch in chunks_by_bytes(whole, "text"):
                s, near = shared.value.score(text_array(batch.column("text")), evidence=True)
                yield pa.record_batch({"id": batch.column("id"), "score": pa.array(s), "evidence": pa.array(near, kind)})

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, score double, evidence array<struct<example_id:{example_type},cosine:double,label:int>>"
                           ).withColumnRenamed("id", id_col)


def score_column(spark, model: Model, text: Column) -> Column:
    """The score as a column expression, for filters that keep all columns."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text_array(texts)))

    return scored(text)
