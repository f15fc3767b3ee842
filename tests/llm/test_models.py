"""Toxicity and quality: exact neighbours, held-out accuracy, estimation, edge cases."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tabprobe.llm import quality as Q, toxicity as X
from tabprobe.llm._common import text_array

from .conftest import EDGE_ROWS, prose

BAD = ["vilewort", "grimslur", "nastyism"]


def labelled(n=300):
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = prose(1000 + i, 60).split()
        if toxic:
            words[i % 50], words[(i * 7) % 50] = BAD[i // 3 % 3], BAD[(i // 3 + 1) % 3]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_learns_and_gives_evidence(spark, docs_of):
    docs, labels = labelled()
    df = docs_of(docs + [r for r in EDGE_ROWS if r[0] is None or r[0] > 13])
    table = spark.createDataFrame([(i, t) for i, t in labels if i < 200] + [(5, None), (999, 1), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = X.fit(df, table)
    assert set(BAD) <= set(model.vocabulary.terms)
    got = {r.doc_id: r for r in X.score(df, model).collect()}
    assert all((got[i].score >= 0.5) == bool(t) for i, t in labels if i >= 200)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[201].evidence and all(e.label == 1 for e in got[201].evidence) and got[None].evidence == []
    cosines = [e.cosine for e in got[201].evidence]
    assert cosines == sorted(cosines, reverse=True)


def test_text_ids_and_an_id_with_most_rows(spark):
    docs, labels = labelled(90)
    rows = [(f"d{i:03}", t) for i, t in docs] + [("d003", f"{prose(k, 9)} more") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    model = X.fit(df, spark.createDataFrame([(f"d{i:03}", t) for i, t in labels], "doc_id string, toxic int"))
    assert len(set(model.ids.tolist())) == len(model.ids) <= 90
    got = X.score(df, model).collect()
    assert len(got) == 150 and {e.example_id for r in got for e in r.evidence} <= {i for i, _ in rows}
    assert any(r.evidence for r in got)
    scorer = Q.fit(df, sample=50)
    assert Q.score(df, scorer).count() == 150


def test_block_max_search_is_exact():
    r = np.random.default_rng(5)
    terms, n = 40, 500
    rows = []
    for i in range(n):
        t = np.sort(r.choice(terms, r.integers(0, 6), replace=False))
        rows.append({"id": i, "label": int(r.random() < 0.5), "terms": t.tolist(), "n": r.integers(1, 4, len(t)).tolist()})
    model = X._index(X.Vocabulary([f"t{k:02}" for k in range(terms)]), r.uniform(0.1, 5, terms), rows)
    for _ in range(100):
        t = np.sort(r.choice(terms, r.integers(1, 6), replace=False))
        q = r.random(len(t))
        q /= np.linalg.norm(q)
        s = q @ model.weights[t]
        order = [j for j in np.lexsort((model.ids, -s)) if s[j] > 0][:X.NEIGHBOURS]
        i, found = model.nearest(t, q)
        assert i.tolist() == order and np.allclose(found, s[order])


def test_toxicity_edge_cases(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(docs_of(EDGE_ROWS), none)
    assert {r.score for r in X.score(docs_of(EDGE_ROWS), model).collect()} == {0.0}
    docs, labels = labelled(60)
    model = X.fit(docs_of(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert X.score(docs_of(EDGE_ROWS), model).count() == len(EDGE_ROWS)
    assert X.score(docs_of([]), model).count() == 0 and X.fit(docs_of([]), none).score(text_array(pa.array(["a"])))[0] == 0


def test_toxicity_of_held_out_rows(spark):
    from tabprobe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_toxicity"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.95
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_estimation_finds_accuracies():
    r = np.random.default_rng(6)
    n, names = 20_000, list(Q.LABELLERS)
    fine = r.random(n) < 0.7
    right = np.linspace(0.6, 0.95, len(names))
    votes = np.where(r.random((n, len(names))) < right, np.where(fine, Q.FINE, Q.JUNK)[:, None], np.where(fine, Q.JUNK, Q.FINE)[:, None])
    votes[r.random(votes.shape) < 0.4] = Q.NOTHING
    patterns, count = np.unique(votes @ 3 ** np.arange(len(names)), return_counts=True)
    belief, accuracy, share = Q.posteriors(dict(zip(patterns.tolist(), count.tolist())))
    assert abs(share - 0.7) < 0.03 and np.allclose([accuracy[k] for k in names], right, atol=0.04)


def test_quality_agrees_with_labels(spark):
    from tabprobe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) >= 0.97
    assert all(r.kept for r in rows if r.quality)


def test_quality_edge_cases(docs_of):
    df = docs_of(EDGE_ROWS + [(50, "BUY NOW!! " * 40), (51, "*** ### $$$ " * 30)])
    model = Q.fit(df)
    got = Q.score(df, model).collect()
    assert len(got) == len(EDGE_ROWS) + 2 and all(0 <= r.score <= 1 and len(r.votes) == len(Q.LABELLERS) for r in got)
    votes = {r.doc_id: dict(zip(Q.LABELLERS, r.votes)) for r in got}
    assert votes[1]["no_words"] == votes[2]["no_words"] == votes[3]["no_words"] == "J" and votes[50]["capital_words"] == "J" and votes[51]["symbols"] == "J"
    assert Q.score(docs_of([]), Q.fit(docs_of([]))).count() == 0
    assert Q.fit(docs_of([])).score(text_array(pa.array(["a"])))[0] == 0.5


LICENCES = Path("/usr/share/common-licenses")


def long_prose(words: int) -> str:
    """Real prose: the licence texts of the system one after another, from the start again until there are enough words."""
    texts = [p.read_text() for p in sorted(LICENCES.iterdir()) if not p.is_symlink() and p.name != "BSD"]
    out, n = [], 0
    while n < words:
        out.append(texts[len(out) % len(texts)])
        n += len(out[-1].split())
    return "\n".join(out)


def measure(text: str, name: str) -> float:
    return float(Q.Texts.of(text_array(pa.array([text]))).measures[0, list(Q.LABELLERS).index(name)])


def test_variety_does_not_depend_on_length():
    w = [f"w{k}" for k in range(150)]
    for n in (200, 2_000, 50_000):
        assert abs(measure(" ".join(w[k % 200 % 150] for k in range(n)), "little_variety") - 0.25) < 1e-9
    # every window counts, the last and shorter one too, and windows of one text do not reach into the next
    two = Q.Texts.of(text_array(pa.array([" ".join(w[:100] * 3), " ".join(w[:100]), None, " ".join(["same"] * 30)])))
    assert np.allclose(two.measures[:, list(Q.LABELLERS).index("little_variety")], [1 / 3, 0, 0, 29 / 30])


@pytest.mark.skipif(not LICENCES.is_dir(), reason="no licence texts on this system")
def test_long_clean_prose_is_kept(spark):
    text = long_prose(50_000)
    assert len(text.split()) >= 50_000
    assert measure(text, "little_variety") < 0.45 and measure(text, "not_prose") < 1
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(-1, text), (-2, "cheap pills buy " * 20_000)], docs.schema))
    got = {r.doc_id: r for r in Q.score(df, Q.fit(df)).filter("doc_id < 0").collect()}
    votes = dict(zip(Q.LABELLERS, got[-1].votes))
    assert votes["little_variety"] == "-" and votes["not_prose"] == "F"
    assert got[-1].score >= 0.5 and got[-1].posterior >= 0.5 and got[-2].score < 0.5
