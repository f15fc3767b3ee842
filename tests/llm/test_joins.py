"""N-gram join and line dedup against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabprobe.llm import line_dedup as LD, ngram_join as NJ
from tabprobe.llm.verify import components_of

from .conftest import EDGE_ROWS, prose


def classes(keys, pairs):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def variants(seed, words, n):
    """n texts that differ from each other in one word each."""
    base = prose(seed, words).split()
    return [" ".join(base[:10 + k] + [f"changed{k}"] + base[11 + k:]) for k in range(n)]


def near_rows():
    rows = list(EDGE_ROWS) + [(100 + k, t) for k, t in enumerate(variants(9, 120, 12))]
    rows += [(200 + k, variants(10, 80, 1)[0]) for k in range(5)]
    return rows + [(300, prose(11, 400)), (301, prose(11, 400) + " " + prose(12, 60)), (302, prose(11, 400) + " " + prose(13, 150))]


def test_ngram_join_matches_brute_force(docs_of, monkeypatch):
    rows = near_rows()
    sets, copies = {}, {}
    for i, t in rows:
        w = (t or "").lower().split()
        if i is not None and w:
            sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
            copies[i] = copies.get(i, 0) + 1
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = classes(sets, pairs)
    links = {i: copies[i] - 1 for i in sets}
    for a, b in pairs:
        links[a] += copies[b]
        links[b] += copies[a]
    for block in (256, 3):  # one block a group, then many
        monkeypatch.setattr(NJ, "BLOCK_ROWS", block)
        got = NJ.ngram_join(docs_of(rows)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.class_id, r.n_links) == ((root[r.doc_id], links[r.doc_id]) if r.doc_id in sets else (r.doc_id, 0)), r
    kept = NJ.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(set(ids), key=str) == sorted({root.get(i, i) for i, _ in rows}, key=str) and None in ids


def test_bands_reach_the_recall():
    bands, rows = NJ.bands_for()
    assert 1 - (1 - 0.8 ** rows) ** bands >= NJ.RECALL and bands * rows <= NJ.MOST_HASHES
    r = np.random.default_rng(3)
    shared = r.integers(0, 1 << 63, 800, np.uint64)
    a, b = (np.unique(np.concatenate([shared, r.integers(0, 1 << 63, 100, np.uint64)])) for _ in range(2))
    keys = NJ.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 2000, 1)
    assert abs((keys[0] == keys[1]).mean() - 0.8) < 0.04  # MinHash estimates the similarity


@pytest.mark.parametrize("group_rows", [4096, 2])
def test_line_dedup_matches_brute_force(docs_of, monkeypatch, group_rows):
    monkeypatch.setattr(LD, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(LD, "BLOCK_SETS", group_rows)
    r = random.Random(5)
    lines = variants(20, 25, 9) + [prose(k, 12) for k in range(12)] + ["", "short line", "Short  LINE", "   "]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(6))) for i in range(40)] + [(50, None), (51, ""), (None, "short line\nshort line")]
    all_lines = [(i, n, frozenset(x.lower().split())) for i, t in rows if i is not None for n, x in enumerate((t or "").split("\n"))]
    all_lines.sort(key=lambda x: x[:2])
    pairs = [(a[:2], b[:2]) for a, b in combinations(all_lines, 2) if a[2] and len(a[2] & b[2]) >= 0.8 * len(a[2] | b[2])]
    root = classes([x[:2] for x in all_lines], pairs)
    links, first = {x[:2]: 0 for x in all_lines}, {}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        first[b] = min(first.get(b, a), a)
    out = LD.line_dedup(docs_of(rows))
    got = out.collect()
    assert len(got) == len(all_lines) + 2
    for x in got:
        if x.doc_id is None:
            assert x.kept and x.n_links == 0
            continue
        key = (x.doc_id, x.line_no)
        assert (x.n_links, (x.class_id, x.class_line), x.kept) == (links[key], root[key], key not in first)
        assert (x.match_id, x.match_line) == first.get(key, (None, None))
    cleaned = {r.doc_id: r.text for r in LD.remove_lines(docs_of(rows), out).collect()}
    for i, t in rows:
        if i is not None and t is not None:
            assert cleaned[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in first)
    assert cleaned[50] is None and cleaned[None] == "short line\nshort line"


def test_lines_of_rows_that_repeat_an_id(docs_of):
    """One id on a short text, a long one, and one whose first lines are others; near and equal lines between them."""
    near = variants(33, 30, 4)
    long = [prose(100 + k, 12) for k in range(31)]
    rows = [(1, "short"), (1, "\n".join(long)), (1, "\n".join([near[0], long[0], near[1]])), (2, "\n".join([near[2], long[30], "short"])), (3, near[3])]
    lines = [(i, n, frozenset(x.lower().split())) for i, t in rows for n, x in enumerate(t.split("\n"))]
    want = []
    for i, n, w in lines:
        alike = [(a, b) for a, b, v in lines if len(w & v) >= 0.8 * len(w | v)]
        first = min(alike)
        want.append((i, n, len(alike) - 1, first if first < (i, n) else (None, None)))
    got = [(r.doc_id, r.line_no, r.n_links, (r.match_id, r.match_line)) for r in LD.line_dedup(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lines_are_the_sets_of_their_words():
    """Words cut at all white space, equal ones once, in one order for all lines; breaks and empty texts at any place."""
    r = random.Random(11)
    parts = ["a", "B", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "\u2028", "\u3000", "\u00e9", "\u00c2", "\u2019s", "\U0001f600", "eightlet", "longerword", "w" * 40]
    texts = ["", "x", "", "a\n", "\nb", "\n", " ", "", "y" * 30_000 + " y", *("".join(r.choices(parts, k=r.randrange(80))) for _ in range(300)), ""]
    split = [(i, n, frozenset(x.lower().split())) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    ranks = np.random.default_rng(2).permutation(LD.BUCKETS).astype(np.int32)
    for order in (None, ranks, np.zeros(LD.BUCKETS, np.int32)):
        lines = LD.Lines(pa.array(["first", *texts], pa.large_string()).slice(1), order)
        assert [*zip(lines.text.tolist(), lines.number.tolist())] == [x[:2] for x in split]
        sets = [lines.words[a:b].tolist() for a, b in zip(lines.start, lines.start[1:])]
        hashes = {}
        for (_, _, words), found in zip(split, sets):
            assert len(found) == len(set(found)) == len(words)
            assert found == sorted(found, key=lambda h: ((order[h % LD.BUCKETS] if order is not None else 0), h))
            assert hashes.setdefault(words, set(found)) == set(found)
        assert len({frozenset(x) for x in hashes.values()}) == len(hashes)


def test_counters_and_postings_are_packed(spark, docs_of, monkeypatch):
    """Few rows whatever the words; a bucket compared some of its groups at a time gives the same components."""
    r = random.Random(12)
    near = [x for k in range(12) for x in variants(50 + k, 20, 4)]
    rows = [(i, "\n".join([*r.sample(near, 8), " ".join(f"word{r.randrange(10**6)}" for _ in range(60))])) for i in range(60)]
    docs = docs_of(rows).select(F.col("doc_id").alias("id"), "text").coalesce(2)
    split = LD._split(docs).collect()
    assert 0 < sum(x.line is None for x in split) <= 2 * LD.BUCKETS // LD.SLICE and sum(x.line is not None for x in split) == 60 * 9
    assert sum(np.frombuffer(x.counts, np.int32).sum() for x in split if x.line is None) == sum(x.size for x in split if x.line is not None)
    counters = np.full(LD.BUCKETS, 2, np.int32)
    shared = spark.sparkContext.broadcast((counters, np.arange(LD.BUCKETS, dtype=np.int32)))
    posted = sorted(LD._postings(docs, shared, 0.8, 3).collect())
    assert len(posted) <= 2 * 3 and sum(len(x.rows) for x in posted) // 48 > 1000
    components = []
    for most in (LD.COMPARED_ROWS, 100):
        monkeypatch.setattr(LD, "COMPARED_ROWS", most)
        batches = [pa.record_batch({"bucket": pa.array([x.bucket], pa.int32()), "rows": pa.array([bytes(x.rows)], pa.binary())}) for x in posted]
        edges = [(a, b) for batch in LD._candidates(0.8, 3)(iter(batches)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
        components.append(classes(sorted({x for e in edges for x in e}), sorted(edges)))
    assert components[0] == components[1] and len(components[0]) > 12


def test_thresholds_of_the_ngram_join(docs_of):
    for t in (0.3, 0.5, 0.7, 0.74, 0.95, 1.0):
        bands, rows = NJ.bands_for(t)
        assert 1 - (1 - t ** rows) ** bands >= NJ.RECALL and bands * rows <= NJ.MOST_HASHES
    for wrong in (0.01, 0, -1, 1.1):
        with pytest.raises(ValueError):
            NJ.bands_for(wrong)


def test_edge_rows_and_empty_tables(docs_of):
    rows = list(dict.fromkeys(EDGE_ROWS))
    assert LD.line_dedup(docs_of(rows)).count() == sum(len((t or "").split("\n")) for _, t in rows)
    assert LD.line_dedup(docs_of([])).count() == 0
    assert NJ.ngram_join(docs_of([])).count() == 0 and NJ.keep_one(docs_of([])).count() == 0


def test_components():
    r = np.random.default_rng(4)
    for _ in range(20):
        a, b = r.integers(0, 50, (2, 30))
        expected = classes(range(50), zip(a.tolist(), b.tolist()))
        assert components_of(a, b, 50).tolist() == [expected[k] for k in range(50)]
