import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tabprobe.llm import periodic_runs as P
from tests.llm.conftest import EDGE_ROWS, prose


def brute(words):
    """All runs by comparing every pair of places, smallest periods first."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs))


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def shapes():
    r = np.random.default_rng(5)
    for k in (1, 2, 3):
        for n in (0, 1, 5, 6, 7, 40, 150):
            yield r.integers(0, k, n).tolist()
    for n in (100, 500):
        yield thue_morse(n)
        yield fibonacci(n)
    for m in (1, 2, 3, 7, 8, 16, 31, 32, 33):  # blocks that are periodic themselves
        yield ([0] * m + [1] * m) * 4
        yield [2, 3] + ([0] * m + [1]) * 5 + [0] * (m // 2) + [4]
        yield ([0, 1] * m + [0]) * 4 + [0, 1] * m
    for _ in range(30):  # repeated pieces within noise
        text = r.integers(0, 4, r.integers(0, 40)).tolist()
        for _ in range(r.integers(1, 4)):
            q = int(r.integers(1, 40))
            piece = r.integers(0, r.integers(1, 6), q).tolist()
            text += (piece * 9)[:int(q * r.uniform(3, 9))] + r.integers(0, 9, r.integers(0, 9)).tolist()
        yield text


@pytest.mark.parametrize("piece", [1, 7, 64, 10_000])
def test_runs_equal_brute_force_however_the_text_arrives(piece):
    for words in shapes():
        catchers = P.SquareCatchers()
        for at in range(0, len(words), piece):
            catchers.append(np.array(words[at:at + piece]))
        assert catchers.runs() == brute(words), words


def test_many_texts_in_one_stream():
    texts = [" ".join(map(str, words)) for words in shapes()]
    for piece in (50, 1 << 18):
        words, offsets = P.words_of(pa.array(texts, pa.large_string()))
        text, *parts = P.runs_of(words, offsets, piece)
        got = [[] for _ in texts]
        for t, *run in zip(text.tolist(), *(p.tolist() for p in parts)):
            got[t].append(tuple(run))
        assert got == [brute(t.split()) for t in texts]
        joined = P.collapsed(words, offsets, text, *parts).to_pylist()
        assert joined == [brute_collapsed(t.split(), r) for t, r in zip(texts, got)]


def test_squares_are_reported_as_words_arrive():
    catchers = P.SquareCatchers()
    text = [9, 8] + [0, 1, 2] * 5 + [7]
    caught = [[s for s in catchers.append(np.array([w])) if s[2] == 3] for w in text]
    assert [c for c in caught if c] == [[(2, n, 3)] for n in range(6, 16)]  # at once with the sixth word
    assert catchers.runs() == [(2, 15, 3)]


def test_long_run_and_long_text():
    rng = np.random.default_rng(3)
    period = rng.integers(0, 50, 4000)
    text = np.concatenate([rng.integers(0, 50, 30_000), np.tile(period, 5)[:17_000], [60], np.zeros(20_000, int)])
    catchers = P.SquareCatchers()
    for at in range(0, len(text), 9_999):
        catchers.append(text[at:at + 9_999])
    got = [r for r in catchers.runs() if r[1] > 100]
    end = 47_000
    start = 30_000 - next(i for i in range(1, 100) if text[30_000 - i] != text[34_000 - i]) + 1
    assert got == [(start, end - start, 4000), (47_001, 20_000, 1)]


def test_edge_rows(spark, docs_of):
    rows = EDGE_ROWS + [(20, "a b " * 9), (20, "a b " * 9), (21, "\x0b\x1c \x0c x y\tx y x y\nx y\rx y x y"), (22, "na " * 30_000)]
    got = sorted(map(str, ((r[0], [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(docs_of(rows)).collect())))

    def one(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute(words) if len(words) < 500 else ([(0, 30_000, 1)] if i == 22 else [])
        return i, runs, brute_collapsed(words, runs) if len(words) < 500 else ("na" if i == 22 else " ".join(words))

    want = [one(i, t) for i, t in rows]
    assert got == sorted(map(str, want)) and len(got) == len(rows)
    assert P.periodic_runs(docs_of([])).count() == 0


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{a},{b},{q}\n" for a, b, q in runs)), sha(brute_collapsed(words, runs)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_registered_query_on_given_documents(spark):
    """Against brute force on all documents of up to 400 words."""
    from tabprobe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    short = [i for i, t in docs.items() if len((t or "").split()) <= 400]
    assert set(got) == set(docs) and len(short) > 50
    assert {i: got[i] for i in short} == {i: expected(i, docs[i]) for i in short}
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_query_digests_of_planted_and_odd_rows(spark, docs_of):
    from tabprobe.llm.queries import run_digests
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:25]
    rows = [(i, prose(i, 1 + 7 * k)) for k, i in enumerate(planted)] + [(planted[0], " "), (planted[1], None), (None, "b " * 8), (3, "c d\n" * 8)]
    got = sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in run_digests(docs_of(rows)).collect())))
    assert got == sorted(str(expected(*r)) for r in rows)
