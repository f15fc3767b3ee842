"""SentencePiece and packing."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabprobe.llm import packing, sentencepieces as SP
from tabprobe.llm._common import text_array
from tabprobe.llm.tokenizing import WordEncoder

from .conftest import EDGE_ROWS, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  a  b ", "Ａﬁ x\ty\n", "日本語 テスト 𝄞", "a" * 300, " x", "x ", "\x00\x01é", "a\n\nb  c   d", "<|endoftext|> it's we'll",
         "a  b", "1,234 x2y", prose(1, 40)]


@pytest.fixture(scope="module")
def model():
    return SP.load(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def bpe():
    t = Tokenizer.from_file(BPE)
    return t


def viterbi(model, text):
    """Best segmentation of the whole marked text, character by character; ties keep the earliest start."""
    if not text:
        return []
    text = SP.MARKER + text.replace(" ", SP.MARKER)
    number = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (SP.NORMAL, SP.USER_DEFINED)}
    longest = max(map(len, number))
    best = [(0.0, None, None)] + [(-np.inf, None, None)] * len(text)
    for a in range(len(text)):
        found = [(b, number[text[a:b]], model.scores[number[text[a:b]]]) for b in range(a + 1, min(len(text), a + longest) + 1) if text[a:b] in number]
        if not any(b == a + 1 for b, _, _ in found):
            found.append((a + 1, model.unknown, model.unknown_score))
        for b, i, s in found:
            if best[a][0] + s > best[b][0]:
                best[b] = (best[a][0] + s, a, i)
    out, at = [], len(text)
    while at:
        _, a, i = best[at]
        out.append([int(model.byte[x]) for x in text[a:at].encode()] if i == model.unknown else [i])
        at = a
    return [i for ids in reversed(out) for i in ids]


def both(model, texts):
    ids, offsets = model.encode(text_array(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])], model.decode(ids.astype(np.int64), offsets)


def test_segmentation_is_the_best_of_the_whole_text(model):
    got, texts = both(model, TEXTS + ["▁a▁▁b"])
    assert got == [viterbi(model, t) for t in TEXTS + ["▁a▁▁b"]]
    assert texts == TEXTS + [" a  b"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aethr no.\n é日"), max_size=30), min_size=1, max_size=4))
def test_any_text_comes_back(model, texts):
    got, back = both(model, texts)
    assert back == texts and got == [viterbi(model, t) for t in texts]


def test_the_library_decodes_the_ids_alike(model):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got, _ = both(model, TEXTS)
    assert [lib.decode(x) for x in got] == TEXTS


def test_double_array_finds_its_keys_only():
    keys = [b"a", b"ab", b"b", b"\xff\x00", b"abcd", bytes(range(256))]
    base, check, value = SP.double_array(keys, list(range(len(keys))))

    def look(word):
        s = 0
        for c in word:
            s, before = base[s] + c, s
            if check[s] != before:
                return -1
        return value[s]

    assert [look(k) for k in keys] == list(range(len(keys)))
    assert [look(k) for k in (b"abc", b"c", b"ba", b"\xff", b"aba")] == [-1] * 5


def test_encode_and_decode_tables(docs_of, model):
    encoded = SP.encode(docs_of(EDGE_ROWS), model)
    got = SP.decode(encoded, model).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((i, t or "") for i, t in EDGE_ROWS), key=repr)
    assert SP.decode(SP.encode(docs_of([]), model), model).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ1'.s \n\t  é日"), max_size=25), min_size=1, max_size=4))
def test_word_by_word_ids_are_the_whole_texts_ids(bpe, texts):
    ids, offsets = WordEncoder(BPE).encode(text_array(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [bpe.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("length", [2048, 64])
def test_pieces_cover_each_document_once(docs_of, bpe, length):
    rows = [r for n, r in enumerate(EDGE_ROWS) if n != 7] + [(100 + n, t) for n, t in enumerate(TEXTS)] + [(1000 + n, "same text") for n in range(300)]
    pieces = packing.pack(docs_of(rows), BPE, length=length).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array(bpe.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == ids.tobytes() and {p.doc_tokens for p in own} == {len(ids)}
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
    for spans in by_sequence.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist() and sum(n for _, n in spans) <= length
    assert sum(sum(n for _, n in s) < length for s in by_sequence.values()) <= 8  # one short sequence a partition
    assert packing.pack(docs_of([]), BPE).count() == 0


def test_registered_query_derives_the_digest(spark):
    from tabprobe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_packing"](spark, sf).collect()
    t = Tokenizer.from_file(BPE)
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in texts.items()}
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes()) for p in got)
    assert sum(p.length for p in got) == sum(map(len, ids.values()))


def test_hilbert_curve_visits_each_point_by_unit_steps():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_ids_are_those_of_the_plain_call(bpe):
    """Special tokens' strings, odd white space and words beyond the memory; batches of any size."""
    from tabprobe.llm import tokenizing
    texts = TEXTS + ["a <|endoftext|>b", "<|endoftext|>", "x<|endoftext|> <|endoftext|> y", "end\n", "\tw end\n next", " ", "é ü ß", "a\u00a0b c"]
    texts += [prose(i, 30) + f" w{i}x" for i in range(200)]
    want = [bpe.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[texts.index("<|endoftext|>")] == [50256]
    import pyarrow as pa
    for most in (5, 300_000):
        enc = tokenizing.WordEncoder(BPE)
        tokenizing.KEPT_WORDS, kept = most, tokenizing.KEPT_WORDS
        try:
            for step in (7, 300, 1):
                got = []
                for i in range(0, len(texts), step):
                    ids, cut = enc.encode(pa.array(texts[i:i + step], pa.large_string()))
                    got += [ids[a:b].tolist() for a, b in zip(cut, cut[1:])]
                assert got == want
        finally:
            tokenizing.KEPT_WORDS = kept


def test_an_id_with_most_rows_adds_one_to_the_sample(spark, docs_of, monkeypatch):
    import public_tokenizers as pt
    seen = []
    real = packing._cuts
    monkeypatch.setattr(packing, "_cuts", lambda sampled, parts: seen.append(sampled.num_rows) or real(sampled, parts))
    rows = [(1, prose(i, 20)) for i in range(60)] + [(i, prose(i, 5)) for i in range(2, 8)]
    assert packing.pack(docs_of(rows), pt.path("byte_bpe_50k.json")).agg({"doc_tokens": "count"}).first()[0] >= len(rows)
    assert seen == [7]
