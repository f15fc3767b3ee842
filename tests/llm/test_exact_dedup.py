import hashlib
from collections import Counter, defaultdict

import pytest

from tabprobe.llm import exact_dedup as D

from .conftest import EDGE_ROWS


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("buckets", [1 << 20, 3])
def test_matches_brute_force(docs_of, buckets):
    rows = EDGE_ROWS + [(20, "Ä b"), (21, "ä b"), (22, "Ä B")]
    ids, count = defaultdict(list), Counter()
    for i, t in rows:
        ids[lowered(t)].append(i)
    expected = []
    for i, t in rows:
        group = ids[lowered(t)]
        known = [x for x in group if x is not None]
        expected.append((i, max(known) if known else None, len(group), hashlib.sha256(lowered(t).encode()).hexdigest()))
    got = D.exact_dedup(docs_of(rows), digest_all=True, buckets=buckets).collect()
    key = repr
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(expected, key=key)
    kept = Counter(r.keep_id for r in got if r.kept)
    assert all(n == 1 for n in kept.values()) and len(kept) == len(ids)


def test_drop_copies_keeps_whole_rows(docs_of):
    df = docs_of(EDGE_ROWS)
    out = D.drop_copies(df)
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len({lowered(t) for _, t in EDGE_ROWS}) == len({lowered(t) for _, t in kept})
    assert (9, dict(EDGE_ROWS)[9]) in kept and (3, "   ") in kept


def test_empty_table_and_text_hashed_only_when_needed(docs_of):
    assert D.exact_dedup(docs_of([])).count() == 0 and D.drop_copies(docs_of([])).count() == 0
    got = {r.doc_id: r.text_sha256 for r in D.exact_dedup(docs_of([(1, "a"), (2, "bb"), (3, "A")])).collect()}
    assert got[2] is None and got[1] == got[3] is not None
