from tabprobe.llm import license_scan as L
from tabprobe.llm.license_texts import KNOWN

from .conftest import EDGE_ROWS


def test_whole_licences_in_other_spellings(docs_of):
    mit = next(t for i, k, t in KNOWN if (i, k) == ("MIT", "text"))
    rows = [(1, mit), (2, "Copyright (c) 2020 Some One\n" + mit.upper().replace("\n", "  \n")),
            (3, mit.replace("sublicense", "sub-license").replace("License", "Licence")), (4, mit + " and more"), (5, None), (6, "")]
    got = {r.doc_id: r for r in L.scan_licenses(docs_of(rows)).collect()}
    assert [got[i].license_id for i in range(1, 7)] == ["MIT", "MIT", "MIT", None, None, None]
    assert got[1].text_digest == got[2].text_digest == got[3].text_digest and got[5].text_digest == got[6].text_digest


def test_notices_in_lines(docs_of):
    rows = [(1, "words\nLICENSED under the apache Licence, v2.0\nAll rights reserved!\nAll rights reserved."), (2, "All rights reserved"), (3, "no")]
    got = {r.doc_id: r for r in L.scan_licenses(docs_of(rows)).collect()}
    assert got[1].notices == ["Apache-2.0", "all-rights-reserved"] and got[1].notice_lines == 3 and got[1].license_id is None
    assert got[2].license_id == "all-rights-reserved" and got[2].kind == "notice"
    assert got[3].notices == [] and got[3].notice_lines == 0


def test_edge_rows(docs_of):
    assert L.scan_licenses(docs_of(EDGE_ROWS)).count() == len(EDGE_ROWS)
    assert L.scan_licenses(docs_of([])).count() == 0


def test_full_texts_of_long_licences(docs_of):
    texts = {i: t for i, k, t in KNOWN if k == "text" and not t.startswith("All rights reserved.") and len(t) > 5_000}
    assert {"Apache-2.0", "CC0-1.0", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(texts)
    names = sorted(texts)
    rows = [(n, texts[i]) for n, i in enumerate(names)] + [(100 + n, "(c) 2019 J. R. Smith\n" + texts[i].upper()) for n, i in enumerate(names)]
    got = {r.doc_id: r for r in L.scan_licenses(docs_of(rows)).collect()}
    assert [got[n].license_id for n in range(len(names))] == [got[100 + n].license_id for n in range(len(names))] == names
    assert {r.kind for r in got.values()} == {"text"}


def test_copyright_statement_ends_with_its_sentence(docs_of):
    mit = next(t for i, k, t in KNOWN if (i, k) == ("MIT", "text"))
    notice = "Licensed under the Apache License, Version 2.0."
    owners = ["2020 X.", "(c) 2020 J. R. Smith.", "2020 Example Inc.", "© 2019-2020 Example, Inc. and its affiliates.", "2020 www.example.org!"]
    rows = [(n, f"Copyright {o} {notice}") for n, o in enumerate(owners)]
    rows += [(10 + n, f"Copyright {o}\n{mit}") for n, o in enumerate(owners)]
    rows += [(20, "Copyright 2020 X. " + " ".join(mit.split())), (21, ""), (22, "Copyright 2020 X. All rights reserved.\n" + mit),
             (23, "Copyright (c) 2020 J. Allen and T. Reed"), (24, "Copyright 2020 Example. Call a.b.c here. In 1999 it was new."),
             (25, "© " + "1.2." * 100_000 + " end. Last words"), (26, "Copyright 2020 Example. copyright law")]
    got = {r.doc_id: r for r in L.scan_licenses(docs_of(rows)).collect()}
    assert [got[n].notices for n in range(len(owners))] == [["Apache-2.0"]] * len(owners)
    assert [got[n].license_id for n in range(len(owners))] == ["Apache-2.0"] * len(owners)
    assert [got[10 + n].license_id for n in range(len(owners))] == ["MIT"] * len(owners)
    assert got[20].license_id == "MIT" and got[20].text_digest != got[21].text_digest
    assert got[22].license_id == "MIT" and got[22].notices == ["all-rights-reserved"]
    assert got[23].text_digest == got[21].text_digest
    assert len({got[n].text_digest for n in (21, 24, 25, 26)}) == 4


def test_same_as_sql_on_licences(spark, docs_of):
    import duckdb
    from tabprobe.llm.queries import ORACLE_SQL
    rows = [(n, "Copyright 2020 X. All rights reserved. " * (n % 2) + t) for n, (_, _, t) in enumerate(KNOWN)]
    rows += [(100 + n, t) for n, t in enumerate(["Copyright (c) 2020 J. Smith. Licensed under the Apache License, Version 2.0.", "© 2020 a.b. c", "(C) 1999 X. Y. Zed, and Co. or so. More"])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(ORACLE_SQL["op2_license_scan"]).fetchall())
    assert sorted(tuple(r) for r in L.scan_licenses(docs_of(rows)).collect()) == want
