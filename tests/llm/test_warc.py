import hashlib
import types

from tabprobe.llm import warc as W
from tabprobe.llm._common import shared_path


def page(k):
    return f"<html>{k} " + "body " * 40 + "é</html>"


ROWS = ([(i, f"https://www.site{i % 7}.example.org/p/{i}?q=1#top", page(i)) for i in range(60)]
        + [(100 + i, "http://hot.example.com:80/same", page("hot")) for i in range(40)]
        + [(200, "https://a.example/x", "short"), (201, "https://a.example/y", "short"), (202, None, None), (203, "", ""), (204, "not a url\r\n", page(3)),
           (205, "http://[bad", page("odd")), (None, "https://a.example/null", page("null")), (206, "https://a.example/z", page("null"))])


def test_every_page_comes_back(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 7)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in W.archive_and_read(df).collect()}
    assert len(got) == len(ROWS)
    for i, url, html in ROWS:
        raw = (html or "").encode()
        same = [j for j, _, h in ROWS if j is not None and h == html] if len(raw) >= 100 else [i]
        first = min(same) if same and i is not None else None
        if i is None:
            first = 206  # an equal payload whose row has an id
        refers = first if first is not None and first != i else None
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest()
        assert (got[i].record_type, got[i].refers_to) == ("revisit" if refers is not None else "response", refers), i


def test_empty_table(spark):
    assert W.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_index_reads_a_record_by_its_key(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 5)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path, index = shared_path(spark, "warc"), shared_path(spark, "cdx")
    parts = W.write_index(W.write_archive(df, path), index)
    assert [p.first for p in parts] == sorted(p.first for p in parts)
    reader = W.Reader(path, index, parts)
    place, = reader.find(W.url_key("https://www.site5.example.org/p/12?q=1"), 12)
    fields, payload = W.parse_record(reader._range(reader.archive, *place))
    assert payload.decode() == page(12) and fields["warc-target-uri"].endswith("/p/12?q=1#top")
    assert reader.find("org,nowhere)/", 1) == []


def test_keys():
    assert W.url_key("HTTPS://User@WWW.Example.org:443/A?b=c#d") == "org,example,www)/A?b=c"
    assert W.url_key("http://example.org:8080") == "org,example:8080)/"
    assert W.url_key(None) == "" and W.clean_url("a b\r\n") == "a%20b%0D%0A"


def test_text_ids_and_tasks(spark):
    """Ids that are texts of digits; records are read back by several tasks."""
    rows = [(str(i), f"https://a.example/{i}", page(i % 3)) for i in range(30)] + [("007", "https://a.example/b", page(0)), ("-1", None, page("x"))]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    out = W.archive_and_read(df)
    got = {r.page_id: r for r in out.collect()}
    for i, _, html in rows:
        first = min(j for j, _, h in rows if h == html)
        assert got[i].refers_to == (None if first == i else first) and got[i].payload_bytes == len(html.encode())
    assert out.rdd.getNumPartitions() > 1


def test_file_system_of_spark_paths(monkeypatch):
    asked = []
    monkeypatch.setattr(W, "fs", types.SimpleNamespace(FileSystem=types.SimpleNamespace(from_uri=asked.append)))
    for p in ("s3a://bucket/x", "s3n://bucket/x", "s3://bucket/x", "hdfs://host/x", "/tmp/x"):
        W._file_system(p)
    assert asked == ["s3://bucket/x"] * 3 + ["hdfs://host/x", "/tmp/x"]
