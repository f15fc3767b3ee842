"""WARC archives with a two-level capture index.

``write_archive`` writes one gzip member a record (WARC/1.1) into archive files of the shared folder, one or more a
task. Of equal payloads of ``LEAST_BYTES`` or more the row with the smallest id becomes the response record and the
others revisit it. ``write_index`` sorts the captures by (reversed-host URL key, id), compresses them in blocks of
``BLOCK_LINES`` lines and puts a sparse directory, the first key of each block, behind the blocks of each index file.
``read_captures`` binary-searches the list of index files, a file's directory and a block, and then reads a record's
own byte range; revisits are followed to the record they refer to.

Files are written under a name of their own for each task attempt and count once the task's rows are committed
to the tables in the shared folder, so that tasks may run again. On the driver there is one row an index file.

Defined cases: a null payload is empty; a null URL has the empty key; a null id sorts first, cannot be referred to
and never refers while an equal payload has no id; rows that repeat the smallest id of equal payloads are responses
too; control characters and spaces in URLs are percent-encoded; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tabprobe.llm._common import shared_path, stored

TASK_BYTES = 64 << 20  # of records read back by a task
LEAST_BYTES = 100
BLOCK_LINES = 3000
FILE_BYTES = 1 << 30
BUCKETS = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, id {0}, file string, offset long, length long"


def clean_url(url: str | None) -> str:
    return "".join(c if 0x20 < ord(c) != 0x7F else f"%{ord(c):02X}" for c in url or "")


def url_key(url: str | None) -> str:
    """Reversed-host sort key, such as ``org,example,www)/path?query``; fragments and default ports do not count."""
    url = clean_url(url)
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    at = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + f"{at}){parts.path or '/'}{query}"


def _order(key: str, own_id: int | None) -> tuple:
    """As Spark sorts (key, id): by UTF-8 bytes, null ids first."""
    return key.encode(), own_id is not None, own_id if own_id is not None else 0


def record(kind: str, own_id, url: str | None, payload: bytes, digest: str, refers_to=None, refers_url: str | None = None) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    named = "" if own_id is None else own_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{named}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {clean_url(url)}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>",
                 f"WARC-Refers-To-Target-URI: {clean_url(refers_url)}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(WARC header fields in lower case, payload) of a record's gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))  # Spark's names of the store


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the records of ``pages`` under ``path``; returns the captures (key, id, file, offset, length)."""
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    base = base.withColumn("sha", F.sha2("payload", 256))
    large = base.filter(F.octet_length("payload") >= LEAST_BYTES)
    repeated = stored(large.groupBy("sha").agg(F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"),
                                               F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n"), "repeated")
    # payloads without a copy stay where they are: a fixed number of flags is broadcast
    flag = F.pmod(F.xxhash64("sha"), F.lit(BUCKETS)).alias("flag")
    flags = repeated.select(flag).distinct().withColumn("hit", F.lit(True))
    marked = base.withColumn("flag", flag).join(F.broadcast(flags), "flag", "left")
    columns = ["id", "url", "payload", "sha", "first", "first_url"]
    alone = marked.filter("hit is null").withColumns({"first": F.lit(None).cast(base.schema["id"].dataType), "first_url": F.lit(None).cast("string")})
    several = marked.filter("hit").join(repeated, "sha", "left")
    rows = alone.select(columns).unionByName(several.select(columns)).withColumn(
        "first", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(path)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for own_id, url, payload, sha, first, first_url in zip(*(batch.column(c).to_pylist() for c in columns)):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    member = record("response" if first is None else "revisit", own_id, url, payload.encode(), sha, first, first_url)
                    out.write(member)
                    found.append((url_key(url), own_id, name, at, len(member)))
                    at += len(member)
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), batch.column("id").type, pa.string(), pa.int64(), pa.int64()))],
                                          names=["key", "id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(rows.mapInArrow(write, CAPTURE.format(base.schema["id"].dataType.simpleString())), "captures")


@dataclass(frozen=True)
class Part:
    """An index file: where its keys begin and where its directory lies."""
    first: tuple
    file: str
    offset: int
    length: int


def write_index(captures: DataFrame, path: str) -> list[Part]:
    """Write the sorted index of ``captures`` under ``path``; returns its files in key order."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(path)
        system.create_dir(root, recursive=True)
        out, name, at, lines, directory = None, "", 0, [], []

        def close_block() -> None:
            nonlocal at, lines
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(block)
            directory.append([lines[0][0], lines[0][1], at, len(block)])
            at, lines = at + len(block), []

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "file", "offset", "length"))):
                if out is None:
                    name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    close_block()
        if lines:
            close_block()
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail)
            out.close()
            yield pa.record_batch({"key": [directory[0][0]], "id": pa.array([directory[0][1]], kind), "file": [name],
                                   "offset": pa.array([at], pa.int64()), "length": pa.array([len(tail)], pa.int64())})

    kind = pa.string() if captures.schema["id"].dataType.simpleString() == "string" else pa.int64()
    schema = CAPTURE.format("string" if kind == pa.string() else "long")
    files = stored(captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "file", "offset").mapInArrow(write, schema), "index")
    return sorted((Part(_order(r["key"], r["id"]), r["file"], r["offset"], r["length"]) for r in files.collect()), key=lambda p: p.first)


class Reader:
    """Looks captures up and reads their records; keeps one directory, one block and a few files open."""

    def __init__(self, path: str, index_path: str, parts: list[Part], whole_ids: bool = True):
        self.whole_ids = whole_ids  # ids are whole numbers, not texts
        self.parts, self.starts = parts, [p.first for p in parts]
        self.archive, self.index = _file_system(path), _file_system(index_path)
        self.files: OrderedDict = OrderedDict()
        self.loaded: OrderedDict = OrderedDict()
        self.payloads: OrderedDict = OrderedDict()

    def _range(self, where: tuple, file: str, offset: int, length: int) -> bytes:
        system, root = where
        name = f"{root}/{file}"
        if name not in self.files:
            self.files[name] = system.open_input_file(name)
            if len(self.files) > 16:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        return self.files[name].read_at(length, offset)

    def _lines(self, file: str, offset: int, length: int, block: bool) -> tuple[list[tuple], list]:
        at = (file, offset)
        if at not in self.loaded:
            raw = zlib.decompress(self._range(self.index, file, offset, length)).decode()
            lines = [json.loads(x) for x in raw.split("\n")] if block else json.loads(raw)
            self.loaded[at] = [_order(x[0], x[1]) for x in lines], lines
            if len(self.loaded) > 8:
                self.loaded.popitem(last=False)
        self.loaded.move_to_end(at)
        return self.loaded[at]

    def find(self, key: str, own_id) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the captures with this key and id."""
        wanted, found = _order(key, own_id), []
        p = max(bisect.bisect_left(self.starts, wanted) - 1, 0)  # equal keys may begin in the file before
        while p < len(self.parts) and self.starts[p] <= wanted:
            part = self.parts[p]
            starts, blocks = self._lines(part.file, part.offset, part.length, block=False)
            b = max(bisect.bisect_left(starts, wanted) - 1, 0)
            while b < len(blocks) and starts[b] <= wanted:
                keys, lines = self._lines(part.file, blocks[b][2], blocks[b][3], block=True)
                for n in range(bisect.bisect_left(keys, wanted), len(keys)):
                    if keys[n] != wanted:
                        break
                    found.append(tuple(lines[n][2:5]))
                b += 1
            p += 1
        return found

    def summary(self, place: tuple[str, int, int]) -> tuple[str, str | None, int, str]:
        """(record type, id referred to, payload bytes, payload SHA-256) of a record's whole payload."""
        if place in self.payloads:
            self.payloads.move_to_end(place)
            return self.payloads[place]
        fields, payload = parse_record(self._range(self.archive, *place))
        if fields["warc-type"] == "revisit":
            refers_to = fields["warc-refers-to"].removeprefix("<urn:x-page:").removesuffix(">")
            own = int(refers_to) if self.whole_ids else refers_to
            target = self.find(url_key(fields["warc-refers-to-target-uri"]), own)
            _, _, size, digest = self.summary(target[0])
            found = ("revisit", refers_to, size, digest)
        else:
            found = ("response", None, len(payload), hashlib.sha256(payload).hexdigest())
        if f"sha256:{found[3]}" != fields["warc-payload-digest"]:
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
        self.payloads[place] = found
        if len(self.payloads) > 256:
            self.payloads.popitem(last=False)
        return found


def read_captures(wanted: DataFrame, path: str, index_path: str, parts: list[Part], *, id_col: str = "page_id",
                  url_col: str = "url", record_bytes: int = 0) -> DataFrame:
    """One row per capture of the (``id_col``, ``url_col``) pairs of ``wanted``: ``id_col``, ``payload_bytes``,
    ``payload_digest`` (both of the whole payload read back), ``record_type``, ``refers_to``."""
    @F.arrow_udf("string")
    def keys(urls: pa.Array) -> pa.Array:
        return pa.array([url_key(u) for u in urls.to_pylist()], pa.string())

    pairs = wanted.select(F.col(f"`{id_col}`").alias("id"), keys(F.col(f"`{url_col}`")).alias("key")).distinct()
    id_type = wanted.schema[id_col].dataType.simpleString()
    whole_ids = isinstance(wanted.schema[id_col].dataType, IntegralType)
    # keys are small, records are not: adaptive execution must not put them all into one task
    tasks = max(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-record_bytes // TASK_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(path, index_path, parts, whole_ids)
        for batch in batches:
            rows = [(own_id, size, digest, kind, refers) for own_id, k in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist())
                    for kind, refers, size, digest in map(reader.summary, reader.find(k, own_id))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (batch.column("id").type, pa.int64(), pa.string(), pa.string(), pa.string()))],
                                  names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return (pairs.repartitionByRange(tasks, "key", "id").sortWithinPartitions("key", "id")
            .mapInArrow(read, f"id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to string")
            .select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to")))


def archive_and_read(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archive and its index into the shared folder and read every page back through the index."""
    path, index_path = (shared_path(pages.sparkSession, x) for x in ("warc", "cdx"))
    captures = write_archive(pages, path, id_col=id_col, url_col=url_col, payload_col=payload_col)
    total = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return read_captures(pages, path, index_path, write_index(captures, index_path), id_col=id_col, url_col=url_col, record_bytes=total)
