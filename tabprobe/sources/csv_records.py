"""CSV text as records, split over tasks, with quoted fields that run over lines.

Whether a line break ends a record depends on all quotes before it, so a part of a file cannot be read alone. But a
part maps each of the two states at its start (between records, or inside a quoted field) to a state at its end, and
these maps compose. So:

1. lines are read by Spark's splittable text source and stored in chunks, each with its map;
2. a window per file over the chunks' maps (a few bytes a chunk) gives every chunk its true state at the start;
3. each chunk is parsed on its own from there; records that begin in one chunk and end in another leave it as pieces,
   which are put together and parsed in a last, small step.

A quote opens a quoted field only as the first character of a field, a doubled quote inside is a quote, and what
follows the closing quote is taken as it is, as in pandas. Line breaks within fields are read as ``\\n``. Blank lines
are no records (nor, in a file of one column, are quoted blanks). A quoted field left open ends with the file. Gzip files cannot be split: they are read by one task each, but parsed by many.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprobe.session import staged

CHUNK_BYTES = 1 << 20
CHUNK_LINES = 20_000
MOST_FIELD = 1 << 30  # characters; the parser refuses fields above its limit
PLACE = "struct<file:string,block:long,chunk:long,row:long>"


def scan(text: str, inside: bool, sep: str = ",") -> tuple[bool, int, int]:
    """(inside at the end, end of the piece that belongs to an earlier record, start of the piece that goes on later) of a
    chunk of whole lines; ``inside``: whether it starts within a quoted field."""
    opening = re.compile(rf'(?<=[{re.escape(sep)}\n])"')
    at, head, start = 0, 0 if not inside else -1, 0
    while True:
        if not inside:
            if at == 0 and text.startswith('"'):
                opened = 0
            else:
                found = opening.search(text, at)
                if not found:
                    return False, head if head >= 0 else text.index("\n", at) + 1, len(text)
                opened = found.start()
            line = text.rfind("\n", at, opened) + 1
            if line:
                start = line
                if head < 0:
                    head = text.index("\n", at) + 1
            at = opened + 1
        while True:  # the closing quote is one that is not doubled
            at = text.find('"', at)
            if at < 0:
                return True, head if head >= 0 else len(text), start if head >= 0 else len(text)
            if text.startswith('"', at + 1):
                at += 2
            else:
                at, inside = at + 1, False
                break


def _records(text: str, sep: str) -> Iterator[list[str]]:
    csv.field_size_limit(MOST_FIELD)
    for fields in csv.reader(io.StringIO(text), delimiter=sep):
        if fields and (len(fields) > 1 or fields[0].strip(" \t")):
            yield fields


def csv_chunks(spark: SparkSession, path: str | list[str], *, sep: str = ",", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Stored (file, block, chunk, text, from_out, from_in): whole lines, and whether a chunk ends inside quotes when it starts
    outside or inside."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
            code = file.indices.to_numpy()
            size = np.cumsum(pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // chunk_bytes
            new = (np.diff(code) != 0) | (np.diff(block) != 0)
            edges = [0, *(np.flatnonzero(new | (np.diff(size) != 0)) + 1).tolist(), batch.num_rows]
            out = []
            for a, b in zip(edges, edges[1:]):
                key = (file.dictionary[int(code[a])].as_py(), int(block[a]))
                number = number + 1 if key == last else 0
                last = key
                text = "\n".join(batch.column("value").slice(a, b - a).to_pylist()) + "\n"
                ends = [scan(text, inside, sep)[0] for inside in (False, True)] if '"' in text else [False, True]
                out.append((*key, number, text, *ends))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["file", "block", "chunk", "text", "from_out", "from_in"])

    return staged(lines.mapInArrow(join, "file string, block long, chunk long, text string, from_out boolean, from_in boolean"), "csv-chunks")


def _starts(chunks: DataFrame) -> DataFrame:
    """(file, block, chunk, inside): the state at each chunk's start. A map is constant, keeps the state or turns it: the state is
    the last constant before, turned as often as maps since then turn it."""
    before = Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out").cast("int"))
    turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    maps = chunks.select("file", "block", "chunk", fixed.alias("fixed"), turns.alias("turns"))
    so_far = maps.withColumn("turned", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    marked = so_far.withColumn("mark", F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turned")))
    last = F.last("mark", ignorenulls=True).over(before)
    state = F.coalesce(last["fixed"] + F.col("turned") - last["turned"], F.col("turned"))
    return marked.select("file", "block", "chunk", (state % 2 == 1).alias("inside"))


def csv_records(chunks: DataFrame, *, sep: str = ",") -> DataFrame:
    """(place, fields) of every record of the files in ``csv_chunks``, header records included: ``place`` (file, block, chunk,
    row) orders them as in the files and begins with (file, 0, 0, 1); ``fields`` are texts."""
    placed = chunks.select("file", "block", "chunk", "text").join(_starts(chunks), ["file", "block", "chunk"])
    kind = f"place {PLACE}, fields array<string>, part int, piece string"

    def batch_of(places: list[tuple], fields: list, parts: list, pieces: list) -> pa.RecordBatch:
        names = ["file", "block", "chunk", "row"]
        columns = [pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*places))]
        return pa.record_batch([pa.StructArray.from_arrays(columns, names), pa.array(fields, pa.list_(pa.string())),
                                pa.array(parts, pa.int32()), pa.array(pieces, pa.string())], names=["place", "fields", "part", "piece"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # a row is a chunk
                file, block, chunk, text, inside = (batch.column(c)[row].as_py() for c in ("file", "block", "chunk", "text", "inside"))
                _, head, start = scan(text, inside, sep) if inside or '"' in text else (False, 0, len(text))
                found = list(_records(text[head:start], sep))
                pieces = [(0, text[:head])] * (head > 0) + [(1, text[start:])] * (start < len(text))
                places = [(file, block, chunk, i + 1) for i in range(len(found))] + [(file, block, chunk, 0 if part == 0 else len(found) + 1) for part, _ in pieces]
                for at in range(0, len(places), CHUNK_LINES):
                    some = slice(at, at + CHUNK_LINES)
                    yield batch_of(places[some], (found + [None] * len(pieces))[some], ([None] * len(found) + [p for p, _ in pieces])[some],
                                   ([None] * len(found) + [t for _, t in pieces])[some])

    def parse_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for fields in _records(batch.column("text")[row].as_py(), sep):
                    yield pa.record_batch([batch.column("place").slice(row, 1), pa.array([fields], pa.list_(pa.string()))], names=["place", "fields"])

    parsed = placed.mapInArrow(parse, kind)
    whole = parsed.filter("fields is not null").select("place", "fields")
    # a piece that begins a record (part 1) is followed by the pieces (part 0) of the next chunks that end it
    order = Window.partitionBy("place.file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parsed.filter("piece is not null").withColumn("record", F.sum("part").over(order))
    joined = (numbered.groupBy(F.col("place.file"), "record")
              .agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
              .select("place", F.array_join("pieces.piece", "").alias("text")))
    return whole.unionByName(joined.mapInArrow(parse_joined, f"place {PLACE}, fields array<string>"))
