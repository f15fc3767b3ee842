"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm import (exact_dedup, license_scan, line_dedup, multi_index, ngram_join, packing, periodic_runs, quality,
                          sentencepieces, toxicity, vector_cells, warc, whitening)
from tabprobe.llm.license_texts import KNOWN
from tabprobe.sources.io import table

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return add


def _license_sql() -> str:
    def canonical(c: str) -> str:
        c = f"lower(coalesce({c}, ''))"
        c = rf"regexp_replace({c}, '{license_scan.COPYRIGHT_LINE}', '\1', 'g')"
        for pattern, to in license_scan.SPELLINGS:
            for n in (1, 2):
                to = to.replace(f"{{{n}}}", f"\\{n}")
            c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
        c = f"regexp_replace({c}, '{license_scan.PUNCTUATION}', ' ', 'g')"
        return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    values = ", ".join(f"({lit(a)}, {lit(b)}, {lit(t)})" for a, b, t in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256(array_to_string({canonical('raw')}, ' ')) AS digest, min(license_id) AS license_id, min(kind) AS kind
  FROM (VALUES {values}) AS k(license_id, kind, raw) GROUP BY 1),
d AS (SELECT doc_id, {canonical('text')} AS lines FROM documents),
named AS (
  SELECT doc_id, list_sort(list_distinct(list(license_id))) AS notices, count(*) AS n
  FROM (SELECT doc_id, sha256(line) AS digest FROM (SELECT doc_id, unnest(lines) AS line FROM d)) JOIN known USING (digest)
  GROUP BY doc_id),
t AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS text_digest FROM d)
SELECT t.doc_id, t.text_digest, k.license_id, k.kind, coalesce(n.notices, []) AS notices, coalesce(n.n, 0) AS notice_lines
FROM t LEFT JOIN known k ON k.digest = t.text_digest LEFT JOIN named n USING (doc_id)"""


@query("op2_license_scan", _license_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op8_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')) AS h
           FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id has no label."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs)).withColumn("kept", F.col("score") >= 0.5)


@query("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op3_multi_index")
def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_warc", f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {warc.LEAST_BYTES} GROUP BY h)
SELECT p.page_id, p.n AS payload_bytes, p.h AS payload_digest,
       CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = sentencepieces.load(tokenizer_path("piece_bpe_32k.model"))
    decoded = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Periodic runs of ``documents``, one in ten of which is rewritten first: from word a on it repeats p words."""
    def rewritten(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " "))

    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(h % 10 == 0, F.transform(F.array(words), rewritten)[0]).otherwise(F.col("text"))  # words are split once
    found = periodic_runs.periodic_runs(docs.select("doc_id", text.alias("text")))
    kind = found.schema["runs"].dataType.elementType
    best = F.reduce("runs", F.lit(None).cast(kind), lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("top", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


@query("op12_vector_cells")
def op12_vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_cells.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
