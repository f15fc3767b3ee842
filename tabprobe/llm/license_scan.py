"""Licence scan by canonical digest lookup, with DataFrame functions only.

A text is made canonical: lower case, copyright statements at the start of a line
removed up to the end of their sentence (at most the line), punctuation and
white space folded to single spaces, equivalent spellings unified. Its SHA-256
is looked up in the digests of the known licences, which pass through the same
expressions. The same lookup runs for every line, which finds the one-line
notices that documents carry inside other text.

The known table is a fixed list (``license_texts.KNOWN``), so that it is broadcast
for the whole texts and a literal map for the lines; no text is shuffled.

Defined cases: null and empty texts have the digest of the empty text and match
nothing; rows with repeated or null ids are kept apart by nothing but their
columns, each giving a row of its own; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm.license_texts import KNOWN

# Fixed values: (pattern, replacement), applied in this order to lower-case text. Both Java's
# and RE2's regular expressions read them alike.
# A copyright statement goes from the start of a line to the end of its sentence. A point inside a word, before a
# digit or sign, before "and", "or", "et" and "its", or after an initial does not end it; an initial does where the
# next word may begin a notice or licence (licensed, released, all rights, this, permission, MIT, Apache and so on).
# A statement with more than 40 such points ends there, so that Java's matcher needs little stack.
_UP_TO_POINT = r"[^\n.!?]*"
_NAME = (r"([^\s.!?abdgilmprtz]|a([^lp]|p[^a]|l([^l]|l[^ ]))|b[^s]|d([^i]|i[^s])|g[^n]|i([^s]|s[^c])|l([^i]|i[^c])|m([^io]|i[^t]|o[^z])"
         r"|p([^e]|e([^r]|r[^m]))|r([^e]|e[^dl])|t([^h]|h[^ei])|z[^l])")
_GOES_ON = rf"([.!?]+[^\s.!?]|[.!?][ \t]+([0-9<(\[&,;:/-]|and |or |et |its )|[ ,.(]([^\s.!?0-9]\.[ \t]*){{1,3}}{_NAME})"
_SENTENCE = rf"({_UP_TO_POINT}{_GOES_ON}){{0,40}}{_UP_TO_POINT}"
COPYRIGHT_LINE = (rf"(^|\n)[^\p{{L}}\p{{N}}\n]*(copyright {_SENTENCE}[0-9]{{4}}|copyright ?\(c\)|copyright ?©|\(c\) ?[0-9]{{4}}|©)"
                  rf"{_SENTENCE}[.!?]*")
SPELLINGS = [
    (r"\blicenc(e|ed|es|ing)\b", "licens{1}"),
    (r"\bsub[ -]licens", "sublicens"),
    (r"\bnon[ -](commercial|infringement|exclusive)", "non{1}"),
    (r"\b(favo|hono|behavio|endeavo)ur", "{1}or"),
    (r"\b(organi|recogni|authori|utili|initiali|customi|redistribi)s(e|ed|es|ing|ation)\b", "{1}z{2}"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bv(er)?\.? ?([0-9])", "version {2}"),
    (r"https://", "http://"),
]
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical non-empty lines of a text."""
    c = F.lower(F.coalesce(text, F.lit("")))
    c = F.regexp_replace(c, COPYRIGHT_LINE, "$1")
    for pattern, to in SPELLINGS:
        for n in (1, 2):
            to = to.replace(f"{{{n}}}", f"${n}")
        c = F.regexp_replace(c, pattern, to)
    c = F.regexp_replace(c, PUNCTUATION, " ")
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, kind, digest) of the known licences, one row per digest."""
    rows = spark.createDataFrame(KNOWN, "license_id string, kind string, raw string")
    return (rows.withColumn("digest", F.sha2(F.array_join(canonical_lines(F.col("raw")), " "), 256))
            .groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("kind").alias("kind")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``text_digest`` (canonical SHA-256 of the whole text),
    ``license_id`` and ``kind`` of the known text that equals it (else null), ``notices`` (sorted ids of
    the licences that single lines name) and ``notice_lines`` (how many lines do)."""
    known = known_digests(docs.sparkSession)
    marks = F.create_map(*[F.lit(x) for r in known.collect() for x in (r["digest"], r["license_id"])])
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), canonical_lines(F.col(f"`{text_col}`")).alias("__lines"))
    named = F.filter(F.transform("__lines", lambda x: F.element_at(marks, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = rows.select("__id", F.sha2(F.array_join("__lines", " "), 256).alias("__digest"), named.alias("__named"))
    whole = known.select(F.col("digest").alias("__digest"), "license_id", "kind")
    return rows.join(F.broadcast(whole), "__digest", "left").select(
        F.col("__id").alias(id_col), F.col("__digest").alias("text_digest"), "license_id", "kind",
        F.array_sort(F.array_distinct("__named")).alias("notices"),
        F.size("__named").cast("long").alias("notice_lines"))
