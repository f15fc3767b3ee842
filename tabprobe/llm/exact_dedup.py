"""Exact duplicates by progressive refinement, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Three levels, each of
which only looks at what the one before could not tell apart:

1. byte length: counted in a fixed number of length buckets;
2. hash of the length and of the first characters, in buckets again;
3. SHA-256 of the whole text, only for rows whose bucket holds other rows too.

The bucket tables of levels 1 and 2 have at most ``buckets`` rows whatever the
input, so that they can be broadcast and no text is shuffled. A bucket shared
by chance only costs one more full hash. Rows leave level 3 as (id, digest).

Defined cases: a null text is an empty text; null ids are smaller than all
others; of rows repeating both id and text one is kept; an empty table gives
an empty result; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm._common import LOWER, UPPER, lower_az, stored  # noqa: F401

BUCKETS = 1 << 20
PREFIX_CHARS = 64


def _with_levels(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, buckets: int,
                 carry: bool = False) -> DataFrame:
    """(__id, __text, __candidate): whether another row may have an equal text; with ``carry`` also __row, all
    columns in one, so that no name can clash."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []
    base = docs.select(*row, F.col(f"`{id_col}`").alias("__id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))

    def length_bucket() -> Column:
        return F.pmod(F.octet_length("__text"), F.lit(buckets))

    def prefix_bucket() -> Column:
        prefix = lower_az(F.substring("__text", 1, prefix_chars))
        return F.pmod(F.xxhash64(F.octet_length("__text"), prefix), F.lit(buckets))

    def shared(df: DataFrame, key: Column, name: str) -> DataFrame:
        return df.groupBy(key.alias(name)).count().filter("count > 1").select(name)

    lengths = shared(base, length_bucket(), "__lb")
    same_length = base.withColumn("__lb", length_bucket()).join(F.broadcast(lengths), "__lb", "left_semi")
    prefixes = shared(same_length, prefix_bucket(), "__pb").withColumn("__candidate", F.lit(True))
    return (base.withColumn("__pb", prefix_bucket()).join(F.broadcast(prefixes), "__pb", "left")
            .withColumn("__candidate", F.coalesce("__candidate", F.lit(False))).drop("__pb"))


def _full_hash() -> Column:
    return F.sha2(lower_az(F.col("__text")), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_all: bool = False,
                prefix_chars: int = PREFIX_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id`` (largest id of the equal texts),
    ``group_size``, ``kept``, ``text_sha256`` (of the normalised text; null where the text was
    told apart without it, unless ``digest_all``)."""
    levels = _with_levels(docs, id_col, text_col, prefix_chars, buckets)
    digest = _full_hash() if digest_all else F.when(F.col("__candidate"), _full_hash())
    rows = stored(levels.select("__id", "__candidate", digest.alias("__sha")), "dedup")
    alone = rows.filter(~F.col("__candidate")).select(
        "__id", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__size"),
        F.lit(True).alias("__kept"), "__sha")
    ids = rows.filter("__candidate").groupBy("__sha", "__id").agg(F.count(F.lit(1)).alias("__n"))
    # stored, so that the join reads both sides anew and a hot group's rows can be split over tasks
    groups = stored(ids.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.sum("__n").alias("__size")), "groups")
    several = (ids.join(groups, "__sha")
               .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__copy"))
               .select("__id", "__keep", "__size",
                       (F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__copy") == 1)).alias("__kept"), "__sha"))
    return alone.unionByName(several).select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                prefix_chars: int = PREFIX_CHARS, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns. Only texts that
    share length and prefix with another are moved."""
    levels = _with_levels(docs, id_col, text_col, prefix_chars, buckets, carry=True)
    many = levels.filter("__candidate").withColumn("__sha", _full_hash())
    keep = many.groupBy("__sha").agg(F.max("__id").alias("__keep")).withColumnRenamed("__sha", "__ksha")
    kept = (many.join(keep, (F.col("__sha") == F.col("__ksha")) & F.col("__id").eqNullSafe(F.col("__keep")), "left_semi")
            .dropDuplicates(["__sha", "__id"]))
    return levels.filter(~F.col("__candidate")).select("__row").unionByName(kept.select("__row")).select("__row.*")
