"""Corpus pipeline over the documents table: clean, deduplicate, pack.

Each stage works on all rows its predecessor kept and is written as Parquet in the shared folder before the next
one reads it, so that a lost executor costs no finished stage. All but the last stage return the columns of
``documents``; the last one returns the packed pieces (the columns of ``packing.pack``).

Stages: documents with a toxicity score of 0.5 or more go; documents with a quality score below 0.5 go; of equal
texts the one with the largest id stays; of linked near duplicates the one with the smallest id stays; the rest is
packed. Nulls, empty texts, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm import exact_dedup, ngram_join, packing, quality, toxicity
from tabprobe.llm._common import stored
from tabprobe.llm.queries import held_out, tokenizer_path
from tabprobe.sources.io import table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return docs.filter(toxicity.score_column(spark, model, F.col("text")) < 0.5)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.filter(quality.score_column(spark, quality.fit(docs), F.col("text")) >= 0.5)


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", not_toxic), ("quality", good_quality), ("exact_dedup", one_of_each_text),
          ("ngram_join", one_of_each_class), ("packing", packed)]

# A model is fitted and a tokeniser run: no SQL for the rows. tests/llm/test_pipeline.py checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
