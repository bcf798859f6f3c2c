"""From raw documents to packed training sequences: five operators of ``llm``, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's documents.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import exact_dedup, mixing, ngram_join, packing, quality
from llm.common import table, written
from llm.encoding import vocabulary
from llm.queries import digested, quality_weights


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the compression bands go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their 5-word shingles the one with the least id stays."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; labelled quality is the sampling weight."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", mixing.n_words(F.col("text")).alias("words"))  # before the join
    weighted = quality_weights(rows, table(spark, sf_dir, "labels"))
    return mixing.mixed_documents(weighted, F.col("_weight"), size="words").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 1024 tokens."""
    return digested(packing.pack(docs, **vocabulary()))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: Compression ratios, byte-pair ids and packing have no SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
