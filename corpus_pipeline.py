"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage calls one operator of ``tierline.llm`` on everything its predecessor
kept.  All but the last return the columns of ``documents``; the last returns the
pieces of the packed sequences.  Stage results are Parquet tables that the next
stage rereads, so a lost executor repeats part of one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierline.llm import exact, mixing, packing, simhash, toxicity
from tierline.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents the toxicity classifier rejects."""
    return toxicity.clean(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each text."""
    return exact.survivors(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return simhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the mix takes, a row for each time a document is taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the tokens of all documents into sequences."""
    return packing.pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is stored and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
