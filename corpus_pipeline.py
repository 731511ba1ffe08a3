"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftloom.llm.common import mark, read_table, release, stored
from shiftloom.llm.decontamination import drop_leaks
from shiftloom.llm.language import keep_identified
from shiftloom.llm.mixing import take_mix
from shiftloom.llm.sharding import shard_rows
from shiftloom.llm.simhash import drop_near_duplicates


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or in none of the languages learned, go."""
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document comes as often as the mix takes it."""
    return take_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with shard and slot."""
    return shard_rows(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Cross-parsing and fingerprints are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, last = mark(), docs
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
            release(spark, *([last] if i else []), since=before, but=docs)
    return docs
