"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, divergence, forest, language, lexical, mixing, neighbours, scoring, sharding, simhash, substring, surrogates
from .common import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_query(read_table(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_query(read_table(spark, sf_dir, "documents"))


def op4_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scoring_query(read_table(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogates_query(read_table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours_query(read_table(spark, sf_dir, "embeddings"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_query(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(read_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_query(read_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_query(read_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_query(read_table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.forest_query(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_decontamination, op2_chat, op3_mixing, op4_scoring, op5_surrogates, op6_neighbours, op7_substring, op8_simhash, op9_language, op10_sharding,
        op11_divergence, op12_lexical, op13_forest,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.LEAKS_SQL, "op2_chat": chat.CHAT_SQL, "op3_mixing": mixing.MIXING_SQL, "op7_substring": substring.SUBSTRING_SQL,
        "op11_divergence": divergence.DIVERGENCE_SQL, "op12_lexical": lexical.LEXICAL_SQL,
    }
