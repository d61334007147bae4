"""The registered queries of this subpackage, one for each operator, and their check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentloom.llm import exact_dedup, hnsw, host_trust, merkle, mixing, near_dedup, packing, phrases, pii, quality_rules, runs, sharding, suffixes
from talentloom.llm.common import table


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document, in sequences of at most 2048 tokens."""
    return packing.packed(table(spark, folder, "documents"), with_ids=False)


def op2_host_trust(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with the rule that fits it and its verdict."""
    return host_trust.verdict_rows(table(spark, folder, "pages"))


def op3_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what stays once repeated phrases of 20 words are removed."""
    return phrases.phrase_rows(table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the group of equal texts it belongs to."""
    return exact_dedup.decision_rows(table(spark, folder, "documents"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its shard of at most 64 MiB of text."""
    return sharding.shard_rows(table(spark, folder, "documents"))


def op6_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with what stays once repeated strings of 50 bytes are removed."""
    return suffixes.suffix_rows(table(spark, folder, "documents"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the personal data found in it."""
    return pii.digest_rows(table(spark, folder, "documents"))


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its class of near-duplicates."""
    return near_dedup.class_rows(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules.judged_rows(table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the words that the mix of sources takes of it."""
    return mixing.mix_rows(table(spark, folder, "documents"))


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its periodic runs of words."""
    return runs.run_rows(table(spark, folder, "documents"))


def op12_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows found for every row whose id 20 divides."""
    return hnsw.neighbour_rows(table(spark, folder, "embeddings"))


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its proof, and the root its tampered version folds to."""
    return merkle.manifest_rows(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_host_trust": op2_host_trust,
    "op3_phrases": op3_phrases,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sharding": op5_sharding,
    "op6_suffixes": op6_suffixes,
    "op7_pii": op7_pii,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_runs": op11_runs,
    "op12_neighbours": op12_neighbours,
    "op13_manifest": op13_manifest,
}
CHECKS: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_sharding": sharding.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op13_manifest": merkle.ORACLE,
}
