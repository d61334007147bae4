"""From raw documents to packed sequences: the stages of the corpus, each a function of (spark, docs, folder).

``run`` writes each stage's rows as Parquet in the shared scratch folder and reads them again, so a
later stage starts from files that outlive any executor. All stages but the last return the columns
of ``documents``. Near-duplicates have no SQL form, so ``ORACLE_SQL`` is None; ``tests/llm`` holds the
stages against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talentloom.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from talentloom.llm.common import kept, table


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass every rule; the others go."""
    return quality_rules.kept_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each class of near-duplicates, the one with the smallest doc_id."""
    return near_dedup.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources at their target weights: documents repeat for whole epochs, then a selection fills the rest."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents with their token ids, in sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(spark, stage(spark, docs, folder), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, folder)
