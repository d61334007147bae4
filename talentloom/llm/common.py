"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.session import scratch_path

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    Later steps then start from files that outlive any executor, and several of them
    can read the same rows without computing them again.
    """
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_group_facts(rows: DataFrame, key: list[str], part: dict[str, Column], whole: dict[str, Column], spread_by: list[str]) -> DataFrame:
    """``rows`` with the facts of their group, without bringing a group together.

    ``part`` aggregates the rows of a group that share a salt (as many salts as shuffle
    partitions, from a hash of ``spread_by``), ``whole`` aggregates those parts, so a task holds at
    most one row for each key and salt besides its share of the rows. Rows come back by key and
    salt: a group of any size is dealt over all partitions.
    """
    salt = fresh(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*spread_by), F.lit(partitions(rows.sparkSession))).cast("int"))
    parts = salted.groupBy(*key, salt).agg(*[c.alias(n) for n, c in part.items()])
    facts = parts.groupBy(*key).agg(*[c.alias(n) for n, c in whole.items()])
    by_salt = parts.select(*key, salt).join(facts, key)
    return salted.join(by_salt, [*key, salt]).drop(salt)


def pick_rows(docs: DataFrame, decided: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``docs`` that ``decided(doc_id, kept, digest)`` keeps, with all their columns.

    Rows are found again by doc_id. Only ids that stand for several rows need the digest of the text
    as well; of several rows alike in both, the one with the smallest text stays.
    """
    theirs, its, own, other = (fresh(docs, n) for n in ("of_", "its_id_", "digest_", "wanted_"))
    per_id = decided.groupBy(F.col("doc_id").alias(theirs)).agg(F.count("*").alias("n"), F.max("kept").alias("stays"))
    same_id = F.col("doc_id").cast("long").eqNullSafe(F.col(theirs))
    # one id for each document: never a table to broadcast, so the plan is the same at every size; both joins read one shuffle of the texts
    single = docs.join(per_id.filter("n = 1 and stays").select(theirs).hint("merge"), same_id, "left_semi")
    # digests are taken behind an inner join, and the next one asks for its id and takes nulls as equal (there are none); else the
    # optimizer would take the digest of every text before it is shuffled, and shuffle the texts once more
    several = docs.join(per_id.filter("n > 1 and stays").select(theirs).hint("merge"), same_id).withColumn(own, digest(F.col("text")))
    stay = decided.filter("kept").select(F.col("doc_id").alias(its), F.col("digest").alias(other)).distinct()
    several = several.join(stay, F.col(theirs).eqNullSafe(F.col(its)) & F.col(own).eqNullSafe(F.col(other)), "left_semi")
    row = F.struct(*[f"`{c}`" for c in docs.columns])
    one = several.groupBy(theirs, own).agg(F.min_by(row, or_empty(F.col("text"))).alias("row"))
    return single.unionByName(one.select("row.*"))
