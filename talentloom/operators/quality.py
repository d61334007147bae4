"""Data validation as tables: one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions.numeric import share
from talentloom.operators import metrics
from talentloom.operators.sampling import sample_n


def role_overlap(role: Column, features: Column) -> Column:
    """Share of the role's words that the features repeat."""
    def words(c: Column) -> Column:
        parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+")
        return F.array_distinct(F.filter(parts, lambda w: w != ""))
    own = words(role)
    return share(F.size(F.array_intersect(own, words(features))), F.size(own))


def leakage_report(jobs: DataFrame, role: str, features: str, row_id: str,
                   sample_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Mean overlap, percent of rows at or above one half, verdict; over all rows unless a sample is asked for."""
    score = role_overlap(F.col(role), F.col(features))
    rows = jobs.select(row_id, role, features)
    scored = (rows if sample_rows is None else sample_n(rows, row_id, sample_rows, seed)).select(score.alias("s"))
    summary = scored.agg(
        F.count("*").alias("sampled"), F.avg("s").alias("avg_overlap"),
        (F.avg(F.when(F.col("s") >= 0.5, 1.0).otherwise(0.0)) * 100).alias("leaky_percent"))
    return summary.withColumn("verdict", verdict(F.col("leaky_percent")))


def verdict(percent: Column) -> Column:
    return F.when(percent > 50, "confirmed").when(percent > 20, "possible").otherwise("none")


def _checks(df: DataFrame, source: str, *rows: tuple[str, Column, Column, Column]) -> DataFrame:
    """One-row aggregate -> check rows."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(source).alias("source"), F.lit(check).alias("check"), key.cast("string").alias("key"),
                 value.cast("double").alias("value"), status.alias("status"))
        for check, key, value, status in rows
    ])))


def resume_checks(df: DataFrame, category: str, text: str, min_rows: int = rules.MIN_CLASS_ROWS) -> DataFrame:
    """Rows, columns, nulls, mean length; classes and their sizes, small ones flagged."""
    info = F.lit("info")
    one = df.agg(
        F.count("*").alias("rows"), F.avg(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns])
    general = _checks(
        one, "resumes",
        ("rows", F.lit(""), F.col("rows"), info), ("columns", F.lit(""), F.lit(len(df.columns)), info),
        ("avg_chars", F.lit(text), F.round("chars"), info),
        *[("nulls", F.lit(c), F.col(f"null_{c}"), info) for c in df.columns])
    counts = metrics.value_counts(df.filter(F.col(category).isNotNull()), category)
    status = F.when(F.col("rows") < min_rows, "warning").otherwise("ok")
    per_class = counts.select(F.lit("resumes").alias("source"), F.lit("class_rows").alias("check"),
                              F.col(category).cast("string").alias("key"), F.col("rows").cast("double").alias("value"),
                              status.alias("status"))
    small = F.count_if(F.col("rows") < min_rows)
    classes = _checks(
        counts.agg(F.count("*").alias("k"), small.alias("small")), "resumes",
        ("classes", F.lit(""), F.col("k"), info),
        ("small_classes", F.lit(""), F.col("small"), F.when(F.col("small") > 0, "warning").otherwise("ok")))
    return metrics.union_all([general, classes, per_class])


def job_checks(df: DataFrame, role: str, features: str, row_id: str, sample_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Rows, roles, the ten most frequent roles, leakage."""
    info = F.lit("info")
    counts = metrics.value_counts(df.filter(F.col(role).isNotNull()), role)
    general = _checks(df.agg(F.count("*").alias("rows")), "jobs",
                      ("rows", F.lit(""), F.col("rows"), info), ("columns", F.lit(""), F.lit(len(df.columns)), info))
    roles = _checks(counts.agg(F.count("*").alias("k")), "jobs", ("roles", F.lit(""), F.col("k"), info))
    top = counts.orderBy(F.desc("rows"), F.asc(role)).limit(10).select(
        F.lit("jobs").alias("source"), F.lit("top_role").alias("check"), F.col(role).cast("string").alias("key"),
        F.col("rows").cast("double").alias("value"), info.alias("status"))
    leak = leakage_report(df, role, features, row_id, sample_rows, seed)
    status = F.when(F.col("verdict") == "none", "ok").otherwise("warning")
    leakage = _checks(leak, "jobs",
                      ("leakage_avg", F.col("verdict"), F.round("avg_overlap", 6), status),
                      ("leakage_percent", F.col("verdict"), F.round("leaky_percent", 6), status))
    return metrics.union_all([general, roles, top, leakage])
