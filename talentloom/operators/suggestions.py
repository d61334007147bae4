"""Requests to and replies from a suggestion service, as columns.  The call itself is not ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions import text as T

REPLY = (
    "struct<summary: string, suggestions: array<struct<"
    "category: string, severity: string, original: string, suggestion: string, explanation: string>>>"
)


def prompt(resume_text: Column, jd_text: Column, limit: int = 10) -> Column:
    """The request: 4,000 characters of the text and 2,000 of the opening (the service's limit)."""
    return F.concat(
        F.lit("## Resume:\n"), F.substring(T.blank_if_null(resume_text), 1, 4000),
        F.lit("\n\n## Job Description:\n"), F.substring(T.blank_if_null(jd_text), 1, 2000),
        F.lit(f"\n\nProvide up to {limit} improvement suggestions."),
    )


def parse_replies(df: DataFrame, reply_id: str, json: str, limit: int = 10) -> DataFrame:
    """(reply, ord, summary, five fields, error): the first ``limit`` suggestions with defaults.

    A broken reply gives one row with an error; a reply without suggestions gives one row with its
    summary and no fields.
    """
    parsed = df.select(reply_id, F.from_json(F.col(json), REPLY, {"mode": "PERMISSIVE"}).alias("r"),
                       F.try_parse_json(F.col(json)).isNull().alias("broken"))
    listed = F.slice(F.coalesce(F.col("r.suggestions"), F.array().cast(REPLY.split("suggestions: ")[1][:-1])), 1, limit)
    rows = parsed.select(
        reply_id, F.coalesce(F.when(~F.col("broken"), F.col("r.summary")), F.lit("")).alias("summary"),
        F.when(F.col("broken"), F.lit("reply is not valid JSON")).alias("error"),
        F.posexplode_outer(F.when(~F.col("broken"), listed)).alias("pos", "s"))
    fields = [F.when(F.col("s").isNotNull(), F.coalesce(F.col(f"s.{k}"), F.lit(v))).alias(k) for k, v in rules.SUGGESTION_DEFAULTS.items()]
    return rows.select(reply_id, (F.col("pos") + 1).alias("ord"), "summary", *fields, "error")
