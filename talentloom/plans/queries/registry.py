"""One entry per operator: the Spark query and, where SQL can say it, the check query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.plans.inputs import Inputs
from talentloom.plans.queries.sql import with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None):
    """Register ``f(inputs) -> DataFrame`` under ``key``."""

    def register(f: Callable[[Inputs], DataFrame]):
        QUERIES[key] = lambda spark, folder: f(Inputs(spark, folder))
        if check is not None:
            CHECKS[key] = with_inputs(check)
        return f

    return register


def joined(items: Column) -> Column:
    """A list shown as one string, so that every engine compares the same value."""
    return F.coalesce(F.array_join(items, "; "), F.lit(""))


def joined_sql(items: str) -> str:
    return f"coalesce(array_to_string({items}, '; '), '')"
