"""Joins that hold when one key, or null, carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000
#: A hot key holds at least this share of all rows, so there are at most 1 / HOT_SHARE of them to broadcast.
HOT_SHARE = 1e-4
#: Salts for rows whose key is null: they match nothing and only have to be spread.
NULL_SALTS = 1 << 20


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS, share: float = HOT_SHARE) -> DataFrame:
    """(key, _salts): keys above ``min_rows`` rows and above ``share`` of all rows, one salt for each such portion.

    The share bounds the table at ``1 / share`` rows whatever the data, without leaving a hot key out: a key
    below it holds less than that share, which one shuffle partition carries.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    portion = F.greatest(F.lit(min_rows), F.ceil(share * F.col("_all")))
    total = counts.agg(F.sum("_rows").alias("_all")).scalar()
    return counts.withColumn("_all", total).filter(F.col("_rows") > portion).select(key, F.ceil(F.col("_rows") / portion).cast("int").alias("_salts"))


def skew_join(
    many: DataFrame, one: DataFrame, key: str, row_id: str, how: str = "left",
    min_rows: int = HOT_ROWS, count_on: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` (any number of rows per key) to ``one`` (a row per key).

    Rows of a hot key are spread by a hash of their own id, which stays the same when a lost task is run
    again, over as many salts as its rows need; only the few matching rows of ``one`` are repeated. Rows
    without a key are spread as well. All other rows keep salt 0, so a table without hot keys is joined as
    usual. ``count_on`` names a cheaper table with the same keys to count, when ``many`` is itself the result of joins.
    """
    hot = F.broadcast(hot_keys(many if count_on is None else count_on, key, min_rows))  # at most 1 / HOT_SHARE rows
    salts = F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    spread = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(row_id), salts).cast("int")).drop("_salts")
    repeated = one.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)),
    ).drop("_salts")
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")
