"""Mixing sources to target weights with Efraimidis-Spirakis keys, in DataFrame functions only.

A document's size is its number of words. Sources take the weights 1, 2, 3, 1, 2, 3, … in the order
of their names (code points, null last) and share all words by weight; a target stops at three times
its source's size and the excess is shared by weight among the others until none is above. That
fixed point is found in closed form: with sources ordered by cap / weight, the first whose cap is not
below the level left over by those before it gives the level of all that follow.

A source takes every document ``epochs = floor(target / size of the source)`` times and then, for the
words left, documents in the order of their keys ``-ln(u) / quality``, where u comes from a hash of
doc_id: the sum of sizes before a document in that order says how much of it is taken, and the document
at the boundary counts with the words that are left (``mixed`` takes it whole or not at all, whichever is nearer). Keys fall into buckets of the key's range, so a
source's order is summed bucket by bucket: no task sees more than one bucket of rows, or one source's
list of buckets.

Defined cases: a null text has size 0 and is taken 0 times; documents of one id and key follow by size,
equal ones by any order (they are alike); a source of size 0 has target 0; an empty table gives an empty
table; ``mixed`` keeps further columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import WORD, fresh, kept, or_empty, partitions

MAX_EPOCHS = 3
WEIGHTS = [1, 2, 3]
BUCKET_ROWS = 100_000
UNIT = float(1 << 52)


def size_of(text: Column) -> Column:
    return F.regexp_count(or_empty(text), F.lit(WORD)).cast("long")


def length_quality(size: Column) -> Column:
    """Quality weight of a document, from 0.25 for no words to 1 from 200 words on."""
    return 0.25 + 0.75 * F.least(F.lit(1.0), size.cast("double") / 200.0)


def uniform(doc_id: Column) -> Column:
    """A number between 0 and 1 from the id: 13 hexadecimal digits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / UNIT


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, budget): one row for each source of ``rows(source, size)``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    w = w.withColumns({"cap": MAX_EPOCHS * F.col("source_size"), "all_words": F.sum("source_size").over(everything), "all_weights": F.sum("weight").over(everything)})
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"place": F.row_number().over(by_ratio), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weighed": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    w = w.withColumn("level", (F.col("all_words") - F.col("capped")).cast("double") / (F.col("all_weights") - F.col("weighed")).cast("double"))
    reached = F.col("cap").cast("double") / F.col("weight").cast("double") >= F.col("level")
    w = w.withColumn("level", F.min_by("level", F.when(reached, F.col("place"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight").cast("double"))
    w = w.withColumn("target", target)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size").cast("double"))).otherwise(F.lit(0)).cast("long")
    w = w.withColumn("epochs", epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size")
    return w.select("source", "source_size", "source_rows", "target", "epochs", F.greatest(F.lit(0).cast("long"), budget).alias("budget"))


def shares(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, source, size, key, …)`` with (source_size, target, epochs, part): ``epochs`` times the whole document and ``part`` words more."""
    total = rows.count()
    buckets = max(partitions(rows.sparkSession), -(-total // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(buckets * (1.0 - F.exp(-0.8 * F.col("key"))))).cast("long"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    facts = _on_source(sums, targets(rows), []).drop("bucket_size")
    joined = _on_source(rows, facts, ["bucket"])
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("budget") - prefix))
    return joined.withColumn("part", part).drop("before", "bucket")


def _on_source(left: DataFrame, right: DataFrame, more: list[str]) -> DataFrame:
    """Inner join on the source, where null is a source like any other."""
    right = right.withColumnRenamed("source", "source_r")
    for c in more:
        right = right.withColumnRenamed(c, c + "_r")
    on = left["source"].eqNullSafe(F.col("source_r"))
    for c in more:
        on = on & (left[c] == F.col(c + "_r"))
    return left.join(right, on).drop("source_r", *[c + "_r" for c in more])


def mix_rows(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it."""
    size = size_of(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size")).withColumn("key", -F.log(uniform(F.col("doc_id"))) / length_quality(F.col("size")))
    s = shares(kept(docs.sparkSession, rows, "sizes"))
    return s.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "source")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated for each epoch, and those that the fractional selection adds.

    No text is cut: the document at a source's budget is taken whole where at least half of it fits, else left out, so a source
    misses its target by half a document at most.
    """
    held = fresh(docs, "row_")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias(held), "doc_id", "source", size_of(F.col("text")).alias("size"))
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"))) / length_quality(F.col("size")))
    # decisions are made on ids and sizes; texts only meet them at the end, by id, size and key
    light = kept(docs.sparkSession, rows.drop(held), "sizes")
    added = F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    taken = shares(light).filter("size > 0 and (epochs > 0 or part > 0)").groupBy("doc_id", "source", "size").agg(
        F.sum("epochs").alias("epochs"), F.sum(added).alias("more"), F.count("*").alias("rows"))
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size"), "epochs", "more", "rows")
    joined = rows.join(taken.hint("merge"), rows["doc_id"].eqNullSafe(F.col("t_id")) & rows["source"].eqNullSafe(F.col("t_source")) & (rows["size"] == F.col("t_size")))
    # rows alike in id, source and size: each is repeated for its epochs; what is above them is dealt by number
    number = F.row_number().over(Window.partitionBy("t_id", "t_source", "t_size").orderBy("doc_id"))
    joined = joined.withColumn("number", F.when(F.col("rows") > 1, number).otherwise(F.lit(1)))
    times = (F.col("epochs") / F.col("rows")).cast("int") + F.when(F.col("number") <= F.col("more"), 1).otherwise(0)
    return joined.select(held, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(held)[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
t AS (SELECT sum(source_size)::BIGINT AS total FROM s),
level AS (
  SELECT (total - coalesce((SELECT sum(3 * source_size) FROM s AS b WHERE 3 * b.source_size / b.weight::DOUBLE < c.ratio), 0))::DOUBLE
    / (SELECT sum(weight) FROM s AS b WHERE 3 * b.source_size / b.weight::DOUBLE >= c.ratio)::DOUBLE AS lam, ratio
  FROM t, (SELECT DISTINCT 3 * source_size / weight::DOUBLE AS ratio FROM s) AS c),
lam AS (SELECT min(lam) AS lam FROM level WHERE ratio >= lam AND ratio = (SELECT min(ratio) FROM level WHERE ratio >= lam)),
g AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, lam * weight::DOUBLE) AS target FROM s, lam),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS epochs FROM g),
k AS (SELECT d.*, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
  / (0.25 + 0.75 * least(1.0::DOUBLE, size::DOUBLE / 200.0)) AS key FROM d),
p AS (SELECT k.doc_id, k.source, size, source_size, target, epochs, greatest(0, floor(target + 0.5)::BIGINT - epochs * source_size) AS budget,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken, source FROM p
"""
