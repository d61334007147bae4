"""Sharding by extendible hashing, in DataFrame functions only.

The directory is indexed by prefix bits of a hash of the document. A bucket whose texts exceed the
byte limit splits on its next bit, and only such a bucket does; the buckets that fit are the shards.
Bytes are added up for cells twelve bits below the buckets in question, and rolled up to every depth
between, so a round of the loop settles twelve levels; a further round reads only the rows of buckets
that are still too large. The driver learns whether any are left, and the depths in use, nothing else.

Defined cases: a null text has no bytes; a document larger than the limit ends alone in a shard; rows
that share a doc_id are told apart by their place in the scan, so copies of one row also spread over
shards (which copy lands where may change with the scan's partitions; the shards' limits hold all the
same); an empty table has no shards; ``sharded`` keeps further columns whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import fresh, kept, or_empty

LIMIT_BYTES = 64 << 20
BITS = 60
STEP = 12


def hash_of(value: Column) -> Column:
    """The first 60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> dict[str, Column]:
    """What a row's hash and place need of its text: bytes, and a hash that orders rows of one id."""
    return {"size": F.octet_length(or_empty(F.col("text"))).cast("long"), "tie": F.xxhash64("text")}


def keyed(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, size, tie, …)`` with their hash as ``key`` instead of ``tie``."""
    repeated = rows.groupBy(F.col("doc_id").alias("of")).agg(F.count("*").alias("n")).filter("n > 1").select("of")
    placed_ = rows.withColumn("part", F.spark_partition_id())
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    once = placed_.join(repeated, same, "left_anti").withColumn("key", hash_of(F.col("doc_id").cast("string")))
    order = Window.partitionBy("doc_id", "part").orderBy("size", "tie")
    several = placed_.join(repeated, same, "left_semi").withColumn("number", F.row_number().over(order))
    several = several.withColumn("key", hash_of(F.concat_ws(":", F.col("doc_id").cast("string"), "part", "number"))).drop("number")
    return once.unionByName(several).drop("part", "tie")


def prefix(key: Column, depth: Column) -> Column:
    return F.call_function("shiftright", key, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows) of every shard of ``rows(key, size)``."""
    shards: list[DataFrame] = []
    depth, left = 0, rows
    while True:
        below = min(STEP, BITS - depth)
        cells = left.groupBy(prefix(F.col("key"), F.lit(depth + below)).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        level = F.explode(F.sequence(F.lit(0), F.lit(below))).alias("level")
        up = cells.select("bytes", "rows", "cell", level).select("bytes", "rows", "level", F.call_function("shiftright", F.col("cell"), (F.lit(below) - F.col("level")).cast("int")).alias("prefix"))
        buckets = up.groupBy("level", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        buckets = kept(rows.sparkSession, buckets.withColumn("large", (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)), "buckets")
        parents = buckets.filter("large").select((F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"))
        child = buckets.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["level", "parent"], "left_semi")
        top = buckets.filter("level = 0") if depth == 0 else child.limit(0).drop("parent")
        settled = child.drop("parent").unionByName(top).filter(~F.col("large") | (F.col("level") == BITS - depth))
        shards.append(settled.select((F.col("level") + depth).cast("int").alias("depth"), "prefix", "shard_bytes", "shard_rows"))
        large = buckets.filter((F.col("level") == below) & F.col("large")).select(F.col("prefix").alias("cell"))
        depth += below
        if depth >= BITS or large.isEmpty():
            return reduce(DataFrame.unionByName, shards)
        left = rows.join(large, prefix(F.col("key"), F.lit(depth)) == F.col("cell"), "left_semi")


def placed(rows: DataFrame, limit: int) -> DataFrame:
    """``rows(key, size, …)`` with (shard, depth, shard_bytes, shard_rows); a shard is named by its bits."""
    found = kept(rows.sparkSession, directory(rows, limit), "directory")
    depths = [r["depth"] for r in found.select("depth").distinct().collect()]  # at most 61 numbers
    found = found.withColumnsRenamed({"depth": "depth_", "prefix": "prefix_"})
    tried = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]).cast("array<int>")))
    joined = tried.join(found, (F.col("depth") == F.col("depth_")) & (prefix(F.col("key"), F.col("depth")) == F.col("prefix_")))
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix_"), F.col("depth"), F.lit("0")))
    return joined.withColumn("shard", name).drop("depth_", "prefix_")


def shard_rows(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    light = kept(docs.sparkSession, docs.select("doc_id", *[c.alias(n) for n, c in sized(docs).items()]), "sizes")
    rows = kept(docs.sparkSession, keyed(light), "keys")
    return placed(rows, limit).select("doc_id", F.col("size").alias("n_bytes"), "shard", "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Writes all columns of ``docs`` as Parquet, one folder per shard (``shard=b0110``)."""
    held = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "doc_id", *[c.alias(n) for n, c in sized(docs).items()])
    rows = kept(docs.sparkSession, keyed(held).drop("doc_id"), "staged")
    out = placed(rows, limit).select("row.*", F.concat(F.lit("b"), "shard").alias(fresh(docs, "shard")))
    name = out.columns[-1]
    out.repartition(F.col(f"`{name}`")).write.partitionBy(name).parquet(path)


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h FROM documents),
b AS (SELECT 0 AS depth, h, doc_id, n_bytes, sum(n_bytes) OVER () AS bytes, count(*) OVER () AS n FROM d
  UNION ALL SELECT depth + 1, h, doc_id, n_bytes, sum(n_bytes) OVER (PARTITION BY h >> ({BITS - 1} - depth)), count(*) OVER (PARTITION BY h >> ({BITS - 1} - depth))
  FROM b WHERE bytes > {LIMIT_BYTES} AND n > 1 AND depth < {BITS})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - depth)), depth, '0') END AS shard, depth,
  bytes::BIGINT AS shard_bytes, n AS shard_rows FROM b WHERE bytes <= {LIMIT_BYTES} OR n = 1 OR depth = {BITS}
"""
