"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each task reads its documents once, in chunks. For a chunk it keeps (doc_id, SHA-256 of the
   normalised text) and sends every owner of a fingerprint range the chunk's distinct 64-bit
   fingerprints of that range: sorted, as gaps in Rice's form of the Golomb code. The texts stay where
   they are, in blocks of a table that is bucketed by block.
2. An owner decodes what it got and replies to each chunk with one bit for each fingerprint: seen in
   another chunk or not.
3. A chunk's suspects are the rows whose bit is set or whose fingerprint the chunk has twice. Their
   places travel to the blocks, and only their texts leave them, to be compared byte by byte (grouped by
   the whole normalised text, added up before they move, so a group that holds a third of all rows moves
   once for each task).
4. Every row gets the facts of its group by (hash, salt), see ``common.with_group_facts``.

Texts are equal when they are the same after lower-casing A-Z. Defined cases: a null text is the
empty text; a null doc_id is smaller than any other; rows that repeat a doc_id and its text are
members of one group of which one stays (``kept`` is true for exactly one row of a group); a text of any
length is read whole and fills a block of its own; an empty table gives an empty table; further columns are kept by ``survivors`` whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import kept, or_empty, partitions, pick_rows, with_group_facts
from talentloom.session import scratch_path

CHUNK_ROWS = 65_536
#: Text of a block, and of the blocks that one task reads.
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 128 << 20
#: Fingerprints an owner gets, at least as many owners as shuffle partitions.
OWNER_ROWS = 1 << 20
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


# --- the code -----------------------------------------------------------------------------------


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted, distinct 64-bit integers as gaps: quotients in unary, then remainders in ``b`` bits each."""
    gaps = np.diff(values, prepend=np.uint64(0))
    spread = int(values[-1] - values[0]) // max(1, len(values) - 1) if len(values) > 1 else 1
    b = max(0, min(63, spread.bit_length() - 1))
    base, gaps = int(gaps[0]), gaps[1:]
    quotient = (gaps >> np.uint64(b)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    low = (gaps[:, None] >> np.arange(b, dtype=np.uint64)[None, :]) & np.uint64(1)
    head = np.array([len(values), b, base, len(unary)], np.uint64).tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes()


def rice_decode(code: bytes) -> np.ndarray:
    n, b, base, n_unary = (int(x) for x in np.frombuffer(code, np.uint64, 4))
    body = np.frombuffer(code, np.uint8, offset=32)
    cut = (n_unary + 7) // 8
    stops = np.flatnonzero(np.unpackbits(body[:cut])[:n_unary] == 0)
    quotient = np.diff(stops, prepend=-1) - 1
    bits = np.unpackbits(body[cut:])[: (n - 1) * b].reshape(n - 1, b).astype(np.uint64)
    low = (bits << np.arange(b, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    gaps = (quotient.astype(np.uint64) << np.uint64(b)) + low
    return np.cumsum(np.concatenate([np.array([base], np.uint64), gaps]), dtype=np.uint64)


def owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    """Ranges of equal width, in the order of the fingerprints."""
    return ((prints >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def fingerprints(hashes: pa.Array) -> np.ndarray:
    """The first eight bytes of each SHA-256."""
    joined = b"".join(h[:8] for h in hashes.to_pylist())
    return np.frombuffer(joined, ">u8").astype(np.uint64)


# --- tasks --------------------------------------------------------------------------------------

SENT = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("sha", pa.binary()),
                  ("owner", pa.int64()), ("code", pa.binary()), ("ends", pa.list_(pa.int64())), ("data", pa.binary())])
SENT_SQL = "chunk long, block long, place int, doc_id long, sha binary, owner long, code binary, ends array<long>, data binary"


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SENT], schema=SENT)


def _reader(owners: int):
    """Rows (doc_id, sha), messages (owner, code) and blocks of texts (data, ends); a place counts from the start of its chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        shas: list[bytes] = []
        size = 0

        def end_block() -> Iterator[pa.RecordBatch]:
            n = len(ids)
            yield _batch(n, chunk=[chunk] * n, block=[block] * n, place=range(len(shas) - n, len(shas)), doc_id=ids, sha=shas[len(shas) - n:])
            yield _batch(1, block=[block], place=[len(shas) - n], ends=[np.cumsum([len(t) for t in texts])], data=[b"".join(texts)])

        def end_chunk() -> pa.RecordBatch:
            prints = np.unique(fingerprints(pa.array(shas, pa.binary())))
            owner = owner_of(prints, owners)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            sent = [(int(owner[a]), rice_encode(prints[a:z])) for a, z in zip(cuts, [*cuts[1:], len(prints)])]
            return _batch(len(sent), chunk=[chunk] * len(sent), block=[block] * len(sent), owner=[o for o, _ in sent], code=[c for _, c in sent])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                norm = normalised(text.as_py())
                if ids and size + len(norm) > BLOCK_BYTES:
                    yield from end_block()
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(doc_id)
                texts.append(norm)
                shas.append(hashlib.sha256(norm).digest())
                size += len(norm)
                if len(shas) == CHUNK_ROWS:
                    yield from end_block()
                    yield end_chunk()
                    chunk, block, ids, texts, shas, size = chunk + 1, block + 1, [], [], [], 0
        if ids:
            yield from end_block()
        if shas:
            yield end_chunk()

    return read


def _reply(messages: pa.Table) -> pa.Table:
    """One owner: for each message, the bits of the fingerprints that another chunk sent too."""
    lists = [rice_decode(c) for c in messages["code"].to_pylist()]
    _, where, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice = count[where] > 1
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(twice, cuts)]
    return pa.table({"chunk": messages["chunk"], "owner": messages["owner"], "bits": pa.array(bits, pa.binary())})


def _suspects(owners: int):
    def mark(rows: pa.Table, replies: pa.Table) -> pa.Table:
        prints = fingerprints(rows["sha"].combine_chunks())
        distinct, where, count = np.unique(prints, return_inverse=True, return_counts=True)
        suspect = count > 1
        owner = owner_of(distinct, owners)
        for o, bits in zip(replies["owner"].to_pylist(), replies["bits"].to_pylist()):
            a, z = np.searchsorted(owner, [o, o + 1])
            suspect[a:z] |= np.unpackbits(np.frombuffer(bits, np.uint8))[: z - a].astype(bool)
        return rows.select(["chunk", "block", "place", "doc_id", "sha"]).append_column("suspect", pa.array(suspect[where]))

    return mark


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts at the wanted places of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            ends = [0, *row["ends"]]
            yield pa.record_batch({"norm": pa.array([row["data"][ends[p - row["place"]]:ends[p - row["place"] + 1]] for p in row["places"]], pa.binary())})


# --- the operator -------------------------------------------------------------------------------


def decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha): one row for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_rows, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    owners = max(partitions(spark), -(-n_rows // OWNER_ROWS))
    name = f"texts_{uuid.uuid4().hex}"
    written = docs.mapInArrow(_reader(owners), SENT_SQL).write.option("compression", "zstd").bucketBy(max(partitions(spark), -(-n_bytes // BUCKET_BYTES)), "block")
    written.option("path", scratch_path(spark, name)).saveAsTable(name)
    sent = spark.table(name)
    messages = sent.filter("owner is not null").select("chunk", "owner", "code")
    replies = messages.groupBy("owner").applyInArrow(_reply, "chunk long, owner long, bits binary")
    rows = sent.filter("sha is not null").select("chunk", "block", "place", "doc_id", "sha")
    marked = kept(spark, rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_suspects(owners), "chunk long, block long, place int, doc_id long, sha binary, suspect boolean"), "suspects")

    suspects = marked.filter("suspect").drop("suspect")
    wanted = suspects.groupBy("block").agg(F.collect_list("place").alias("places"))  # at most the rows of a block
    held = sent.filter("data is not null").select("block", "place", "ends", "data")
    texts = held.join(wanted.hint("merge"), "block").select("place", "ends", "data", "places").mapInArrow(_texts, "norm binary")
    # verified by bytes: the group is the whole text; two texts under one SHA-256 would end the run
    by_text = texts.groupBy("norm").agg(F.count("*").alias("n")).select(F.unhex(F.sha2("norm", 256)).alias("sha"), "n")
    by_sha = by_text.groupBy("sha").agg(F.sum("n").alias("group_size"), F.count("*").alias("texts"))
    checked = by_sha.select("sha", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).alias("group_size"))

    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order"), "doc_id", "chunk", "place")
    facts = with_group_facts(suspects.withColumn("row", key), ["sha"], {"last": F.max("row")}, {"last": F.max("last")}, ["chunk", "place"])
    sizes = with_group_sizes(facts, checked)
    grouped = sizes.select("doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("last")).alias("kept"), "sha")
    alone = marked.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(grouped)


def with_group_sizes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Joins the verified size of a group to its rows, by hash and salt like the other facts."""
    salt = F.pmod(F.xxhash64("chunk", "place"), F.lit(partitions(rows.sparkSession))).cast("int")
    salted = rows.withColumn("salt", salt)
    by_salt = salted.select("sha", "salt").distinct().join(sizes, "sha")
    return salted.join(by_salt, ["sha", "salt"])


def decision_rows(docs: DataFrame) -> DataFrame:
    return decisions(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = kept(docs.sparkSession, decisions(docs).select("doc_id", "kept", F.col("sha").alias("digest")), "decided")
    return pick_rows(docs, decided, sha_of)


def sha_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(or_empty(text), UPPER.decode(), LOWER.decode()).cast("binary"), 256))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
