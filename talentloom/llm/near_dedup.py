"""Near-duplicates by Order MinHash: sketches that keep the text order of their minima, verified by banded alignment.

Two documents are linked when their aligned similarity is at least 0.8: with a and b runs of five words in
the two texts (shingles, labelled by occurrence) and m of them matched in text order, m / (a + b - m).
It equals the Jaccard similarity of the labelled shingles unless passages changed their order. A class
is a set of documents that links connect.

1. Documents with the same words are one node; only nodes take part below.
2. A sketch is the ``TUPLE`` smallest labelled shingles under one hash, put back into text order and hashed;
   a node has ``SKETCHES`` of them (texts of fewer than ``SHORT`` shingles have ``SHORT_SKETCHES`` sketches of
   two; between the two bounds a text has both, so a pair that may be linked always shares a form). Nodes
   with an equal sketch share a bucket. Candidates share at least ``SHARED`` buckets (one for short texts); a pair
   at 0.8 does not with a probability of 7e-6 (80 sketches that each agree with 0.8**8), at 0.85 of 1e-9.
3. No bucket is expanded into its pairs. Each round picks leaders in every bucket that still joins several
   components - first the node with the largest buckets, which is the likely source of a family of copies,
   then ``GROWTH`` times as many each round by hash - and verifies leaders against members of other components.
   Found links merge components. Pairs are left out that cannot be linked because one has too many shingles
   that no other text has, by their distances to a common leader, or (after the first round) because the counts of their common
   shingles, by classes of their hashes, differ too much. A node leaves a bucket for good once lengths and common shingles rule out a link to all other components there. The rounds end when every candidate pair is connected, ruled out or verified, so no
   link between candidates is lost, and pairs inside a family that hangs together are never looked at.

Verification merges the two lists of shingles within the band that a similarity of 0.8 allows, which makes it
exact: the longest chain of matches in increasing order on both sides, in O(n log n). Shingles are compared by
32 bits of their hashes; a chance agreement within a pair changes its similarity by one shingle at most.

Defined cases: a null text has no words; all texts without words are one class; a text of one to four words is
one shingle; a null doc_id is the last in order; rows that repeat are one node and one class; an empty table gives
an empty table; ``survivors`` keeps further columns whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import kept, partitions, pick_rows, with_group_facts

WORDS = 5
SIMILAR = 0.8
SKETCHES, TUPLE, SHARED = 80, 8, 2
SHORT_SKETCHES, SHORT_TUPLE = 16, 2
SHORT, OVERLAP = 32, 24
GROWTH = 16
COUNTERS = 128
CHUNK_BYTES = 2 << 20
OWNER_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([int.from_bytes(hashlib.blake2b(f"sketch {i}".encode(), digest_size=8).digest(), "little") for i in range(SKETCHES)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_print(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


_codes: dict[bytes, int] = {}


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the labelled shingles, in text order."""
    if len(_codes) > 1 << 20:
        _codes.clear()
    code = []
    for w in words:
        c = _codes.get(w)
        if c is None:
            c = _codes[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        code.append(c)
    if not code:
        return np.array([], np.uint64)
    x = np.array(code, np.uint64)
    n = max(1, len(x) - WORDS + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(min(WORDS, len(x))):
            h = h * _ODD + x[k: k + n]
        h = _mix(h)
        # the label: how often the shingle came before
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if not new.all():
            at = np.arange(n)
            label = np.empty(n, np.uint64)
            label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
            h = np.where(label > 0, _mix(h + label * _ODD), h)
    return h


def _tuples(h: np.ndarray, seeds: np.ndarray, size: int) -> list[int]:
    out = []
    step = max(1, (1 << 20) // len(h))  # bounded memory for very long texts
    with np.errstate(over="ignore"):
        for a in range(0, len(seeds), step):
            s = seeds[a: a + step, None]
            v = (h[None, :] ^ s) * _ODD
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            if len(h) > size:
                least = np.argpartition(v, size - 1, axis=1)[:, :size]
                least.sort(axis=1)  # back into text order
            else:
                least = np.broadcast_to(np.arange(len(h)), (len(s), len(h)))
            total = np.full(len(s), size, np.uint64) ^ s[:, 0]
            for k in range(least.shape[1]):
                total = _mix(total * _ODD + h[least[:, k]])
            out += total.view(np.int64).tolist()
    return out


def sketches(h: np.ndarray) -> list[int]:
    if not len(h):
        return []
    out = _tuples(h, _SEEDS[:SHORT_SKETCHES], SHORT_TUPLE) if len(h) < SHORT else []
    return out + (_tuples(h, _SEEDS, TUPLE) if len(h) >= OVERLAP else [])


def compared(a: np.ndarray, b: np.ndarray) -> tuple[bool, float]:
    """Is the aligned similarity of two shingle lists at least ``SIMILAR``? And their Jaccard similarity."""
    total = len(a) + len(b)
    need = SIMILAR * total / (1 + SIMILAR) - 1e-9
    order = np.argsort(b)
    ranked = b[order]
    at = np.minimum(np.searchsorted(ranked, a), len(b) - 1)
    i = np.flatnonzero(ranked[at] == a)
    jaccard = len(i) / (total - len(i))
    if len(i) < need:
        return False, jaccard
    j = order[at[i]]
    band = total - 2 * need + 1
    j = j[np.abs(i - j) <= band]
    if len(j) and (np.diff(j) > 0).all():
        m = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect.bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        m = len(tails)
    return m >= need, jaccard


# --- tasks ----------------------------------------------------------------------------------------


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            prints, counts, lists = [], [], []
            for text in part.column(1):
                words = words_of(text.as_py())
                h = shingles(words)
                prints.append(word_print(words))
                counts.append(len(h))
                lists.append(sketches(h))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), part.column(0), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["row", "doc_id", "print", "n", "sketches"])
            row += n


def _of_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) where the words are those of the node."""
    for batch in batches:
        same = [word_print(words_of(t.as_py())) == p for p, t in zip(batch.column(1).to_pylist(), batch.column(2))]
        yield batch.filter(pa.array(same, pa.bool_())).select(["node", "text"])


CHUNK = pa.schema([("chunk", pa.int64()), ("nodes", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
CHUNK_SQL = "chunk long, nodes array<long>, lengths array<long>, data binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of many nodes in one row, 32 bits each."""
    chunk = TaskContext.get().partitionId() << 28
    nodes, bodies, size = [], [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([chunk], [nodes], [[len(x) // 4 for x in bodies]], [b"".join(bodies)]), CHUNK)], schema=CHUNK)

    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            nodes.append(node)
            bodies.append((shingles(words_of(text.as_py())) >> np.uint64(32)).astype("<u4").tobytes())
            size += len(bodies[-1])
            if size >= CHUNK_BYTES:
                yield flush()
                chunk, nodes, bodies, size = chunk + 1, [], [], 0
    if nodes:
        yield flush()


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends = np.cumsum([0, *row["lengths"]]) * 4
            yield pa.RecordBatch.from_arrays([pa.array(row["nodes"], pa.int64()), pa.array([row["data"][x:y] for x, y in zip(ends[:-1], ends[1:])], pa.binary())], ["node", "body"])


def _by_owner(data: bytes, owners: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct shingles of a chunk, how often each occurs, and the places of those that go to one owner."""
    distinct, count = np.unique(np.frombuffer(data, "<u4"), return_counts=True)
    owner = distinct % owners
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order].astype(np.int64), prepend=-1))
    return distinct, count, np.split(order, cuts[1:]) if len(order) else []


def _send(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                distinct, count, parts = _by_owner(row["data"], owners)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array([int(distinct[p[0]] % owners) for p in parts], pa.int64()),
                    pa.array([distinct[p].tobytes() for p in parts], pa.binary()), pa.array([np.minimum(count[p], 2).astype(np.uint8).tobytes() for p in parts], pa.binary()),
                ], ["chunk", "owner", "shingles", "counts"])

    return send


def _shared(messages: pa.Table) -> pa.Table:
    """One owner: a bit for each shingle of a message, set where another node has it too."""
    lists = [np.frombuffer(x, "<u4") for x in messages["shingles"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in messages["counts"].to_pylist()])
    _, where = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(where, weights=counts)[where]
    bits = [np.packbits(t > 1).tobytes() for t in np.split(total, np.cumsum([len(x) for x in lists])[:-1])]
    return pa.table({"chunk": messages["chunk"], "owner": messages["owner"], "bits": pa.array(bits, pa.binary())})


def _common(owners: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                distinct, _, parts = _by_owner(row["data"], owners)
                bits = {r["owner"]: r["bits"] for r in row["replies"] or []}
                known = np.zeros(len(distinct), bool)
                for p in parts:
                    known[p] = np.unpackbits(np.frombuffer(bits[int(distinct[p[0]] % owners)], np.uint8))[: len(p)]
                mine = known[np.searchsorted(distinct, np.frombuffer(row["data"], "<u4"))]
                lengths = np.array(row["lengths"], np.int64)
                total = np.concatenate([[0], np.cumsum(mine)])
                ends = np.cumsum(lengths)
                parts = np.split(np.frombuffer(row["data"], "<u4"), ends[:-1])
                counters = [np.bincount(x[k] % COUNTERS, minlength=COUNTERS) for x, k in zip(parts, np.split(mine, ends[:-1]))]
                yield pa.RecordBatch.from_arrays([pa.array(row["nodes"], pa.int64()), pa.array(total[ends] - total[ends - lengths], pa.int64()), pa.array(counters, pa.list_(pa.int32()))], ["node", "common", "counters"])

    return count


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [compared(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) for x, y in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.bool_()), pa.array([x for _, x in found], pa.float64())], ["a", "b", "linked", "jaccard"])


# --- components -----------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: the smallest node that links connect it to.

    Each step joins every node to the smallest of its neighbours and roots, and halves the paths; the number
    of steps grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = kept(spark, both, "edges")
    roots = kept(spark, edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        # the smallest root in the neighbourhood, handed to the own root as well
        seen = edges.join(roots.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        best = roots.join(seen, "node").select("node", "root", F.least("root", "near").alias("best"))
        hooked = best.groupBy("root").agg(F.min("best").alias("hook"))
        offered = best.select("node", F.col("best").alias("to")).unionByName(hooked.select(F.col("root").alias("node"), F.col("hook").alias("to")))
        parent = kept(spark, offered.groupBy("node").agg(F.min("to").alias("to")), "parents")
        jumped = parent.join(parent.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.least("to", "next").alias("root"))
        new = kept(spark, jumped, "roots")
        changed = new.join(roots.withColumnRenamed("root", "old"), "node").filter("root != old").limit(1).count()
        roots = new
        if not changed:
            return roots


# --- the operator -----------------------------------------------------------------------------------


def classes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, print, class_id, class_size, kept): one row for each row of ``docs``.

    ``class_id`` is the smallest doc_id of the class, ``kept`` is true for one row of each class, with that id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = kept(spark, docs.mapInArrow(_read, "row long, doc_id long, print binary, n long, sketches array<long>"), "sketched")
    rows = with_group_facts(read, ["print"], {"node": F.min("row")}, {"node": F.min("node")}, ["row"])
    rows = kept(spark, rows.withColumn("sketches", F.when(F.col("row") == F.col("node"), F.col("sketches"))), "rows")

    links = _links(docs, rows)
    roots = components(links)
    node_class = rows.select("row", "doc_id", "print", "node").join(roots, "node", "left").select("row", "doc_id", "print", F.coalesce("root", "node").alias("class"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    facts = with_group_facts(node_class.withColumn("order", order), ["class"], {"first": F.min("order"), "class_size": F.count("*")}, {"first": F.min("first"), "class_size": F.sum("class_size")}, ["row"])
    return facts.select("row", "doc_id", "print", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("order") == F.col("first")).alias("kept"))


def _links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes, enough to connect every class."""
    spark = docs.sparkSession
    sketched = rows.filter("sketches is not null").select(F.explode(F.array_distinct("sketches")).alias("bucket"), "node", "n")
    sizes = sketched.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = kept(spark, sketched.join(sizes, "bucket"), "buckets")
    per_node = shared.groupBy("node").agg(F.sum("size").alias("weight"), F.max("size").alias("largest"))
    # a node leads in all its buckets at one turn: 0 for the heads below, else by hash, evenly over its largest bucket
    even = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    weighed = kept(spark, shared.join(per_node, "node").withColumn("turn", 1.0 + even * F.col("largest")).drop("largest"), "weighed")
    texts = _texts_of(docs, rows, weighed.select("node").distinct())
    chunks = kept(spark, texts.mapInArrow(_chunks, CHUNK_SQL), "chunks")
    bodies = chunks.mapInArrow(_bodies, "node long, body binary")
    common = kept(spark, _common_shingles(chunks), "common")
    weighed = kept(spark, weighed.join(common.drop("counters"), "node").filter(F.col("common") >= _least_common(F.col("n"), SIMILAR * F.col("n"))), "able")
    # first to lead are the nodes that are the heaviest of their own largest bucket
    heaviest = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).getField("node").alias("head"))
    widest = weighed.groupBy("node").agg(F.max(F.struct("size", "bucket")).getField("bucket").alias("bucket"))
    heads = widest.join(heaviest, "bucket").filter("node = head").select("head").distinct()
    members = weighed.join(heads, F.col("node") == F.col("head"), "left").withColumn("turn", F.when(F.col("head").isNotNull(), F.lit(0.0)).otherwise(F.col("turn"))).drop("head", "size")
    members = kept(spark, members, "members")

    found: DataFrame | None = None
    tested: DataFrame | None = None
    alive = members.withColumns({"comp": F.col("node"), "pivot": F.lit(None).cast("long"), "far": F.lit(None).cast("double")})
    low, high = -1.0, 0.5
    while True:
        counted = [c for c in ("counters",) if c in alive.columns]
        leaders = alive.filter((F.col("turn") > low) & (F.col("turn") <= high)).select("bucket", *[F.col(c).alias("l_" + c) for c in ("node", "n", "common", "comp", "turn", "pivot", "far", *counted)])
        # of two leaders, the later one is the member; earlier leaders have been compared with all of their buckets
        later = (F.col("turn") > F.col("l_turn")) | (F.col("turn") == F.col("l_turn")) & (F.col("node") > F.col("l_node"))
        met = alive.join(leaders, "bucket").filter((F.col("comp") != F.col("l_comp")) & later & _may_link() & (_enough_alike() if counted else F.lit(True)))
        pairs = met.groupBy(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).agg(F.count("*").alias("times"), F.first(F.greatest("n", "l_n")).alias("longer"))
        pairs = pairs.filter(F.col("times") >= F.when(F.col("longer") >= SHORT, SHARED).otherwise(1)).select("a", "b")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        right = pairs.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("right")), "b")
        joined = right.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("left")), "a").select("a", "b", "left", "right")
        seen = kept(spark, joined.mapInArrow(_verify, "a long, b long, linked boolean, jaccard double"), "compared")
        linked = seen.filter("linked").select("a", "b")
        tested = seen.select("a", "b") if tested is None else tested.unionByName(seen.select("a", "b"))
        if low < 0:
            members = kept(spark, members.join(_pivots(seen, members), "node", "left"), "members")
        roots = components(linked if found is None else found.unionByName(linked))
        found = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b")  # connects as much
        low, high = high, (1.0 + GROWTH if high < 1 else 1.0 + (high - 1.0) * GROWTH)
        # a row that has gone does not come back: components only grow together, and leaders leave
        left = (alive if counted else members).drop("comp").filter(F.col("turn") > low).join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        left = _still_open(left)
        alive = kept(spark, left if counted else left.join(common.select("node", "counters"), "node"), "alive")
        if alive.isEmpty():
            return found


def _still_open(rows: DataFrame) -> DataFrame:
    """The rows whose bucket may hold a link to another component, by lengths and common shingles.

    A node of ``common`` shingles is linked to none longer than its reach. A row stays where the shortest node of all other components of
    its bucket lies within its reach, and the farthest reach of theirs takes in its own length. Both hold for every pair that
    ``_may_link`` lets pass, so only rows go that no such pair has.
    """
    reach = (F.col("common") + 2e-6) * ((1 + SIMILAR) / SIMILAR) - F.col("n")
    rows = rows.withColumn("reach", reach)
    per_comp = rows.groupBy("bucket", "comp").agg(F.min("n").alias("short"), F.max("reach").alias("far_reach"))
    first = per_comp.groupBy("bucket").agg(F.min(F.struct("short", "comp")).alias("s"), F.max(F.struct("far_reach", "comp")).alias("r"), F.count("*").alias("comps")).filter("comps > 1").drop("comps")
    # those of the second best, for the rows of the component that has the best
    others = per_comp.join(first, "bucket").groupBy("bucket").agg(
        F.first("s").alias("s"), F.first("r").alias("r"),
        F.min(F.when(F.col("comp") != F.col("s.comp"), F.col("short"))).alias("s2"), F.max(F.when(F.col("comp") != F.col("r.comp"), F.col("far_reach"))).alias("r2"))
    shortest = F.when(F.col("comp") == F.col("s.comp"), F.col("s2")).otherwise(F.col("s.short"))
    farthest = F.when(F.col("comp") == F.col("r.comp"), F.col("r2")).otherwise(F.col("r.far_reach"))
    return rows.join(others, "bucket").filter((shortest <= F.col("reach")) & (farthest >= F.col("n"))).drop("reach", "s", "r", "s2", "r2")


def _common_shingles(chunks: DataFrame) -> DataFrame:
    """(node, common, counters): how many shingles of a node some other node has as well, in all and by ``COUNTERS`` classes of their hashes.

    They are found by an exchange of short hashes and bits.
    """
    spark = chunks.sparkSession
    total = chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    owners = max(partitions(spark), -(-total // OWNER_BYTES))
    sent = chunks.mapInArrow(_send(owners), "chunk long, owner long, shingles binary, counts binary")
    replies = sent.groupBy("owner").applyInArrow(_shared, "chunk long, owner long, bits binary").groupBy("chunk").agg(F.collect_list(F.struct("owner", "bits")).alias("replies"))
    return chunks.join(replies, "chunk", "left").mapInArrow(_common(owners), "node long, common long, counters array<int>")


def _least_common(n: Column, m: Column) -> Column:
    """Matched shingles that two nodes of ``n`` and ``m`` shingles need for a link, and so need to share with others."""
    return SIMILAR / (1 + SIMILAR) * (n + m) - 1e-6


def _may_link() -> Column:
    """False only where two nodes cannot be linked: by the shingles they share with any other node, or by their distances to a third.

    Shingles that no other node has cannot be matched, so a text with many edits of its own is known to have no
    link without a comparison; this also bounds the lengths. One minus the Jaccard similarity obeys the triangle inequality, and the aligned similarity is at most the Jaccard
    similarity; so two nodes whose distances to one pivot differ by more than 0.2 are more than 0.2 apart.
    """
    enough = F.least("common", "l_common") >= _least_common(F.col("n"), F.col("l_n"))
    apart = (F.col("pivot") == F.col("l_pivot")) & (F.abs(F.col("far") - F.col("l_far")) > 1 - SIMILAR + 1e-6)
    return enough & ~F.coalesce(apart, F.lit(False))


def _enough_alike() -> Column:
    """False only where two nodes cannot be linked, since they share too few shingles of each class that other nodes have too.

    Matched shingles are of one class, and common, on both sides; so there are at most as many as the smaller counters add up to.
    """
    at_most = F.aggregate(F.zip_with("counters", "l_counters", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    return at_most >= _least_common(F.col("n"), F.col("l_n"))


def _pivots(seen: DataFrame, members: DataFrame) -> DataFrame:
    """(node, pivot, far): of the heads a node was compared with, the heaviest, and the distance to it."""
    heads = members.filter("turn = 0").select(F.col("node").alias("pivot"), "weight").distinct()
    both = seen.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "jaccard").unionByName(seen.select(F.col("b").alias("node"), F.col("a").alias("pivot"), "jaccard"))
    best = both.join(heads, "pivot").groupBy("node").agg(F.max(F.struct("weight", "pivot", (1 - F.col("jaccard")).alias("far"))).alias("best"))
    return best.select("node", "best.pivot", "best.far")


def _texts_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes. Texts are found by doc_id; where an id has several rows, by their words as well."""
    several = rows.groupBy(F.col("doc_id").alias("of")).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    ids = rows.filter("row = node").join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("id"), "print")
    same = F.col("id").eqNullSafe(F.col("of"))
    once = docs.join(ids.join(several, same, "left_anti").hint("merge"), F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    more = docs.join(ids.join(several, same, "left_semi").hint("merge"), F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "print", "text")
    mine = more.mapInArrow(_of_print, "node long, text string")  # a function of rows, so no text is read before its id is known to have several
    return once.unionByName(mine.dropDuplicates(["node"]))


def print_of(text: Column) -> Column:
    @F.arrow_udf("binary")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([word_print(words_of(t.as_py())) for t in texts], pa.binary())

    return prints(text)


def class_rows(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "class_size", "kept")


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each class (the smallest doc_id), with all columns of ``docs``."""
    decided = kept(docs.sparkSession, classes(docs).select("doc_id", "kept", F.col("print").alias("digest")), "decided")
    return pick_rows(docs, decided, print_of)
