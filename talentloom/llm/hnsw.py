"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph for each shard.

1. Equal vectors are one node, which keeps its ``K + 1`` smallest vec_ids: no answer can hold more of them. So a vector that
   stands for a third of all rows is one node.
2. Shards follow content: coarse centres, fitted on a bounded sample (``SAMPLE`` nodes of smallest hash), cut the nodes into
   cells of about ``SHARD`` nodes; a cell with more is cut into parts by hash, all of which are searched, so no task
   holds an unbounded cell. Every node is indexed.
3. Each shard becomes a graph, stored as one row of flat arrays: vectors, levels and the neighbours of each level. Nodes enter
   in batches: a batch searches the graph so far and itself, keeps spread-out neighbours, and links back. Inner products order
   vectors as distances do once each has one more component that brings it to the length of the longest of its shard.
4. How many cells a query visits is measured, not assumed: ``TRIALS`` queries are compared with all nodes, and the smallest number
   of cells (nearest centre first) is taken that holds ``COVER`` of their true neighbours.
5. Queries (distinct vectors) go to their cells in blocks, beside a copy of the shard's row; shard results are merged, and
   scores are computed again on the original vectors in double precision, component by component in order.

The router - ``CELLS`` centres at most - and the trial queries have a size bound of their own and go to every task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a
vec_id; a query meets vectors of its own length only; rows that repeat are candidates each, and a query leaves out one row with its own
id and vector; ties go to the smaller vec_id; with at most ``K`` candidates in a shard all are found; an empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import kept, partitions

K = 20
EVERY = 20
SHARD = 8192
SAMPLE, CELLS = 32_768, 2048
TRIALS, COVER = 256, 0.98
LINKS, BASE_LINKS = 16, 32
BUILD_BEAM, SEARCH_BEAM = 64, 128
BATCH = 512
QUERY_BLOCK = 4096
NODES_SQL = "digest binary, width int, vector binary, ids array<long>"


# --- the graph of one shard --------------------------------------------------------------------------


def search(x: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first, as (nodes, similarities); -1 where there are fewer.

    All queries walk at once: each step opens the nearest unopened nodes of every beam.
    """
    count, opened_at_once = len(queries), 4
    nodes = np.full((count, beam), -1, np.int32)
    near = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    seen = np.zeros((count, len(x) + 1), bool)  # the last column stands for "no node"
    seen[:, -1] = True
    width = entries.shape[1]
    for c in range(width):
        e = entries[:, c]
        new = ~seen[np.arange(count), e]
        seen[np.arange(count), e] = True
        nodes[:, c] = np.where(new, e, -1)
        near[:, c] = np.where(new, np.einsum("ij,ij->i", x[e], queries), -np.inf)
        done[:, c] = ~new
    live = np.arange(count)
    while len(live):
        waiting = np.where(done[live], -np.inf, near[live])
        pick = np.argpartition(-waiting, opened_at_once - 1, axis=1)[:, :opened_at_once] if beam > opened_at_once else np.tile(np.arange(beam), (len(live), 1))
        open_now = np.take_along_axis(waiting, pick, 1) > -np.inf
        busy = open_now.any(1)
        live, pick, open_now = live[busy], pick[busy], open_now[busy]
        if not len(live):
            break
        row = live[:, None]
        at = np.where(open_now, nodes[row, pick], -1)
        done[row, pick] = True
        found = np.where(at[:, :, None] >= 0, neighbours[at], -1).reshape(len(live), -1)
        found = np.where(found < 0, len(x), found)
        found.sort(axis=1)
        new = ~seen[row, found]
        new[:, 1:] &= found[:, 1:] != found[:, :-1]
        seen[row, found] = True
        # only new nodes are compared
        i, j = np.nonzero(new)
        offered = np.full(found.shape, -np.inf, np.float32)
        offered[i, j] = np.einsum("ij,ij->i", x[found[i, j]], queries[live[i]])
        all_near = np.concatenate([near[live], offered], 1)
        best = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        near[live] = np.take_along_axis(all_near, best, 1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], np.where(new, found, -1).astype(np.int32)], 1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), best, 1)
    order = np.argsort(-near, axis=1, kind="stable")
    nodes, near = np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)
    return np.where(near > -np.inf, nodes, -1), near


def spread(x: np.ndarray, own: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates (nearest first, -1: none), ``most`` that are nearer to ``own`` than to one another; the nearest others fill up."""
    out = np.full((len(nodes), most), -1, np.int32)
    for a in range(0, len(nodes), 512):
        ids, s = nodes[a: a + 512], near[a: a + 512]
        there = ids >= 0
        v = x[np.maximum(ids, 0)]
        pair = v @ v.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        worst = np.full(ids.shape, -np.inf, np.float32)  # similarity to the nearest one taken
        total = np.zeros(len(ids), np.int64)
        for c in range(ids.shape[1]):
            take = there[:, c] & (total < most) & (s[:, c] > worst[:, c])
            taken[:, c] = take
            total += take
            worst = np.where(take[:, None], np.maximum(worst, pair[:, c]), worst)
        rank = np.where(there, np.arange(ids.shape[1]) + np.where(taken, 0, ids.shape[1]), 1 << 30)
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        chosen = np.where(np.take_along_axis(rank, first, 1) < 1 << 30, np.take_along_axis(ids, first, 1), -1)
        out[a: a + 512, : chosen.shape[1]] = chosen
    return out


def _link_back(x: np.ndarray, neighbours: np.ndarray, new: np.ndarray, most: int) -> None:
    """Add the reverse of the links of the nodes ``new``; a full list keeps the spread-out ones."""
    source = np.repeat(new, neighbours.shape[1])
    target = neighbours[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    near = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-near, target))
    source, target = source[order], target[order]
    heads = np.flatnonzero(np.diff(target, prepend=-1))
    place = np.arange(len(target)) - np.repeat(heads, np.diff([*heads, len(target)]))
    keep = place < most
    source, target, place = source[keep], target[keep], place[keep]
    heads, row = np.unique(target, return_inverse=True)
    offered = np.full((len(heads), most), -1, np.int32)
    offered[row, place] = source
    both = np.concatenate([neighbours[heads], offered], 1)
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    s = np.where(both >= 0, np.einsum("ijk,ik->ij", x[np.maximum(both, 0)], x[heads]), -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")
    both, s = np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1)
    full = (both >= 0).sum(1) > most
    neighbours[heads[~full]] = both[~full][:, :most]
    if full.any():
        neighbours[heads[full]] = spread(x, heads[full], both[full], s[full], most)


def descend(x: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, beam: int = 2) -> np.ndarray:
    """Entry nodes for the level below ``levels`` (highest first): the nearest found, level by level."""
    entries = np.zeros((len(queries), 1), np.int32)
    for neighbours in levels:
        nodes, _ = search(x[: len(neighbours)], neighbours, queries, entries, max(beam, 8))
        entries = np.where(nodes[:, :beam] >= 0, nodes[:, :beam], nodes[:, :1])
    return entries


def build(x: np.ndarray, seeds: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays, highest level first; nodes are in order of falling level, as ``order_of`` gives them."""
    counts = level_counts(seeds)
    levels: list[np.ndarray] = []
    for depth, n in enumerate(counts):
        most = BASE_LINKS if depth == len(counts) - 1 else LINKS
        neighbours = np.full((n, most), -1, np.int32)
        at = 0
        while at < n:
            # the first nodes meet all others, later ones come in batches that the graph so far outnumbers
            end = min(n, at + (BATCH if at == 0 else min(BATCH, at)))
            new = np.arange(at, end, dtype=np.int32)
            among = (x[at:end] @ x[at:end].T).astype(np.float32)
            np.fill_diagonal(among, -np.inf)
            width = min(BUILD_BEAM, end - at)
            mates = np.argpartition(-among, width - 1, axis=1)[:, :width]
            nodes, near = (mates + at).astype(np.int32), np.take_along_axis(among, mates, 1)
            if at:
                entries = descend(x, levels, x[at:end])
                entries = np.where(entries < at, entries, 0)
                old, s = search(x[:at], neighbours[:at], x[at:end], entries, BUILD_BEAM)
                nodes, near = np.concatenate([old, nodes], 1), np.concatenate([s, near], 1)
            nodes = np.where(near > -np.inf, nodes, -1)
            order = np.argsort(-near, axis=1, kind="stable")[:, :BUILD_BEAM]
            neighbours[at:end] = spread(x, new, np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1), most)
            _link_back(x[:end], neighbours[:end], new, most)
            at = end
        levels.append(neighbours)
    return levels


def level_counts(seeds: np.ndarray) -> list[int]:
    """How many nodes each level has, highest first; ``seeds`` are even in (0, 1], and a node reaches level -log(seed) / log(LINKS)."""
    reach = np.floor(-np.log(seeds) / np.log(LINKS)).astype(int)
    return [n for n in (int((reach >= i).sum()) for i in range(reach.max(initial=0), -1, -1)) if n > 0]


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors brought to one length by one more component, the longest to length one."""
    length = np.linalg.norm(x, axis=1)
    x = x / length.max()
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - np.square(x).sum(1)))[:, None]], 1).astype(np.float32)


def exact(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in order of the components."""
    return np.cumsum(queries * x, axis=1)[:, -1]


# --- tasks ----------------------------------------------------------------------------------------


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digests, widths, vectors = [], [], [], []
        for i, values in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = values.as_py()
            if i is None or not values or None in values:
                continue
            v = np.array(values, "<f8") + 0.0  # one zero
            if np.isfinite(v).all() and v.any():
                ids.append(i)
                vectors.append(v.tobytes())
                widths.append(len(v))
                digests.append(hashlib.blake2b(vectors[-1], digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(widths, pa.int32()), pa.array(vectors, pa.binary())], ["vec_id", "digest", "width", "vector"])


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    """Directions; vectors of any finite size, also where squares overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(cells_for: dict[int, int]):
    def fit(sample: pa.Table) -> pa.Table:
        """Centres of one width by a few rounds of k-means on directions."""
        sample = sample.sort_by("digest")
        width = sample["width"][0].as_py()
        x = _unit(_matrix(sample["vector"], width))
        n = min(cells_for[width], len(x))
        centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
        for _ in range(8 if n > 1 else 0):
            mine = np.concatenate([np.argmax(x[a: a + 4096] @ centres.T, 1) for a in range(0, len(x), 4096)])
            total = np.zeros_like(centres)
            np.add.at(total, mine, x)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(length > 1e-12, total / np.maximum(length, 1e-12), centres)
        return pa.table({"width": pa.array([width] * n, pa.int32()), "cell": pa.array(range(n), pa.int32()), "centre": pa.array([c.astype("<f8").tobytes() for c in centres], pa.binary())})

    return fit


def _cells(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The cells of the ``most`` nearest centres of each row, nearest first."""
    return np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")[:, :most]


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths).tolist():
        yield width, batch.filter(pa.array(widths == width))


def _assign(router: dict[int, np.ndarray], most: int, names: list[str]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _by_width(batch):
                cells = _cells(_matrix(part.column("vector"), width), router[width], most)
                row = np.repeat(np.arange(part.num_rows), cells.shape[1])
                part = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(cells.ravel(), pa.int32())], [*names, "cell"])

    return assign


def _trial(router: dict[int, np.ndarray], trials: dict[int, np.ndarray]):
    def trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest nodes of each trial query in this task: the rank of their cell among the query's cells, and the score."""
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for width, part in _by_width(batch):
                if width not in trials:
                    continue
                x, q = _matrix(part.column("vector"), width), trials[width]
                rank = np.argsort(_cells(q, router[width], len(router[width])), axis=1)
                score, cell = q @ x.T, np.broadcast_to(rank[:, _cells(x, router[width], 1)[:, 0]], (len(q), len(x)))
                if width in best:
                    score, cell = np.concatenate([best[width][0], score], 1), np.concatenate([best[width][1], cell], 1)
                top = np.argsort(-score, axis=1, kind="stable")[:, :K]
                best[width] = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        for width, (score, cell) in best.items():
            n = score.size
            query = np.repeat(np.arange(len(score)), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([width] * n, pa.int32()), pa.array(query, pa.int32()), pa.array(score.ravel()), pa.array(cell.ravel(), pa.int32())], ["width", "query", "score", "cell_rank"])

    return trial


SHARDS = pa.schema([("width", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("size", pa.int64()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))),
                    ("counts", pa.list_(pa.int32())), ("neighbours", pa.list_(pa.binary()))])
SHARDS_SQL = "width int, cell int, part int, size long, vectors binary, ids array<array<long>>, counts array<int>, neighbours array<binary>"


def _build(nodes: pa.Table) -> pa.Table:
    """One shard as one row of flat arrays."""
    width = nodes["width"][0].as_py()
    # the level of a node follows from its digest, so a shard that is built again is the same
    seeds = np.array([int.from_bytes(d[-8:], "little") + 1 for d in nodes["digest"].to_pylist()], np.float64) / 2.0 ** 64
    order = np.lexsort((nodes["digest"].to_numpy(zero_copy_only=False), seeds))
    nodes, seeds = nodes.take(pa.array(order)), seeds[order]
    x = _matrix(nodes["vector"], width)
    levels = build(lifted(x / np.abs(x).max()), seeds)
    row = {"width": width, "cell": nodes["cell"][0].as_py(), "part": nodes["part"][0].as_py(), "size": len(x), "vectors": x.tobytes(), "ids": nodes["ids"].to_pylist(),
           "counts": [len(x) for x in levels], "neighbours": [x.tobytes() for x in levels]}
    return pa.Table.from_pylist([row], schema=SHARDS)


FOUND = pa.schema([("digest", pa.binary()), ("width", pa.int32()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("same", pa.bool_())])))])
FOUND_SQL = "digest binary, width int, found array<struct<score:double,vec_id:long,same:boolean>>"


def _search(key, queries: pa.Table, shards: pa.Table) -> pa.Table:
    """One block of queries in one shard."""
    if not queries.num_rows or not shards.num_rows:
        return FOUND.empty_table()
    shard = {c: shards[c][0].as_py() for c in shards.column_names}
    width = shard["width"]
    x = np.frombuffer(shard["vectors"], "<f8").reshape(-1, width)
    y = lifted(x / np.abs(x).max())
    levels = [np.frombuffer(data, np.int32).reshape(n, -1) for n, data in zip(shard["counts"], shard["neighbours"])]
    out = []
    q_all = _matrix(queries["vector"], width)
    own = queries["digest"].to_pylist()
    for a in range(0, len(q_all), BATCH):
        q = q_all[a: a + BATCH]
        lifted_q = np.concatenate([_unit(q), np.zeros((len(q), 1))], 1).astype(np.float32)
        nodes, _ = search(y, levels[-1], lifted_q, descend(y, levels[:-1], lifted_q), SEARCH_BEAM)
        for i in range(len(q)):
            at = nodes[i][nodes[i] >= 0][: 2 * K + 2]  # single precision may swap close ones
            scores = exact(np.broadcast_to(q[i], (len(at), width)), x[at])
            best = sorted((-s, v, n) for s, n in zip(scores.tolist(), at.tolist()) for v in shard["ids"][n])[: K + 1]
            mine = q[i].tobytes()
            out.append({"digest": own[a + i], "width": width, "found": [{"score": -s, "vec_id": v, "same": x[n].tobytes() == mine} for s, v, n in best]})
    return pa.Table.from_pylist(out, schema=FOUND)


# --- the operator -----------------------------------------------------------------------------------


def nodes_of(valid: DataFrame) -> DataFrame:
    """(digest, width, vector, ids): distinct vectors with their ``K + 1`` smallest ids, first within salts, then over them."""
    salted = valid.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(partitions(valid.sparkSession))))
    least = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, K + 1).alias("ids")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("digest", "salt").orderBy("vec_id"))).filter(F.col("rank") <= K + 1)
    parts = ranked.groupBy("digest", "salt").agg(F.first("width").alias("width"), F.first("vector").alias("vector"), F.collect_list("vec_id").alias("ids"))
    return parts.groupBy("digest").agg(F.first("width").alias("width"), F.first("vector").alias("vector"), least)


def router_of(nodes: DataFrame) -> dict[int, np.ndarray]:
    """By width, the centres: as many as cells of ``SHARD`` nodes need, ``CELLS`` at most."""
    sizes = {r["width"]: r["n"] for r in nodes.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(CELLS).collect()}
    cells = {w: min(CELLS, -(-n // SHARD)) for w, n in sizes.items()}
    rate = {w: min(1.0, SAMPLE / n) for w, n in sizes.items()}
    # digests are even, so those below a bound are a sample of about SAMPLE nodes of each width
    bound = F.create_map(*[F.lit(v) for w, r in rate.items() for v in (w, r)])[F.col("width")] if rate else F.lit(0.0)
    even = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) / float(1 << 30)
    fitted = nodes.select("digest", "width", "vector").filter(even < bound).groupBy("width").applyInArrow(_fit(cells), "width int, cell int, centre binary")
    router: dict[int, list] = {}
    for r in fitted.orderBy("width", "cell").collect():
        router.setdefault(r["width"], []).append(np.frombuffer(r["centre"], "<f8"))
    return {w: np.stack(c) for w, c in router.items()}


def cells_to_visit(nodes: DataFrame, queries: DataFrame, router: dict[int, np.ndarray]) -> int:
    """The smallest number of cells that hold ``COVER`` of the true neighbours of the trial queries."""
    if all(len(c) == 1 for c in router.values()):
        return 1
    trials: dict[int, list] = {}
    for r in queries.orderBy(F.xxhash64("digest"), "digest").select("width", "vector").limit(TRIALS).collect():
        trials.setdefault(r["width"], []).append(np.frombuffer(r["vector"], "<f8"))
    tried = nodes.select("width", "vector").mapInArrow(_trial(router, {w: np.stack(q) for w, q in trials.items()}), "width int, query int, score double, cell_rank int")
    best = Window.partitionBy("width", "query").orderBy(F.desc("score"), "cell_rank")
    ranks = tried.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= K).groupBy("cell_rank").agg(F.count("*").alias("n")).orderBy("cell_rank").collect()
    total, reached = sum(r["n"] for r in ranks), 0
    for r in ranks:
        reached += r["n"]
        if reached >= COVER * total:
            return r["cell_rank"] + 1
    return 1


def index(nodes: DataFrame, router: dict[int, np.ndarray]) -> DataFrame:
    """One row for each shard: its vectors, ids and flat neighbour arrays."""
    placed = kept(nodes.sparkSession, nodes.mapInArrow(_assign(router, 1, ["digest", "width", "vector", "ids"]), f"{NODES_SQL}, cell int"), "placed")
    sizes = placed.groupBy("width", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    sharded = placed.join(sizes, ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")).drop("parts")
    return kept(nodes.sparkSession, sharded.groupBy("width", "cell", "part").applyInArrow(_build, SHARDS_SQL), "shards")


def searched(shards: DataFrame, queries: DataFrame, router: dict[int, np.ndarray], visits: int) -> DataFrame:
    """(digest, width, found): of each distinct query vector, the ``K + 1`` nearest rows of all the shards it visits."""
    sent = kept(queries.sparkSession, queries.select("digest", "width", "vector").mapInArrow(_assign(router, visits, ["digest", "width", "vector"]), "digest binary, width int, vector binary, cell int"), "sent")
    blocks = sent.groupBy("width", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    copies = shards.join(blocks, ["width", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    parts = shards.select("width", "cell", F.col("part").alias("of")).join(blocks, ["width", "cell"]).withColumnRenamed("of", "part")
    dealt = sent.join(parts, ["width", "cell"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).drop("blocks")
    key = ["width", "cell", "part", "block"]
    found = dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(_search, FOUND_SQL)
    order = F.transform(F.flatten(F.collect_list("found")), lambda f: F.struct((-f["score"]).alias("far"), f["vec_id"].alias("vec_id"), f["same"].alias("same"), f["score"].alias("score")))
    merged = found.groupBy("digest").agg(F.slice(F.array_sort(order), 1, K + 1).alias("found"))
    return merged


def neighbours(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` (``K`` at most) nearest rows found for each row that ``is_query`` picks by ``vec_id``.

    ``vectors(vec_id, embedding)``; every row but the query's own is a candidate.
    """
    spark = vectors.sparkSession
    valid = kept(spark, vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_valid, "vec_id long, digest binary, width int, vector binary"), "vectors")
    nodes = kept(spark, nodes_of(valid), "nodes")
    asked = valid.filter(is_query).select(F.col("vec_id").alias("query_id"), "digest", F.xxhash64("vec_id").alias("spread"))
    distinct = kept(spark, nodes.join(asked.select("digest").distinct(), "digest", "left_semi"), "queries")
    router = router_of(nodes)
    found = kept(spark, searched(index(nodes, router), distinct, router, cells_to_visit(nodes, distinct, router)), "found")
    # many rows may ask with one vector: its result goes to as many salts as there are partitions, where they have spread
    salts = partitions(spark)
    asked = asked.withColumn("salt", F.pmod("spread", F.lit(salts)))
    used = asked.select("digest", "salt").distinct()
    results = asked.join(used.join(found, "digest"), ["digest", "salt"])
    own = F.array_position(F.transform("found", lambda f: f["same"] & (f["vec_id"] == F.col("query_id"))), True)
    left = F.filter("found", lambda f, i: i + 1 != own)
    ranked = results.select("query_id", F.posexplode(F.slice(left, 1, k)).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def neighbour_rows(vectors: DataFrame) -> DataFrame:
    """The nearest rows of every row whose id ``EVERY`` divides."""
    return neighbours(vectors, F.col("vec_id") % EVERY == 0)
