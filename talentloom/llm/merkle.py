"""A manifest of a table as a persistent Merkle tree, whose versions copy only the ancestors of the leaf that changed.

Every row is a leaf: the sha256 of its fields. In each source leaves ascend by doc_id; while several nodes remain, every
``FAN`` consecutive ones (the last run may be shorter, even one) become the sha256 of their hex digests. What remains is
the source's subroot; the subroots in order of source make the root in the same way.

1. Leaves are numbered within their source from a range-sorted table and the counts of its partitions.
2. Blocks of ``FAN ** height`` aligned leaves are built each in a task and stored as flat node arrays (version 0). Their tops
   are the leaves of the next layer of blocks, until every source has one block left; the same goes for the subroots. A source
   of any size is dealt over its blocks, and a task holds one block.
3. Every node of an upper layer tells the blocks below it its siblings, so each lowest block gets one short path to the root.
4. A tampered leaf is a version of its own: it shares every node with version 0 but its ancestors, which are copied with the
   new digest, first within the stored block, then along the path. ``versions`` lists the copied nodes.

Defined cases: a null field is hashed as ``-``; a null source is a source of its own, before all others; a null doc_id comes first in its
source and is never tampered with; rows with one doc_id are ordered by their leaves, and rows alike in all fields stand
next to each other; a text of any length is hashed whole; an only leaf is its own subroot, and an only subroot the root; an empty table gives an empty table; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.llm.common import kept, partitions

FAN, HEIGHT = 3, 8
_HEX = 64


def field(value: Column) -> Column:
    """A value with its length in front, so that fields cannot run into each other."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def without_lines(docs: DataFrame) -> Column:
    """The text that tampering leaves: without line feeds where 2 divides the checksum of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.translate("text", "\n", "")).otherwise(F.col("text"))


# --- tasks ----------------------------------------------------------------------------------------


def _digest(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def _levels(leaves: list[bytes], whole: bool, height: int) -> list[list[bytes]]:
    """All levels above and with ``leaves``: until one node remains, or ``height`` levels in a part of a larger tree."""
    levels = [leaves]
    while len(levels) <= height and (not whole or len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([_digest(last[i: i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def _path(levels: list[list[bytes]], at: int) -> list[tuple[int, list[bytes]]]:
    """For each level below the top, the node's place in its run and the run."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % FAN
        out.append((at - first, nodes[first: first + FAN]))
        at //= FAN
    return out


def _split(data: bytes) -> list[bytes]:
    return [data[i: i + _HEX] for i in range(0, len(data), _HEX)]


BLOCKS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("parts", pa.int64()), ("nodes", pa.list_(pa.binary())), ("rows", pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("altered", pa.string())]))), ("top", pa.string())])
BLOCKS_SQL = "tree string, block long, parts long, nodes array<binary>, rows array<struct<doc_id:long,at:long,altered:string>>, top string"


def _build(height: int):
    def build(leaves: pa.Table) -> pa.Table:
        """One block: its node levels, and its rows (of lowest blocks) in order."""
        leaves = leaves.sort_by("at")
        parts = leaves["parts"][0].as_py()
        levels = _levels([x.encode() for x in leaves["digest"].to_pylist()], parts == 1, height)
        rows = leaves.select(["doc_id", "at", "altered"]).to_pylist() if "doc_id" in leaves.column_names else []
        block = {"tree": leaves["tree"][0].as_py(), "block": leaves["at"][0].as_py() // FAN ** height, "parts": parts, "nodes": [b"".join(x) for x in levels], "rows": rows, "top": levels[-1][0].decode()}
        return pa.Table.from_pylist([block], schema=BLOCKS)

    return build


STEP = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.list_(pa.string()))]))
STEP_SQL = "array<struct<place:int,run:array<string>>>"


def _paths(height: int):
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every leaf of an upper block: the path through that block."""
        for batch in batches:
            for row in batch.to_pylist():
                levels = [_split(x) for x in row["nodes"]]
                found = [[{"place": p, "run": [x.decode() for x in run]} for p, run in _path(levels, i)] for i in range(len(levels[0]))]
                first = row["block"] * FAN ** height
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(found), pa.string()), pa.array(range(first, first + len(found)), pa.int64()), pa.array(found, STEP)], ["tree", "at", "path"])

    return paths


VERSIONS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
                      ("copied", pa.list_(pa.struct([("level", pa.int32()), ("digest", pa.string())])))])
VERSIONS_SQL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<struct<level:int,digest:string>>"


def _fold(height: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row of a block with its proof and the root of its version."""
        for batch in batches:
            for row in batch.to_pylist():
                levels = [_split(x) for x in row["nodes"]]
                upper = [(s["place"], [x.encode() for x in s["run"]]) for s in row["path"] or []]
                above = [x for place, run in upper for i, x in enumerate(run) if i != place]
                out = []
                for leaf in row["rows"]:
                    at = leaf["at"] - row["block"] * FAN ** height
                    node = (leaf["altered"] or "").encode() or levels[0][at]
                    below, copied = [], []
                    path = _path(levels, at)
                    for place, run in path:
                        below += run[:place] + run[place + 1:]
                    for place, run in path + upper:
                        node = _digest([*run[:place], node, *run[place + 1:]])
                        copied.append(node)
                    folded, mine = node.decode(), levels[0][at].decode()
                    out.append((leaf["doc_id"], mine, row["subroot"], row["root"], hashlib.sha256(b"".join(below + above)).hexdigest(), folded, folded == row["root"],
                                [{"level": i + 1, "digest": x.decode()} for i, x in enumerate(copied)] if leaf["altered"] else []))
                    if len(out) == 2048:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return fold


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), VERSIONS)], schema=VERSIONS)


# --- the operator -----------------------------------------------------------------------------------


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, their number within ``tree`` by ``order``, and ``size``, the rows of the tree."""
    placed = rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    placed = kept(rows.sparkSession, placed.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), name)
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    tree = Window.partitionBy("tree")
    starts = counts.select("tree", "part", (F.sum("n").over(tree.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return placed.join(starts, ["tree", "part"]).withColumn("at", F.col("line") + F.col("shift")).drop("part", "line", "shift")


def _layers(leaves: DataFrame, name: str, height: int) -> list[DataFrame]:
    """Tables of blocks, lowest first, of the trees with ``leaves(tree, at, size, digest, ...)``; the last has one block a tree."""
    layers = []
    while True:
        sized = leaves.withColumns({"block": F.floor(F.col("at") / FAN ** height), "parts": F.ceil(F.col("size") / FAN ** height)}).drop("size")
        layers.append(kept(leaves.sparkSession, sized.groupBy("tree", "block").applyInArrow(_build(height), BLOCKS_SQL), name))
        if layers[-1].filter("parts > 1").isEmpty():
            return layers
        leaves = layers[-1].select("tree", F.col("block").alias("at"), F.col("parts").alias("size"), F.col("top").alias("digest"))


def _to_top(layers: list[DataFrame], height: int) -> DataFrame:
    """(tree, block, path): of every lowest block, the path through all layers above it."""
    paths = layers[0].select("tree", "block", F.col("block").alias("at"), F.array().cast(STEP_SQL).alias("path"))
    for upper in layers[1:]:
        step = upper.select("tree", "block", "nodes").mapInArrow(_paths(height), f"tree string, at long, path {STEP_SQL}").withColumnRenamed("path", "step")
        paths = paths.join(step, ["tree", "at"]).select("tree", "block", F.floor(F.col("at") / FAN ** height).alias("at"), F.concat("path", "step").alias("path"))
    return paths.drop("at")


def versions(docs: DataFrame, altered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copied): one row for each row of ``docs``.

    ``altered`` is the text as it is found now (by default the text itself); where it differs, the row's version copies its ancestors,
    which ``copied`` lists from the leaf's parent to the version's root, ``folded_root``.
    """
    spark = docs.sparkSession
    facts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    now = leaf_of(*facts, F.col("altered_text"))
    texts = docs.select(*facts, "text", (F.col("text") if altered is None else altered).alias("altered_text"))
    leaves = texts.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(*facts, F.col("text")).alias("digest"),
                          F.when(~F.col("altered_text").eqNullSafe(F.col("text")), now).alias("altered"), F.monotonically_increasing_id().alias("row"))
    leaves = kept(spark, leaves, "leaves")
    layers = _layers(_numbered(leaves, ["doc_id", "digest", "row"], "placed").drop("row"), "blocks", height)
    paths = _to_top(layers, height)

    # the subroots, in the order of their sources, are the leaves of one more tree
    subroots = layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest"))
    numbered = kept(spark, _numbered(subroots, ["of"], "subroots"), "subroots")
    forest = _layers(numbered.drop("of"), "forest", height)
    top = forest[-1].select("top").first()
    lowest = forest[0].select("tree", "block", "nodes").mapInArrow(_paths(height), f"tree string, at long, path {STEP_SQL}").withColumnRenamed("path", "step")
    beyond = lowest.withColumn("block", F.floor(F.col("at") / FAN ** height)).join(_to_top(forest, height), ["tree", "block"]).select("tree", "at", F.concat("step", "path").alias("rest"))
    ends = numbered.join(beyond, ["tree", "at"]).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "rest")
    paths = paths.join(ends, "tree").select("tree", "block", "subroot", F.lit(top["top"] if top else None).alias("root"), F.concat("path", "rest").alias("path"))
    whole = layers[0].select("tree", "block", "nodes", "rows").join(paths, ["tree", "block"])
    return whole.mapInArrow(_fold(height), VERSIONS_SQL)


def manifest_rows(docs: DataFrame) -> DataFrame:
    """Every row with its leaf, subroot, root and proof, and the root of the version in which its line feeds are gone."""
    return versions(docs, without_lines(docs)).drop("copied")


#: The checksum bit by bit, and the tree level by level; every proof and every fold is made from the whole list of nodes.
ORACLE = """
WITH RECURSIVE facts AS (
  SELECT doc_id, source, lang, n_chars, text,
    list_reduce([4294967295::BIGINT] || list_transform(range(0, 8 * length(doc_id::VARCHAR)),
      lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT ELSE 0::BIGINT END),
      lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))) AS state
  FROM documents),
hashed AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    CASE WHEN doc_id IS NOT NULL AND xor(state, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered
  FROM facts),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS altered
  FROM hashed),
placed AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
nodes AS (
  SELECT source, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3),
subroots AS (
  SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
forest AS (
  SELECT 0 AS level, place AS pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM forest WHERE n > 1 GROUP BY level, pos // 3),
root AS (SELECT digest AS root, level AS height FROM forest WHERE n = 1),
way AS (
  SELECT p.rid, p.source, k.k AS step, s.height, CASE WHEN k.k < s.height THEN p.pos // (3 ** k.k)::BIGINT ELSE s.place // (3 ** (k.k - s.height))::BIGINT END AS own
  FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source, root r, (SELECT unnest(range(0, 80)) AS k) k WHERE k.k < s.height + r.height),
steps AS (
  SELECT w.rid, w.step,
    coalesce(string_agg(coalesce(u.digest, f.digest), '' ORDER BY coalesce(u.pos, f.pos)) FILTER (coalesce(u.pos, f.pos) < w.own), '') AS before,
    coalesce(string_agg(coalesce(u.digest, f.digest), '' ORDER BY coalesce(u.pos, f.pos)) FILTER (coalesce(u.pos, f.pos) > w.own), '') AS behind
  FROM way w LEFT JOIN nodes u ON u.source IS NOT DISTINCT FROM w.source AND u.level = w.step AND w.step < w.height AND u.pos // 3 = w.own // 3
    LEFT JOIN forest f ON f.level = w.step - w.height AND f.pos // 3 = w.own // 3
  GROUP BY w.rid, w.step),
proofs AS (SELECT rid, string_agg(before || behind, '' ORDER BY step) AS proof FROM steps GROUP BY rid),
folds AS (
  SELECT rid, 0::BIGINT AS step, altered AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(s.before || f.digest || s.behind) FROM folds f JOIN steps s ON s.rid = f.rid AND s.step = f.step),
ends AS (SELECT rid, arg_max(digest, step) AS folded_root FROM folds GROUP BY rid)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(q.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN ends e USING (rid) LEFT JOIN proofs q USING (rid), root r
"""
