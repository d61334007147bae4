"""Periodic runs, nearest neighbours and the dataset manifest, against plain Python."""

import collections
import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.llm import hnsw, merkle, runs

# --- periodic runs ---


def brute_runs(x):
    out = {}
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p), p)
            i = max(i + 1, j)
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_runs_of_random_sequences():
    rng = np.random.default_rng(3)
    large = 0
    for _ in range(1500):
        n = int(rng.integers(0, 350))
        x = rng.integers(0, int(rng.integers(1, 5)), n)
        for _ in range(int(rng.integers(0, 5)) if n > 8 else 0):
            at = int(rng.integers(0, n - 1))
            period = int(rng.integers(1, max(2, (n - at) // 4 + 2)))
            length = int(rng.integers(0, n - at + 1))
            x[at: at + length] = x[at + np.arange(length) % period]
            if length and rng.random() < 0.3:
                x[at + int(rng.integers(0, length))] = 9
        want = brute_runs(x.tolist())
        large += sum(p >= runs.SCALE for _, _, p in want)
        assert runs.runs_of(x) == want
    assert large > 100  # found through the synchronising sets


def test_positions_at_every_scale_are_dense_and_depend_on_their_context():
    name = np.random.default_rng(1).integers(0, 50, 4000).astype(np.uint64)
    for scale in (8, 16, 64):
        at = runs._selected(name, scale)
        assert np.diff(at).max() <= scale
        again = runs._selected(name[1000:3000], scale)
        inner = at[(at >= 1000) & (at < 3000 - scale)] - 1000
        assert (inner == again).all()


def test_run_rows(docs, documents):
    rng = np.random.default_rng(4)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (5, "x " * 5), (6, "x " * 6), (7, "a b c " * 4), (7, "a b c " * 4), (8, "a b c " * 3 + "a b"), (9, "ä ö " * 8)]
    rows += [(i, " ".join(rng.choice(["u", "v", "w"], int(rng.integers(0, 200))))) for i in range(100, 200)]
    rows += [(200, "y z " * 100_000), (201, ("w%d " * 700) % tuple(range(700)) * 30)]
    rows += [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    got = runs.run_rows(docs(rows[:-60]).union(documents.limit(60).select("doc_id", "text", "lang", "source", "n_chars"))).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_row(*r) for r in rows if r[0] not in (200, 201)) + collections.Counter(tuple(r) for r in got if r.doc_id in (200, 201))
    long = {r.doc_id: tuple(r)[1:5] for r in got if r.doc_id in (200, 201)}
    for i, n, p in ((200, 200_000, 2), (201, 21_000, 700)):
        assert zlib.crc32(str(i).encode()) % 10 and long[i] == (1, 0, n, p)
    assert runs.run_rows(docs([])).collect() == []


def test_collapse_keeps_other_texts(docs):
    clash = docs([(1, "a  b\n" * 4), (2, "say  it once"), (3, None)]).withColumn("runs", F.lit(1)).withColumn("start", F.lit(2))
    got = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in runs.collapse(clash).collect()}
    assert got == {1: ("a b", [(0, 8, 2)]), 2: ("say  it once", []), 3: (None, [])}


# --- nearest neighbours ---

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], VECTORS)


def product(a, b):
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist()):  # sum() would compensate
        total += x * y
    return total


def brute_near(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = collections.Counter()
    for a, (i, q) in enumerate(good):
        if i % hnsw.EVERY == 0:
            hits = sorted((-product(q, v), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(hits[: hnsw.K]))
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(size=8).tolist()
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(i, same) for i in range(60, 130)] + [(20, same), (20, same)]
    rows += [(i, rng.normal(size=4).tolist()) for i in range(130, 145)]  # another length, fewer than twenty
    rows += [(None, same), (200, None), (220, []), (240, [0.0] * 8), (260, [1.0] * 7 + [None]), (280, [float("nan")] + [1.0] * 7), (300, [float("inf")] + [1.0] * 7), (320, [-0.0] * 7 + [1.0]), (321, [0.0] * 7 + [1.0])]
    got = collections.Counter(map(tuple, hnsw.neighbour_rows(table(spark, rows)).collect()))
    assert got == brute_near(rows)
    assert hnsw.neighbour_rows(table(spark, [])).collect() == []


def test_recall_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 700)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([rng.normal(size=(1500, 32)), centres[rng.integers(0, 30, 1500)] + 0.1 * rng.normal(size=(1500, 32))]).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    got = hnsw.neighbour_rows(spark.createDataFrame([(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)], VECTORS)).toPandas()
    x = x.astype(float)
    hits = 0
    for i in range(0, 3000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        mine = got[got.query_id == i].sort_values("rank")
        assert len(mine) == 20 and (np.diff(mine.score) <= 0).all()
        assert np.allclose(mine.score, s[mine.vec_id])
        hits += len(set(np.argsort(-s)[:20]) & set(mine.vec_id))
    assert hits / 3000 > 0.9


def test_graph_is_navigable():
    rng = np.random.default_rng(7)
    x = hnsw.lifted(rng.normal(size=(3000, 24)))
    levels = hnsw.build(x, np.sort(1 - rng.random(3000)))
    assert [len(n) for n in levels] == sorted(len(n) for n in levels) and len(levels) > 1
    q = np.concatenate([hnsw._unit(rng.normal(size=(100, 24))), np.zeros((100, 1))], 1).astype(np.float32)
    nodes, near = hnsw.search(x, levels[-1], q, hnsw.descend(x, levels[:-1], q), hnsw.SEARCH_BEAM)
    assert all(len(set(r)) == len(r) for r in nodes.tolist())
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b[:20])) / 20 for a, b in zip(want, nodes)]) > 0.95
    assert all((n < len(n)).all() for n in levels)


# --- the manifest ---


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def put(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    out = []
    for nodes in levels[:-1]:
        out.append((at % 3, nodes[at - at % 3: at - at % 3 + 3]))
        at //= 3
    return out


def brute_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, digest(*[put(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")])), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([k[2] for k, _ in sorted(by[s], key=lambda x: x[0])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for at, (k, r) in enumerate(sorted(by[s], key=lambda x: x[0])):
            path = way(trees[s], at) + way(top, place)
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = digest(*[put(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])
            for i, run in path:
                node = digest(*run[:i], node, *run[i + 1:])
            out.append((r["doc_id"], k[2], trees[s][-1][0], top[-1][0], digest(*[x for i, run in path for j, x in enumerate(run) if j != i]), node, node == top[-1][0]))
    return collections.Counter(out)


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest_equals_brute_force(documents, height):
    got = merkle.versions(documents, merkle.without_lines(documents), height).drop("copied").collect()
    assert collections.Counter(map(tuple, got)) == brute_manifest([r.asDict() for r in documents.collect()])
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_manifest_of_odd_rows(docs):
    rows = [(1, "a\nb", None), (2, None, None), (None, "x\n", "s"), (3, "", "s"), (4, "t\n\n", "s"), (4, "t\n\n", "s"), (4, "other\n", "s"), (5, "é\n" * 5, "ü"), (6, "w\n" * 300_000, "ü"), (7, "only", ""), (8, None, "9")]
    df = docs(rows).withColumn("at", F.lit(1)).withColumn("tree", F.lit("t")).withColumn("altered", F.lit("z"))
    want = brute_manifest([r.asDict() for r in df.collect()])
    for height in (1, 8):
        got = merkle.versions(df, merkle.without_lines(df), height).drop("copied").collect()
        assert collections.Counter(map(tuple, got)) == want
    assert merkle.manifest_rows(docs([])).collect() == []
    (one,) = merkle.manifest_rows(docs([(9, "alone")])).collect()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == digest()


def test_versions_copy_ancestors_only(docs):
    df = docs([(i, f"text {i}", "s%d" % (i % 4)) for i in range(200)])
    changed = F.when(F.col("doc_id") == 77, F.lit("forged")).otherwise(F.col("text"))
    rows = merkle.versions(df, changed, 2).collect()
    (bad,) = [r for r in rows if not r.verified]
    assert bad.doc_id == 77 and all(r.copied == [] for r in rows if r.verified)
    # 50 leaves of a source: four levels above them, then two above four subroots
    assert [c.level for c in bad.copied] == [1, 2, 3, 4, 5, 6] and bad.copied[-1].digest == bad.folded_root
