"""Repeated phrases and strings, near-duplicates and the pipeline, against plain Python."""

import bisect
import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from talentloom.llm import near_dedup, phrases, suffixes
from talentloom.llm.common import pick_rows
from talentloom.llm.repeats import Fragment


def brute_words(rows):
    docs = sorted((((i is None, i or 0), (t or "").encode().split()) for i, t in rows), key=lambda r: r[0])
    first = {}
    for i, w in docs:
        for s in range(len(w) - 19):
            k = tuple(w[s:s + 20])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s:s + 20])] < (i, s):
                gone[s:s + 20] = [True] * 20
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((None if i[0] else i[1], len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return collections.Counter(out)


def brute_bytes(rows):
    docs = [((i is None, i or 0), (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in docs:
        for s in range(len(b) - 49):
            first[b[s:s + 50]] = min(first.get(b[s:s + 50], i), i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < i:
                gone[s:s + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((None if i[0] else i[1], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return collections.Counter(out)


def passages(seed, n, letters=None):
    """Texts that share passages, repeat within themselves, or consist of few words."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" for i in range(300)] if letters is None else letters
    shared = [" ".join(rng.choice(vocabulary, int(rng.integers(15, 60)))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 40)))) if rng.random() < 0.5 else shared[int(rng.integers(0, 6))] for _ in range(int(rng.integers(0, 6)))]
        rows.append((int(rng.integers(0, 10**6)), (" \n"[int(rng.integers(0, 2))]).join(parts)))
    return rows


CASES = {
    "passages": passages(1, 120), "two words": passages(2, 60, ["a", "b"]), "one word": [(i, "na " * (15 + i)) for i in range(20)],
    "copies": [(i % 7, "one two three four five six seven eight nine ten " * 3) for i in range(14)],
    "odd": [(1, None), (2, ""), (3, " \t\n"), (None, " ".join(f"u{i}" for i in range(50))), (4, " ".join(f"u{i}" for i in range(60))), (5, "x" * 5000), (6, "y" + "x" * 5000), (7, "é" * 200), (8, "ü" + "é" * 200)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_phrases_equal_brute_force(docs, case):
    got = phrases.phrase_rows(docs(CASES[case])).collect()
    assert collections.Counter(map(tuple, got)) == brute_words(CASES[case])


@pytest.mark.parametrize("case", CASES)
def test_strings_equal_brute_force(docs, case):
    got = suffixes.suffix_rows(docs(CASES[case])).collect()
    assert collections.Counter(map(tuple, got)) == brute_bytes(CASES[case])


def test_whole_small_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert collections.Counter(map(tuple, phrases.phrase_rows(documents).collect())) == brute_words(rows)
    assert collections.Counter(map(tuple, suffixes.suffix_rows(documents).collect())) == brute_bytes(rows)


def test_cleaned_texts(docs):
    line = " ".join(f"k{i}" for i in range(25))
    got = {r.doc_id: (r.text, [tuple(s) for s in r.spans]) for r in phrases.cleaned(docs([(1, line), (2, "before " + line + " after")])).collect()}
    assert got == {1: (line, []), 2: ("before after", [(1, 26)])}


def test_suffix_order():
    rng = np.random.default_rng(7)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 30, 31, 32, 500]:
        for k in (1, 2, 5, 300):
            x = rng.integers(1, k + 1, n)
            assert suffixes.suffix_order(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_frequent_anchors_go_window_by_window(docs, monkeypatch):
    """The same fragments, whole or one window each, give the same marks."""
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("ab"), 400)).encode()
    whole = [Fragment(text[s:s + 60], d, s, 11) for d in range(3) for s in range(0, 300, 11)]
    split = [Fragment(f.content[j:j + 50], f.doc, f.start + j, 1) for f in whole for j in range(f.windows)]
    assert np.concatenate(suffixes.judge(whole)).tolist() == np.concatenate(suffixes.judge(split)).tolist()


def test_only_shared_strings_are_put_in_order(monkeypatch):
    """Fragments that share an anchor but no string of 50 bytes stay out of the suffix order; those that share one are judged as by brute force."""
    rng = np.random.default_rng(11)
    word = lambda n: bytes(rng.integers(97, 123, n).tolist())
    alone = [Fragment(word(30) + b"a common anchor." + word(30), d, 0, 27) for d in range(40)]
    line = word(70)
    met = [Fragment(word(9) + line[:60], 5, 0, 20), Fragment(line, 3, 0, 21), Fragment(line, 9, 0, 21), Fragment(line[5:] + word(4), 7, 0, 20), Fragment(b"z" * 60, 8, 0, 11)]
    sizes, order = [], suffixes.suffix_order
    monkeypatch.setattr(suffixes, "suffix_order", lambda text: sizes.append(len(text)) or order(text))
    assert not np.concatenate(suffixes.judge([*alone, alone[0], met[4]])).any() and not sizes
    fragments = [*alone[:20], *met, *alone[20:]]
    got = suffixes.judge(fragments)
    first: dict[bytes, int] = {}
    for f in fragments:
        for k in range(f.windows):
            s = f.content[k:k + 50]
            first[s] = min(first.get(s, f.doc), f.doc)
    assert [x.tolist() for x in got] == [[first[f.content[k:k + 50]] < f.doc for k in range(f.windows)] for f in fragments]
    assert max(sizes) == 69 + 70 + 69 + 2  # three distinct fragments and what closes them


# --- near-duplicates ---


def brute_similar(a, b):
    """Aligned similarity of two lists of labelled shingles, written from the definition."""
    at = {s: i for i, s in enumerate(b)}
    tails = []
    for x in (at[s] for s in a if s in at):
        k = bisect.bisect_left(tails, x)
        tails[k:k + 1] = [x]
    return len(tails) / (len(a) + len(b) - len(tails))


def brute_shingles(words):
    seen, out = collections.Counter(), []
    for i in range(max(1, len(words) - 4) if words else 0):
        s = tuple(words[i:i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def brute_classes(rows):
    by = {}
    for i, t in rows:
        by.setdefault(tuple((t or "").encode().split()), []).append(i)
    nodes = [brute_shingles(list(w)) for w in by]
    sets = [set(n) for n in nodes]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and find(a) != find(b) and both >= 0.8 * (len(nodes[a]) + len(nodes[b]) - both) - 1e-9 and brute_similar(nodes[a], nodes[b]) >= 0.8 - 1e-12:
                root[find(a)] = find(b)
    classes = {}
    for k, ids in enumerate(by.values()):
        classes.setdefault(find(k), []).extend(ids)
    return {i: min(c) for c in classes.values() for i in c}


def family(rng, base, n, first):
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 8))):
            w[int(rng.integers(0, len(w)))] = f"edit{int(rng.integers(0, 10**6))}"
        rows.append((first + k, " ".join(w)))
    return rows


def test_classes_equal_brute_force(docs):
    rng = np.random.default_rng(11)
    rows = []
    for f in range(4):
        rows += family(rng, [f"f{f}w{i}" for i in range([30, 120, 250, 600][f])], 40, 1000 * f)
    rows += [(9000 + i, f"single text number {i} " + " ".join(f"s{i}_{k}" for k in range(60))) for i in range(30)]
    rows += [(9100 + i, " ".join(f"t{k}" for k in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 10, 24, 29, 31, 33, 40])]
    rows += [(20_001, "f0w0"), (20_002, None), (20_003, ""), (20_004, " \n")]
    want = brute_classes(rows)
    got = near_dedup.class_rows(docs(rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    size = collections.Counter(want.values())
    assert all(r.class_size == size[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)
    left = near_dedup.survivors(docs(rows).withColumnRenamed("lang", "node"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(size) and "node" in left.columns


def test_a_large_family_around_the_threshold(docs):
    """Most pairs of the family share sketches, many are just above or just below the threshold."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(500):
        w = list(base)
        for i in rng.choice(150, int(rng.integers(0, 7)), replace=False):
            w[i] = f"x{int(rng.integers(0, 40))}"
        rows.append((k, " ".join(w)))
    want = brute_classes(rows)
    assert 2 < len(set(want.values())) < 450
    assert {r.doc_id: r.class_id for r in near_dedup.class_rows(docs(rows)).collect()} == want


def test_nodes_leave_buckets_where_no_other_component_is_in_reach(docs, monkeypatch):
    """Two families share a passage and so buckets, but no text of one is long enough for a link to the other."""
    rng = np.random.default_rng(14)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for first, words in ((0, base), (1000, base + [f"more{i}" for i in range(80)])):
        for k in range(60):
            w = list(words)
            for i in rng.choice(200, 2, replace=False):  # never so many that a family does not hang together at once
                w[i] = f"edit{first + k}"
            rows.append((first + k, " ".join(w)))
    open_rows, write = [], near_dedup.kept

    def record(spark, df, name):
        out = write(spark, df, name)
        if name == "alive":
            open_rows.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "kept", record)
    assert {r.doc_id: r.class_id for r in near_dedup.class_rows(docs(rows)).collect()} == brute_classes(rows)
    assert len(open_rows) == 2 and open_rows[-1] == 0  # two rounds join what hangs together, a third one went through the buckets of both before


def test_a_row_stays_open_for_the_second_best_component(spark):
    """Bucket 1: each of two components is in reach of the other; 2: one component; 3: a third one too far; 4: what is in reach lies in the own component."""
    rows = [(1, 1, 100, 95, 1), (1, 2, 100, 100, 2), (2, 3, 100, 100, 3), (2, 4, 90, 90, 3), (3, 5, 100, 100, 5), (3, 6, 100, 100, 6), (3, 7, 200, 200, 7),
            (4, 8, 100, 100, 8), (4, 9, 100, 100, 8), (4, 10, 126, 126, 10), (4, 11, 125, 125, 11)]
    got = near_dedup._still_open(spark.createDataFrame(rows, "bucket long, node long, n long, common long, comp long"))
    assert got.columns == ["bucket", "node", "n", "common", "comp"]
    assert sorted(r.node for r in got.collect()) == [1, 2, 5, 6, 8, 9, 10, 11]


def test_similarity_keeps_the_order():
    words = [f"a{i}".encode() for i in range(100)]
    a, b = near_dedup.shingles(words), near_dedup.shingles(words[50:] + words[:50])
    assert near_dedup.compared(a, a) == (True, 1.0)
    moved = near_dedup.compared(a, b)
    assert moved[0] is False and moved[1] > 0.9
    assert near_dedup.compared(a, near_dedup.shingles(words[:-1] + [b"x"]))[0] is True


def test_near_repeated_rows_null_ids_and_empty(docs):
    assert near_dedup.class_rows(docs([])).count() == 0
    text = " ".join(f"q{i}" for i in range(50))
    rows = [(5, text), (5, text), (5, "other"), (None, text + " end"), (4, text + " end")]
    got = near_dedup.class_rows(docs(rows)).collect()
    assert sum(r.kept for r in got) == 2 and sorted(r.class_size for r in got) == [1, 4, 4, 4, 4]
    assert sorted((r.doc_id, r.text) for r in near_dedup.survivors(docs(rows)).collect()) == [(4, text + " end"), (5, "other")]


# --- pipeline ---


def test_pipeline_stage_by_stage(spark, documents, folder):
    rows, seen = documents, [documents]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder).cache()
        assert rows.columns == documents.columns and rows.dtypes == documents.dtypes, name
        seen.append(rows)
    start, good, exact, near, mix = ([(r.doc_id, r.text) for r in x.collect()] for x in seen)
    assert set(good) <= set(start) and len(good) > 0.5 * len(start)
    last = {}
    for i, t in good:
        last[t.encode().lower()] = max(i, last.get(t.encode().lower(), i))
    assert sorted(i for i, _ in exact) == sorted(last.values())
    assert sorted(i for i, _ in near) == sorted(set(brute_classes(exact).values()))
    assert set(mix) <= set(near)  # whole documents only
    size = {i: len(t.encode().split()) for i, t in near}
    assert abs(sum(size[i] for i, _ in mix) - sum(size.values())) <= len({r.source for r in seen[3].collect()}) * (max(size.values()) / 2 + 1)
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], folder).collect()
    assert len({(p.sequence_id, p.offset) for p in packed}) == len(packed)
    assert sum(p.start == 0 for p in packed) == len(mix)


def test_run_gives_the_packed_mix(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.filter("length(ids) != 4 * length").count() == 0 and got.count() > 0


# --- texts found again by their ids ---


def no_digest(text):
    @F.arrow_udf("binary")
    def digests(texts):
        raise ValueError("a digest was taken")

    return digests(text)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_texts_of_single_ids_need_no_digest(spark, docs, broadcast):
    rows = docs([(i, f"text {i} " * 30) for i in range(50)])
    decided = near_dedup.kept(spark, rows.select("doc_id", (F.col("doc_id") % 2 == 0).alias("kept"), F.col("text").cast("binary").alias("digest")), "decided")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        left = pick_rows(rows, decided, no_digest)
        assert sorted(r.doc_id for r in left.collect()) == list(range(0, 50, 2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_of_nodes_are_compared_by_words_after_their_ids(spark, docs):
    table = docs([(1, "a b"), (2, "c"), (2, "d"), (2, "d "), (None, "e")]).select("doc_id", "text")
    rows = spark.createDataFrame([(10, 10, 1, near_dedup.word_print([b"a", b"b"])), (11, 11, 2, near_dedup.word_print([b"c"])), (12, 12, 2, near_dedup.word_print([b"d"])),
                                  (13, 12, 2, near_dedup.word_print([b"d"])), (14, 14, None, near_dedup.word_print([b"e"]))], "row long, node long, doc_id long, print binary")
    found = near_dedup._texts_of(table, rows, rows.select("node").distinct())
    assert sorted((r.node, r.text.strip()) for r in found.collect()) == [(10, "a b"), (11, "c"), (12, "d"), (14, "e")]
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
