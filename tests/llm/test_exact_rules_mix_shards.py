"""Operators with a check query: exact dedup, quality rules, mixing, sharding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.llm import exact_dedup, mixing, quality_rules, sharding
from talentloom.llm.queries import CHECKS, QUERIES

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a a a a"), (5, "x " * 3000), (6, "Äß ÄSS"), (6, "Äß ÄSS"), (None, "no id"), (7, "w" * 50_000)]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_check(spark, folder, oracle, name):
    got = QUERIES[name](spark, folder).toPandas()
    want = oracle(CHECKS[name]).df()[list(got.columns)]
    key = [c for c in got.columns if got[c].dtype != float]
    got, want = (d.sort_values(key).reset_index(drop=True) for d in (got, want))
    for c in got.columns:
        assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c


# --- exact dedup ---


def test_rice_round_trip():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 100, 5000):
        values = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(values)) == values).all()
    dense = np.arange(7, 300, dtype=np.uint64)
    assert (exact_dedup.rice_decode(exact_dedup.rice_encode(dense)) == dense).all()
    assert len(exact_dedup.rice_encode(np.unique(rng.integers(0, 1 << 40, 10_000, dtype=np.uint64)))) < 10_000 * 8 * 0.55


def test_exact_groups(docs):
    rows = [(1, "Same TEXT"), (9, "same text"), (4, "SAME text"), (2, "Éa"), (3, "éa"), (5, None), (6, ""), (7, "alone")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decision_rows(docs(rows)).collect()}
    assert got == {1: (9, 3, False), 9: (9, 3, True), 4: (9, 3, False), 2: (2, 1, True), 3: (3, 1, True), 5: (6, 2, False), 6: (6, 2, True), 7: (7, 1, True)}


def test_exact_repeated_rows_and_null_ids(docs):
    rows = [(3, "a"), (3, "A"), (3, "b"), (None, "a"), (None, None), (1, "b")]
    got = exact_dedup.decision_rows(docs(rows)).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3
    assert {(r.keep_id, r.group_size) for r in got} == {(3, 3), (3, 2), (None, 1)}
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in exact_dedup.survivors(docs(rows)).collect())
    assert left == [(False, 3, "A"), (False, 3, "b"), (True, 0, "")]


def test_exact_hot_group_and_extra_columns(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit(1).alias("salt"), F.lit(2).alias("kept"), F.lit(3).alias("sha"))
    left = exact_dedup.survivors(df)
    assert left.columns == df.columns and left.count() == 2001
    assert left.filter("text = 'HOT'").first().doc_id == 2997


@pytest.mark.parametrize("f", [exact_dedup.decision_rows, exact_dedup.survivors, quality_rules.judged_rows, quality_rules.kept_rows, mixing.mix_rows, mixing.mixed, sharding.shard_rows])
def test_empty_and_odd_tables(docs, f):
    assert f(docs([])).count() == 0
    f(docs(ODD)).collect()


# --- quality rules ---


def brute_repeats(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})


def test_repeated_windows(docs):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(list("abc"), n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 4, 4, 5, 5])]
    rows += [(90, "a a a a"), (91, "a a a"), (92, "a b a b a")]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judged_rows(docs(rows)).collect()}
    assert got == {i: brute_repeats(t) for i, t in rows}


def test_rules_keep_prose_and_drop_junk(docs):
    prose = " ".join(f"the w{i} of w{i * 7} and" for i in range(40))
    rows = [(1, prose), (2, "short"), (3, prose.replace(" ", "### ")), (4, "same line here\n" * 60), (5, " ".join(f"x{i}" for i in range(300))), (6, None)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judged_rows(docs(rows)).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, False), 4: (True, False), 5: (False, False), 6: (True, False)}
    assert [r.doc_id for r in quality_rules.kept_rows(docs(rows)).collect()] == [1]


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "the cat", "mine", "words")], "doc_id long, text string, n_words string, words_ string")
    out, flag = quality_rules.judged(df)
    assert out.columns == [*df.columns, flag] and out.first().n_words == "mine"


# --- mixing ---


def test_targets_stop_at_three_times_the_source(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0), (None, 500)], "source string, size long")
    t = {r.source: r for r in mixing.targets(rows).collect()}
    assert t["a"].target == 30 and t["c"].target == 0 and abs(sum(r.target for r in t.values()) - 1510) < 1e-6
    assert abs(t["b"].target / t[None].target - 2) < 1e-9  # weights 2 (b) and 1 (null, fourth)


def test_mix_takes_its_targets_and_repeats(docs):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", None, "d"][min(3, int(rng.integers(0, 9)))]) for i in range(400)]
    got = mixing.mix_rows(docs(rows)).collect()
    assert sorted(got) == sorted(mixing.mix_rows(docs(rows)).collect())
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1 and sum(r.size for r in rs) == rs[0].source_size
    mix = mixing.mixed(docs(rows)).collect()
    text = {i: t for i, t, _ in rows}
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in mix)  # nothing is cut
    times = {i: sum(r.doc_id == i for r in mix) for i in text}
    for source, rs in by.items():
        assert all(times[r.doc_id] in (r.taken // r.size, -(-r.taken // r.size)) for r in rs if r.size)
        assert abs(sum(r.size * times[r.doc_id] for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1, source


def test_mix_with_repeated_rows(docs):
    rows = [(1, "a b c d", "s")] * 5 + [(2, "e f", "t")] * 3 + [(3, "long " * 40, "u")]
    d = docs(rows)
    target = {r.source: r.target for r in mixing.mix_rows(d).collect()}
    for source, half in (("s", 2), ("t", 1), ("u", 20)):
        assert abs(sum(len(r.text.split()) for r in mixing.mixed(d).collect() if r.source == source) - target[source]) <= half + 1
    clash = d.withColumn("row_", F.lit(1)).withColumn("times", F.lit(2)).withColumn("part", F.lit(3))
    assert mixing.mixed(clash).columns == clash.columns


# --- sharding ---


def test_shards_fit_and_only_large_ones_split(docs):
    rng = np.random.default_rng(2)
    rows = [(i, "x" * int(rng.integers(0, 400))) for i in range(2000)] + [(5000, "y" * 30_000)]
    got = sharding.shard_rows(docs(rows), limit=10_000).collect()
    assert len(got) == 2001
    size, bits = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        bits.setdefault(r.shard, 0)
        bits[r.shard] += 1
        assert len(r.shard) == r.depth
    for r in got:
        assert r.shard_bytes == size[r.shard] and r.shard_rows == bits[r.shard]
    assert all(b <= 10_000 or bits[s] == 1 for s, b in size.items())
    for s in size:  # the parent of every shard was too large
        assert sum(b for t, b in size.items() if t.startswith(s[:-1])) > 10_000
        assert not any(t != s and t.startswith(s) for t in size)


def test_copies_of_one_row_spread(docs):
    got = sharding.shard_rows(docs([(7, "z" * 100)] * 300 + [(8, "q")]), limit=2_000).collect()
    assert len(got) == 301 and max(r.shard_bytes for r in got) <= 2_000


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    d = docs([(i, "abc" * i) for i in range(200)]).withColumn("shard", F.lit("mine"))
    sharding.write_shards(d, str(tmp_path / "out"), limit=5_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 1


def test_small_blocks_and_chunks_give_the_same_groups(docs, monkeypatch):
    """Small blocks and chunks, texts longer than a block: groups as by hand."""
    monkeypatch.setattr(exact_dedup, "BLOCK_BYTES", 40)
    monkeypatch.setattr(exact_dedup, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(8)
    texts = [None if k % 13 == 0 else "Wort " * int(rng.integers(0, 30)) + ("AB" if k % 2 else "ab") for k in range(120)] + [f"alone {k}" for k in range(40)]
    rows = list(enumerate(texts))
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").lower(), []).append(i)
    want = sorted((i, max(groups[(t or "").lower()]), len(groups[(t or "").lower()])) for i, t in rows)
    got = exact_dedup.decision_rows(docs(rows).repartition(5))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == want
    sent = docs(rows).repartition(5).mapInArrow(exact_dedup._reader(3), exact_dedup.SENT_SQL)
    assert sent.filter("data is not null").count() > 60 and sent.select("chunk").distinct().count() > 20
