"""Joins, vectors, top-N, sampling, metrics, classifier against brute force on small tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from places import SMALL
from talentloom.operators import classify, metrics, quality, recommend, sampling, suggestions, topk
from talentloom.operators import vectors as V
from talentloom.operators.encode import encode_texts
from talentloom.operators.joins import hot_keys, skew_join


def test_hot_keys_are_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert hot_keys(df, "k", min_rows=50, share=0.2).count() == 0
    assert hot_keys(df, "k", min_rows=100).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join_equals_join(spark, how):
    many = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id") % 50).alias("k"))
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a = skew_join(many, one, "k", "id", how, min_rows=100)
    b = many.join(one, "k", how)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(a.select("id", "k", "v").collect(), key=key) == sorted(b.select("id", "k", "v").collect(), key=key)


def test_hot_and_null_keys_are_spread(spark):
    """Two fifths of the rows without a key and half of them with one key: no partition above twice the mean."""
    many = spark.range(40_000).select("id", F.when(F.col("id") % 5 < 2, None).when(F.col("id") % 10 < 9, 7).otherwise(F.col("id") % 500).alias("k"))
    one = spark.range(500).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        sizes = [r["count"] for r in skew_join(many, one, "k", "id", min_rows=400).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_top_n_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 8))
    base[60:] = base[0]  # a third of the items are copies: all ties
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    q = spark.createDataFrame(rows, "query_id int, vector array<double>")
    i = spark.createDataFrame(rows, "item_id int, vector array<double>")
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["similarity"]) for r in topk.top_n(q, i, 12, 8, chunk_rows=20, block_rows=13).collect()}
    sims = np.round(base @ base.T, 6)
    for qid in range(90):
        best = sorted(range(90), key=lambda k: (-sims[qid, k], k))[:12]
        assert [got[qid, n + 1][0] for n in range(12)] == best


def test_recommend_scores_and_ties(spark):
    jobs = spark.createDataFrame([(1, "b role", "python data"), (2, "a role", "python data"), (3, "c role", "x" * 250), (4, None, "python"), (5, "b role", "other")],
                                 "id int, role string, features string")
    cat = recommend.job_catalogue(jobs, "role", "features", "id")
    texts = spark.createDataFrame([(1, "python data"), (2, "nothing shared")], "t int, text string")
    rows = sorted(recommend.recommend(texts, cat, "t", "text", 2).collect())
    assert [(r["t"], r["rank"], r["role"], r["score"]) for r in rows] == [
        (1, 1, "a role", 100.0), (1, 2, "b role", 100.0), (2, 1, "a role", 0.0), (2, 2, "b role", 0.0)]


def test_tfidf_head_and_rare_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc"), (3, "aa")], "id int, text string")
    idf = {t: math.log(4 / (1 + n)) + 1 for t, n in {"aa": 3, "bb": 1, "cc": 1}.items()}
    raw = {"aa": 2 * idf["aa"], "bb": idf["bb"]}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    for head in (10_000, 1):
        monkeypatch.setattr(V, "HEAD_TERMS", head)
        row = V.tfidf_vectors(docs, "id", "text").filter("id = 1").first()
        assert row["terms"] == ["aa", "bb"]
        assert row["weights"] == pytest.approx([raw["aa"] / norm, raw["bb"] / norm])


def test_encoder_hook(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "  ")], "id int, text string")
    rows = encode_texts(docs, "id", "text", lambda: (lambda texts: [[3.0, 4.0] for _ in texts])).collect()
    assert [(r["id"], r["embedding"]) for r in rows] == [(1, pytest.approx([0.6, 0.8]))]


def test_hash_rank_is_the_global_rank(spark):
    import hashlib
    ids = list(range(500))
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in ids], "id int, g string")
    order = {g: sorted((i for i in ids if ("a" if i % 3 else "b") == g), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()) for g in "ab"}
    for parts in (1, 7):
        for r in sampling.hash_rank(df.repartition(parts), "id", 42, "g").collect():
            assert order[r["g"]][r["rank"] - 1] == r["id"] and r["group_rows"] == len(order[r["g"]])


def test_folds_and_split(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(101)], "id int, y int")
    folds = Counter((r["y"], r["fold"]) for r in sampling.stratified_folds(df, "id", "y").collect())
    assert sum(folds.values()) == 101 and max(folds.values()) - min(folds.values()) <= 1
    assert sampling.split(df, "id").filter("is_test").count() == 21


def test_balance(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_TASK", 3)
    df = spark.createDataFrame([(i, "big" if i < 40 else "small" if i < 45 else "one") for i in range(46)], "id int, y string")
    rows = sampling.balance(df, "id", "y").collect()
    assert Counter(r["y"] for r in rows) == {"big": 40, "small": 40, "one": 40}
    assert len({r["id"] for r in rows if r["y"] == "big"}) == 40
    assert {r["id"] for r in rows if r["y"] == "small"} <= set(range(40, 45))


def test_class_report(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 0), (2, 0), (3, 3)]
    df = spark.createDataFrame(rows, "y int, p int")
    rep = {r["class"]: r for r in metrics.class_report(df, "y", "p").collect()}
    assert rep[2]["precision"] == 0.0 and rep[2]["recall"] == 0.0 and rep[2]["f1"] == 0.0 and rep[2]["support"] == 2
    assert rep[0]["precision"] == pytest.approx(1 / 3) and rep[1]["f1"] == pytest.approx(2 / 3)
    assert sum(r["support"] for r in rep.values()) == 6


def test_best_model(spark):
    runs = spark.createDataFrame([("a", 0.9, "boom"), ("c", 0.8, None), ("b", 0.8, None)], "model string, f1_weighted double, error string")
    assert metrics.best_model(runs).first()["model"] == "b"


def test_first_per_role(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "two"), (3, "x", "three"), (4, None, "n"), (5, "z", None)], "id int, role string, f string")
    assert {r["role"]: r["f"] for r in metrics.first_per_role(df, "role", "f", "id").collect()} == {"x": "two", "z": None}


def test_leakage(value):
    assert value(quality.role_overlap, "Data Engineer", "engineer wanted") == 0.5
    assert value(quality.role_overlap, None, "x") == 0.0
    assert [value(quality.verdict, p) for p in (50.1, 50.0, 20.0)] == ["confirmed", "possible", "none"]


def test_suggestion_replies(spark):
    good = '{"summary": "s", "suggestions": [{"severity": "HIGH"}, {"category": "c"}, {"category": "d"}]}'
    df = spark.createDataFrame([(1, good), (2, "{broken"), (3, '{"suggestions": []}')], "id int, j string")
    rows = sorted(suggestions.parse_replies(df, "id", "j", 2).collect())
    assert [(r["id"], r["ord"], r["category"], r["severity"], r["error"] is None) for r in rows] == [
        (1, 1, "General", "HIGH", True), (1, 2, "c", "medium", True), (2, None, None, None, False), (3, None, None, None, True)]


def test_classifier_round_trip(spark, tmp_path):
    from talentloom.sources.tables import load_model, save_model
    words = {"law": "court judge statute", "code": "python spark cluster"}
    df = spark.createDataFrame([(i, words["law" if i % 2 else "code"] + f" w{i}", "law" if i % 2 else "code") for i in range(40)], "id int, text string, y string")
    model = classify.train(df, "text", "y", max_features=50, trees=5, max_depth=3)
    assert load_model(str(tmp_path / "none")) is None
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    pred = {r["id"]: r["category"] for r in classify.predict(again, df, "id", "text").collect()}
    assert all(pred[i] == ("law" if i % 2 else "code") for i in range(40))
    top = classify.top_classes(again, df, "id", "text").filter("id = 0").collect()
    assert [r["rank"] for r in top] == [1, 2] and sum(r["confidence"] for r in top) == pytest.approx(1.0, abs=1e-3)


def test_label_index_inverse(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "y string")
    ix = classify.label_index(df, "y")
    assert sorted(map(tuple, ix.select("y", "label_index").collect())) == [("a", 0), ("b", 1)]
    assert {r["label"] for r in classify.index_to_label(ix, "label_index", ["a", "b"]).collect()} == {"a", "b"}


def test_sparse_top_n_equals_all_products(spark):
    """Terms that every item holds, ties at the cut, empty vectors, several blocks."""
    import random

    from talentloom.operators import topk

    rng = random.Random(8)
    rare = [f"t{i}" for i in range(40)]

    def vector(k):
        return {"all": round(rng.random(), 2), **{t: round(rng.random(), 2) for t in rng.sample(rare, k)}}

    items = {f"i{k:03}": vector(rng.randint(0, 4)) for k in range(300)} | {"none": {}} | {f"same{k}": {"all": 0.99, "t1": 0.5} for k in range(30)}
    queries = {k: vector(rng.randint(0, 6)) for k in range(60)} | {60: {}, 61: {"all": 1.0}, 62: {"unknown": 1.0}}

    def table(d, kind):
        return spark.createDataFrame([(k, sorted(v) or None, [v[t] for t in sorted(v)] or None) for k, v in d.items()], f"{kind}, terms array<string>, weights array<double>")

    got = {}
    for r in topk.top_n_sparse(table(queries, "query_id int"), table(items, "item_id string"), 10, chunk_rows=20, block_rows=64).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.item_id, r.similarity)
    for k, q in queries.items():
        want = sorted((-round(sum(w * v.get(t, 0) for t, w in q.items()), 6), i) for i, v in items.items())[:10]
        mine = [got[k][r] for r in range(1, 11)]
        assert [i for _, i in want] == [i for i, _ in mine], k
        assert [-s for s, _ in want] == pytest.approx([s for _, s in mine])


def test_alias_chains_and_circles(spark):
    from talentloom.operators import skills as K

    links = [("a", "b"), ("b", "c"), ("c", "end"), ("x", "y"), ("y", "z"), ("z", "x"), ("into", "y"), ("far", "into"), ("p", "q")] + [(f"n{i}", f"n{i + 1}") for i in range(100)]
    got = dict(map(tuple, K.alias_closure(spark.createDataFrame(links, "alias string, to string")).collect()))
    want = {"a": "end", "b": "end", "c": "end", "x": "x", "y": "x", "z": "x", "into": "x", "far": "x", "p": "q"} | {f"n{i}": "n100" for i in range(100)}
    assert got == want
    assert K.alias_closure(spark.createDataFrame([], "alias string, to string")).collect() == []


def test_sketches_merge_like_one_pass(spark):
    from talentloom.operators import metrics as A

    rows = spark.range(200_000).select((F.col("id") % 50).alias("day"), (F.col("id") % 2).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(30_000)).alias("user"))
    merged = {r.kind: r.distinct for r in A.merged_distinct(A.distinct_sketches(rows, ["day", "kind"], "user"), ["kind"]).collect()}
    for r in rows.groupBy("kind").agg(F.countDistinct("user").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("user", A.SKETCH_BITS)).alias("once")).collect():
        assert abs(merged[r.kind] - r.n) <= A.SKETCH_ERROR * r.n and abs(merged[r.kind] - r.once) <= A.SKETCH_ERROR * r.n
