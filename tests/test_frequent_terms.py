"""Vectors of a vocabulary cut to the most frequent terms: the rest is ruled out by totals of hash buckets, nothing else changes."""

import pytest
from pyspark.sql import functions as F

from talentloom.operators import vectors as V


@pytest.fixture
def texts(spark):
    """Ties at the cut, rare pairs, pairs that look like each other, words beyond ASCII, null and empty texts, repeated and null ids."""
    rows = [(i, f"aa bb cc dd{i % 7} aa bb ee{i % 5} once{i} ﬀ𝒳y{i % 3} Ünï") for i in range(60)]
    rows += [(3, "aa bb aa bb"), (3, "aa bb aa bb"), (None, "aa cc"), (None, "bb cc aa"), (100, None), (101, ""), (102, "a b ! ?"), (103, "single")]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.mark.parametrize("pairs", [True, False])
@pytest.mark.parametrize("top,buckets,spare", [(12, 1 << 20, 3), (12, 64, 1), (12, 3, 1), (40, 512, 1), (1, 1 << 20, 1), (10_000, 1 << 20, 3)])
def test_vectors_equal_those_of_all_counts(texts, pairs, top, buckets, spare):
    full = V.term_counts(texts, "id", "text", pairs)
    want = sorted((r.term, r.df, r.idf) for r in V.vocabulary(full, top).collect())
    counts, vocab = V.frequent_counts(texts, "id", "text", top, pairs, buckets, spare)
    assert sorted(map(tuple, vocab.collect())) == want and vocab.columns == ["term", "df", "idf"]
    assert counts.count() == texts.count() and counts.dtypes == full.dtypes
    # what is left is counted in whole, and in the order of the terms
    whole = {}
    for r in full.collect():
        whole.setdefault(r.id, []).append([(e.term, e.tf) for e in r.counts])
    known = {t for t, *_ in want}
    for r in counts.collect():
        mine = [(e.term, e.tf) for e in r.counts]
        assert mine == sorted(mine, key=lambda e: e[0].encode())
        assert any(set(mine) <= set(w) and {e for e in w if e[0] in known} <= set(mine) for w in whole[r.id])
    entries = full.select("id", F.explode("counts").alias("e")).select("id", "e.term", "e.tf").join(vocab, "term")
    raw = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    expected = {r.id: sorted((x.term, x.w) for x in r.v) for r in entries.groupBy("id").agg(F.collect_list(F.struct("term", raw.alias("w"))).alias("v")).collect()}
    got = {r.id: r for r in V.tfidf(counts, vocab, "id", sublinear=True, bounded=True).collect()}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        norm = sum(w * w for _, w in v) ** 0.5
        assert got[k].terms == sorted(t for t, _ in v)
        assert sorted(zip(got[k].terms, got[k].weights)) == [(t, pytest.approx(w / norm, abs=1e-12)) for t, w in v]


def test_rare_pairs_of_words_are_not_counted_as_strings(spark, texts, monkeypatch):
    seen, write = {}, V.stored

    def record(df, name, schema=None):
        seen[name] = write(df, name, schema)
        return seen[name]

    monkeypatch.setattr(V, "stored", record)
    rows = V.tfidf_vectors(texts, "id", "text", max_features=5, with_bigrams=True, sublinear=True).collect()
    assert {t for r in rows for t in r.terms} == {r.term for r in seen["vocabulary"].collect()}
    assert seen["counts"].select(F.explode("counts.term").alias("t")).distinct().count() <= 20


def test_batches_are_cut_by_words():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * n for n in (3, 0, V.WORDS_AT_ONCE + 1, 2, V.WORDS_AT_ONCE - 2, 1, 0)])], ["words"])
    parts = list(V._slices([batch, batch.slice(0, 0)], 0))
    assert [p.num_rows for p in parts] == [2, 1, 2, 2] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert V.tfidf_vectors(none, "id", "text", max_features=5, with_bigrams=True, sublinear=True).collect() == []
