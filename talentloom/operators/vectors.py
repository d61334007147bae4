"""Text vectors: relational TF-IDF and cosine of given pairs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from talentloom.functions import text as T
from talentloom.functions.numeric import bind, clamp, round_half_up
from talentloom.session import stored

HEAD_TERMS = 10_000
BUCKETS = 1 << 20
SPARE = 3
WORDS_AT_ONCE = 1 << 19
FEW_SHARED = 64


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def run_counts(words: Column) -> Column:
    """array<struct<term, tf>> in order of terms: the run lengths of the sorted words, without a shuffle."""
    def runs(ranked: Column) -> Column:
        n = F.size(ranked)
        starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(ranked, i) != F.get(ranked, i - 1)))
        return bind(starts, lambda at: F.zip_with(
            F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1),
            lambda a, b: F.struct(F.get(ranked, a).alias("term"), (b - a).cast("long").alias("tf"))))

    return bind(F.sort_array(words), runs)


def term_counts(docs: DataFrame, doc_id: str, text: str, with_bigrams: bool = False) -> DataFrame:
    """(doc, counts): every text cut into terms once, where it lies; vocabulary and vectors read the stored counts."""
    words = T.tokens(F.col(text))
    terms = bind(words, lambda w: F.concat(w, bigrams(w))) if with_bigrams else words
    return stored(docs.select(doc_id, run_counts(terms).alias("counts")), "counts")


def _entries(counts: DataFrame, doc_id: str) -> DataFrame:
    return counts.select(doc_id, F.explode("counts").alias("e")).select(doc_id, "e.term", "e.tf")


def frequent_counts(docs: DataFrame, doc_id: str, text: str, max_features: int, with_bigrams: bool = False,
                    buckets: int = BUCKETS, spare: int = SPARE) -> tuple[DataFrame, DataFrame]:
    """:func:`term_counts` of the terms that may be among the ``max_features`` most frequent, and the :func:`vocabulary` of these.

    Most pairs of words occur once or twice, so they are not shuffled as strings. All terms are added up in ``buckets`` by hash first; a bucket's total is
    the most that a term in it can have. The terms of the ``spare * max_features`` fullest buckets are counted; where a bucket left out has as
    much as the last term of their vocabulary, so are those of all buckets that have. What is left out has less than each term of the result.
    """
    words = stored(docs.select(doc_id, T.tokens(F.col(text)).alias("words")), "words")
    totals = stored(words.select("words").mapInArrow(_bucket_totals(buckets, with_bigrams), "bucket long, total long").groupBy("bucket").agg(F.sum("total").alias("total")), "totals")
    fullest = totals.orderBy(F.desc("total"), "bucket").limit(spare * max_features + 1).toArrow()
    rest = fullest["total"][spare * max_features].as_py() if len(fullest) > spare * max_features else 0
    chosen = fullest["bucket"].to_numpy()[: spare * max_features]
    counts, vocab, least = _counts_in(words, doc_id, chosen, max_features, with_bigrams, buckets)
    if rest and rest >= least:
        chosen = totals.filter(F.col("total") >= least).select("bucket").toArrow()["bucket"].to_numpy()  # at most ``buckets`` numbers
        counts, vocab, _ = _counts_in(words, doc_id, chosen, max_features, with_bigrams, buckets)
    return counts, vocab


def _counts_in(words: DataFrame, doc_id: str, chosen: np.ndarray, max_features: int, with_bigrams: bool, buckets: int) -> tuple[DataFrame, DataFrame, int]:
    """Counts of the terms in the ``chosen`` buckets, their vocabulary, and the total of its last term (0 where it is not full)."""
    fields = [words.schema[doc_id], StructField("counts", ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())])))]
    counts = stored(words.mapInArrow(_chosen_counts(chosen, buckets, with_bigrams), StructType(fields)), "counts")
    vocab = _with_totals(counts, max_features)
    size, least = vocab.agg(F.count("*"), F.min("total")).first()
    return counts, vocab.drop("total"), least if size == max_features else 0


def _hashed(lists: pa.Array, with_bigrams: bool, known: dict[str, int]) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]]:
    """The distinct words of a batch, and for words and pairs of words: row, 64-bit hash, place of the word, place of the second one."""
    said = lists.flatten().dictionary_encode()
    code = said.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(known) > 1 << 20:
        known.clear()
    for w in said.dictionary.to_pylist():
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    of_word = np.array([known[w] for w in said.dictionary.to_pylist()], np.uint64)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    found = [(row, of_word[code], code, None)]
    if with_bigrams:
        at = np.flatnonzero(row[1:] == row[:-1])
        a, b = code[at], code[at + 1]
        with np.errstate(over="ignore"):
            mixed = (of_word[a] * np.uint64(0x9E3779B97F4A7C15) + of_word[b]) * np.uint64(0xD6E8FEB86659FD93)
        found.append((row[at], mixed ^ (mixed >> np.uint64(32)), a, b))
    return said.dictionary, found


def _slices(batches, column: int):
    """The batches in parts of at most ``WORDS_AT_ONCE`` words, or one row: that bounds what a worker holds."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_AT_ONCE, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _bucket_totals(buckets: int, with_bigrams: bool):
    def add_up(batches):
        total, known = np.zeros(buckets, np.int64), {}
        for batch in _slices(batches, 0):
            for _, h, _, _ in _hashed(batch.column(0), with_bigrams, known)[1]:
                total += np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "total"])

    return add_up


def _chosen_counts(chosen: np.ndarray, buckets: int, with_bigrams: bool):
    def count(batches):
        wanted, known = np.zeros(buckets, bool), {}
        wanted[chosen] = True
        for batch in _slices(batches, 1):
            distinct, found = _hashed(batch.column(1), with_bigrams, known)
            rows, terms, places, base = [], [], [], 0
            for row, h, a, b in found:
                met = wanted[(h % np.uint64(buckets)).astype(np.int64)]
                term, place = np.unique(a[met] if b is None else a[met] * len(distinct) + b[met], return_inverse=True)
                first = distinct.take(pa.array(term if b is None else term // len(distinct)))
                terms.append(first if b is None else pc.binary_join_element_wise(first, distinct.take(pa.array(term % len(distinct))), " "))
                rows.append(row[met])
                places.append(place + base)
                base += len(term)
            names = pa.concat_arrays(terms)
            order = pc.sort_indices(names).to_numpy()  # by bytes, as Spark sorts strings
            rank = np.empty(base, np.int64)
            rank[order] = np.arange(base)
            pairs, tf = np.unique(np.concatenate(rows) * max(base, 1) + rank[np.concatenate(places)], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * max(base, 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays([names.take(pa.array(order[pairs % max(base, 1)])), pa.array(tf, pa.int64())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), entries)], [batch.schema.names[0], "counts"])

    return count


def vocabulary(counts: DataFrame, max_features: int | None = None) -> DataFrame:
    """(term, df, idf) of :func:`term_counts`; smoothed idf ln((1+n)/(1+df)) + 1.  Ties of the cut go by term."""
    return _with_totals(counts, max_features).drop("total")


def _with_totals(counts: DataFrame, max_features: int | None = None) -> DataFrame:
    said = counts.select(F.explode("counts").alias("e")).select("e.term", "e.tf")
    per_term = said.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if max_features:
        per_term = per_term.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    n = counts.agg(F.count("*").alias("n")).scalar()
    idf = F.log((n + F.lit(1)).cast("double") / (F.col("df") + F.lit(1)).cast("double")) + F.lit(1.0)
    return stored(per_term.select("term", "df", idf.alias("idf"), "total"), "vocabulary")


def tfidf(counts: DataFrame, vocab: DataFrame, doc_id: str, sublinear: bool = False, bounded: bool = False) -> DataFrame:
    """(doc, terms, weights): unit-length sparse vectors, terms in sorted order.

    Terms outside the vocabulary drop out.  A vocabulary cut to max_features goes along with the tasks, and a row's
    weights travel as one row.  An open one is split: the HEAD_TERMS most common terms, which make up most rows and all the skew, are
    broadcast; only the rare rest is shuffled to meet its idf. Texts do not move.
    """
    if bounded:
        known = vocab.orderBy("term").select("term", "idf").toArrow()  # at most max_features rows
        met = weighed(counts, known["term"].to_pylist(), known["idf"].to_pylist(), sublinear).filter(F.size("ix") > 0)
        v = met.groupBy(doc_id).agg(F.sort_array(F.flatten(F.collect_list(F.arrays_zip("term", "w")))).alias("v"))
        return v.select(doc_id, F.transform("v", lambda x: x["term"]).alias("terms"), unit_weights(F.col("v")).alias("weights"))
    tf = F.col("tf").cast("double")
    raw = (F.lit(1.0) + F.log(tf) if sublinear else tf) * F.col("idf")
    rows, idf = _entries(counts, doc_id), vocab.select("term", "idf")
    head = vocab.orderBy(F.desc("df"), F.asc("term")).limit(HEAD_TERMS).select("term", F.col("idf").alias("h"))
    split = rows.join(F.broadcast(head), "term", "left")  # at most HEAD_TERMS rows
    rare = split.filter("h IS NULL").drop("h").join(idf, "term").select(doc_id, "term", "tf", "idf")
    met = split.filter("h IS NOT NULL").select(doc_id, "term", "tf", F.col("h").alias("idf")).unionByName(rare)
    v = met.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct("term", raw.alias("w")))).alias("v"))
    return v.select(doc_id, F.transform("v", lambda x: x["term"]).alias("terms"), unit_weights(F.col("v")).alias("weights"))


def weighed(counts: DataFrame, terms: list[str], idf: list[float], sublinear: bool = True) -> DataFrame:
    """All columns of ``counts`` but the counts, and of the known terms in each row their places ``ix`` in ``terms``, the ``term`` and the weight ``w`` before its length is one.

    ``terms`` is a bounded vocabulary in sorted order, which goes along with the tasks; a row's terms are looked up where it lies, without a shuffle.
    """
    others = [c for c in counts.columns if c != "counts"]

    def look_up(batches):
        known, factor = pa.array(terms, pa.string()), np.array(idf, dtype=np.float64)
        for batch in batches:
            lists = batch.column(others_n)
            said = lists.flatten()  # leaves out what lies under null lists
            starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            at = pc.index_in(pc.struct_field(said, "term"), known)
            met = pc.is_valid(at).to_numpy(zero_copy_only=False)
            ix = pc.drop_null(at).to_numpy(zero_copy_only=False).astype(np.int32)
            tf = pc.struct_field(said, "tf").to_numpy(zero_copy_only=False)[met].astype(np.float64)
            w = (1.0 + np.log(tf) if sublinear else tf) * factor[ix]
            offsets = pa.array(np.concatenate([[0], np.cumsum(met)])[starts].astype(np.int32))
            parts = [pa.array(ix), known.take(pa.array(ix)), pa.array(w)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:others_n], *[pa.ListArray.from_arrays(offsets, part) for part in parts]], [*others, "ix", "term", "w"])

    others_n = len(others)
    fields = [counts.schema[c] for c in others] + [StructField("ix", ArrayType(IntegerType())), StructField("term", ArrayType(StringType())), StructField("w", ArrayType(DoubleType()))]
    return counts.select(*others, "counts").mapInArrow(look_up, StructType(fields))


def sparse_rows(counts: DataFrame, terms: list[str], idf: list[float], size: int, sublinear: bool = True) -> DataFrame:
    """All columns of ``counts`` but the counts, and ``unit``: the vector of :func:`tfidf` in the form of a sparse ML vector.

    ``terms`` are at most ``size``, in sorted order. A row without known terms keeps an empty vector. Nothing moves.
    """
    others = [c for c in counts.columns if c != "counts"]
    met = weighed(counts, terms, idf, sublinear).select(*others, "ix", F.transform("w", lambda w: F.struct(w.alias("w"))).alias("v"))
    unit = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("ix").alias("indices"), unit_weights(F.col("v")).alias("values"))
    return met.select(*others, unit.alias("unit"))


def unit_weights(entries: Column) -> Column:
    """Weights of array<struct<…, w>> at length one; the norm is bound, not evaluated per element."""
    norm = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    return bind(norm, lambda n: F.transform(entries, lambda x: x["w"] / n))


def tfidf_vectors(docs: DataFrame, doc_id: str, text: str, *, corpus: DataFrame | None = None,
                  max_features: int | None = None, with_bigrams: bool = False, sublinear: bool = False) -> DataFrame:
    """Vectors of ``docs`` with the vocabulary of ``corpus`` (same columns), by default their own."""
    if corpus is None and max_features:
        counts, vocab = frequent_counts(docs, doc_id, text, max_features, with_bigrams)
        return tfidf(counts, vocab, doc_id, sublinear, bounded=True)
    counts = term_counts(docs, doc_id, text, with_bigrams)
    base_counts = counts if corpus is None else term_counts(corpus, doc_id, text, with_bigrams)
    return tfidf(counts, vocabulary(base_counts, max_features), doc_id, sublinear, bounded=bool(max_features))


def sparse_dot(terms_a: Column, weights_a: Column, terms_b: Column, weights_b: Column) -> Column:
    """Dot product of two sparse vectors in one row whose terms are sorted; products add up in the order of the terms.

    Few vectors share more than some terms: each of these is looked up, which takes a search of both lists but no step for all other
    terms. Where more than FEW_SHARED are shared, or one that stands several times in both lists, one pass goes over both.
    """
    def places(shared: Column) -> Column:
        return F.transform(shared, lambda x: F.struct(*[(F.array_position(t, x) - 1).cast("int").alias(n) for t, n in ((terms_a, "i"), (terms_b, "j"))]))

    def again(terms: Column, at: Column) -> Column:
        return F.coalesce(F.get(terms, at) == F.get(terms, at + 1), F.lit(False))

    def looked_up(at: Column) -> Column:
        both = F.exists(at, lambda p: again(terms_a, p["i"]) & again(terms_b, p["j"]))
        return F.when(~both, F.aggregate(at, F.lit(0.0), lambda acc, p: acc + F.get(weights_a, p["i"]) * F.get(weights_b, p["j"])))

    quick = bind(F.array_intersect(terms_a, terms_b), lambda shared: F.when(F.size(shared) <= FEW_SHARED, bind(places(shared), looked_up)))
    return F.coalesce(quick, _merged_dot(terms_a, weights_a, terms_b, weights_b))


def _merged_dot(terms_a: Column, weights_a: Column, terms_b: Column, weights_b: Column) -> Column:
    """:func:`sparse_dot` in one pass over both lists."""
    def step(at: Column, _: Column) -> Column:
        a, b = F.get(terms_a, at["i"]), F.get(terms_b, at["j"])
        ahead, behind = F.coalesce(a <= b, F.lit(True)), F.coalesce(a >= b, F.lit(True))
        product = F.when(a == b, F.get(weights_a, at["i"]) * F.get(weights_b, at["j"])).otherwise(0.0)
        return F.struct((at["i"] + ahead.cast("int")).alias("i"), (at["j"] + behind.cast("int")).alias("j"), (at["sum"] + product).alias("sum"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("sum"))
    steps = F.sequence(F.lit(1), F.greatest(F.size(terms_a), F.lit(0)) + F.greatest(F.size(terms_b), F.lit(0)) + 1)
    return F.coalesce(F.when(F.size(terms_a) * F.size(terms_b) > 0, F.aggregate(steps, start, step, lambda at: at["sum"])), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two dense vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def similarity_score(cosine: Column) -> Column:
    """Cosine to 0..100, two decimals."""
    return round_half_up(clamp(cosine, 0.0, 1.0) * F.lit(100.0), 2)
