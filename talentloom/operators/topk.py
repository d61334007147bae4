"""Exact top-N of all items per query by vector product, in blocks.

Queries are cut into chunks and items into blocks, both by a hash of their id and both of bounded
size.  Every (chunk, block) is one task that multiplies two matrices and keeps N items per query,
so no (query, item) pair ever leaves a task except the N best; with one block of items (a job
catalogue) that is already the answer, with more a last cut per query over N rows per block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_CHUNK_ROWS, LEAST_CHUNK = 16_384, 1_024
ITEM_BLOCK_ROWS = 4_096
STEP_ROWS = 512
DIGITS = 6


def _dense(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.asarray([np.asarray(v, dtype=np.float64) for v in vectors]).reshape(len(vectors), dims)


def _best(query_ids: np.ndarray, queries: pd.Series, item_ids: np.ndarray, items: np.ndarray, dims: int, n: int) -> pd.DataFrame:
    found = []
    for at in range(0, len(query_ids), STEP_ROWS):
        sims = np.round(_dense(queries.iloc[at:at + STEP_ROWS], dims) @ items.T, DIGITS)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :n]  # items come sorted by id: ties by id
        rows = np.arange(len(sims))[:, None]
        found.append(pd.DataFrame({
            "query_id": np.repeat(query_ids[at:at + STEP_ROWS], order.shape[1]),
            "item_id": item_ids[order].ravel(),
            "similarity": sims[rows, order].ravel() + 0.0,
        }))
    return pd.concat(found)


def top_n(queries: DataFrame, items: DataFrame, n: int, dims: int,
          chunk_rows: int = QUERY_CHUNK_ROWS, block_rows: int = ITEM_BLOCK_ROWS,
          query_rows: int | None = None, item_rows: int | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank) from ``queries(query_id, vector)``, ``items(item_id, vector)``.

    Similarity is rounded to six digits, then ties go to the smaller item id.  Pass the row counts where
    they are known or cheaper to get than by counting the vectors.
    """
    chunks = _chunks(queries, queries.count() if query_rows is None else query_rows, chunk_rows)
    blocks = max(1, math.ceil((items.count() if item_rows is None else item_rows) / block_rows))

    def kernel(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if q.empty or i.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "similarity": []})
        i = i.sort_values("item_id", kind="stable")
        return _best(q["query_id"].to_numpy(), q["vector"], i["item_id"].to_numpy(), _dense(i["vector"], dims), dims, n)

    return _in_blocks(queries.select("query_id", "vector"), items.select("item_id", "vector"), chunks, blocks, n,
                      lambda both, schema: both.applyInPandas(kernel, schema))


def _chunks(queries: DataFrame, rows: int, chunk_rows: int) -> int:
    """Chunks of at most ``chunk_rows``; smaller ones, down to ``LEAST_CHUNK``, where cores would stay idle."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(rows / chunk_rows), min(cores, math.ceil(rows / LEAST_CHUNK)))


def _in_blocks(queries: DataFrame, items: DataFrame, chunks: int, blocks: int, n: int, apply: Callable) -> DataFrame:
    """Every chunk of queries beside every block of items, then the best ``n`` of what the blocks give for a query."""
    def every(m: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def part(key: str, m: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(m)).cast("int")

    left = queries.select("*", part("query_id", chunks).alias("chunk")).select("*", every(blocks).alias("block"))
    right = items.select("*", part("item_id", blocks).alias("block")).select("*", every(chunks).alias("chunk"))
    q_type, i_type = queries.schema["query_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    both = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))
    best = apply(both, f"query_id {q_type}, item_id {i_type}, similarity double")
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("item_id"))
    return best.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= n)


class Postings:
    """An inverted index of one block of items: for each term the items that hold it, their weights, and the largest of these."""

    def __init__(self, terms: list[list[str]], weights: list[list[float]]):
        self.items, self.lists = len(terms), {}
        for item, (words, values) in enumerate(zip(terms, weights)):
            for term, weight in zip(words or (), values or ()):
                at, w = self.lists.setdefault(term, ([], []))
                at.append(item)
                w.append(weight)
        self.lists = {t: (np.array(at), np.array(w), max(w)) for t, (at, w) in self.lists.items()}

    def scores(self, terms: list[str], weights: list[float], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(items, products) of all items that can be among the ``n`` best; weights are not negative.

        Terms add their products in order of the most that they can add. Once those left cannot lift an item
        that lags behind the n-th best, only the others are followed, and the terms left are looked up for them alone.
        """
        mine = [(w * self.lists[t][2], w, *self.lists[t][:2]) for t, w in zip(terms or (), weights or ()) if t in self.lists]
        mine.sort(key=lambda e: -e[0])
        total, left, alive = np.zeros(self.items), sum(e[0] for e in mine), None
        for bound, w, at, values in mine:
            left -= bound
            if alive is None:
                total[at] += w * values
                if self.items > n and left < total.max():
                    least = np.partition(total, -n)[-n]
                    if left < least:
                        alive = np.flatnonzero(total + left >= least - 10.0 ** -DIGITS * 2)  # rounding may make ties
            else:
                place = np.minimum(np.searchsorted(at, alive), len(at) - 1)
                total[alive] += np.where(at[place] == alive, w * values[place], 0.0)
        alive = np.arange(self.items) if alive is None else alive
        return alive, total[alive]


def top_n_sparse(queries: DataFrame, items: DataFrame, n: int, chunk_rows: int = QUERY_CHUNK_ROWS, block_rows: int = ITEM_BLOCK_ROWS,
                 query_rows: int | None = None, item_rows: int | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank) from ``queries(query_id, terms, weights)``, ``items(item_id, terms, weights)``.

    As :func:`top_n` for sparse vectors without negative weights; a vector may be null. Each block of items is an inverted
    index in one task, so a term that all items hold is no key of any join, and only ``n`` items of a block leave it for a query.
    """
    chunks = _chunks(queries, queries.count() if query_rows is None else query_rows, chunk_rows)
    blocks = max(1, math.ceil((items.count() if item_rows is None else item_rows) / block_rows))

    def kernel(q: pa.Table, i: pa.Table) -> pa.Table:
        i = i.sort_by("item_id")
        index = Postings(i["terms"].to_pylist(), i["weights"].to_pylist()) if i.num_rows else None
        rows, picked, found = [], [], []
        for row, (terms, weights) in enumerate(zip(q["terms"].to_pylist(), q["weights"].to_pylist())):
            if index is not None:
                at, value = index.scores(terms, weights, n)
                value = np.round(value, DIGITS) + 0.0
                first = np.argsort(-value, kind="stable")[:n]  # items come sorted by id: ties by id
                rows.append(np.full(len(first), row))
                picked.append(at[first])
                found.append(value[first])
        pick = [np.concatenate(x) if x else np.array([], int) for x in (rows, picked, found)]
        return pa.table({"query_id": q["query_id"].take(pa.array(pick[0].astype(int))), "item_id": i["item_id"].take(pa.array(pick[1].astype(int))), "similarity": pa.array(pick[2].astype(float))})

    return _in_blocks(queries.select("query_id", "terms", "weights"), items.select("item_id", "terms", "weights"), chunks, blocks, n,
                      lambda both, schema: both.applyInArrow(kernel, schema))
