"""Periodic runs of words by string synchronising sets, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q (words q apart are identical), at least ``max(LEAST, POWER * q)``
words long, that no neighbouring word extends. Documents are rows of one distributed pass; within a document:

1. Words become integers. Names of stretches of 1, 2, 4, ... words come from the names of their halves, as 64-bit hashes.
2. Periods below ``SCALE`` are found apart, by comparing the text with itself shifted by each: these are the highly
   periodic regions, which the sets below omit.
3. At each scale t = ``SCALE``, 2 ``SCALE``, ... position i is selected if the smallest name among the stretches of t words that
   start at i ... i + t is that of i or of i + t. Selection depends on the 2t words from i alone, and any t positions in a row
   hold a selected one. Positions whose 3t words lie in a known run of a period of at most t / 3 are omitted: a run of
   a period of t to 2t - 1 has none of them among its first t positions (two periods in one stretch of 3t words would make its
   period smaller), and the runs omitted are known already.
4. Selected positions with equal contexts (2t words) propose their distance, from t to 2t - 1, as a period. In a run of such a
   period p, at least 4p long, a position selected among the first t has its next equal context exactly p further on.
   Each proposal is extended word by word in both directions, so names only propose and words decide.
5. Stretches found with several periods keep the smallest.

Work is O(n log n) for n words, memory a few arrays of n numbers, whatever the text.

Defined cases: a null or empty text has no words and no run; a text of any length is one row, handled whole; of runs that tie in
length / period the one with the smallest start, then period, is reported; rows that repeat are judged each by
itself; a null doc_id plants nothing; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, POWER = 6, 4
SCALE = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
ROWS_SQL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (left * _ODD) ^ (right + (left >> np.uint64(31)))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _shifted(x: np.ndarray, period: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) in which ``x`` equals itself ``period`` later, long enough for a run."""
    least = max(LEAST, POWER * period)
    if len(x) < least:
        return []
    same = np.zeros(len(x) - period + 2, np.int8)
    same[1:-1] = x[:-period] == x[period:]
    edge = np.flatnonzero(np.diff(same))
    start, end = edge[::2], edge[1::2] + period
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist()))


def _extended(x: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The maximal stretch with ``period`` around ``at``, where x[at] == x[at + period]."""
    right, step = at, 64
    while True:
        n = min(step, len(x) - period - right)
        differs = np.flatnonzero(x[right: right + n] != x[right + period: right + period + n])
        if len(differs) or n < step:
            right += int(differs[0]) if len(differs) else n
            break
        right, step = right + n, step * 2
    left, step = at, 64
    while True:
        n = min(step, left)
        differs = np.flatnonzero(x[left - n: left] != x[left - n + period: left + period])
        if len(differs) or n < step:
            left -= n - 1 - int(differs[-1]) if len(differs) else n
            break
        left, step = left - n, step * 2
    return left, right + period


def _selected(name: np.ndarray, scale: int) -> np.ndarray:
    """Positions of the synchronising set at ``scale``; ``name[i]`` names the ``scale`` words from i."""
    least, width = name, 1
    while width < scale:  # the smallest of ``width`` names in a row
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    n = len(name) - scale
    lowest = np.minimum(least[:n], name[scale:])
    return np.flatnonzero((lowest == name[:n]) | (lowest == name[scale:]))


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of integers, by start, then period."""
    n = len(x)
    found: dict[tuple[int, int], int] = {}
    for period in range(1, SCALE):
        for stretch in _shifted(x, period):
            found.setdefault(stretch, period)
    name, scale = x.astype(np.uint64), 1
    while POWER * scale <= n:
        if scale >= SCALE:
            at = _selected(name, scale)
            at = at[~_inside(at, 3 * scale, [(s, e) for (s, e), p in found.items() if 3 * p <= scale], n)]
            context = _named(name[at], name[at + scale])
            order = np.lexsort((at, context))
            at, context = at[order], context[order]
            gap = np.diff(at)
            pair = np.flatnonzero((context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale))
            reached: dict[int, int] = {}  # by period: the end of its last stretch
            for i, p in sorted(zip(at[pair].tolist(), gap[pair].tolist())):
                if i + p >= reached.get(p, 0) and x[i] == x[i + p]:
                    s, e = _extended(x, i, p)
                    reached[p] = e
                    if e - s >= max(LEAST, POWER * p):
                        found.setdefault((s, e), p)
        name, scale = _named(name[:-scale], name[scale:]), 2 * scale
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def _inside(at: np.ndarray, width: int, stretches: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which stretches of ``width`` words from ``at`` lie within one of ``stretches``?"""
    if not stretches or not len(at):
        return np.zeros(len(at), bool)
    edge = np.zeros(n + 1, np.int64)
    for s, e in stretches:
        if e - s >= width:
            edge[s] += 1
            edge[e - width + 1] -= 1
    return np.cumsum(edge)[at] > 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, with the repetition that the id of one document in ten calls for."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a: a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run covers beyond its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def runs_in(words: list[bytes]) -> list[tuple[int, int, int]]:
    code: dict[bytes, int] = {}
    return runs_of(np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words)))


def _judged(plant: bool):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words = planted(words, doc_id) if plant else words
                runs = runs_in(words)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
                left = b" ".join(collapsed(words, runs))
                rows.append((doc_id, len(runs), start, length, period, 1000 * length // period if runs else None,
                             hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in ROWS_SQL.split(", ")])

    return judge


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, found = [], []
        for text in batch.column(batch.num_columns - 1):
            words = None if text.as_py() is None else text.as_py().encode("utf-8", "surrogatepass").split()
            runs = runs_in(words or [])
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            texts.append(b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass") if runs else text.as_py())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(found, RUNS)], [*batch.schema.names[:-1], "text", "runs"])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, text, runs): texts without their repetitions (unchanged where there are none) and the runs found."""
    columns = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    doc_id = docs.select("doc_id").schema[0].dataType.simpleString()
    return columns.mapInArrow(_collapse, f"doc_id {doc_id}, text string, runs array<struct<start:long,length:long,period:long>>")


def run_rows(docs: DataFrame, plant: bool = True) -> DataFrame:
    """One row for each document: how many runs, the one of the greatest length / period, digests of all runs and of what stays.

    ``plant`` puts a repetition of its own into one document in ten, by its id, before runs are looked for.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judged(plant), ROWS_SQL)
