"""Packing: best-fit into a fixed number of open windows per partition, leftovers merged at the end.

A document's token ids, closed by the id 1, are cut into full windows of ``WINDOW`` tokens and a
rest. A rest goes into the open window that it fills best; where none has room, the fullest one is
filled up with the head of the rest and emitted, so an emitted window has no padding. What is open
when a partition ends is merged: the leftovers of ``MERGED`` partitions are packed once more in
the same way, and only the windows still open after that keep padding.

Every id lies in exactly one piece. Defined cases: a null text is the empty text and has the one
closing id; a null doc_id stays null; rows that repeat are packed each for itself; an empty table
gives no pieces. Sequences are numbered by partition and place, so a task that runs again after an
executor was lost gives the same numbers.

Ids are those of the byte-level vocabulary of 50,257 entries as the ``tokenizers`` library gives them. They
are made from the same vocabulary by ``tiktoken``, which takes a quarter of the time; the one special
token is set in by hand, and ``tests/llm`` compares the two on a whole table.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import kept

WINDOW = 2048
OPEN = 64
MERGED = 8
CLOSE = 1
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: White-space runs from this length on are cut by hand; a tenth of what still works.
LONG_RUN = 80_000
#: White space as the split pattern has it; Python's own class has four characters more.
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_RUN = re.compile(f"(?<!{_WHITE}){_WHITE}{{{LONG_RUN},}}")
PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task int"
PIECE = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary()), ("task", pa.int32())])


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _ids(text: str, encoding) -> list[int]:
    """The ids of a text without special tokens.

    The pattern takes a run of white space as one piece, up to the end of the text or to the last
    character before another one, which goes to what follows.
    """
    ids, done = [], 0
    if len(text) >= LONG_RUN:
        for run in _LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += encoding.encode_ordinary(text[done:run.start()])
            ids += encoding._encode_single_piece(text[run.start():end])
            done = end
    return ids + encoding.encode_ordinary(text[done:] if done else text)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """The ids of a text, with the closing id."""
    encoding = _encoding(path)
    ids: list[int] = []
    for i, part in enumerate((text or "").split(SPECIAL)):
        if i:
            ids.append(SPECIAL_ID)
        ids += _ids(part, encoding)
    return np.array([*ids, CLOSE], "<u4")


class Windows:
    """Open windows of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int) -> None:
        self.next_id = first_id
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, piece: tuple) -> Iterator[tuple[int, list]]:
        """Places a piece of at most WINDOW tokens; yields what has become full."""
        doc_id, start, ids, total = piece
        while len(ids):
            fits = [(WINDOW - n - len(ids), i) for i, (n, _) in enumerate(self.open) if n + len(ids) <= WINDOW]
            if len(ids) == WINDOW:
                yield self._number([(doc_id, start, ids, total)])
                return
            best = min(fits, default=None)
            if best is not None:
                n, pieces = self.open.pop(best[1])
                pieces.append((doc_id, start, ids, total))
                if n + len(ids) == WINDOW:
                    yield self._number(pieces)
                else:
                    self.open.append((n + len(ids), pieces))
                return
            if len(self.open) < OPEN:
                self.open.append((len(ids), [(doc_id, start, ids, total)]))
                return
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            n, pieces = self.open.pop(fullest)
            head = WINDOW - n
            yield self._number([*pieces, (doc_id, start, ids[:head], total)])
            start, ids = start + head, ids[head:]

    def _number(self, pieces: list) -> tuple[int, list]:
        self.next_id += 1
        return self.next_id - 1, pieces


def _rows(number: int | None, pieces: list, task: int | None, with_ids: bool) -> list[tuple]:
    out, offset = [], 0
    for doc_id, start, ids, total in pieces:
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset, ids.tobytes() if with_ids else None, task))
        offset += len(ids)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE)], schema=PIECE)


def _pack(path: str, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        windows, rows = Windows(task << 36), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), path)
                for start in range(0, len(ids), WINDOW):
                    for number, pieces in windows.add((doc_id, start, ids[start:start + WINDOW], len(ids))):
                        rows += _rows(number, pieces, None, with_ids)
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
        # leftovers carry their ids, since merging may cut them again
        for i, (_, pieces) in enumerate(windows.open):
            rows += _rows(i, pieces, task, True)
        if rows:
            yield _batch(rows)

    return pack


def _merge(with_ids: bool):
    def merge(key: tuple, left: pa.Table) -> pa.Table:
        group = key[0].as_py()
        windows, rows = Windows((1 << 62) + (group << 32)), []
        items = sorted(left.select(["task", "sequence_id", "offset", "doc_id", "start", "doc_tokens", "ids"]).to_pylist(), key=lambda r: (r["task"], r["sequence_id"], r["offset"]))
        by_window: dict = {}
        for r in items:
            by_window.setdefault((r["task"], r["sequence_id"]), []).append(r)
        # the fullest first: the small ones then fill the gaps
        for pieces in sorted(by_window.values(), key=lambda p: -sum(len(r["ids"]) for r in p)):
            for r in pieces:
                for number, full in windows.add((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])):
                    rows += _rows(number, full, None, with_ids)
        for number, pieces in _poured(windows):
            rows += _rows(number, pieces, None, with_ids)
        return pa.Table.from_batches([_batch(rows)])

    return merge


def _poured(windows: Windows) -> Iterator[tuple[int, list]]:
    """What is open at the very end, poured together: the smallest windows are cut to fill the largest."""
    waiting = sorted(windows.open, key=lambda w: w[0])
    windows.open = []
    queue = [p for _, pieces in reversed(waiting) for p in pieces]
    n, current = 0, []
    for doc_id, start, ids, total in queue:
        while len(ids):
            head = min(len(ids), WINDOW - n)
            current.append((doc_id, start, ids[:head], total))
            n, start, ids = n + head, start + head, ids[head:]
            if n == WINDOW:
                yield windows._number(current)
                n, current = 0, []
    if current:
        yield windows._number(current)


def packed(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""
    path = path or vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = kept(docs.sparkSession, docs.mapInArrow(_pack(path, with_ids), PIECE_SQL), "pieces")
    full = pieces.filter("task is null")
    left = pieces.filter("task is not null").groupBy((F.col("task") / MERGED).cast("int").alias("group")).applyInArrow(_merge(with_ids), PIECE_SQL)
    return full.unionByName(left).drop("task", *[] if with_ids else ["ids"])
