"""Where windows of consecutive units (words or bytes) occur again: what the two operators on repeats share.

Windows are found without sending them all around:

1. Texts are gathered into blocks of whole documents, written once to a table bucketed by block, so
   that later joins on the block move only the small side.
2. A window's *anchor* is the smallest hash among the runs of ``gram`` units in it. Equal windows have
   equal anchors, and neighbouring windows mostly share one, so a block sends each owner of a range of
   anchors a few numbers for each run of windows. The owner replies with two bits: the anchor occurs
   again somewhere, and it occurs very often.
3. Only windows whose anchor recurs leave their block, as *fragments*: the units under a run of
   windows with one anchor, each distinct fragment once, with its first place in the block. A shard gets
   all fragments of an anchor. Windows of very frequent anchors go one by one, dealt by their own
   content, so that a passage in a third of all documents meets in no task.
4. A shard says for each window of a fragment whether it also starts earlier (the operators do that by
   their own methods). In the block, later places of the same fragment are repeats at once.

The order of places is (doc_id, start) or doc_id alone; a null doc_id comes last, and rows that share a
doc_id are one document to this order. Hash collisions can only add candidates: fragments and windows are
compared by content. Nothing depends on how rows are dealt over tasks.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import kept, partitions
from talentloom.session import scratch_path

BLOCK_BYTES = 2 << 20
OWNER_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
#: Units hashed at a time, whatever the length of a document.
SEGMENT = 1 << 16
#: Windows in a fragment at most; text of one repeated syllable has long runs.
RUN = 64
#: An anchor with more places than this counts as very frequent.
FREQUENT = 4096
NO_RUNS = np.array([], np.uint64), *(np.array([], np.int64) for _ in range(4))
LAST = np.iinfo(np.int64).max
#: doc_id, place, bytes and windows of a fragment
HEAD = "<i8", "<u4", "<u4", "u1"
BASE = 0x9E3779B97F4A7C15
REPORT = ["n_units long", "n_removed long", "n_spans long", "kept_sha256 string"]


@dataclass(frozen=True)
class Kind:
    """What a unit is. ``judge(fragments) -> bits`` is the operator's method in a shard."""

    words: bool
    window: int
    gram: int
    within: bool  # also windows that start earlier in the same document
    judge: Callable[[list["Fragment"]], list[np.ndarray]]


class Fragment(NamedTuple):
    content: bytes
    doc: int
    start: int
    windows: int


# --- blocks -------------------------------------------------------------------------------------


def _blocks(words: bool):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 28
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([b"".join(texts)], pa.binary()), pa.array([size], pa.int64()),
            ], ["block", "ids", "lengths", "data", "n_bytes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if words:
                    data = b" ".join(data.split())  # splits at the six white-space bytes and no others
                if ids and size + len(data) > BLOCK_BYTES:
                    yield flush()
                    block, ids, texts, size = block + 1, [], [], 0
                ids.append(doc_id)
                texts.append(data)
                size += len(data)
        if ids:
            yield flush()

    return build


def blocks(docs: DataFrame, words: bool) -> DataFrame:
    """(block, ids, lengths, data, n_bytes), bucketed by block."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(words), "block long, ids array<long>, lengths array<long>, data binary, n_bytes long")
    name = f"blocks_{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").bucketBy(max(16, partitions(spark)), "block").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def _powers(n: int, known: list[np.ndarray] = [np.ones(1, np.uint64)] * 2) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, ``n`` or more; a worker keeps the most it has needed."""
    if len(known[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                known[i] = np.cumprod(factors, dtype=np.uint64)
    return known


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch [s, e) of bytes; it depends on these bytes alone."""
    up, down = _powers(1 << max(16, len(buf).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64, out=total[1:])
        return _mix((total[e] - total[s]) * down[s])


def _marked(n: int, *places: np.ndarray) -> np.ndarray:
    """The given places below ``n``, in order."""
    mark = np.zeros(n, bool)
    for p in places:
        mark[p] = True
    return np.flatnonzero(mark)


class Block:
    """A block's units, and its windows grouped into runs of one anchor."""

    def __init__(self, kind: Kind, ids: list, lengths: list, data: bytes) -> None:
        self.kind, self.ids, self.data = kind, ids, data
        self.buf = np.frombuffer(data, np.uint8)
        self.doc_end = np.cumsum(np.array(lengths, np.int64))
        self.doc_start = self.doc_end - np.array(lengths, np.int64)
        self.order = np.array([LAST if i is None else i for i in ids], np.int64)
        if kind.words:
            # a word starts behind a space or where a document starts
            space = np.flatnonzero(self.buf == 32)
            filled = self.doc_end > self.doc_start
            self.start = _marked(len(data), space + 1, self.doc_start[filled])
            self.end = _marked(len(data) + 1, space, self.doc_end[filled])
        else:
            self.start = np.arange(len(self.buf), dtype=np.int64)
            self.end = self.start + 1
        #: the first unit of each document, and the number of units
        self.first = np.searchsorted(self.start, self.doc_start)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.first = np.where(self.count > 0, self.first, 0)
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), self.count)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, document, first unit, number of windows, times) of each run.

        ``times`` is how often the run itself holds its anchor, where windows of one document count: in
        text of a short period, a window can start again within its own run.
        """
        found = [self._runs(a, min(a + SEGMENT, len(self.start))) for a in range(0, len(self.start), SEGMENT)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else NO_RUNS

    def _runs(self, a: int, z: int):
        """Runs of the windows that start in units [a, z)."""
        size, gram = self.kind.window, self.kind.gram
        last = min(z + size - 1, len(self.start))  # units looked at: [a, last)
        if last - a < size:
            return NO_RUNS
        low, high = int(self.start[a]), int(self.end[last - 1])
        h = hashes(self.buf[low:high], self.start[a: last - gram + 1] - low, self.end[a + gram - 1: last] - low)
        grams, w, step = h, size - gram + 1, 1
        while step * 2 <= w:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        n_windows = last - a - size + 1
        h = np.minimum(h[:n_windows], h[w - step: w - step + n_windows])
        n_windows = min(n_windows, z - a)
        h = h[:n_windows]
        at = np.arange(a, a + n_windows)
        doc = self.doc[a: a + n_windows]
        ok = doc == self.doc[a + size - 1: a + size - 1 + n_windows]
        h, at, doc = h[ok], at[ok], doc[ok]
        if not len(h):
            return NO_RUNS
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])]))
        length = np.diff(np.append(new, len(h)))
        pieces = -(-length // RUN)
        if (pieces > 1).any():
            base = np.repeat(new, pieces)
            nth = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = np.repeat(length, pieces) - nth * RUN
            new, length = base + nth * RUN, np.minimum(left, RUN)
        times = np.ones(len(new), np.int64)
        if self.kind.within:
            span = length + w - 1
            offset = np.cumsum(span) - span
            inside = np.repeat(at[new] - a - offset, span) + np.arange(span.sum())
            times = np.add.reduceat((grams[inside] == np.repeat(h[new], span)).astype(np.int64), offset)
        return _mix(h[new]), doc[new], at[new], length, times


# --- step 2: which anchors recur ------------------------------------------------------------------


def _anchors(kind: Kind, owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, lengths, data = (batch.column(i)[row].as_py() for i in range(4))
                anchor, _, _, _, times = Block(kind, ids, lengths, data).runs()
                distinct, where = np.unique(anchor, return_inverse=True)
                count = np.bincount(where, weights=times, minlength=len(distinct))
                owner = (distinct % np.uint64(owners)).astype(np.int64)
                by_owner = np.argsort(owner, kind="stable")
                cuts = np.flatnonzero(np.diff(owner[by_owner], prepend=-1))
                parts = np.split(by_owner, cuts[1:]) if len(by_owner) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(parts), pa.int64()), pa.array([int(owner[p[0]]) for p in parts], pa.int64()),
                    pa.array([(distinct[p] >> np.uint64(32)).astype("<u4").tobytes() for p in parts], pa.binary()),
                    pa.array([np.minimum(count[p], 255).astype(np.uint8).tobytes() for p in parts], pa.binary()),
                ], ["block", "owner", "anchors", "counts"])

    return send


def _recurring(messages: pa.Table) -> pa.Table:
    """One owner: two rows of bits for each message (recurs, is very frequent)."""
    anchors = [np.frombuffer(x, "<u4") for x in messages["anchors"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in messages["counts"].to_pylist()])
    _, where = np.unique(np.concatenate(anchors), return_inverse=True)
    total = np.bincount(where, weights=counts)[where]
    cuts = np.cumsum([len(x) for x in anchors])[:-1]
    bits = [np.packbits(np.stack([t > 1, t > FREQUENT])).tobytes() for t in np.split(total, cuts)]
    return pa.table({"block": messages["block"], "owner": messages["owner"], "bits": pa.array(bits, pa.binary())})


def _flags(anchor: np.ndarray, owners: int, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each run of a block."""
    distinct, where = np.unique(anchor, return_inverse=True)
    owner = (distinct % np.uint64(owners)).astype(np.int64)
    by_owner = np.argsort(owner, kind="stable")
    recurs, often = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    for r in replies:
        a, z = np.searchsorted(owner[by_owner], [r["owner"], r["owner"] + 1])
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: 2 * (z - a)].reshape(2, z - a).astype(bool)
        recurs[by_owner[a:z]], often[by_owner[a:z]] = bits
    return recurs[where], often[where]


# --- step 3: fragments -------------------------------------------------------------------------------


def _fragments(kind: Kind, owners: int, shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, lengths, data, replies = (batch.column(i)[row].as_py() for i in range(5))
                b = Block(kind, ids, lengths, data)
                state, messages = _sent(b, owners, shards, replies or [])
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * (len(messages) + 1), pa.int64()), pa.array([None, *[s for s, _ in messages]], pa.int64()),
                    pa.array([state, *[m for _, m in messages]], pa.binary()),
                ], ["block", "shard", "payload"])

    return send


def _sent(b: Block, owners: int, shards: int, replies: list[dict]) -> tuple[bytes, list[tuple[int, bytes]]]:
    kind = b.kind
    anchor, doc, first, n, _ = b.runs()
    recurs, often = _flags(anchor, owners, replies)
    anchor, doc, first, n, often = (x[recurs] for x in (anchor, doc, first, n, often))
    # windows of very frequent anchors one by one
    repeat = np.where(often, n, 1)
    nth = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    anchor, doc, often = np.repeat(anchor, repeat), np.repeat(doc, repeat), np.repeat(often, repeat)
    first, n = np.repeat(first, repeat) + nth, np.where(often, 1, np.repeat(n, repeat))
    place = first - b.first[doc]
    by_place = np.lexsort((place, b.order[doc]))
    anchor, doc, often, first, n, place = (x[by_place] for x in (anchor, doc, often, first, n, place))
    low, high = b.start[first].tolist(), b.end[first + n + kind.window - 2].tolist()
    # each distinct fragment by a number, in the order in which they are seen; ids and places at which it was seen first
    data = b.data
    cut = [data[s:e] for s, e in zip(low, high)]
    seen: dict[bytes, int] = {}
    content = np.array([seen.setdefault(c, len(seen)) for c in cut], np.int32)
    picked = np.flatnonzero(np.diff(np.maximum.accumulate(content), prepend=-1))
    order = b.order[doc]
    later = order != order[picked][content]
    if kind.within:
        later |= place != place[picked][content]
    shard = (anchor[picked] % np.uint64(shards)).astype(np.int64)
    for j in np.flatnonzero(often[picked]).tolist():
        shard[j] = int.from_bytes(hashlib.blake2b(cut[picked[j]], digest_size=8).digest(), "little") % shards
    by_shard = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[by_shard], prepend=-1))
    messages = []
    for part in np.split(by_shard, cuts[1:]) if len(by_shard) else []:
        at = picked[part]
        bodies = [cut[i] for i in at.tolist()]
        # column by column, places only where they count: neighbours are alike, which the compression finds
        columns = b.order[doc[at]], place[at] if kind.within else np.zeros(len(at)), [len(x) for x in bodies], n[at]
        head = b"".join(np.asarray(c).astype(t).tobytes() for c, t in zip(columns, HEAD))
        messages.append((int(shard[part[0]]), _packed(len(part).to_bytes(8, "little") + head + b"".join(bodies))))
    state = {"content": np.diff(content, prepend=0).astype(np.int32), "first": np.diff(first, prepend=0).astype(np.int32), "n": n.astype(np.uint8), "later": later, "shard": shard.astype(np.int32), "by_shard": by_shard.astype(np.int32), "windows": n[picked].astype(np.uint8)}
    return _packed(pickle.dumps(state, protocol=5)), messages


def _packed(data: bytes) -> bytes:
    return zstandard.compress(data, 6)


def _read(payload: bytes) -> list[Fragment]:
    payload = zstandard.decompress(payload)
    n = int.from_bytes(payload[:8], "little")
    at, columns = 8, []
    for kind in HEAD:
        columns.append(np.frombuffer(payload, kind, n, at))
        at += n * np.dtype(kind).itemsize
    doc, start, size, windows = columns
    ends = at + np.cumsum(size, dtype=np.int64)
    bodies = [payload[a:z] for a, z in zip((ends - size).tolist(), ends.tolist())]
    return list(map(Fragment, bodies, doc.tolist(), start.tolist(), windows.tolist()))


def _judged(kind: Kind):
    def judge(messages: pa.Table) -> pa.Table:
        lists = [_read(x) for x in messages["payload"].to_pylist()]
        bits = kind.judge([f for x in lists for f in x])
        out, at = [], 0
        for x in lists:
            out.append(np.packbits(np.concatenate(bits[at:at + len(x)])).tobytes())
            at += len(x)
        return pa.table({"block": messages["block"], "shard": messages["shard"], "payload": pa.array(out, pa.binary())})

    return judge


# --- the end: what stays -----------------------------------------------------------------------------


def removed_units(b: Block, state: dict, replies: dict[int, bytes]) -> np.ndarray:
    """True for each unit of the block that a repeated window covers."""
    content, first, n, later, windows = np.cumsum(state["content"]), np.cumsum(state["first"].astype(np.int64)), state["n"].astype(np.int64), state["later"], state["windows"].astype(np.int64)
    # where the bits of each distinct fragment begin, in all replies put end to end
    by_shard, shard = state["by_shard"], state["shard"]
    offset = np.zeros(len(windows), np.int64)
    streams, base = [], 0
    cuts = np.flatnonzero(np.diff(shard[by_shard], prepend=-1))
    for part in np.split(by_shard, cuts[1:]) if len(by_shard) else []:
        sizes = windows[part]
        offset[part] = base + np.cumsum(sizes) - sizes
        streams.append(np.unpackbits(np.frombuffer(replies[int(shard[part[0]])], np.uint8))[: sizes.sum()])
        base += int(sizes.sum())
    bits = np.concatenate(streams).astype(bool) if streams else np.zeros(0, bool)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(first, n) + nth
    gone = np.repeat(later, n) | bits[np.repeat(offset[content], n) + nth] if len(n) else np.zeros(0, bool)
    change = np.zeros(len(b.start) + 1, np.int64)
    starts = at[gone]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + b.kind.window, -1)
    return np.cumsum(change)[:-1] > 0


def _report(kind: Kind, with_text: bool):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, data, parts = (batch.column(i)[row].as_py() for i in range(1, 5))
                b = Block(kind, ids, lengths, data)
                by_shard = {p["shard"]: p["payload"] for p in parts}
                gone = removed_units(b, pickle.loads(zstandard.decompress(by_shard.pop(None))), by_shard)
                rows = [_kept(b, gone, i) for i in range(len(ids))]
                names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "spans", "text"]
                arrays = [pa.array(ids, pa.int64()), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows])]
                if with_text:
                    arrays += [pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([r[4] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return report


def _kept(b: Block, gone: np.ndarray, i: int) -> tuple[int, int, int, list[dict], bytes]:
    n = int(b.count[i])
    mine = gone[b.first[i]: b.first[i] + n]
    data = b.data[b.doc_start[i]: b.doc_end[i]]
    n_gone = int(mine.sum())
    if not n_gone:
        return n, 0, 0, [], data
    edge = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
    spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
    if b.kind.words:
        words = data.split(b" ")
        left = b" ".join([words[k] for k in np.flatnonzero(~mine).tolist()])
    else:
        left = np.frombuffer(data, np.uint8)[~mine].tobytes()
    return n, n_gone, len(spans), spans, left


def report(docs: DataFrame, kind: Kind, with_text: bool = False) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept_sha256[, spans, text]): one row for each row of ``docs``.

    ``spans`` are the removed runs in units of the document, ``text`` the bytes that stay.
    """
    spark = docs.sparkSession
    table = blocks(docs, kind.words)
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    owners = max(partitions(spark), -(-total // OWNER_BYTES))
    shards = max(partitions(spark), -(-total // SHARD_BYTES))
    sent = table.select("block", "ids", "lengths", "data").mapInArrow(_anchors(kind, owners), "block long, owner long, anchors binary, counts binary")
    found = sent.groupBy("owner").applyInArrow(_recurring, "block long, owner long, bits binary")
    replies = found.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("replies"))
    body = table.select("block", "ids", "lengths", "data")
    fragments = kept(spark, body.join(replies, "block", "left").mapInArrow(_fragments(kind, owners, shards), "block long, shard long, payload binary"), "fragments")
    verdicts = fragments.filter("shard is not null").groupBy("shard").applyInArrow(_judged(kind), "block long, shard long, payload binary")
    parts = fragments.filter("shard is null").unionByName(verdicts).groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias("parts"))
    schema = ["doc_id long", *REPORT, *(["spans array<struct<start:long,end:long>>", "text binary"] if with_text else [])]
    return body.join(parts, "block").mapInArrow(_report(kind, with_text), ", ".join(schema))
