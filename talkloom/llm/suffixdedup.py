"""Repeated byte windows removed by a depth-limited most-significant-digit radix sort of suffixes.

A suffix is taken through its first ``DEPTH`` = 100 bytes, its window; equal windows are what is left together after the
last digit, so nothing deeper is ever compared. The first of a group (smaller doc_id, then earlier start) stays, the bytes
of the others go. The digits are:

1. The pivot: of the 32-byte strings in the window, the one of the smallest hash (the leftmost of equals). It depends on
   the window alone, so equal windows share it. Windows that follow each other mostly share a pivot too, and such a run
   (35 windows on average) is one record here: all suffixes are dealt by this digit at a cost of one record a run, and
   runs whose pivot stands alone are dropped.
2. The run: its bytes, from its first window's beginning to its last one's end. Runs that are equal throughout hold equal
   windows in equal order, so all of them but the first are settled, window by window. Under a pivot with one kind of run
   there is nothing more to do.
3. The whole window, for the windows of the first run of each kind where a pivot has several kinds: these are the edges of
   repeats. All but the first of an equal group go.

Digits are hashes: 64 bits of the pivot and 64 of the run under it, 95 of a window. Equal records of one batch are put together before
a shuffle, so a frequent run or window meets itself once a batch; pivots with a thousandth of all runs or more, which are
a thousand at most, are dealt by pivot and run. Groups are told apart by streaming over sorted partitions: no group is held.
Texts cross a shuffle twice, compressed, to where the records of their document are.

Defined cases: null is empty text; a document without repeats is returned as it is; rows that repeat doc_id and text are
one document stated again and get one result; rows that repeat a doc_id with other texts are documents of their own, in the
order of a hash of the text; a null doc_id comes last. doc_id is an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.sources.scratch import cut, drop_cut

DEPTH = 100
PIVOT = 32
#: Windows of a block: arrays of this length stay in the cache.
BLOCK = 1 << 17
#: A pivot is hot if it has this share of all runs.
HOT = 1000
LAST_ID = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[int, tuple] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and the powers of the base and of its inverse modulo 2^64."""
    if not _TABLES or len(_TABLES[0][1]) < n:
        m = 1 << 64
        n = max(n, BLOCK + 4096)

        def of(base: int) -> np.ndarray:
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        with np.errstate(over="ignore"):
            _TABLES[0] = (np.random.default_rng(7).integers(0, m - 1, 256, np.uint64), of(_BASE), of(pow(_BASE, -1, m)))
    return _TABLES[0]


def pivot_keys(data: np.ndarray, pivot: int = PIVOT) -> np.ndarray:
    """A mixed hash of the ``pivot`` bytes from each place of ``data``."""
    byte, up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte[data] * up[: len(data)], out=sums[1:])
        h = (sums[pivot:] - sums[:-pivot]) * down[: len(data) - pivot + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, have = keys, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(keys) - width + 1], out[width - have : width - have + len(keys) - width + 1])


def runs(data: np.ndarray, valid: np.ndarray, depth: int = DEPTH, pivot: int = PIVOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, number of windows, pivot hash) of the runs of windows in ``data``; ``valid`` marks windows inside one document."""
    n = len(data) - depth + 1
    keys = pivot_keys(data, pivot)
    ranked = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    at = (_least(ranked, depth - pivot + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    at = np.where(valid[:n], at, -1)
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    lengths = np.diff(np.append(begins, n))
    real = at[begins] >= 0
    return begins[real], lengths[real], keys[at[begins[real]]]


def _pieces(offsets: np.ndarray, depth: int) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of (document, from, to): a long text is cut into pieces that overlap by ``depth`` - 1 bytes."""
    block, size = [], 0
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a >= depth:
            end = min(b, a + BLOCK + depth - 1)
            block.append((i, a, end))
            size += end - a
            if size >= BLOCK:
                yield block
                block, size = [], 0
            if end == b:
                break
            a = end - depth + 1
    if block:
        yield block


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def batch_runs(column: pa.Array, depth: int = DEPTH, pivot: int = PIVOT) -> tuple[np.ndarray, ...]:
    """(document number, begin in its text, windows, pivot hash, run hash) of all runs of a batch of texts."""
    offsets, data = _binary(column)
    out: list[tuple] = []
    digest = xxhash.xxh3_64_intdigest
    for block in _pieces(offsets, depth):
        buf = np.concatenate([data[a:b] for _, a, b in block])
        whole = buf.tobytes()
        ends = np.cumsum([b - a for _, a, b in block])
        begins = np.concatenate([[0], ends[:-1]])
        valid = np.ones(len(buf), bool)
        for k in range(1, depth):
            valid[ends - k] = False
        at, n, h = runs(buf, valid, depth, pivot)
        which = np.searchsorted(ends, at, "right")
        first = np.array([a for _, a, _ in block], np.int64)
        doc = np.array([i for i, _, _ in block], np.int64)[which]
        ctx = np.array([digest(whole[a:b]) for a, b in zip(at.tolist(), (at + n + depth - 1).tolist(), strict=True)], np.uint64)
        out.append((doc, at - begins[which] + first[which] - offsets[doc], n, h, ctx))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first_of_equals(a: np.ndarray, b: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """For each record the number of the first, in ``order``, of those with the same ``a`` and ``b``."""
    by = np.lexsort((*order[::-1], b, a))
    new = np.concatenate([[True], (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])])
    out = np.empty(len(a), np.int64)
    out[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


#: A record: two digits, the document's key, and its place << 10 | hot << 9 | told << 8 | number of windows. ``told``: the batch
#: has an earlier equal one; ``hot``: it is dealt by both digits.
_RECORD = "one long, two long, doc long, tie long, at long"
TOLD, OPEN = 1 << 8, 1 << 9


def _records(one, two, doc, tie, at, hot=None) -> pa.RecordBatch:
    first = _first_of_equals(one, two, doc, tie, at)
    told = (doc != doc[first]) | (tie != tie[first]) | (at != at[first])
    keep = told | (first == np.arange(len(first)))  # without rows stated again
    if hot is not None:
        one, at = np.where(hot, one ^ two, one), np.where(hot, at | OPEN, at)
    with np.errstate(over="ignore"):  # told records need no group and are dealt evenly
        spread = (doc * 31 + at) * np.int64(0x2545F4914F6CDD1D)
    one, two, at = np.where(told, spread, one), np.where(told, 0, two), np.where(told, at | TOLD, at)
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (one, two, doc, tie, at)], names=["one", "two", "doc", "tie", "at"])


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("tie").to_numpy(zero_copy_only=False).astype(np.int64)


def _heavy(depth: int, pivot: int, share: int):
    """Of each batch the pivots that have one in ``share`` of its runs or more, and under a null pivot the number of its runs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, _, h, ctx = batch_runs(batch.column("body"), depth, pivot)
            if not len(h):
                continue
            kinds = np.unique(np.stack([h, ctx]), axis=1)[0]
            v, n = np.unique(kinds, return_counts=True)
            hot = n * share >= len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array([None, *v[hot].view(np.int64).tolist()], pa.int64()), pa.array([len(kinds), *n[hot].tolist()], pa.int64())], names=["one", "n"])

    return of


def _run_records(hot: np.ndarray, depth: int, pivot: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = _keys(batch)
            i, at, n, h, ctx = batch_runs(batch.column("body"), depth, pivot)
            h, ctx = h.view(np.int64), ctx.view(np.int64)
            yield _records(h, ctx, doc[i], tie[i], at << 10 | n, np.isin(h, hot))

    return of


def _settle(opens: bool):
    """Records sorted by digits, document and place: those that aren't the first of their group are ``gone``. With ``opens``
    the firsts of groups that share digit one with another group, and of hot ones, come out too, not gone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # digit one, digit two and the first record of the group so far; a first whose digit one has no other group yet
        group = kind = first = held = None
        for batch in batches:
            one, two, doc, tie, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("one", "two", "doc", "tie", "at"))
            told = (at & TOLD) > 0
            out = [np.stack([doc, tie, at])[:, told]]
            one, two, doc, tie, at = (c[~told] for c in (one, two, doc, tie, at))
            n = len(one)
            still = []
            if n:
                g, k = np.empty(n, bool), np.empty(n, bool)
                g[0], k[0] = one[0] != group, one[0] != group or two[0] != kind
                g[1:] = one[1:] != one[:-1]
                k[1:] = g[1:] | (two[1:] != two[:-1])
                begin = np.maximum.accumulate(np.where(k, np.arange(n), -1))
                carried = (0, 0, 0) if first is None else first
                of_first = [np.where(begin >= 0, x[begin], c) for x, c in zip((doc, tie, at), carried, strict=True)]
                later = ~k & ((doc != of_first[0]) | (tie != of_first[1]) | (at != of_first[2]))
                out.append(np.stack([doc, tie, at])[:, later])
                firsts = np.flatnonzero(k) if opens else []
                if len(firsts):
                    other = ~g[firsts]
                    follows = np.append(other[1:], False)  # the next group has the same digit one
                    is_open = ((at[firsts] & OPEN) > 0) | other | follows
                    if held is not None and other[0]:  # so has the first group after the batch before
                        still.append(np.array([held]).T)
                    held = None if is_open[-1] else tuple(x[firsts[-1]] for x in (doc, tie, at))
                    still.append(np.stack([doc, tie, at])[:, firsts[is_open]])
                group, kind, first = one[-1], two[-1], tuple(x[-1] for x in of_first)
            gone, still = np.concatenate(out, axis=1), np.concatenate(still, axis=1) if still else np.zeros((3, 0), np.int64)
            rows = np.concatenate([gone, still], axis=1)
            rows[2] = rows[2] >> 10 << 8 | rows[2] & 255
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.arange(rows.shape[1]) < gone.shape[1])], names=["doc", "tie", "at", "gone"])

    return of


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``body`` compressed, for its way through a shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        body = pa.array([pack(x or b"") for x in batch.column("body").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), batch.column("tie"), body], names=["doc_id", "doc", "tie", "body"])


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _window_records(depth: int, most: int = 200_000):
    """The windows of each document's open runs, ``most`` or a document's at a time."""
    digest = xxhash.xxh3_128_digest

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = _keys(batch)
            digits: list[bytes] = []
            which: list[np.ndarray] = []
            where: list[np.ndarray] = []
            for i, (blob, ats) in enumerate(zip(batch.column("body"), batch.column("ats"), strict=True)):
                body, ats = _unpack(blob.as_py()), np.unique(ats.values.to_numpy())
                n = ats & 255
                places = np.repeat((ats >> 8) - np.cumsum(n) + n, n) + np.arange(n.sum())
                digits += [digest(body[p : p + depth]) for p in places.tolist()]
                which.append(np.full(len(places), i))
                where.append(places)
                if len(digits) >= most or i == batch.num_rows - 1:
                    both = np.frombuffer(b"".join(digits), np.int64).reshape(-1, 2)
                    of_doc, at = np.concatenate(which), np.concatenate(where)
                    yield _records(both[:, 0], both[:, 1] & 0x7FFFFFFF, doc[of_doc], tie[of_doc], at << 10 | 1)
                    digits, which, where = [], [], []

    return of


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without(body: bytes, ats: np.ndarray, depth: int = DEPTH) -> tuple[bytes, int, int]:
    """(kept bytes, number removed, number of maximal removed runs)."""
    edges = np.zeros(len(body) + 1, np.int32)
    np.add.at(edges, ats >> 8, 1)
    np.add.at(edges, (ats >> 8) + (ats & 255) + depth - 1, -1)
    off = np.cumsum(edges[:-1]) > 0
    kept = np.frombuffer(body, np.uint8)[~off].tobytes()
    return kept, int(off.sum()), int((off[1:] & ~off[:-1]).sum() + (off[:1].sum()))


def _results(depth: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, blob, ats in zip(batch.column("doc_id").to_pylist(), batch.column("body"), batch.column("ats"), strict=True):
                body, removed, spans = _unpack(blob.as_py()), 0, 0
                n = len(body)
                if ats.is_valid:
                    body, removed, spans = without(body, ats.values.to_numpy(), depth)
                rows.append((name, n, removed, spans, hashlib.sha256(body).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return of


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, doc, tie, body): ``doc`` and ``tie`` order documents; ``tie`` is zero where doc_ids don't repeat."""
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    again = not ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    tie = F.xxhash64(body) if again else F.lit(0).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"), tie.alias("tie"), body.alias("body"))


def _sorted(records: DataFrame) -> DataFrame:
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(n, "one").sortWithinPartitions("one", "two", "doc", "tie", "at")


def repeats(rows: DataFrame, depth: int = DEPTH, pivot: int = PIVOT, share: int = HOT) -> DataFrame:
    """(doc, tie, ats): what goes of each document, as place << 8 | number of windows, over ``keyed`` rows."""
    if not 2 <= pivot <= depth <= 256 + pivot - 2:
        raise ValueError("a window holds a pivot, and a run of windows has 255 at most")
    long = rows.where(F.octet_length("body") >= depth)
    heavy = long.select("body").mapInArrow(_heavy(depth, pivot, share), "one long, n long").groupBy("one").agg(F.sum("n").alias("n"))
    heavy = cut(heavy, "suffix-heavy")
    total = heavy.where("one IS NULL").agg(F.sum("n")).first()[0] or 0
    hot = np.array(sorted(r.one for r in heavy.where(F.col("one").isNotNull() & (F.col("n") * share >= total)).select("one").collect()), np.int64)
    drop_cut(heavy)
    dealt = _sorted(long.select("doc", "tie", "body").mapInArrow(_run_records(hot, depth, pivot), _RECORD))
    found = cut(dealt.mapInArrow(_settle(True), "doc long, tie long, at long, gone boolean"), "suffix-runs")
    of_doc = found.where("NOT gone").groupBy("doc", "tie").agg(F.collect_list("at").alias("ats"))
    packed = long.mapInArrow(_packed, "doc_id long, doc long, tie long, body binary")
    windows = packed.join(of_doc, ["doc", "tie"]).select("doc", "tie", "body", "ats").mapInArrow(_window_records(depth), _RECORD)
    edges = cut(_sorted(windows).mapInArrow(_settle(False), "doc long, tie long, at long, gone boolean"), "suffix-windows")
    gone = found.where("gone").unionByName(edges)
    return gone.groupBy("doc", "tie").agg(F.collect_list("at").alias("ats"))


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, pivot: int = PIVOT, share: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    rows = keyed(docs, doc_id, text)
    lists = repeats(rows, depth, pivot, share)
    packed = rows.mapInArrow(_packed, "doc_id long, doc long, tie long, body binary")
    return packed.join(lists, ["doc", "tie"], "left").select("doc_id", "body", "ats").mapInArrow(_results(depth), _RESULT)


def op13(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    return deduped(docs)
