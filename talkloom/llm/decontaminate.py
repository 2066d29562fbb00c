"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each task cuts its documents into shards of a few MB, sorts all word suffixes of a shard, and binary-searches every
suffix of every benchmark item in it, a word further at a time. The range of the suffix array that still matches at a depth holds all
places of a match that long, so each document gets its own longest match, whatever else is in its shard. No document leaves its task
and nothing is shuffled. The items are the small side: they are sent along up to ``item_block_bytes`` of text at a time. Larger
benchmarks are searched block by block, one after the other, each over all documents; the findings of a block go to a table of the shared
folder, by row number, and are merged at the end, so neither the driver nor a task ever holds more than one block.

Defined cases: null or empty text has no words and no hit; null item ids or items without words are no items; an item
id that occurs twice counts once, if any of its texts occurs; repeated document rows are each reported; an empty
benchmark leaves all documents clean. Of several longest matches the first place in the document is told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.bytewords import Words, as_bytes, blocks
from talkloom.llm.rows import packed, unpacked
from talkloom.sources.scratch import cut

WINDOW = 10
SHARD_BYTES = 4 << 20
ITEM_BLOCK_BYTES = 8 << 20

RESULT = "n_words long, n_hit long, longest_words long, longest_at long, items array<string>, spans array<long>"


def suffix_array(h: np.ndarray, depth: int) -> np.ndarray:
    """Word positions in the order of the suffixes from there, compared over ``depth`` words, by prefix doubling.

    Only suffixes that still tie are sorted again.
    """
    n = len(h)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    new = np.ones(n, bool)
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    at = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    slots = np.arange(n)
    done = 1
    while done < depth:
        single = new & np.append(new[1:], True)
        slots = slots[~single[slots]]
        if not len(slots):
            break
        here = order[slots]
        after = here + done
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1) + 1
        first = rank[here]
        by = np.lexsort((second, first)) if n >= 1 << 31 else np.argsort(first * (n + 1) + second, kind="stable")
        here, first, second = here[by], first[by], second[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        order[slots] = here
        new[slots] = fresh
        at = np.flatnonzero(fresh)
        rank[here] = np.repeat(slots[at], np.diff(np.append(at, len(slots))))
        done *= 2
    return order


class Items:
    """Benchmark items as hashed words, with every suffix of every item as a query."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int = WINDOW):
        w = Words(texts)
        n = np.bincount(w.doc, minlength=len(texts)).astype(np.int64)
        begin = np.cumsum(n) - n
        self.ids, self.hash = ids, w.hash
        self.item = w.doc
        self.at = np.arange(len(w.hash)) - begin[w.doc]
        self.left = n[w.doc] - self.at
        self.width = np.minimum(n, window)[w.doc]
        self.depth = int(n.max(initial=0))


def search(h: np.ndarray, order: np.ndarray, q: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place in ``order`` the words of the longest match of any item suffix that begins there; and for each suffix of
    the items the range of ``order`` that matches a whole window (empty if none)."""
    m = len(q.hash)
    long = np.zeros(len(order), np.int64)
    w_lo, w_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    key = h[order]
    lo, hi = np.searchsorted(key, q.hash, "left"), np.searchsorted(key, q.hash, "right")
    live = np.flatnonzero(hi > lo)
    lo, hi, t = lo[live], hi[live], 1
    while len(live):
        # ranges of one depth are equal or apart
        first, of = np.unique(lo, return_index=True)
        size = hi[of] - first
        long[np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = t
        full = q.width[live] == t
        w_lo[live[full]], w_hi[live[full]] = lo[full], hi[full]
        go = q.left[live] > t
        live, lo, hi = live[go], lo[go], hi[go]
        want = q.hash[live + t]
        lo, hi = _bound(h, order, lo, hi, t, want, False), _bound(h, order, lo, hi, t, want, True)
        go = hi > lo
        live, lo, hi, t = live[go], lo[go], hi[go], t + 1
    return long, w_lo, w_hi


def _bound(h, order, lo, hi, t, want, after: bool):
    lo, hi = lo.copy(), hi.copy()
    n = len(h)
    while True:
        act = np.flatnonzero(lo < hi)
        if not len(act):
            return lo
        mid = (lo[act] + hi[act]) >> 1
        p = order[mid] + t
        v = np.where(p < n, h[np.minimum(p, n - 1)], np.uint64(0))
        right = v <= want[act] if after else v < want[act]
        lo[act[right]] = mid[right] + 1
        hi[act[~right]] = mid[~right]


def scan_shard(texts: list[bytes], q: Items) -> pd.DataFrame:
    """The findings of ``RESULT`` for each of ``texts``."""
    w = Words(texts)
    k, n_docs = len(w.hash), len(texts)
    n_words = np.bincount(w.doc, minlength=n_docs).astype(np.int64)
    out = pd.DataFrame({"n_words": n_words, "n_hit": np.zeros(n_docs, np.int64), "longest_words": np.zeros(n_docs, np.int64), "longest_at": np.full(n_docs, -1, np.int64)})
    out["items"] = [[] for _ in range(n_docs)]
    out["spans"] = [[] for _ in range(n_docs)]
    if not k or not len(q.hash):
        return out
    # a separator of its own after each text, below all word hashes, so that no match goes on into the next text
    place = np.arange(k) + w.doc
    h = np.empty(k + n_docs, np.uint64)
    ends = np.cumsum(n_words) + np.arange(n_docs)
    h[ends] = np.arange(n_docs, dtype=np.uint64) + np.uint64(1)
    h[place] = w.hash
    doc_at = np.empty(k + n_docs, np.int64)
    doc_at[place], doc_at[ends] = w.doc, np.arange(n_docs)
    order = suffix_array(h, q.depth)
    by_order, lo, hi = search(h, order, q)
    first = np.cumsum(n_words) - n_words + np.arange(n_docs)
    long = np.empty_like(by_order)
    long[order] = by_order
    best = np.maximum.reduceat(long, first)
    at_best = np.flatnonzero((long > 0) & (long == best[doc_at]))
    docs, earliest = np.unique(doc_at[at_best], return_index=True)
    where = np.full(n_docs, -1, np.int64)
    where[docs] = at_best[earliest] - first[docs]
    out["longest_words"], out["longest_at"] = best, where
    found = np.flatnonzero(hi > lo)
    if len(found):
        # ranges of one width are equal or apart: each is written out once, whatever the number of suffixes that have it
        ranges, of = np.unique(q.width[found] * (len(order) + 1) + lo[found], return_inverse=True)
        one = np.empty(len(ranges), np.int64)
        one[of] = found
        count = hi[one] - lo[one]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at, width = order[np.repeat(lo[one], count) + offset], np.repeat(q.width[one], count)
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + width, -1)
        hit = np.cumsum(step[:-1]) > 0
        out["n_hit"] = np.bincount(doc_at[hit], minlength=n_docs).astype(np.int64)
        # the documents of each range, and then the items of each document's ranges
        holds = np.unique(np.repeat(np.arange(len(ranges)), count) * n_docs + doc_at[at])
        has = np.unique(of * len(q.ids) + q.item[found])
        first_item = np.searchsorted(has // len(q.ids), np.arange(len(ranges) + 1))
        in_range = holds // n_docs
        many = np.diff(first_item)[in_range]
        which = np.repeat(first_item[in_range], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        items: dict[int, set[str]] = {}
        for pair in np.unique(np.repeat(holds % n_docs, many) * len(q.ids) + has[which] % len(q.ids)).tolist():
            items.setdefault(pair // len(q.ids), set()).add(q.ids[pair % len(q.ids)])
        for d, ids in items.items():
            out.at[d, "items"] = sorted(ids)
        turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).view(np.int8)))
        spans: dict[int, list[int]] = {}
        for a, b in zip(turn[0::2], turn[1::2], strict=True):
            d = int(doc_at[a])
            spans.setdefault(d, []).extend((int(a - first[d]), int(b - first[d])))
        for d, ends in spans.items():
            out.at[d, "spans"] = ends
    return out


def merge_blocks(parts: list[dict]) -> dict:
    """The findings in one document of several blocks of items as one."""
    best = max(parts, key=lambda p: (p["longest_words"], -p["longest_at"]))
    inside = sorted((a, b) for p in parts for a, b in zip(p["spans"][0::2], p["spans"][1::2], strict=True))
    merged: list[int] = []
    for a, b in inside:
        if merged and a <= merged[-1]:
            merged[-1] = max(merged[-1], b)
        else:
            merged += [a, b]
    hit = sum(merged[1::2]) - sum(merged[0::2])
    return best | {"n_hit": hit, "items": sorted({i for p in parts for i in p["items"]}), "spans": merged}


def _items_of(benchmark: DataFrame, item_id: str, item_text: str):
    return benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))


def _scanner(sent, window: int):
    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        q = Items(*sent.value, window)
        for batch in batches:
            parts = [scan_shard(part, q) for _, part in blocks(as_bytes(batch), SHARD_BYTES)]
            yield pd.concat(parts, ignore_index=True) if parts else scan_shard([], q)

    return scan


def findings(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, into: str = "_found", item_block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``into`` of RESULT: its words, the words inside an occurrence of a window, its longest
    verbatim match of any item suffix and where that begins, and the items found."""
    spark = docs.sparkSession
    items = _items_of(benchmark, item_id, item_text)
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("i")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // item_block_bytes))

    def scanner(block: int):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        rows = sorted(tuple(r) for r in rows.collect())
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1].encode("utf-8", "surrogatepass") for r in rows]))
        return _scanner(sent, window), sent

    if n_blocks == 1:
        return docs.withColumn(into, scanner(0)[0](F.col(text)))
    rows = cut(packed(docs, _scanned=F.col(text), _nth=F.monotonically_increasing_id()), "decontaminate-rows")
    parts = []
    for b in range(n_blocks):
        scan, sent = scanner(b)
        found = rows.select("_nth", scan("_scanned").alias("f"))
        # what a block doesn't find needs no row but the first block's, which has the number of words
        parts.append(cut(found if b == 0 else found.where("f.longest_words > 0"), "decontaminate-found"))
        sent.unpersist()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)

    @F.pandas_udf(RESULT)
    def merge(fs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([merge_blocks(list(f)) for f in fs], columns=[x.split()[0] for x in RESULT.split(", ")])

    merged = every.groupBy("_nth").agg(F.collect_list("f").alias("fs")).select(F.col("_nth").alias("_of_nth"), merge("fs").alias("_merged"))
    joined = rows.join(merged, F.col("_nth") == F.col("_of_nth"))
    return unpacked(joined, docs, **{into: F.col("_merged")})


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, longest_words, longest_at."""
    f = findings(docs.select("doc_id", "text"), benchmark)
    items = F.col("_found.items")
    return f.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        F.col("_found.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("_found.n_hit") > 0).alias("contaminated"),
        F.col("_found.longest_words").alias("longest_words"),
        F.col("_found.longest_at").alias("longest_at"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a window of an item."""
    found = findings(packed(docs, _text=F.col("text")), benchmark, "_text")
    return unpacked(found.where(F.col("_found.n_hit") == 0), docs)
