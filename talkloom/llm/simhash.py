"""SimHash near-duplicate groups by deletion-variant signatures.

Fingerprints of 64 bits are linked at ``MAX_BITS`` = 3 or fewer differing bits. Cut into two halves, one half of any
linked pair differs by at most one bit. Each distinct fingerprint is indexed under both halves as they are and under
each half with one bit left out; equality joins on those keys yield every pair once per half, and the full distance is
verified. A pair whose half is equal is found under the half itself; a pair that differs in bit p of it is found under
the variant without p, where only rows with p = 0 meet rows with p = 1. These joins are asked to sort and merge: Spark sizes
the index as the table before its explosion, 66 times too low, and would send it whole through the driver.

Copies share a fingerprint and stand in the index once, so a group of copies of any size is one row. A half that very
many distinct fingerprints share is indexed a level deeper (``HOT_HALF``): its rows carry also the variants of the other
half, cut in two again, and pairs are only formed among rows that agree there.

Groups are connected components by alternating large-star and small-star steps over the links, as joins of tables in
the shared folder; nothing is collected but the size and a checksum of the links.

Defined cases: null or empty text and text of white space has fingerprint 0, linked like any other; a row without
doc_id has a fingerprint and no component; rows that repeat a doc_id are reported each, linked by either text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.llm.rows import ROW, packed, unpacked
from talkloom.sources.scratch import cut, drop_cut

SHINGLE = 3
SEED = 42
MAX_BITS = 3
HOT_HALF = 4000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of ``text``, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    hash_of = xxhash.xxh64_intdigest
    if n <= 1:
        return hash_of(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: n - 1]]).tolist()
    h = np.array([hash_of(joined[a : b - 1], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(x.encode("utf-8", "surrogatepass")) if isinstance(x, str) else 0 for x in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def _halves(fp: Column) -> list[Column]:
    return [fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)]


def _key(code: int | Column, value: Column) -> Column:
    return F.shiftleft((F.lit(code) if isinstance(code, int) else code).cast("long"), 32).bitwiseOR(value)


def _variants(fp: Column) -> Column:
    """Array of (key, side): side 0 and 1 meet under a key, 2 meets itself."""
    out = []
    for s, half in enumerate(_halves(fp)):
        out.append(F.array(F.struct(_key(s * 33 + 32, half).alias("key"), F.lit(2).alias("side"))))
        bit = lambda p: F.expr(f"shiftleft(1L, {p})")
        out.append(F.array(*[F.struct(_key(s * 33 + p, half.bitwiseAND(F.bitwise_not(bit(p)))).alias("key"), F.when(half.bitwiseAND(bit(p)) == 0, 0).otherwise(1).alias("side")) for p in range(32)]))
    return F.concat(*out)


def _deeper(fp: Column, key: Column) -> Column:
    """Sub-keys of a row under a hot ``key``: the variants of the 16-bit quarters of the half that the key doesn't hold."""
    other = F.when(F.shiftright(key, 32) < 33, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    out = []
    for q in range(2):
        quarter = F.shiftright(other, 16 * q).bitwiseAND(F.lit(0xFFFF))
        out += [F.lit((q * 16 + p) << 16).cast("long").bitwiseOR(quarter.bitwiseAND(F.lit(0xFFFF & ~(1 << p)))) for p in range(16)]
    return F.array(*out)


def links(distinct: DataFrame, hot_half: int = HOT_HALF) -> DataFrame:
    """Pairs (a < b) of ``node`` whose ``fp`` differ in MAX_BITS bits or fewer; ``distinct`` has one row per fp."""
    halves = F.explode(F.array(*[_key(s * 33 + 32, h) for s, h in enumerate(_halves(F.col("fp")))]))
    hot = distinct.select(halves.alias("exact")).groupBy("exact").count().where(F.col("count") > hot_half)
    hot = cut(hot, "simhash-hot")
    index = distinct.select("node", "fp", F.explode(_variants(F.col("fp"))).alias("v")).select("node", "fp", "v.key", "v.side")
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= MAX_BITS
    ends = [F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")]

    def pairs(rows: DataFrame, on: list[str]) -> DataFrame:
        left, right = rows.where("side != 1").alias("l"), rows.where("side != 0").alias("r")
        same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
        meet = (F.col("l.side") == 0) & (F.col("r.side") == 1) | (F.col("l.side") == 2) & (F.col("r.side") == 2) & (F.col("l.node") < F.col("r.node"))
        return left.join(right.hint("merge"), [*same, meet, near]).select(*ends)

    if hot.isEmpty():
        return pairs(index, ["key"])
    half, code = F.col("exact").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(F.col("exact"), 32)
    hot_keys = hot.select(F.explode(F.array("exact", *[_key(code - 32 + p, half.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << p)))) for p in range(32)])).alias("key")).distinct()
    cold = index.join(hot_keys, "key", "left_anti")
    deep = index.join(hot_keys, "key", "left_semi").withColumn("sub", F.explode(_deeper(F.col("fp"), F.col("key"))))
    return pairs(cold, ["key"]).unionByName(pairs(deep, ["key", "sub"]))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a < b): the smallest node that can be reached."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())

    now = cut(edges.distinct(), "simhash-links")
    was = state(now)
    for _ in range(max_rounds if was[0] else 0):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(lower, "b")
        small = star.select(F.col("m").alias("a"), F.col("b")).unionByName(star.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        after = cut(small, "simhash-links")
        drop_cut(now)
        now, then = after, state(after)
        if then == was:
            break
        was = then
    else:
        if was[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id long) for each row of ``docs``."""
    prints = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), simhash64(F.col(text)).alias("fp")), "simhash-prints")
    distinct = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"))
    # a doc_id with several texts ties their fingerprints together and is a node of each
    distinct = cut(distinct, "simhash-distinct")
    twice = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("p"), F.max("fp").alias("q")).where("p != q").select("doc_id")
    tied = prints.join(twice, "doc_id", "left_semi").join(distinct, "fp").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where("a != b")
    tied = tied.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = components(links(distinct).unionByName(tied))
    of_print = cut(distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "simhash-groups")
    out = prints.join(of_print, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each group; of rows that repeat that doc_id one stays
    (the smallest text). Rows without doc_id stay."""
    groups = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n"))
    groups = cut(groups.where("c = doc_id").select(F.col("doc_id").alias("_id"), (F.col("n") > 1).alias("_again")), "simhash-kept")
    rows = packed(docs, _doc=F.col("doc_id").cast("long"), _text=F.coalesce(F.col("text"), F.lit("")))
    kept = rows.join(groups, F.col("_doc") == F.col("_id"))
    out = kept.where("NOT _again").select(ROW).unionByName(rows.where("_doc IS NULL").select(ROW))
    if not groups.where("_again").isEmpty():
        out = out.unionByName(kept.where("_again").groupBy("_id").agg(F.min_by(ROW, "_text").alias(ROW)).select(ROW))
    return unpacked(out, docs)
