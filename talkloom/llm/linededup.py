"""Line dedup across documents, in DataFrame functions only.

Lines are exploded, normalised and hashed to 128 bits; one aggregation per hash (combined before its shuffle) finds the
lines of two or more documents and the smallest doc_id that keeps them. Only (doc_id, row hash, position, line hash) is
shuffled to that join, never text. The positions that go are gathered per document and joined to the documents, whose
remaining lines are put together by position.

Defined cases: null text counts as one empty line and stays null; a row without
doc_id holds no line for others and keeps all its own; rows that repeat a doc_id are one document for counting and each
lose the same lines; keys of fewer than ``MIN_CHARS`` code points always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.rows import ROW, packed, unpacked

MIN_CHARS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """``line`` without white space at its ends, A-Z lower-cased."""
    space = F.lit(" \t\n\x0b\x0c\r")
    return F.translate(F.btrim(line, space), UPPER, LOWER)


def dropped_positions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _hash, _gone): 0-based positions of the lines to drop of each document that loses any."""
    # the hash stands below the explosion: beside it, it would be worked out again for each line
    whole = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.split(F.col(text), "\n", -1).alias("_lines"))
    lines = whole.select("_id", "_hash", F.posexplode("_lines").alias("_pos", "_line"))
    keyed = lines.select("_id", "_hash", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= MIN_CHARS)
    hashed = keyed.select("_id", "_hash", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2"))
    shared = hashed.groupBy("_h1", "_h2").agg(F.min("_id").alias("_keep"), F.max("_id").alias("_last")).where("_keep < _last")
    # dealt anew, so that the join below shuffles both sides and a line in very many documents can be split
    shared = shared.select("_h1", "_h2", "_keep").hint("rebalance")
    gone = hashed.join(shared, ["_h1", "_h2"]).where("_id > _keep")
    return gone.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("_pos")).alias("_gone"))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` but for the places ``gone`` (ascending): the runs between these one after the other, so long texts need linear time."""

    def runs(all_lines: Column) -> Column:
        before, after = F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(all_lines)))
        return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(all_lines, a + 2, b - a - 1)))

    # a lambda's variable holds the lines, which are split once; as an expression they would be split again for each run
    return F.get(F.transform(F.array(lines), runs), F.lit(0))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` as a struct, its remaining lines in ``_kept``, and ``_n_lines``, ``_n_dropped`` (long)."""
    gone = dropped_positions(docs, doc_id, text)
    rows = packed(docs, _doc=F.col(doc_id), _text=F.col(text), _at=F.xxhash64(text))
    joined = rows.join(gone, (F.col("_doc") == F.col("_id")) & (F.col("_at") == F.col("_hash")), "left")
    n = F.length(F.regexp_replace(F.coalesce(F.col("_text"), F.lit("")), "[^\n]+", "")) + 1
    joined = joined.withColumn("_n_lines", n.cast("long")).withColumn("_n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(_without(F.split("_text", "\n", -1), F.col("_gone")), "\n"))
    return joined.select(ROW, "_n_lines", "_n_dropped", kept.alias("_kept"))


def op10(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(F.col(ROW).getField("doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"))


def with_deduped_text(docs: DataFrame) -> DataFrame:
    """``docs`` with its text, and n_chars where it has that, after dropping; every document stays, if without text."""
    new = {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_kept").cast("long")
    return unpacked(dedup_lines(docs), docs, **new)


OP10_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, r, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT doc_id, r, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS keep FROM k WHERE doc_id IS NOT NULL AND length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
f AS (SELECT k.*, (m.key IS NOT NULL AND k.doc_id > m.keep) IS TRUE AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id, r
"""
