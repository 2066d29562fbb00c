"""Queries of the sources: what is written in each way is read back, beside what it should hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.functions.semantics import pct
from talkloom.operators import chunker, series
from talkloom.plans.model_queries import DAILY, NOTHING, TREND, daily
from talkloom.plans.oracle import pct_sql, t_p_sql, trim_sql
from talkloom.plans.registry import query
from talkloom.sources import tables
from talkloom.sources.scratch import shared_dir


def _path(r, name: str) -> str:
    return f"{shared_dir(r.spark)}/talkloom/{name}-{uuid.uuid4().hex}"


@query("s05_csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'a \"quoted\", line' || chr(10) || 'and another' END AS note FROM customer")
def csv_round_trip(r):
    """Quotes, commas, line ends and nulls come back."""
    path = _path(r, "csv")
    note = F.when(F.col("c_custkey") % 5 == 0, F.lit('a "quoted", line\nand another'))
    tables.write_csv(r.table("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", note.alias("note")), path)
    return tables.read_csv(r.spark, path, "c_custkey long, c_name string, c_mktsegment string, c_acctbal double, note string")


@query("s07_cached_vectors", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, true AS kept, true AS other FROM embeddings")
def cached_vectors(r):
    """A second call with the same parameters reads what the first made; other parameters have a table of their own."""
    from talkloom.functions.vectors import norm

    source, cache, calls = f"{r.dir}/embeddings.parquet", _path(r, "cache"), []

    def make() -> DataFrame:
        calls.append(1)
        return r.table("embeddings").select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))

    for params in ({"digits": 6, "metric": "l2"}, {"metric": "l2", "digits": 6}):
        out = tables.cached(r.spark, make, source, cache, params)
    kept = len(calls) == 1
    tables.cached(r.spark, make, source, cache, {"digits": 6, "metric": "cosine"})
    return out.select("vec_id", "norm", F.lit(kept).alias("kept"), F.lit(len(calls) == 2).alias("other"))


@query("s12_swapped_table", "SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey + 2 AS n_regionkey FROM nation")
def swapped_table(r):
    """A table replaced by what reads it, without a moment at which there is none."""
    path = _path(r, "swapped")
    tables.swap_table(r.table("nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    for _ in range(2):
        now = tables.current_table(r.spark, path)
        tables.swap_table(now.withColumns({"n_name": F.upper("n_name"), "n_regionkey": F.col("n_regionkey") + 1}), path)
    return tables.current_table(r.spark, path)


@query("s14_append_with_column", "SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 1 THEN 'late' END AS batch FROM supplier")
def append_with_column(r):
    """Rows appended with a column that the table lacked."""
    path, s = _path(r, "appended"), r.table("supplier").select("s_suppkey", "s_nationkey")
    tables.append_table(s.where("s_suppkey % 2 = 0"), path)
    late = tables.add_column(tables.add_column(s.where("s_suppkey % 2 = 1"), "batch", "string"), "batch", "string")
    tables.append_table(late.withColumn("batch", F.lit("late")), path)
    return tables.read_table(r.spark, path)


@query("s15_replaced_tracks", "SELECT o_orderkey, o_orderpriority AS track, CASE WHEN o_orderpriority = '2-HIGH' THEN 'again' ELSE 'first' END AS run FROM orders WHERE o_orderpriority <> '2-HIGH' OR o_orderkey % 2 = 0")
def replaced_tracks(r):
    """The rows of one track deleted and inserted, twice with the same result."""
    path = _path(r, "tracks")
    o = r.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("track"))
    o.withColumn("run", F.lit("first")).write.partitionBy("track").parquet(path)
    for _ in range(2):
        tables.replace_partitions(o.where("track = '2-HIGH' AND o_orderkey % 2 = 0").withColumn("run", F.lit("again")), path, "track")
    return r.spark.read.parquet(path).select("o_orderkey", "track", "run")


@query("s22_load_or_default", "SELECT r_regionkey, r_name, 'loaded' AS source FROM region UNION ALL SELECT count(*), 'none', 'default' FROM region UNION ALL SELECT count(*), 'empty', 'default' FROM region")
def load_or_default(r):
    """Rows by default where there is no table, or an empty one."""
    region = r.table("region").select("r_regionkey", "r_name")
    empty, n = _path(r, "empty"), region.count()
    region.where("false").write.parquet(empty)
    read = lambda path, name: tables.read_or(r.spark, path, "r_regionkey long, r_name string", [(n, name)]).select("r_regionkey", "r_name")
    loaded = read(f"{r.dir}/region.parquet", "unused").withColumn("source", F.lit("loaded"))
    return loaded.unionByName(read(_path(r, "none"), "none").unionByName(read(empty, "empty")).withColumn("source", F.lit("default")))


@query("p15_trend_label_tests", f"""WITH {DAILY}, {TREND}, p AS (SELECT *, {t_p_sql('t', 'nu')} AS p FROM (SELECT *, sqrt(r2 * (n - 2) / (1 - r2)) * sign(slope) AS t, n - 2 AS nu FROM f)),
l AS (SELECT key, CASE WHEN slope > 0.05 AND p < 0.05 THEN 'growing ↑' WHEN slope < -0.05 AND p < 0.05 THEN 'declining ↓' ELSE 'stable →' END AS trend FROM p)
SELECT count(*) FILTER (WHERE starts_with(trend, 'growing')) AS growing, count(*) FILTER (WHERE trend LIKE '%↓') AS falling, count(*) FILTER (WHERE contains(trend, 'able')) AS stable, count(*) AS n FROM l""")
def trend_label_tests(r):
    """Prefix, suffix and containment."""
    t = series.trend_labels(daily(r))
    return t.agg(F.count_if(F.startswith("trend", F.lit("growing"))).alias("growing"), F.count_if(F.endswith("trend", F.lit("↓"))).alias("falling"), F.count_if(F.contains("trend", F.lit("able"))).alias("stable"), F.count("*").alias("n"))


@query("w09_message_positions", "SELECT conversation_id, max(i) AS last, count(*) AS n FROM (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY message_date, content) - 1 AS i FROM messages_raw WHERE content IS NOT NULL) GROUP BY 1")
def message_positions(r):
    """Places from 0 within a conversation."""
    m = chunker.numbered(r.messages.where("content IS NOT NULL"))
    return m.groupBy("conversation_id").agg(F.max("message_id").cast("long").alias("last"), F.count("*").alias("n"))


@query("f31_empty_messages", f"""SELECT agent_or_bot, count(*) AS n, count(*) FILTER (WHERE {NOTHING}) AS nothing, {pct_sql(f'count(*) FILTER (WHERE {NOTHING})', 'count(*)', 2)} AS nothing_pct
FROM (SELECT agent_or_bot, regexp_replace(lower({trim_sql('content')}), '[!.,?]+$', '') AS t FROM messages_raw WHERE content IS NOT NULL) GROUP BY 1""")
def empty_messages(r):
    """texts that say nothing once trimmed, lower-cased and without marks at their end."""
    g = r.messages.where("content IS NOT NULL").groupBy("agent_or_bot").agg(F.count("*").alias("n"), F.count_if(chunker.says_nothing(F.col("content"))).alias("nothing"))
    return g.withColumn("nothing_pct", pct(F.col("nothing"), F.col("n"), 2))
