"""Diagnostic queries over chunks, topics, messages and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.semantics import bucket, distinct_agg, mean, pct, trim_all
from talkloom.operators import profile as profile_op
from talkloom.operators.failure import any_failure, confirmed, escalated, n_if
from talkloom.plans import fixed
from talkloom.plans.oracle import N_ANY, N_CONFIRMED, N_ESC, pct_sql, q, trim_sql
from talkloom.plans.registry import query


def rows() -> Column:
    return F.count(F.lit(1))


def with_share(df: DataFrame, name: str, digits: int, by: list[str] | None = None, of: str = "n") -> DataFrame:
    """Adds the share of ``of`` in the whole, or in the rows that agree in ``by``, in percent."""
    return df.withColumn(name, pct(F.col(of), F.sum(of).over(Window.partitionBy(*(by or []))), digits))


def n_distinct(c: str) -> Column:
    return F.count_distinct(c)


def sized(n: Column, bounds: list[tuple[str, int, str]], rest: str) -> Column:
    """The name of the first comparison that holds: (">" or "<", bound, name)."""
    out = None
    for op, bound, name in bounds:
        cond = n > bound if op == ">" else n < bound
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(rest)


CONV_SIZES = [(">", 5000, "VERY LARGE — inspect manually"), (">", 1000, "large"), (">", 200, "medium"), ("<", 50, "tiny — may be fragmented")]
CHUNK_SIZES = [(">", 10000, "VERY LARGE — inspect manually"), (">", 3000, "large"), (">", 500, "medium"), ("<", 100, "tiny — may be fragmented")]


def sized_sql(n: str, bounds) -> str:
    return "CASE " + " ".join(f"WHEN {n} {op} {b} THEN {q(name)}" for op, b, name in bounds) + " ELSE 'normal' END"


def bucket_sql(x: str, bounds, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN {q(name)}" for b, name in bounds) + f" ELSE {q(rest)} END"


@query("d05_chunk_text_summary", """
SELECT count(*) AS total_chunks, count(DISTINCT conversation_id) AS conversations, min(len(embedding)) AS dim, round(avg(chunk_char_count), 0) AS avg_chars,
  quantile_disc(chunk_char_count, 0.5) AS p50_chars, quantile_disc(chunk_char_count, 0.95) AS p95_chars FROM chunks""")
def chunk_text_summary(r):
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY chunk_char_count)").cast("long")
    return r.chunks.agg(rows().alias("total_chunks"), n_distinct("conversation_id").alias("conversations"), F.min(F.size("embedding")).cast("long").alias("dim"), mean(F.col("chunk_char_count"), 0).alias("avg_chars"), p(0.5).alias("p50_chars"), p(0.95).alias("p95_chars"))


@query("d12_row_count", "SELECT count(*) AS conversations_in_pipeline FROM docs")
def row_count(r):
    return r.docs.agg(rows().alias("conversations_in_pipeline"))


@query("d13_request_by_escalation", """
SELECT count(*) FILTER (WHERE requested_agent AND was_escalated_to_agent) AS ask_text_and_joined, count(*) FILTER (WHERE requested_agent AND NOT was_escalated_to_agent) AS ask_text_no_agent,
  count(*) FILTER (WHERE NOT requested_agent AND was_escalated_to_agent) AS joined_no_ask_phrase, count(*) FILTER (WHERE NOT requested_agent AND NOT was_escalated_to_agent) AS neither FROM flags""")
def request_by_escalation(r):
    a, e = F.col("requested_agent"), F.col("was_escalated_to_agent")
    return r.flags.agg(n_if(a & e).alias("ask_text_and_joined"), n_if(a & ~e).alias("ask_text_no_agent"), n_if(~a & e).alias("joined_no_ask_phrase"), n_if(~a & ~e).alias("neither"))


@query("d14_cited_against_actual", r"""
SELECT cluster_id, n_conversations, round(failure_risk_proxy, 3) AS failure_risk_proxy, round(headline_failure_rate_pct, 1) AS actual_failure_pct, try_cast(c AS DOUBLE) AS cited_pct,
  CASE WHEN c IS NULL THEN 'NO NUMBER CITED' WHEN abs(try_cast(c AS DOUBLE) - headline_failure_rate_pct) <= 10 THEN 'ACCURATE' WHEN try_cast(c AS DOUBLE) > headline_failure_rate_pct THEN 'OVERSTATED' ELSE 'UNDERSTATED' END AS accuracy_flag,
  regexp_matches(regexp_extract(cluster_description, '### Evidence quotes\n([^#]*)', 1), '"[^"]+') AS has_quotes,
  regexp_matches(lower(regexp_extract(cluster_description, '### Theme\n([^#]*)', 1)), """ + q(fixed.VAGUE_THEME) + r""") AS theme_is_vague
FROM (SELECT *, nullif(regexp_extract(regexp_extract(cluster_description, '### Failure diagnosis\n([^#]*)', 1), '(\d+\.?\d*)\s*%', 1), '') AS c FROM descriptions) WHERE NOT is_routing_cluster AND cluster_description IS NOT NULL""")
def cited_against_actual(r):
    return profile_op.validated(r.descriptions)


@query("d15_conversation_cluster_sizes", f"""
SELECT primary_topic AS cluster_id, count(*) AS n_conversations, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_total, {sized_sql('count(*)', CONV_SIZES)} AS size_flag FROM topics WHERE primary_topic <> -1 GROUP BY 1""")
def conversation_cluster_sizes(r):
    g = r.topics.where("primary_topic != -1").groupBy(F.col("primary_topic").alias("cluster_id")).agg(rows().alias("n_conversations"))
    return with_share(g, "pct_of_total", 2, of="n_conversations").withColumn("size_flag", sized(F.col("n_conversations"), CONV_SIZES, "normal"))


@query("d16_chunk_cluster_sizes", f"""
SELECT cluster_id, count(*) AS n_chunks, count(DISTINCT conversation_id) AS n_conversations, round(avg(hdbscan_prob), 3) AS avg_confidence, round(avg(chunk_char_count), 0) AS avg_chunk_chars,
  CASE WHEN cluster_id = -1 THEN 'NOISE' ELSE {sized_sql('count(*)', CHUNK_SIZES)} END AS size_flag FROM chunks GROUP BY 1""")
def chunk_cluster_sizes(r):
    n = F.col("n_chunks")
    g = r.chunks.groupBy("cluster_id").agg(rows().alias("n_chunks"), n_distinct("conversation_id").alias("n_conversations"), mean(F.col("hdbscan_prob"), 3).alias("avg_confidence"), mean(F.col("chunk_char_count"), 0).alias("avg_chunk_chars"))
    return g.withColumn("size_flag", F.when(F.col("cluster_id") == -1, "NOISE").otherwise(sized(n, CHUNK_SIZES, "normal")))


@query("d17_samples_of_largest", """
WITH top AS (SELECT cluster_id FROM chunks WHERE cluster_id <> -1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
SELECT cluster_id, rn AS rank_in_cluster, hdbscan_prob, detected_language, chunk_char_count, left(translated_chunk_text, 400) AS text_preview
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY hdbscan_prob DESC, chunk_uid) AS rn FROM chunks JOIN top USING (cluster_id) WHERE NOT is_noise) WHERE rn <= 5""")
def samples_of_largest(r):
    top = r.chunks.where("cluster_id != -1").groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").limit(5)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("hdbscan_prob"), "chunk_uid")).cast("long")
    ranked = r.chunks.where("NOT is_noise").join(F.broadcast(top), "cluster_id", "left_semi").withColumn("rank_in_cluster", rank).where("rank_in_cluster <= 5")
    return ranked.select("cluster_id", "rank_in_cluster", "hdbscan_prob", "detected_language", "chunk_char_count", F.left("translated_chunk_text", F.lit(400)).alias("text_preview"))


@query("d18_shortest_noise", """
SELECT c.chunk_uid, c.hdbscan_prob, c.detected_language, c.chunk_char_count, d.category, d.was_escalated_to_agent, left(c.translated_chunk_text, 500) AS text_preview
FROM chunks c JOIN docs d USING (conversation_id) WHERE c.is_noise ORDER BY c.chunk_char_count, c.chunk_uid LIMIT 50""")
def shortest_noise(r):
    joined = r.chunks.where("is_noise").join(r.docs.select("conversation_id", "category", "was_escalated_to_agent"), "conversation_id")
    return joined.orderBy("chunk_char_count", "chunk_uid").limit(50).select("chunk_uid", "hdbscan_prob", "detected_language", "chunk_char_count", "category", "was_escalated_to_agent", F.left("translated_chunk_text", F.lit(500)).alias("text_preview"))


PROB = [(0.1, "[0.0–0.1] boundary"), (0.3, "[0.1–0.3]"), (0.5, "[0.3–0.5]"), (0.7, "[0.5–0.7]"), (0.9, "[0.7–0.9]")]


@query("d19_probability_buckets", f"SELECT CASE WHEN cluster_id = -1 THEN '[-1] noise' ELSE {bucket_sql('hdbscan_prob', [(f'{b}::DOUBLE', n) for b, n in PROB], '[0.9–1.0] core')} END AS prob_bucket, count(*) AS n_chunks, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct FROM chunks GROUP BY 1")
def probability_buckets(r):
    name = F.when(F.col("cluster_id") == -1, "[-1] noise").otherwise(bucket(F.col("hdbscan_prob"), PROB, "[0.9–1.0] core"))
    return with_share(r.chunks.groupBy(name.alias("prob_bucket")).agg(rows().alias("n_chunks")), "pct", 2, of="n_chunks")


@query("d20_mixed_topic_by_cluster", f"""
SELECT primary_topic AS cluster_id, count(*) AS n_conversations, count(*) FILTER (WHERE is_mixed_topic) AS n_mixed, {pct_sql('count(*) FILTER (WHERE is_mixed_topic)', 'count(*)', 1)} AS pct_mixed, round(avg(n_chunks), 1) AS avg_chunks,
  round((sum(topic_confidence::DECIMAL(18,3)) / count(*))::DOUBLE, 3) AS avg_confidence FROM topics WHERE primary_topic <> -1 GROUP BY 1""")
def mixed_topic_by_cluster(r):
    mixed = n_if(F.col("is_mixed_topic"))
    return r.topics.where("primary_topic != -1").groupBy(F.col("primary_topic").alias("cluster_id")).agg(rows().alias("n_conversations"), mixed.alias("n_mixed"), pct(mixed, rows(), 1).alias("pct_mixed"), mean(F.col("n_chunks"), 1).alias("avg_chunks"), exact_mean("topic_confidence", 3).alias("avg_confidence"))


def exact_mean(c: str, digits: int, cond: Column | None = None) -> Column:
    """The mean of a column of few decimals, summed as decimals so that order doesn't matter."""
    x = F.col(c).cast("decimal(18,3)")
    x = x if cond is None else F.when(cond, x)
    return F.round(F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0)), digits)


@query("d21_language_share_by_cluster", f"SELECT cluster_id, detected_language, count(*) AS n_chunks, {pct_sql('count(*)', 'sum(count(*)) OVER (PARTITION BY cluster_id)', 1)} AS pct_in_cluster FROM chunks WHERE cluster_id <> -1 GROUP BY 1, 2")
def language_share_by_cluster(r):
    return with_share(r.chunks.where("cluster_id != -1").groupBy("cluster_id", "detected_language").agg(rows().alias("n_chunks")), "pct_in_cluster", 1, ["cluster_id"], "n_chunks")


@query("d22_chunking_health", f"""
SELECT count(DISTINCT conversation_id) AS n_conversations_chunked, count(*) AS total_chunks, round(count(*)::DOUBLE / count(DISTINCT conversation_id), 2) AS avg_chunks_per_conv, {pct_sql('count(*) FILTER (WHERE is_noise)', 'count(*)', 2)} AS noise_rate_pct,
  round(avg(hdbscan_prob), 3) AS avg_hdbscan_prob, round(avg(chunk_char_count), 0) AS avg_chunk_chars, min(chunk_char_count) AS min_chunk_chars, max(chunk_char_count) AS max_chunk_chars,
  count(*) FILTER (WHERE chunk_char_count < 200) AS chunks_under_200_chars, count(*) FILTER (WHERE chunk_char_count BETWEEN 800 AND 2800) AS chunks_in_target_window, {pct_sql('count(*) FILTER (WHERE chunk_char_count BETWEEN 800 AND 2800)', 'count(*)', 1)} AS pct_in_target_window FROM chunks""")
def chunking_health(r):
    c, target = F.col("chunk_char_count"), n_if(F.col("chunk_char_count").between(800, 2800))
    return r.chunks.agg(
        n_distinct("conversation_id").alias("n_conversations_chunked"), rows().alias("total_chunks"), F.round(rows() / n_distinct("conversation_id"), 2).alias("avg_chunks_per_conv"), pct(n_if(F.col("is_noise")), rows(), 2).alias("noise_rate_pct"),
        mean(F.col("hdbscan_prob"), 3).alias("avg_hdbscan_prob"), mean(c, 0).alias("avg_chunk_chars"), F.min(c).alias("min_chunk_chars"), F.max(c).alias("max_chunk_chars"), n_if(c < 200).alias("chunks_under_200_chars"), target.alias("chunks_in_target_window"), pct(target, rows(), 1).alias("pct_in_target_window"),
    )


CHARS = [(200, "< 200  (very short)"), (400, "200–399"), (800, "400–799"), (1400, "800–1399 ✓"), (2000, "1400–1999 ✓"), (2800, "2000–2799 ✓"), (4000, "2800–3999 (long)")]


@query("d23_chunk_size_histogram", f"SELECT {bucket_sql('chunk_char_count', CHARS, '>= 4000  (very long)')} AS char_bucket, count(*) AS n_chunks, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct FROM chunks GROUP BY 1")
def chunk_size_histogram(r):
    g = r.chunks.groupBy(bucket(F.col("chunk_char_count"), CHARS, ">= 4000  (very long)").alias("char_bucket")).agg(rows().alias("n_chunks"), F.min("chunk_char_count").alias("least"))
    return with_share(g, "pct", 2, of="n_chunks").orderBy("least").drop("least")


SPLITS = [(2, "no split — short or single-topic"), (4, "light split ✓"), (7, "moderate split ✓"), (11, "heavy split")]


@query("d24_chunks_per_conversation", f"SELECT n_chunks, count(*) AS n_conversations, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct, {bucket_sql('n_chunks', SPLITS, 'very long conversation')} AS interpretation FROM topics GROUP BY 1")
def chunks_per_conversation(r):
    g = with_share(r.topics.groupBy("n_chunks").agg(rows().alias("n_conversations")), "pct", 2, of="n_conversations")
    return g.withColumn("interpretation", bucket(F.col("n_chunks"), SPLITS, "very long conversation"))


@query("d25_boilerplate", "SELECT cluster_id, count(*) AS n_chunks, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(lower(translated_chunk_text), {q(p)})) AS {k}" for k, p in [("nps_chunks", fixed.NPS), ("closing_chunks", fixed.CLOSING), ("filler_chunks", fixed.FILLER)]) + f", {pct_sql(f'count(*) FILTER (WHERE regexp_matches(lower(translated_chunk_text), {q(fixed.BOILERPLATE)}))', 'count(*)', 1)} AS boilerplate_pct FROM chunks WHERE cluster_id <> -1 GROUP BY 1")
def boilerplate(r):
    has = lambda p: n_if(F.lower("translated_chunk_text").rlike(p))
    return r.chunks.where("cluster_id != -1").groupBy("cluster_id").agg(rows().alias("n_chunks"), has(fixed.NPS).alias("nps_chunks"), has(fixed.CLOSING).alias("closing_chunks"), has(fixed.FILLER).alias("filler_chunks"), pct(has(fixed.BOILERPLATE), rows(), 1).alias("boilerplate_pct"))


EXACT = "round((sum(topic_confidence::DECIMAL(18,3)) {0} / nullif(count(*) {0}, 0))::DOUBLE, 3)"


@query("d26_mixed_topic_overall", f"""
SELECT count(*) AS total_conversations, count(*) FILTER (WHERE is_mixed_topic) AS mixed_topic_convs, {pct_sql('count(*) FILTER (WHERE is_mixed_topic)', 'count(*)', 1)} AS pct_mixed, round(avg(n_chunks), 2) AS avg_chunks, round(avg(n_chunks) FILTER (WHERE is_mixed_topic), 2) AS avg_chunks_mixed,
  round(avg(n_chunks) FILTER (WHERE NOT is_mixed_topic), 2) AS avg_chunks_single_topic, {EXACT.format('')} AS avg_confidence, {EXACT.format('FILTER (WHERE is_mixed_topic)')} AS confidence_mixed, {EXACT.format('FILTER (WHERE NOT is_mixed_topic)')} AS confidence_single FROM topics WHERE primary_topic <> -1""")
def mixed_topic_overall(r):
    m = F.col("is_mixed_topic")
    chunks = lambda cond: mean(F.when(cond, F.col("n_chunks")), 2)
    return r.topics.where("primary_topic != -1").agg(
        rows().alias("total_conversations"), n_if(m).alias("mixed_topic_convs"), pct(n_if(m), rows(), 1).alias("pct_mixed"), mean(F.col("n_chunks"), 2).alias("avg_chunks"), chunks(m).alias("avg_chunks_mixed"), chunks(~m).alias("avg_chunks_single_topic"),
        exact_mean("topic_confidence", 3).alias("avg_confidence"), exact_mean("topic_confidence", 3, m).alias("confidence_mixed"), exact_mean("topic_confidence", 3, ~m).alias("confidence_single"),
    )


@query("d27_few_chunk_conversations", f"""
SELECT t.n_chunks, count(*) AS n_conversations, round(avg(d.client_message_count), 1) AS avg_client_msgs, round(avg(d.total_message_count), 1) AS avg_total_msgs, {N_ESC} AS escalated, {pct_sql(N_ESC, 'count(*)', 1)} AS escalation_rate_pct
FROM topics t JOIN docs d USING (conversation_id) WHERE t.primary_topic <> -1 AND t.n_chunks <= 3 GROUP BY 1""")
def few_chunk_conversations(r):
    few = r.topics.where("primary_topic != -1 AND n_chunks <= 3").select("conversation_id", "n_chunks")
    return few.join(r.docs, "conversation_id").groupBy("n_chunks").agg(rows().alias("n_conversations"), mean(F.col("client_message_count"), 1).alias("avg_client_msgs"), mean(F.col("total_message_count"), 1).alias("avg_total_msgs"), escalated().alias("escalated"), pct(escalated(), rows(), 1).alias("escalation_rate_pct"))


@query("d28_language_coherence", f"""
SELECT cluster_id, detected_language AS dominant_language, p AS dominant_lang_pct, CASE WHEN detected_language = 'en' AND p > 80 THEN 'English-dominant (expected)' WHEN detected_language <> 'en' AND p > 60 THEN 'LANGUAGE-DRIVEN ← check this' ELSE 'mixed / multilingual' END AS diagnosis
FROM (SELECT *, max(p) OVER (PARTITION BY cluster_id) AS m FROM (SELECT cluster_id, detected_language, {pct_sql('count(*)', 'sum(count(*)) OVER (PARTITION BY cluster_id)', 1)} AS p FROM chunks WHERE cluster_id <> -1 GROUP BY 1, 2)) WHERE p = m""")
def language_coherence(r):
    shares = language_share_by_cluster(r).withColumn("most", F.max("pct_in_cluster").over(Window.partitionBy("cluster_id"))).where("pct_in_cluster = most")
    lang, p = F.col("detected_language"), F.col("pct_in_cluster")
    says = F.when((lang == "en") & (p > 80), "English-dominant (expected)").when((lang != "en") & (p > 60), "LANGUAGE-DRIVEN ← check this").otherwise("mixed / multilingual")
    return shares.select("cluster_id", lang.alias("dominant_language"), p.alias("dominant_lang_pct"), says.alias("diagnosis"))


@query("d29_single_against_multi", f"""
SELECT CASE WHEN t.n_chunks = 1 THEN 'single chunk' ELSE 'multi-chunk' END AS split_type, count(DISTINCT t.conversation_id) AS n_conversations, round(avg(t.n_chunks), 2) AS avg_chunks, {EXACT.format('')} AS avg_topic_confidence,
  {pct_sql(N_ANY, 'count(*)', 2)} AS headline_failure_rate_pct, {pct_sql(N_CONFIRMED, 'count(*)', 2)} AS confirmed_failure_rate_pct, {pct_sql(N_ESC, 'count(*)', 2)} AS escalation_rate_pct, round(avg(client_message_count), 1) AS avg_client_messages
FROM topics t JOIN flags f USING (conversation_id) WHERE t.primary_topic <> -1 GROUP BY 1""")
def single_against_multi(r):
    t = r.topics.where("primary_topic != -1").drop("is_noise")
    kind = F.when(F.col("n_chunks") == 1, "single chunk").otherwise("multi-chunk").alias("split_type")
    return t.join(r.flags, "conversation_id").groupBy(kind).agg(n_distinct("conversation_id").alias("n_conversations"), mean(F.col("n_chunks"), 2).alias("avg_chunks"), exact_mean("topic_confidence", 3).alias("avg_topic_confidence"), pct(any_failure(), rows(), 2).alias("headline_failure_rate_pct"), pct(confirmed(), rows(), 2).alias("confirmed_failure_rate_pct"), pct(escalated(), rows(), 2).alias("escalation_rate_pct"), mean(F.col("client_message_count"), 1).alias("avg_client_messages"))


@query("d30_artifact_clusters", f"""
SELECT cluster_id, count(*) AS n_chunks, count(DISTINCT conversation_id) AS n_conversations, round(avg(hdbscan_prob), 3) AS avg_confidence, round(avg(chunk_char_count), 0) AS avg_chars, round(avg(client_message_count), 1) AS avg_client_msgs,
  {pct_sql(N_ESC, 'count(DISTINCT conversation_id)', 1)} AS escalation_rate_pct, array_to_string((list(left(translated_chunk_text, 200) ORDER BY hdbscan_prob DESC, chunk_uid))[1:3], ' || ') AS top_3_samples
FROM chunks JOIN docs USING (conversation_id) WHERE cluster_id IN (0, 1, 2) GROUP BY 1""")
def artifact_clusters(r):
    joined = r.chunks.where(F.col("cluster_id").isin(0, 1, 2)).join(r.docs.select("conversation_id", "client_message_count", "was_escalated_to_agent"), "conversation_id")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("hdbscan_prob"), "chunk_uid"))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", F.left("translated_chunk_text", F.lit(200)).alias("t")))))
    return joined.withColumn("rank", rank).groupBy("cluster_id").agg(
        rows().alias("n_chunks"), n_distinct("conversation_id").alias("n_conversations"), mean(F.col("hdbscan_prob"), 3).alias("avg_confidence"), mean(F.col("chunk_char_count"), 0).alias("avg_chars"), mean(F.col("client_message_count"), 1).alias("avg_client_msgs"),
        pct(escalated(), n_distinct("conversation_id"), 1).alias("escalation_rate_pct"), F.array_join(F.transform(top, lambda x: x["t"]), " || ").alias("top_3_samples"),
    )


NOISE = [(300, "< 300 (short / boilerplate)"), (800, "300–799"), (2000, "800–1999 (in-target, unique topic)")]


@query("d31_noise_sizes", f"SELECT {bucket_sql('chunk_char_count', NOISE, '>= 2000 (long, rare topic)')} AS noise_char_bucket, count(*) AS n_noise_chunks, round(avg(chunk_char_count), 0) AS avg_chars, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_noise FROM chunks WHERE is_noise GROUP BY 1")
def noise_sizes(r):
    g = r.chunks.where("is_noise").groupBy(bucket(F.col("chunk_char_count"), NOISE, ">= 2000 (long, rare topic)").alias("noise_char_bucket")).agg(rows().alias("n_noise_chunks"), mean(F.col("chunk_char_count"), 0).alias("avg_chars"))
    return with_share(g, "pct_of_noise", 2, of="n_noise_chunks")


@query("d32_verdicts", f"""
SELECT *, CASE WHEN noise_pct > 20 THEN 'HIGH NOISE' ELSE 'OK' END AS noise_verdict, CASE WHEN pct_very_short > 30 THEN 'MANY SHORT' ELSE 'OK' END AS short_verdict, CASE WHEN pct_in_target < 50 THEN 'FEW IN TARGET' ELSE 'OK' END AS size_verdict,
  CASE WHEN pct_mixed < 5 THEN 'LOW MIXING — chunking may be unnecessary' WHEN pct_mixed > 50 THEN 'HIGH MIXING — inspect noise' ELSE 'OK' END AS mixing_verdict
FROM (SELECT count(DISTINCT conversation_id) AS n_convs, count(*) AS n_chunks, round(count(*)::DOUBLE / count(DISTINCT conversation_id), 2) AS avg_chunks_per_conv, {pct_sql('count(*) FILTER (WHERE is_noise)', 'count(*)', 2)} AS noise_pct,
    {pct_sql('count(*) FILTER (WHERE chunk_char_count < 400)', 'count(*)', 2)} AS pct_very_short, {pct_sql('count(*) FILTER (WHERE chunk_char_count BETWEEN 800 AND 2800)', 'count(*)', 1)} AS pct_in_target FROM chunks),
  (SELECT {pct_sql('count(*) FILTER (WHERE is_mixed_topic)', 'count(*)', 1)} AS pct_mixed FROM topics WHERE primary_topic <> -1)""")
def verdicts(r):
    c = F.col("chunk_char_count")
    stats = r.chunks.agg(n_distinct("conversation_id").alias("n_convs"), rows().alias("n_chunks"), F.round(rows() / n_distinct("conversation_id"), 2).alias("avg_chunks_per_conv"), pct(n_if(F.col("is_noise")), rows(), 2).alias("noise_pct"), pct(n_if(c < 400), rows(), 2).alias("pct_very_short"), pct(n_if(c.between(800, 2800)), rows(), 1).alias("pct_in_target"))
    mixing = r.topics.where("primary_topic != -1").agg(pct(n_if(F.col("is_mixed_topic")), rows(), 1).alias("pct_mixed"))
    says = lambda cond, name: F.when(cond, name).otherwise("OK")
    m = F.col("pct_mixed")
    # both sides are one row
    return stats.crossJoin(mixing).withColumns({"noise_verdict": says(F.col("noise_pct") > 20, "HIGH NOISE"), "short_verdict": says(F.col("pct_very_short") > 30, "MANY SHORT"), "size_verdict": says(F.col("pct_in_target") < 50, "FEW IN TARGET"), "mixing_verdict": F.when(m < 5, "LOW MIXING — chunking may be unnecessary").when(m > 50, "HIGH MIXING — inspect noise").otherwise("OK")})


@query("d33_volume_by_role", f"""
SELECT agent_or_bot AS role, count(*) AS n_messages, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 1)} AS pct_of_messages, sum(length(content))::BIGINT AS total_chars, {pct_sql('sum(length(content))', 'sum(sum(length(content))) OVER ()', 1)} AS pct_of_chars, round(avg(length(content)), 0) AS avg_chars_per_message,
  quantile_disc(length(content), 0.5) AS p50_chars, quantile_disc(length(content), 0.9) AS p90_chars, quantile_disc(length(content), 0.99) AS p99_chars FROM messages_raw WHERE content IS NOT NULL GROUP BY 1""")
def volume_by_role(r):
    m = r.messages.where("content IS NOT NULL").withColumn("len", F.length("content").cast("long"))
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY len)").cast("long")
    g = m.groupBy(F.col("agent_or_bot").alias("role")).agg(rows().alias("n_messages"), F.sum("len").alias("total_chars"), mean(F.col("len"), 0).alias("avg_chars_per_message"), p(0.5).alias("p50_chars"), p(0.9).alias("p90_chars"), p(0.99).alias("p99_chars"))
    return with_share(with_share(g, "pct_of_messages", 1, of="n_messages"), "pct_of_chars", 1, of="total_chars")


@query("d34a_messages_per_conversation", """
SELECT count(DISTINCT conversation_id) AS n_conversations, round(avg(c), 1) AS avg_client_messages, round(avg(b), 1) AS avg_bot_messages, round(avg(a), 1) AS avg_agent_messages, round(avg(cc), 0) AS avg_client_chars_per_conv, round(avg(bc), 0) AS avg_bot_chars_per_conv, round(avg(bc::DOUBLE / nullif(cc + bc, 0)), 3) AS avg_bot_char_share
FROM (SELECT conversation_id, count(*) FILTER (WHERE agent_or_bot = 'Client') AS c, count(*) FILTER (WHERE agent_or_bot = 'Bot') AS b, count(*) FILTER (WHERE agent_or_bot = 'Agent') AS a,
  coalesce(sum(length(content)) FILTER (WHERE agent_or_bot = 'Client'), 0)::BIGINT AS cc, coalesce(sum(length(content)) FILTER (WHERE agent_or_bot = 'Bot'), 0)::BIGINT AS bc FROM messages_raw WHERE content IS NOT NULL GROUP BY 1)""")
def messages_per_conversation(r):
    role, chars = F.col("agent_or_bot"), lambda who: F.sum(F.when(F.col("agent_or_bot") == who, F.length("content")).otherwise(0))
    each = r.messages.where("content IS NOT NULL").groupBy("conversation_id").agg(*[n_if(role == who).alias(k) for k, who in [("c", "Client"), ("b", "Bot"), ("a", "Agent")]], chars("Client").alias("cc"), chars("Bot").alias("bc"))
    return each.agg(n_distinct("conversation_id").alias("n_conversations"), mean(F.col("c"), 1).alias("avg_client_messages"), mean(F.col("b"), 1).alias("avg_bot_messages"), mean(F.col("a"), 1).alias("avg_agent_messages"), mean(F.col("cc"), 0).alias("avg_client_chars_per_conv"), mean(F.col("bc"), 0).alias("avg_bot_chars_per_conv"), mean(F.try_divide(F.col("bc"), F.col("cc") + F.col("bc")), 3).alias("avg_bot_char_share"))


LENGTHS = [(30, "< 30 chars (very short)"), (100, "30–99 chars"), (300, "100–299 chars"), (700, "300–699 chars"), (1500, "700–1499 chars")]


@query("d34b_length_buckets", f"SELECT agent_or_bot AS role, {bucket_sql('length(content)', LENGTHS, '>= 1500 chars (long AI response)')} AS length_bucket, count(*) AS n_messages, {pct_sql('count(*)', 'sum(count(*)) OVER (PARTITION BY agent_or_bot)', 1)} AS pct_within_role FROM messages_raw WHERE content IS NOT NULL AND agent_or_bot IN ('Client', 'Bot') GROUP BY 1, 2")
def length_buckets(r):
    m = r.messages.where(F.col("content").isNotNull() & F.col("agent_or_bot").isin("Client", "Bot"))
    g = m.groupBy(F.col("agent_or_bot").alias("role"), bucket(F.length("content"), LENGTHS, ">= 1500 chars (long AI response)").alias("length_bucket")).agg(rows().alias("n_messages"))
    return with_share(g, "pct_within_role", 1, ["role"], "n_messages")


@query("d34c_filter_outcomes", f"""
SELECT CASE WHEN length(t) < 8 THEN 'too_short (< 8 chars)' WHEN lower(t) IN ({', '.join(q(x) for x in fixed.SHORT_REPLIES)}) THEN 'boilerplate_exact_match' WHEN length(t) < 50 AND t LIKE '%thank%' THEN 'likely boilerplate (short thanks)' ELSE 'substantive (survives filter)' END AS filter_outcome,
  count(*) AS n_messages, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 1)} AS pct FROM (SELECT {trim_sql('content')} AS t FROM messages_raw WHERE content IS NOT NULL AND agent_or_bot = 'Client') GROUP BY 1""")
def filter_outcomes(r):
    t = trim_all(F.col("content"))
    says = F.when(F.length(t) < 8, "too_short (< 8 chars)").when(F.lower(t).isin(fixed.SHORT_REPLIES), "boilerplate_exact_match").when((F.length(t) < 50) & t.like("%thank%"), "likely boilerplate (short thanks)").otherwise("substantive (survives filter)")
    g = r.messages.where("content IS NOT NULL AND agent_or_bot = 'Client'").groupBy(says.alias("filter_outcome")).agg(rows().alias("n_messages"))
    return with_share(g, "pct", 1, of="n_messages")


def turns(who: str) -> Column:
    return F.regexp_count("translated_chunk_text", F.lit(rf"\[{who}\]:")).cast("long")


AI_TURNS, USER_TURNS = (rf"len(regexp_extract_all(translated_chunk_text, '\[{w}\]:'))" for w in ("AI", "USER"))


@query("d35a_role_share_in_chunks", rf"""
SELECT round(avg({AI_TURNS}), 2) AS avg_ai_turns_per_chunk, round(avg({USER_TURNS}), 2) AS avg_user_turns_per_chunk, round(avg(length(regexp_replace(translated_chunk_text, '\[USER\]: [^\[]*', '', 'g'))::DOUBLE / nullif(length(translated_chunk_text), 0)), 3) AS approx_ai_char_share,
  round(avg(chunk_char_count), 0) AS avg_chunk_chars, count(*) AS total_chunks FROM chunks""")
def role_share_in_chunks(r):
    t = F.col("translated_chunk_text")
    rest = F.length(F.regexp_replace(t, r"\[USER\]: [^\[]*", ""))
    return r.chunks.agg(mean(turns("AI"), 2).alias("avg_ai_turns_per_chunk"), mean(turns("USER"), 2).alias("avg_user_turns_per_chunk"), mean(F.try_divide(rest, F.length(t)), 3).alias("approx_ai_char_share"), mean(F.col("chunk_char_count"), 0).alias("avg_chunk_chars"), rows().alias("total_chunks"))


@query("d35b_turn_pairs", f"SELECT {AI_TURNS} AS ai_turns, {USER_TURNS} AS user_turns, count(*) AS n_chunks, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct FROM chunks WHERE NOT is_noise GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")
def turn_pairs(r):
    g = r.chunks.where("NOT is_noise").groupBy(turns("AI").alias("ai_turns"), turns("USER").alias("user_turns")).agg(rows().alias("n_chunks"))
    return with_share(g, "pct", 2, of="n_chunks").orderBy(F.desc("n_chunks"), "ai_turns", "user_turns").limit(20)


MESSAGES = [(5, "1–4 messages"), (9, "5–8 messages"), (16, "9–15 messages"), (26, "16–25 messages")]


@query("d35c_mixed_by_length", f"SELECT {bucket_sql('d.total_message_count', MESSAGES, '> 25 messages')} AS conv_length_bucket, count(*) AS n_conversations, round(avg(t.n_chunks), 2) AS avg_chunks, {pct_sql('count(*) FILTER (WHERE is_mixed_topic)', 'count(*)', 1)} AS pct_mixed, {EXACT.format('')} AS avg_topic_confidence FROM topics t JOIN docs d USING (conversation_id) WHERE t.primary_topic <> -1 GROUP BY 1")
def mixed_by_length(r):
    joined = r.topics.where("primary_topic != -1").join(r.docs.select("conversation_id", "total_message_count"), "conversation_id")
    return joined.groupBy(bucket(F.col("total_message_count"), MESSAGES, "> 25 messages").alias("conv_length_bucket")).agg(rows().alias("n_conversations"), mean(F.col("n_chunks"), 2).alias("avg_chunks"), pct(n_if(F.col("is_mixed_topic")), rows(), 1).alias("pct_mixed"), exact_mean("topic_confidence", 3).alias("avg_topic_confidence"))


@query("d35d_translation_coverage", f"""
SELECT CASE WHEN translated_chunk_text = original_chunk_text THEN 'no translation (non-English original)' WHEN translated_chunk_text IS NULL THEN 'NULL (unexpected)' ELSE 'translated' END AS translation_status, detected_language, count(*) AS n_chunks, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct
FROM chunks GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30""")
def translation_coverage(r):
    t, o = F.col("translated_chunk_text"), F.col("original_chunk_text")
    says = F.when(t == o, "no translation (non-English original)").when(t.isNull(), "NULL (unexpected)").otherwise("translated")
    g = r.chunks.groupBy(says.alias("translation_status"), "detected_language").agg(rows().alias("n_chunks"))
    return with_share(g, "pct", 2, of="n_chunks").orderBy(F.desc("n_chunks"), "translation_status", "detected_language").limit(30)


def rounded(c: str, digits: int, name: str) -> Column:
    return F.round(c, digits).alias(name)


@query("d36a_descriptions_ranked", """
SELECT cluster_id, n_conversations, is_routing_cluster, round(confirmed_failure_rate_pct, 1) AS confirmed_pct, round(headline_failure_rate_pct, 1) AS headline_pct, round(escalation_rate_pct, 1) AS esc_pct, round(failure_risk_proxy, 3) AS risk, gemini_status, trim(cluster_description, chr(10) || ' ') AS cluster_description FROM descriptions""")
def descriptions_ranked(r):
    d = r.descriptions.orderBy(F.desc("failure_risk_proxy"), "cluster_id")
    return d.select("cluster_id", "n_conversations", "is_routing_cluster", rounded("confirmed_failure_rate_pct", 1, "confirmed_pct"), rounded("headline_failure_rate_pct", 1, "headline_pct"), rounded("escalation_rate_pct", 1, "esc_pct"), rounded("failure_risk_proxy", 3, "risk"), "gemini_status", "cluster_description")


def theme_sql(heading: str) -> str:
    return trim_sql(rf"nullif(regexp_extract(d.cluster_description, '### {heading}\n([^\n#]+)', 1), '')")


@query("d36b_tiers_by_cluster", f"""
SELECT cluster_id, d.n_conversations, round(d.failure_risk_proxy, 3) AS risk, {theme_sql('Theme')} AS theme, p.confirmed_failures, round(p.confirmed_failure_rate_pct, 1) AS confirmed_pct, p.headline_failures, round(p.headline_failure_rate_pct, 1) AS headline_pct, round(p.suspected_failure_rate_pct, 1) AS suspected_pct,
  p.escalated_count, round(p.escalation_rate_pct, 1) AS esc_pct, p.resolved_positive FROM descriptions d JOIN profile p USING (cluster_id)""")
def tiers_by_cluster(r):
    d = r.descriptions.select("cluster_id", "cluster_description")
    return r.profile.join(d, "cluster_id").select("cluster_id", "n_conversations", rounded("failure_risk_proxy", 3, "risk"), profile_op.first_line(F.col("cluster_description"), "Theme").alias("theme"), "confirmed_failures", rounded("confirmed_failure_rate_pct", 1, "confirmed_pct"), "headline_failures", rounded("headline_failure_rate_pct", 1, "headline_pct"), rounded("suspected_failure_rate_pct", 1, "suspected_pct"), "escalated_count", rounded("escalation_rate_pct", 1, "esc_pct"), "resolved_positive")


@query("d36c_routing_against_problem", "SELECT is_routing_cluster, count(*) AS n_clusters, sum(n_conversations)::BIGINT AS total_conversations, round((sum(failure_risk_proxy::DECIMAL(18,4)) / count(*))::DOUBLE, 3) AS avg_risk, round((sum(escalation_rate_pct::DECIMAL(18,1)) / count(*))::DOUBLE, 1) AS avg_esc_pct FROM descriptions GROUP BY 1")
def routing_against_problem(r):
    exact = lambda c, places, digits: F.round(F.sum(F.col(c).cast(f"decimal(18,{places})")).cast("double") / rows(), digits)
    return r.descriptions.groupBy("is_routing_cluster").agg(rows().alias("n_clusters"), F.sum("n_conversations").alias("total_conversations"), exact("failure_risk_proxy", 4, 3).alias("avg_risk"), exact("escalation_rate_pct", 1, 1).alias("avg_esc_pct"))


@query("d36d_top_risks_with_actions", f"SELECT cluster_id, n_conversations, round(failure_risk_proxy, 3) AS risk, {theme_sql('Theme')} AS theme, {theme_sql('Failure diagnosis')} AS failure_summary, {theme_sql('Suggested action')} AS suggested_action FROM descriptions d WHERE NOT is_routing_cluster ORDER BY failure_risk_proxy DESC, cluster_id LIMIT 5")
def top_risks_with_actions(r):
    d = r.descriptions.where("NOT is_routing_cluster").orderBy(F.desc("failure_risk_proxy"), "cluster_id").limit(5)
    line = lambda h: profile_op.first_line(F.col("cluster_description"), h)
    return d.select("cluster_id", "n_conversations", rounded("failure_risk_proxy", 3, "risk"), line("Theme").alias("theme"), line("Failure diagnosis").alias("failure_summary"), line("Suggested action").alias("suggested_action"))


SECTIONS = {"has_theme": "### Theme", "has_failure": "### Failure diagnosis", "has_action": "### Suggested action", "has_quotes": "### Evidence quotes"}


@query("d36e_section_presence", "SELECT cluster_id, n_conversations, gemini_status, " + ", ".join(f"contains(cluster_description, '{h}') AS {k}" for k, h in SECTIONS.items()) + f", length({trim_sql('cluster_description')}) AS desc_length FROM descriptions")
def section_presence(r):
    d = F.col("cluster_description")
    return r.descriptions.select("cluster_id", "n_conversations", "gemini_status", *[d.contains(h).alias(k) for k, h in SECTIONS.items()], F.length(d).cast("long").alias("desc_length"))


@query("d36f_non_english_clusters", f"SELECT cluster_id, p.n_conversations, p.languages_in_cluster, round(p.pct_non_english, 1) AS pct_non_english, {theme_sql('Theme')} AS theme FROM profile p JOIN descriptions d USING (cluster_id) WHERE p.pct_non_english > 30")
def non_english_clusters(r):
    d = r.descriptions.select("cluster_id", "cluster_description")
    p = r.profile.where("pct_non_english > 30").join(d, "cluster_id")
    return p.select("cluster_id", "n_conversations", "languages_in_cluster", rounded("pct_non_english", 1, "pct_non_english"), profile_op.first_line(F.col("cluster_description"), "Theme").alias("theme"))


@query("d37_declining_clusters", f"SELECT cluster_id, n_chunks, n_conversations, chunk_headline_failure_rate_pct, headline_failure_rate_pct, {trim_sql('cluster_description')} AS cluster_description FROM (SELECT unnest([{', '.join(map(str, fixed.DECLINING))}]) AS cluster_id) JOIN descriptions USING (cluster_id)")
def declining_clusters(r):
    ids = r.spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in fixed.DECLINING])).alias("cluster_id"))
    return r.descriptions.join(ids, "cluster_id").select("cluster_id", "n_chunks", "n_conversations", "chunk_headline_failure_rate_pct", "headline_failure_rate_pct", "cluster_description")


@query("d38_dashboard_kpis", f"""
SELECT (SELECT count(*) FROM docs) AS conversations, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT cluster_id) FROM chunks WHERE NOT is_noise) AS clusters, (SELECT count(DISTINCT detected_language) FROM docs) AS languages,
  (SELECT {pct_sql(N_ANY, 'count(*)', 2)} FROM flags) AS headline_failure_rate_pct, (SELECT {pct_sql('count(*) FILTER (WHERE is_noise)', 'count(*)', 1)} FROM chunks) AS noise_pct, (SELECT round(avg(hdbscan_prob), 3) FROM chunks WHERE is_high_conf) AS high_conf_prob""")
def dashboard_kpis(r):
    d = r.docs.agg(rows().alias("conversations"), n_distinct("detected_language").alias("languages"))
    c = r.chunks.agg(rows().alias("chunks"), F.count_distinct(F.when(~F.col("is_noise"), F.col("cluster_id"))).alias("clusters"), pct(n_if(F.col("is_noise")), rows(), 1).alias("noise_pct"), mean(F.when(F.col("is_high_conf"), F.col("hdbscan_prob")), 3).alias("high_conf_prob"))
    f = r.flags.agg(pct(any_failure(), rows(), 2).alias("headline_failure_rate_pct"))
    return d.crossJoin(c).crossJoin(f)  # one row each


@query("d39_track_summary", "SELECT pipeline_track, count(*) AS n, count(DISTINCT cluster_id) FILTER (WHERE cluster_id <> -1) AS clusters FROM (SELECT * FROM labels WHERE pipeline_track = 'multilingual' UNION ALL SELECT * FROM labels WHERE pipeline_track = 'translated') GROUP BY 1")
def track_summary(r):
    both = r.labels.where("pipeline_track = 'multilingual'").unionByName(r.labels.where("pipeline_track = 'translated'"))
    return both.groupBy("pipeline_track").agg(rows().alias("n"), F.count_distinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("clusters"))


LABEL_STRATA = ["negative", "probable_failure", "positive", "recent"]


@query("d40a_conversation_label_table", f"""
WITH smp AS (SELECT l.pipeline_track, l.cluster_id, f.conversation_id, CASE WHEN l.pipeline_track = 'multilingual' THEN left(coalesce(conversation_text_multilingual, ''), 400) ELSE left(coalesce(conversation_text_translated, ''), 400) END AS snippet,
    CASE WHEN failure_type IN ('explicit_negative_bot', 'explicit_negative_escalated') THEN 'negative' WHEN failure_type IN ('repetition_loop', 'agent_request_unserved') THEN 'probable_failure' WHEN failure_type = 'resolved_positive' THEN 'positive' ELSE 'recent' END AS stratum, conversation_start_date AS st
  FROM labels l JOIN flags f USING (conversation_id) WHERE l.cluster_id <> -1),
base AS (SELECT pipeline_track, l.cluster_id, count(*) AS cluster_size, {pct_sql("count(*) FILTER (WHERE detected_language <> 'en')", 'count(*)', 1)} AS pct_non_english, array_to_string(list_sort(list(DISTINCT detected_language))[1:10], ',') AS languages_in_cluster,
    {N_CONFIRMED} AS confirmed_failures, {N_ANY} AS headline_failures, {pct_sql(N_ANY, 'count(*)', 2)} AS headline_failure_rate_pct, {pct_sql(N_ESC, 'count(*)', 1)} AS escalation_rate_pct FROM labels l JOIN flags USING (conversation_id) WHERE l.cluster_id <> -1 GROUP BY 1, 2)
SELECT b.*, s.sample_texts FROM base b LEFT JOIN (SELECT pipeline_track, cluster_id, string_agg('[' || stratum || '] ' || snippet, chr(10) ORDER BY array_position([{', '.join(q(s) for s in LABEL_STRATA)}], stratum), rn) AS sample_texts
  FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_track, cluster_id, stratum ORDER BY st DESC, conversation_id) AS rn FROM smp) WHERE rn <= 3 GROUP BY 1, 2) s USING (pipeline_track, cluster_id)""")
def conversation_label_table(r):
    texts = r.docs.select("conversation_id", "conversation_text_multilingual", "conversation_text_translated")
    joined = r.labels.where("cluster_id != -1").select("pipeline_track", "cluster_id", "conversation_id").join(r.flags, "conversation_id")
    base = joined.groupBy("pipeline_track", "cluster_id").agg(rows().alias("cluster_size"), pct(n_if(F.col("detected_language") != "en"), rows(), 1).alias("pct_non_english"), distinct_agg(F.col("detected_language"), ",", 10).alias("languages_in_cluster"), confirmed().alias("confirmed_failures"), any_failure().alias("headline_failures"), pct(any_failure(), rows(), 2).alias("headline_failure_rate_pct"), pct(escalated(), rows(), 1).alias("escalation_rate_pct"))
    text = F.when(F.col("pipeline_track") == "multilingual", F.col("conversation_text_multilingual")).otherwise(F.col("conversation_text_translated"))
    kind = profile_op.stratum(F.col("failure_type"))
    kind = F.when(kind.isin("negative", "probable_failure", "positive"), kind).otherwise("recent")
    rank = F.row_number().over(Window.partitionBy("pipeline_track", "cluster_id", "stratum").orderBy(F.desc("conversation_start_date"), "conversation_id"))
    chosen = joined.withColumn("stratum", kind).withColumn("rn", rank).where("rn <= 3").join(texts, "conversation_id")
    line = F.concat(F.lit("["), F.col("stratum"), F.lit("] "), F.left(F.coalesce(text, F.lit("")), F.lit(400)))
    entry = F.struct(profile_op.rank_of(F.col("stratum"), LABEL_STRATA).alias("o"), "rn", line.alias("line"))
    lines = chosen.groupBy("pipeline_track", "cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"]), "\n").alias("sample_texts"))
    return base.join(lines, ["pipeline_track", "cluster_id"], "left")


@query("d40b_cluster_size_comparison", f"""
SELECT pipeline_track, cluster_id, n AS cluster_size, {pct_sql('n', 'sum(CASE WHEN cluster_id <> -1 THEN n END) OVER (PARTITION BY pipeline_track)', 2)} AS pct_of_clustered, {pct_sql('n', 'sum(n) OVER (PARTITION BY pipeline_track)', 2)} AS pct_of_all FROM (SELECT pipeline_track, cluster_id, count(*) AS n FROM labels GROUP BY 1, 2)""")
def cluster_size_comparison(r):
    g = r.labels.groupBy("pipeline_track", "cluster_id").agg(rows().alias("cluster_size"))
    w = Window.partitionBy("pipeline_track")
    real = F.when(F.col("cluster_id") != -1, F.col("cluster_size"))
    return g.withColumns({"pct_of_clustered": pct(F.col("cluster_size"), F.sum(real).over(w), 2), "pct_of_all": pct(F.col("cluster_size"), F.sum("cluster_size").over(w), 2)})


@query("d40c_summary_by_track", f"SELECT pipeline_track, count(*) FILTER (WHERE cluster_id <> -1) AS n_clusters, max(n) FILTER (WHERE cluster_id <> -1) AS largest, min(n) FILTER (WHERE cluster_id <> -1) AS smallest, {pct_sql('coalesce(sum(n) FILTER (WHERE cluster_id = -1), 0)', 'sum(n)', 2)} AS noise_pct FROM (SELECT pipeline_track, cluster_id, count(*) AS n FROM labels GROUP BY 1, 2) GROUP BY 1")
def summary_by_track(r):
    g = r.labels.groupBy("pipeline_track", "cluster_id").agg(rows().alias("n"))
    real = F.when(F.col("cluster_id") != -1, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster_id") == -1, F.col("n"))), F.lit(0))
    return g.groupBy("pipeline_track").agg(F.count(real).alias("n_clusters"), F.max(real).alias("largest"), F.min(real).alias("smallest"), pct(noise, F.sum("n"), 2).alias("noise_pct"))


TRACK = "multilingual"


@query("d41a_sizes_with_flag", f"SELECT cluster_id, count(*) AS n, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct, {sized_sql('count(*)', CONV_SIZES)} AS size_flag FROM labels WHERE pipeline_track = 'multilingual' GROUP BY 1")
def sizes_with_flag(r):
    r.labels.createOrReplaceTempView("talkloom_labels")
    g = r.spark.sql("SELECT cluster_id, count(*) AS n FROM talkloom_labels WHERE pipeline_track = :track GROUP BY cluster_id", args={"track": TRACK})
    return with_share(g, "pct", 2).withColumn("size_flag", sized(F.col("n"), CONV_SIZES, "normal"))


SAMPLE = "SELECT cluster_id, rn AS rank_in_cluster, conversation_id, membership_prob, left(conversation_text_multilingual, 400) AS text_preview FROM (SELECT l.*, row_number() OVER (PARTITION BY l.cluster_id ORDER BY membership_prob DESC, conversation_id) AS rn FROM labels l JOIN chosen USING (cluster_id) WHERE pipeline_track = 'multilingual') JOIN docs USING (conversation_id) WHERE rn <= {n}"


def surest(r, clusters: DataFrame, n: int) -> DataFrame:
    """The ``n`` surest conversations of each of ``clusters``."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("membership_prob"), "conversation_id")).cast("long")
    own = r.labels.where(F.col("pipeline_track") == TRACK).join(F.broadcast(clusters), "cluster_id", "left_semi").withColumn("rank_in_cluster", rank).where(F.col("rank_in_cluster") <= n)
    return own.join(r.docs, "conversation_id").select("cluster_id", "rank_in_cluster", "conversation_id", "membership_prob", F.left("conversation_text_multilingual", F.lit(400)).alias("text_preview"))


@query("d41b_samples_of_largest", "WITH chosen AS (SELECT cluster_id FROM labels WHERE pipeline_track = 'multilingual' AND cluster_id <> -1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) " + SAMPLE.format(n=5))
def conversation_samples_of_largest(r):
    top = r.labels.where((F.col("pipeline_track") == TRACK) & (F.col("cluster_id") != -1)).groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").limit(5)
    return surest(r, top, 5)


@query("d41e_samples_of_tiny", "WITH chosen AS (SELECT cluster_id FROM labels WHERE pipeline_track = 'multilingual' AND cluster_id <> -1 GROUP BY 1 HAVING count(*) < 100) " + SAMPLE.format(n=3))
def samples_of_tiny(r):
    tiny = r.labels.where((F.col("pipeline_track") == TRACK) & (F.col("cluster_id") != -1)).groupBy("cluster_id").count().where("count < 100")
    return surest(r, tiny, 3)


def _noise(r, n: int, longest: bool) -> DataFrame:
    size = F.length("conversation_text_multilingual").cast("long")
    d = r.labels.where((F.col("pipeline_track") == TRACK) & (F.col("cluster_id") == -1)).select("conversation_id").join(r.docs, "conversation_id").withColumn("n_chars", size)
    return d.orderBy(F.desc("n_chars") if longest else "n_chars", "conversation_id").limit(n).select("conversation_id", "detected_language", "n_chars", F.left("conversation_text_multilingual", F.lit(500)).alias("text_preview"))


NOISE_SQL = "SELECT conversation_id, detected_language, length(conversation_text_multilingual) AS n_chars, left(conversation_text_multilingual, 500) AS text_preview FROM labels JOIN docs USING (conversation_id) WHERE pipeline_track = 'multilingual' AND cluster_id = -1 ORDER BY 3 {0}, 1 LIMIT {1}"


@query("d41c_shortest_noise", NOISE_SQL.format("", 50))
def shortest_noise_conversations(r):
    return _noise(r, 50, False)


@query("d41d_longest_noise", NOISE_SQL.format("DESC", 30))
def longest_noise_conversations(r):
    return _noise(r, 30, True)


@query("d41f_membership_buckets", f"SELECT CASE WHEN cluster_id = -1 THEN '[-1] noise' ELSE {bucket_sql('membership_prob', [(f'{b}::DOUBLE', n) for b, n in PROB], '[0.9–1.0] core')} END AS prob_bucket, count(*) AS n, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct FROM labels WHERE pipeline_track = 'multilingual' GROUP BY 1")
def membership_buckets(r):
    name = F.when(F.col("cluster_id") == -1, "[-1] noise").otherwise(bucket(F.col("membership_prob"), PROB, "[0.9–1.0] core"))
    return with_share(r.labels.where(F.col("pipeline_track") == TRACK).groupBy(name.alias("prob_bucket")).agg(rows().alias("n")), "pct", 2)


@query("d43a_chunk_translation_merge", """
SELECT chunk_uid, detected_language, original_chunk_text AS translated, 'none' AS granularity FROM chunks WHERE detected_language = 'en' UNION ALL
SELECT chunk_uid, detected_language, CASE WHEN translated_chunk_text <> original_chunk_text THEN translated_chunk_text ELSE '[en] ' || original_chunk_text END, CASE WHEN translated_chunk_text <> original_chunk_text THEN 'message_level' ELSE 'chunk_level' END FROM chunks WHERE detected_language <> 'en'""")
def chunk_translation_merge(r):
    from talkloom.plugins import MarkingTranslator

    english = r.chunks.where("detected_language = 'en'").select("chunk_uid", "detected_language", F.col("original_chunk_text").alias("translated"), F.lit("none").alias("granularity"))
    foreign = r.chunks.where("detected_language != 'en'")
    done = foreign.where("translated_chunk_text != original_chunk_text").select("chunk_uid", "detected_language", F.col("translated_chunk_text").alias("translated"), F.lit("message_level").alias("granularity"))
    fresh = MarkingTranslator().translate(foreign.where("translated_chunk_text = original_chunk_text"), "original_chunk_text", "translated", "status")
    return english.unionByName(done).unionByName(fresh.where("status = ''").select("chunk_uid", "detected_language", "translated", F.lit("chunk_level").alias("granularity")))


@query("d43b_granularity_summary", f"""
SELECT granularity, count(*) AS n_chunks, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct FROM (SELECT CASE WHEN detected_language = 'en' THEN 'none' WHEN translated_chunk_text <> original_chunk_text THEN 'message_level' ELSE 'chunk_level' END AS granularity FROM chunks) GROUP BY 1""")
def granularity_summary(r):
    return with_share(chunk_translation_merge(r).groupBy("granularity").agg(rows().alias("n_chunks")), "pct", 2, of="n_chunks")


@query("d44a_daily_chunks", "SELECT cluster_id, CAST(conversation_start_date AS DATE) AS ds, count(*) AS y FROM chunks JOIN docs USING (conversation_id) WHERE NOT is_noise GROUP BY 1, 2")
def daily_chunks(r):
    days = r.docs.select("conversation_id", F.to_date("conversation_start_date").alias("ds"))
    return r.chunks.where("NOT is_noise").join(days, "conversation_id").groupBy("cluster_id", "ds").agg(rows().alias("y"))


@query("d44b_daily_conversations", "SELECT cluster_id, CAST(conversation_start_date AS DATE) AS ds, count(DISTINCT conversation_id) AS y FROM chunks JOIN docs USING (conversation_id) WHERE NOT is_noise GROUP BY 1, 2")
def daily_conversations(r):
    days = r.docs.select("conversation_id", F.to_date("conversation_start_date").alias("ds"))
    once = r.chunks.where("NOT is_noise").select("cluster_id", "conversation_id").distinct()
    return once.join(days, "conversation_id").groupBy("cluster_id", "ds").agg(rows().alias("y"))


@query("v13_conversation_topics", "SELECT * FROM topics")
def conversation_topics(r):
    return r.topics
