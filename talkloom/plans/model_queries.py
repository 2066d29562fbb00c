"""Queries of the chunker, of clusters and vectors, of series and of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.semantics import pct, week_start
from talkloom.functions.vectors import dot, unit
from talkloom.operators import chunker, clusters, density, fitted, harness, layout, series, terms
from talkloom.plans import fixed
from talkloom.plans.oracle import pct_sql, q, t_p_sql, trim_sql
from talkloom.plans.registry import query

# --- chunker --------------------------------------------------------------------------------------------------------
LEAST, MOST = 40, 120


def chunker_messages(r) -> DataFrame:
    m = chunker.numbered(r.messages.where("content IS NOT NULL"))
    lang = r.docs.select("conversation_id", "detected_language")
    whole = F.coalesce(F.col("detected_language") != "en", F.lit(False))
    joined = m.join(lang, "conversation_id", "left")
    return joined.select("conversation_id", "message_id", "message_date", F.col("agent_or_bot").alias("role"), F.col("content").alias("original_text"), F.col("content").alias("translated_text"), F.when(whole, "conversation_level").otherwise("message_level").alias("translation_granularity"), F.coalesce("detected_language", F.lit("en")).alias("language"))


NOTHING = f"(t = '' OR t IN ({', '.join(q(x) for x in fixed.EMPTY_MESSAGES)}) OR {' OR '.join(f'starts_with(t, {q(p)})' for p in fixed.EMPTY_BEGINNINGS)})"
CHUNKER_SQL = f"""
WITH RECURSIVE kept AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY message_id) AS k FROM (
    SELECT m.conversation_id, message_id, message_date, CASE WHEN agent_or_bot = 'Client' THEN '[USER]: ' ELSE '[AI]: ' END || content AS line, coalesce(d.detected_language, 'en') AS language,
      len(list_filter(regexp_split_to_array(content, '[\\s\\x{{a0}}]+'), lambda x: x <> '')) AS tc, regexp_replace(lower({trim_sql('content')}), '[!.,?]+$', '') AS t
    FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY message_date, content) - 1 AS message_id FROM messages_raw WHERE content IS NOT NULL) m LEFT JOIN docs d USING (conversation_id))
  WHERE NOT {NOTHING} AND tc >= 2),
walk AS (
  SELECT conversation_id, k, 1::BIGINT AS lo, tc::BIGINT AS tokens, NULL::BIGINT AS closed FROM kept WHERE k = 1
  UNION ALL
  SELECT w.conversation_id, n.k, CASE WHEN c THEN w.k ELSE w.lo END, CASE WHEN c THEN p.tc ELSE w.tokens END + n.tc, CASE WHEN c THEN w.lo END
  FROM (SELECT w.*, w.tokens + n.tc > {MOST} AND w.tokens >= {LEAST} AS c FROM walk w JOIN kept n ON n.conversation_id = w.conversation_id AND n.k = w.k + 1) w
  JOIN kept n ON n.conversation_id = w.conversation_id AND n.k = w.k + 1 JOIN kept p ON p.conversation_id = w.conversation_id AND p.k = w.k),
spans AS (
  SELECT conversation_id, closed AS lo, k - 1 AS hi FROM walk WHERE closed IS NOT NULL
  UNION ALL SELECT conversation_id, arg_max(lo, k), max(k) FROM walk GROUP BY 1),
seq AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY hi, lo) - 1 AS chunk_seq FROM spans)
SELECT s.conversation_id, s.conversation_id || '__c' || lpad(chunk_seq::VARCHAR, 4, '0') AS chunk_id, chunk_seq, min(message_id) AS message_start_idx, max(message_id) AS message_end_idx, count(*) AS num_messages,
  length(string_agg(line, chr(10) ORDER BY k.k)) AS chunk_char_count, string_agg(line, chr(10) ORDER BY k.k) AS original_chunk_text, string_agg(line, chr(10) ORDER BY k.k) AS translated_chunk_text,
  CASE WHEN min(language) <> 'en' THEN 'conversation_level' ELSE 'message_level' END AS translation_granularity, min(language) AS languages, min(message_date) AS min_message_date
FROM seq s JOIN kept k ON k.conversation_id = s.conversation_id AND k.k BETWEEN s.lo AND s.hi GROUP BY 1, 2, 3"""


@query("o08_chunker", CHUNKER_SQL)
def chunk(r):
    return chunker.chunk(chunker_messages(r), LEAST, MOST)


@query("o08c_chunker_byte_pairs")
def chunk_byte_pairs(r):
    from talkloom.functions.tokens import token_count

    return chunker.chunk(chunker_messages(r), LEAST, MOST, token_count)


@query("f32_token_counts")
def token_counts(r):
    from talkloom.functions.tokens import token_count

    d = r.table("documents").select("lang", token_count(F.col("text")).cast("long").alias("n"), chunker.n_tokens(F.coalesce("text", F.lit(""))).alias("words"))
    return d.groupBy("lang").agg(F.sum("n").alias("byte_pairs"), F.sum("words").alias("words"), F.max("n").alias("longest"))


@query("o08b_semantic_chunker")
def semantic_chunk(r):
    from talkloom.functions.hashed import hash_tokens

    return chunker.chunk_with_encoder(chunker_messages(r), lambda t: hash_tokens(t, 64), LEAST, MOST, 0.2)


# --- vectors and clusters -------------------------------------------------------------------------------------------
VEC = "e AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END::BIGINT AS cluster_id, embedding::DOUBLE[] AS v FROM embeddings)"
CENTRES = VEC + """,
el AS (SELECT vec_id, cluster_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
ce AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, round(avg(x), 9) AS m FROM el WHERE cluster_id <> -1 GROUP BY 1, 2) GROUP BY 1),
cu AS (SELECT cluster_id, c, list_transform(c, lambda x: x / greatest(sqrt(list_inner_product(c, c)), 1e-10)) AS u FROM ce)"""


def vectors(r) -> DataFrame:
    return r.table("embeddings").select("vec_id", "embedding", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("long").alias("cluster_id"))


@query("v12_representatives", f"""WITH {CENTRES}
SELECT cluster_id, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cosine DESC, vec_id) AS rank FROM (SELECT cluster_id, vec_id, round(list_inner_product(v, u) / greatest(sqrt(list_inner_product(v, v)), 1e-10), 6) AS cosine FROM e JOIN cu USING (cluster_id))) WHERE rank <= 3""")
def representatives(r):
    return clusters.representatives(vectors(r), "vec_id")


@query("v18_centroid_overlap", f"WITH {CENTRES} SELECT a.cluster_id AS a, b.cluster_id AS b, round(list_inner_product(a.u, b.u), 6) AS cosine FROM cu a JOIN cu b ON a.cluster_id < b.cluster_id")
def centroid_overlap(r):
    return clusters.overlap(vectors(r))


@query("v08_merge_clusters", f"""WITH RECURSIVE {CENTRES},
links AS (SELECT a.cluster_id AS a, b.cluster_id AS b FROM cu a JOIN cu b ON a.cluster_id <> b.cluster_id WHERE round(list_inner_product(a.u, b.u), 6) >= 0.12),
reach AS (SELECT cluster_id AS a, cluster_id AS b FROM cu UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS cluster_id, min(b) AS root FROM reach GROUP BY 1)
SELECT vec_id, CASE WHEN cluster_id = -1 THEN -1 ELSE n END::BIGINT AS cluster_id FROM e LEFT JOIN (SELECT cluster_id, dense_rank() OVER (ORDER BY root) - 1 AS n FROM roots) USING (cluster_id)""")
def merge_clusters(r):
    v = vectors(r)
    return clusters.relabel(v, clusters.merge_by_links(v, 0.12)).select("vec_id", "cluster_id")


@query("v09_merge_average_linkage")
def merge_average_linkage(r):
    v = vectors(r)
    return clusters.relabel(v, clusters.merge_by_average(v, 0.1)).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("v03_blend", f"""WITH {VEC}, m AS (SELECT a.vec_id, a.i, 0.7::DOUBLE * a.x + (1 - 0.7::DOUBLE) * coalesce(b.x, 0) AS x FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) a
  LEFT JOIN (SELECT vec_id - 1 AS vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) b USING (vec_id, i))
SELECT vec_id, round(sum(x * i) / sqrt(sum(x * x)), 5) AS checksum FROM m GROUP BY 1""")
def blend(r):
    v = vectors(r)
    mixed = clusters.blend(v, v.select((F.col("vec_id") - 1).alias("vec_id"), "embedding"), "vec_id")
    return mixed.select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5).alias("checksum"))


@query("v15a_davies_bouldin", f"""WITH {CENTRES},
sp AS (SELECT cluster_id, avg(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(v[i] - c[i], 2))))) AS s FROM e JOIN cu USING (cluster_id) GROUP BY 1)
SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT a.cluster_id, max((sa.s + sb.s) / sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.c[i] - b.c[i], 2))))) AS w FROM cu a JOIN cu b ON a.cluster_id <> b.cluster_id JOIN sp sa ON sa.cluster_id = a.cluster_id JOIN sp sb ON sb.cluster_id = b.cluster_id GROUP BY 1)""")
def davies_bouldin(r):
    return clusters.davies_bouldin(vectors(r))


@query("v15b_calinski_harabasz", f"""WITH {CENTRES}, mid AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, round(avg(x), 9) AS m FROM el WHERE cluster_id <> -1 GROUP BY 1))
SELECT round((SELECT sum(k * list_sum(list_transform(range(1, 65), lambda i: pow(cu.c[i] - mid.c[i], 2)))) FROM cu JOIN (SELECT cluster_id, count(*) AS k FROM e GROUP BY 1) USING (cluster_id), mid) / ((SELECT count(*) FROM cu) - 1)
  / ((SELECT sum(list_sum(list_transform(range(1, 65), lambda i: pow(v[i] - c[i], 2)))) FROM e JOIN cu USING (cluster_id)) / ((SELECT count(*) FROM e WHERE cluster_id <> -1) - (SELECT count(*) FROM cu))), 4) AS calinski_harabasz""")
def calinski_harabasz(r):
    return clusters.calinski_harabasz(vectors(r))


@query("v14_silhouette", f"""WITH {VEC}, s AS (SELECT vec_id, cluster_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-10)) AS v FROM e WHERE cluster_id <> -1),
d AS (SELECT a.vec_id, a.cluster_id, b.cluster_id AS c2, avg(1 - list_inner_product(a.v, b.v)) AS m FROM s a JOIN s b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
w AS (SELECT vec_id, max(m) FILTER (WHERE cluster_id = c2) AS a, min(m) FILTER (WHERE cluster_id <> c2) AS b FROM d GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n_rows FROM w""")
def silhouette(r):
    return clusters.silhouette(vectors(r))


@query("v17_cohesion", f"WITH {VEC}, u AS (SELECT cluster_id, vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-10)) AS v FROM e WHERE cluster_id <> -1) SELECT cluster_id, (SELECT count(*) FROM u x WHERE x.cluster_id = a.cluster_id) AS n, round(avg(list_inner_product(a.v, b.v)), 6) AS mean_cosine FROM u a JOIN u b USING (cluster_id) WHERE a.vec_id <> b.vec_id GROUP BY 1")
def cohesion(r):
    return clusters.cohesion(vectors(r))


@query("v19_agreement", """
WITH t AS (SELECT label AS a, vec_id % 7 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), m AS (SELECT sum(n) AS N, sum(n * (n - 1) / 2) AS ij, sum(n * ln(n)) AS h FROM t),
sa AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS h FROM (SELECT sum(n) AS n FROM t GROUP BY a)), sb AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS h FROM (SELECT sum(n) AS n FROM t GROUP BY b))
SELECT round((ij - sa.s * sb.s / (N * (N - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (N * (N - 1) / 2)), 6) AS ari, round(2 * ((ln(N) - sa.h / N) + (ln(N) - sb.h / N) - (ln(N) - m.h / N)) / ((ln(N) - sa.h / N) + (ln(N) - sb.h / N)), 6) AS nmi, N::BIGINT AS n FROM m, sa, sb""")
def agreement(r):
    return clusters.agreement(r.table("embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b")), "a", "b")


@query("v21_cross_track", """
WITH p AS (SELECT conversation_id, max(cluster_id) FILTER (WHERE pipeline_track = 'multilingual') AS a, max(cluster_id) FILTER (WHERE pipeline_track = 'translated') AS b FROM labels WHERE NOT (pipeline_track = 'translated' AND conversation_id::BIGINT % 10 = 0) GROUP BY 1),
t AS (SELECT a, b, count(*)::DOUBLE AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2), m AS (SELECT sum(n) AS N, sum(n * (n - 1) / 2) AS ij, sum(n * ln(n)) AS h FROM t),
sa AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS h FROM (SELECT sum(n) AS n FROM t GROUP BY a)), sb AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS h FROM (SELECT sum(n) AS n FROM t GROUP BY b))
SELECT round((ij - sa.s * sb.s / (N * (N - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (N * (N - 1) / 2)), 6) AS ari, round(2 * ((ln(N) - sa.h / N) + (ln(N) - sb.h / N) - (ln(N) - m.h / N)) / ((ln(N) - sa.h / N) + (ln(N) - sb.h / N)), 6) AS nmi,
  (SELECT count(*) FROM p WHERE a IS NOT NULL AND b IS NOT NULL) AS n_shared, (SELECT count(*) FROM p WHERE b IS NULL) AS n_only_a, (SELECT count(*) FROM p WHERE a IS NULL) AS n_only_b FROM m, sa, sb""")
def cross_track(r):
    labels = r.labels.where(~((F.col("pipeline_track") == "translated") & (F.col("conversation_id").cast("long") % 10 == 0)))
    return clusters.cross_track(labels, "multilingual", "translated")


@query("v11_noise_summary", """
SELECT is_noise, count(*) AS n, round(quantile_cont(chunk_char_count, 0.25), 6) AS p25, round(quantile_cont(chunk_char_count, 0.5), 6) AS p50, round(quantile_cont(chunk_char_count, 0.75), 6) AS p75, round(stddev_pop(umap_x), 6) AS spread_x, round(stddev_pop(umap_y), 6) AS spread_y FROM chunks GROUP BY 1""")
def noise_summary(r):
    return clusters.noise_summary(r.chunks)


@query("v10_soft_assign", f"""WITH {CENTRES}, s AS (SELECT vec_id, cu.cluster_id, exp(list_inner_product(list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-10)), u) / 0.1::DOUBLE) AS w FROM (SELECT vec_id, v FROM e WHERE cluster_id = -1), cu),
b AS (SELECT vec_id, arg_max(cluster_id, (w, -cluster_id)) AS c, max(w) / sum(w) AS p FROM s GROUP BY 1)
SELECT vec_id, CASE WHEN b.p >= 0.12::DOUBLE THEN c ELSE e.cluster_id END AS cluster_id, coalesce(b.p >= 0.12::DOUBLE, false) AS soft_assigned FROM e LEFT JOIN b USING (vec_id)""")
def soft_assign(r):
    return clusters.soft_assign(vectors(r), 0.12).select("vec_id", "cluster_id", "soft_assigned")


@query("v30_hard_negatives", f"""WITH {VEC}, u AS (SELECT vec_id, cluster_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-10)) AS v FROM e WHERE cluster_id <> -1)
SELECT anchor, other, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY cosine DESC, other) AS rank FROM (SELECT a.vec_id AS anchor, b.vec_id AS other, round(list_inner_product(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.cluster_id <> b.cluster_id)) WHERE rank <= 3""")
def hard_negatives(r):
    return clusters.hard_negatives(vectors(r))


PAIRS = """
WITH pool AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('pairs:' || chunk_uid)) - 1 AS r, count(*) OVER (PARTITION BY cluster_id) AS n FROM chunks WHERE NOT is_noise AND hdbscan_prob >= 0.70::DOUBLE),
p AS (SELECT cluster_id, chunk_uid, r, n, dense_rank() OVER (ORDER BY cluster_id) - 1 AS c FROM pool WHERE n >= 10), k AS (SELECT count(DISTINCT cluster_id) AS k FROM p)
SELECT a.chunk_uid AS anchor, b.chunk_uid AS other, 1 AS label FROM p a, (VALUES (1), (2)) s(s) JOIN p b ON b.cluster_id = a.cluster_id AND b.r = (a.r + s) % a.n WHERE a.r < 4 AND s < a.n
UNION ALL SELECT a.chunk_uid, b.chunk_uid, 0 FROM p a, k JOIN p b ON b.c = (a.c + 1) % k.k AND b.r = a.r % b.n WHERE a.r < 4 AND a.c <> b.c"""


@query("v29_training_pairs", PAIRS)
def training_pairs(r):
    return clusters.training_pairs(r.chunks)


SWEEP = """
WITH s AS (SELECT detected_language AS pipeline_track, m AS selection_method, count(DISTINCT conversation_id) AS n_clusters, round(100.0::DOUBLE * count(*) FILTER (WHERE is_noise) / count(*), 4) AS noise_pct,
  round(avg(hdbscan_prob) FILTER (WHERE NOT is_noise), 6) AS silhouette_embed_cosine, round(max(umap_x) / 10, 6) AS silhouette_umap, round(avg(umap_y), 6) AS dbcv_umap, round(stddev_pop(hdbscan_prob), 6) AS cluster_persistence_mean
  FROM chunks, (VALUES ('eom'), ('leaf')) t(m) WHERE m = 'eom' OR hdbscan_prob >= 0.5::DOUBLE GROUP BY 1, 2)"""


def sweep_rows(r) -> DataFrame:
    """A setting for each language of the chunks, with all of them (eom) or the surer ones (leaf); its scores are means of theirs."""
    c = r.chunks.withColumn("selection_method", F.explode(F.array(F.lit("eom"), F.lit("leaf")))).where((F.col("selection_method") == "eom") | (F.col("hdbscan_prob") >= 0.5))
    return c.groupBy(F.col("detected_language").alias("pipeline_track"), "selection_method").agg(
        F.count_distinct("conversation_id").alias("n_clusters"), F.round(100.0 * F.count_if("is_noise") / F.count("*"), 4).alias("noise_pct"), F.round(F.avg(F.when(~F.col("is_noise"), F.col("hdbscan_prob"))), 6).alias("silhouette_embed_cosine"),
        F.round(F.max("umap_x") / 10, 6).alias("silhouette_umap"), F.round(F.avg("umap_y"), 6).alias("dbcv_umap"), F.round(F.stddev_pop("hdbscan_prob"), 6).alias("cluster_persistence_mean"),
    )


@query("v23_composite_score", SWEEP + """
SELECT pipeline_track, selection_method, c AS composite, row_number() OVER (PARTITION BY pipeline_track ORDER BY c DESC, selection_method) AS rank_in_track, n_clusters BETWEEN 30 AND 250 AND noise_pct <= 55 AND silhouette_embed_cosine IS NOT NULL AS valid,
  concat_ws('  ', CASE WHEN dbcv_umap > 0.5 THEN 'DBCV✓✓' WHEN dbcv_umap > 0.3 THEN 'DBCV✓' WHEN dbcv_umap IS NOT NULL THEN 'DBCV✗' END, CASE WHEN silhouette_umap > 0.5 THEN 'sil✓✓' WHEN silhouette_umap > 0.25 THEN 'sil✓' WHEN silhouette_umap IS NOT NULL THEN 'sil✗' END,
    CASE WHEN noise_pct < 40 THEN 'noise✓' WHEN noise_pct < 50 THEN 'noise~' ELSE 'noise✗' END, CASE WHEN cluster_persistence_mean > 0.12 THEN 'pers✓✓' WHEN cluster_persistence_mean > 0.10 THEN 'pers✓' WHEN cluster_persistence_mean IS NOT NULL THEN 'pers✗' END) AS quality
FROM (SELECT *, round(0.20::DOUBLE * coalesce(silhouette_embed_cosine, 0) + 0.25::DOUBLE * coalesce(silhouette_umap, 0) + 0.30::DOUBLE * coalesce((dbcv_umap + 1) / 2, 0) + 0.20::DOUBLE * coalesce(cluster_persistence_mean, 0) + 0.05::DOUBLE * greatest(0, (50 - coalesce(noise_pct, 50)) / 50), 6)::DOUBLE AS c FROM s)""")
def composite_score(r):
    s = clusters.composite(sweep_rows(r))
    ok = F.col("n_clusters").between(30, 250) & (F.col("noise_pct") <= 55) & F.col("silhouette_embed_cosine").isNotNull()
    return s.select("pipeline_track", "selection_method", "composite", F.col("rank_in_track").cast("long").alias("rank_in_track"), ok.alias("valid"), "quality")


@query("v06_density_clusters")
def density_clusters(r):
    return density.density_clusters(vectors(r), min_cluster_size=15, min_samples=5)


@query("v10b_noise_memberships")
def noise_memberships(r):
    return density.assign_noise(vectors(r), 0.1, 5, 5, "leaf")


@query("v16_dbcv")
def dbcv(r):
    v = vectors(r)
    return r.spark.createDataFrame([(density.dbcv(v),)], "dbcv double")


@query("v22_density_sweep")
def density_sweep(r):
    return density.sweep(vectors(r), [10, 20], [5], ["eom", "leaf"])


@query("v34_few_clusters")
def few_clusters(r):
    found, size = density.few_clusters(vectors(r), 2, 10)
    return found.withColumn("min_cluster_size", F.lit(size))


@query("v25_k_means")
def k_means(r):
    return density.k_means(vectors(r), 10, [1, 2]).groupBy("cluster").agg(F.count("*").alias("n"))


@query("v26_nearest_centre", f"""WITH {CENTRES}, s AS (SELECT vec_id, cluster_id, round(list_inner_product(v, u) / greatest(sqrt(list_inner_product(v, v)), 1e-10), 9) AS s FROM (SELECT vec_id, v FROM e), cu)
SELECT vec_id, arg_max(cluster_id, (s, -cluster_id)) AS cluster_id, round(max(s), 6) AS cosine FROM s GROUP BY 1""")
def nearest_centre(r):
    v = vectors(r)
    return density.nearest_centre(v, clusters.centroids(v))


@query("v04_reduce_dims")
def reduce_dims(r):
    reduced = density.reduce_dims(vectors(r), 2)
    return reduced.select("vec_id", F.round(F.abs(F.get("embedding", F.lit(0))), 4).alias("x"), F.round(F.abs(F.get("embedding", F.lit(1))), 4).alias("y"))


@query("v04b_layout")
def layout_of_all(r):
    at = lambda i: F.get("position", F.lit(i))
    return layout.layout(vectors(r)).select("vec_id", at(0).alias("x"), at(1).alias("y"))


@query("v05b_layout_of_sample")
def layout_of_sample(r):
    """A layout of 40 rows a cluster, noise too, in which all other rows are placed."""
    v = vectors(r)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.xxhash64("vec_id"), "vec_id"))
    some = v.withColumn("_r", rank).where("_r <= 40").drop("_r")
    at = lambda i: F.get("position", F.lit(i))
    return layout.placed(v, some, layout.layout(some)).select("vec_id", at(0).alias("x"), at(1).alias("y"))


@query("v06b_layout_clusters")
def layout_clusters(r):
    """Density clusters in a layout of ten dimensions."""
    flat = layout.layout(vectors(r), dims=10)
    return density.density_clusters(flat, vector="position", min_cluster_size=15, min_samples=5)


@query("v01_embed")
def embed(r):
    from talkloom.plugins import HashedNgramEmbedder

    made = HashedNgramEmbedder(64).embed(r.docs.where(F.length("conversation_text_translated") >= 10), "conversation_text_translated", "ml_generate_embedding_result", "ml_generate_embedding_status")
    ok = made.where(F.length("ml_generate_embedding_status") == 0)
    v = F.col("ml_generate_embedding_result")
    return ok.select("conversation_id", F.size(v).alias("dim"), F.round(dot(unit(v), unit(v)), 4).alias("norm"))


@query("v20_stability")
def stability(r):
    return harness.stability(vectors(r), 6, [1, 2])


@query("v35_compare_embedders")
def compare_embedders(r):
    from talkloom.plugins import HashedNgramEmbedder

    out = harness.compare_embedders(r.docs, [HashedNgramEmbedder(32), HashedNgramEmbedder(64)], "conversation_id", "conversation_text_translated", 4)
    return out.drop("encode_s")


@query("v32b_reduce_outliers", f"""WITH {CENTRES}, s AS (SELECT vec_id, cu.cluster_id, round(list_inner_product(v, u) / greatest(sqrt(list_inner_product(v, v)), 1e-10), 9) AS s FROM (SELECT vec_id, v FROM e WHERE cluster_id = -1), cu),
b AS (SELECT vec_id, arg_max(cluster_id, (s, -cluster_id)) AS c, max(s) AS s FROM s GROUP BY 1)
SELECT vec_id, CASE WHEN e.cluster_id <> -1 THEN e.cluster_id WHEN round(b.s, 6) >= 0.15::DOUBLE THEN c ELSE -1 END AS cluster_id FROM e LEFT JOIN b USING (vec_id)""")
def reduce_outliers(r):
    return harness.reduce_outliers(vectors(r), 0.15).select("vec_id", "cluster_id")


@query("v32c_reduce_outliers_neighbour", f"""WITH {VEC}, u AS (SELECT vec_id, cluster_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-10)) AS v FROM e),
s AS (SELECT a.vec_id, b.cluster_id AS c, b.vec_id AS other, round(list_inner_product(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.cluster_id = -1 AND b.cluster_id <> -1),
n AS (SELECT vec_id, arg_max(c, (s, -other)) AS c, max(s) AS s FROM s GROUP BY 1)
SELECT vec_id, CASE WHEN e.cluster_id <> -1 THEN e.cluster_id WHEN n.s >= 0.3::DOUBLE THEN n.c ELSE -1 END AS cluster_id FROM e LEFT JOIN n USING (vec_id)""")
def reduce_outliers_neighbour(r):
    return harness.reduce_outliers(vectors(r), 0.3, "neighbour").select("vec_id", "cluster_id")


WINDOW_TOPICS = """w AS (SELECT chunk_uid, cluster_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos, len(t) AS n FROM (SELECT chunk_uid, cluster_id, regexp_extract_all(lower(coalesce(translated_chunk_text, '')), '[\\p{L}\\p{N}_]{2,}') AS t FROM chunks)),
tf AS (SELECT cluster_id AS topic, term, count(*)::DOUBLE AS tf FROM w WHERE cluster_id <> -1 GROUP BY 1, 2), idf AS (SELECT term, ln(1 + (SELECT sum(tf) / count(DISTINCT topic) FROM tf) / sum(tf)) AS idf FROM tf GROUP BY 1),
cw AS (SELECT topic, term, tf / sum(tf) OVER (PARTITION BY topic) * idf AS wt FROM tf JOIN idf USING (term)), tp AS (SELECT topic, term, wt / sqrt(sum(wt * wt) OVER (PARTITION BY topic)) AS wt FROM cw),
wc AS (SELECT chunk_uid, win, term, count(*) AS c FROM w, LATERAL (SELECT unnest(generate_series(least(greatest(pos - 3, 0), greatest(n - 4, 0)), least(pos, greatest(n - 4, 0)))) AS win) GROUP BY 1, 2, 3),
ww AS (SELECT chunk_uid, win, term, c * idf AS ww FROM wc JOIN idf USING (term)), nw AS (SELECT chunk_uid, win, sqrt(sum(ww * ww)) AS nw FROM ww GROUP BY 1, 2),
sm AS (SELECT chunk_uid, topic, round(d / nw, 9) AS s FROM (SELECT chunk_uid, win, topic, sum(ww * wt) AS d FROM ww JOIN tp USING (term) GROUP BY 1, 2, 3) JOIN nw USING (chunk_uid, win)),
sh AS (SELECT chunk_uid, topic, round(sum(s) / sum(sum(s)) OVER (PARTITION BY chunk_uid), 8) AS share FROM sm WHERE s >= 0.1::DOUBLE GROUP BY 1, 2)"""


@query("v32d_window_topics", f"WITH {WINDOW_TOPICS} SELECT chunk_uid, topic, round(share, 6) AS share FROM sh")
def window_topics(r):
    return terms.window_topics(r.chunks, "chunk_uid", "translated_chunk_text", "cluster_id").select("chunk_uid", "topic", F.round("share", 6).alias("share"))


@query("v32e_reduce_outliers_distribution", f"""WITH {WINDOW_TOPICS}, b AS (SELECT chunk_uid, arg_max(topic, (share, -topic)) AS t, max(share) AS s FROM sh GROUP BY 1)
SELECT chunk_uid, CASE WHEN cluster_id = -1 AND s >= 0.12::DOUBLE THEN t ELSE cluster_id END AS cluster_id FROM chunks LEFT JOIN b USING (chunk_uid)""")
def reduce_outliers_distribution(r):
    return harness.reduce_by_distribution(r.chunks, 0.12, "chunk_uid", "translated_chunk_text")


@query("v05_stratified_sample", "SELECT cluster_id, chunk_uid FROM (SELECT cluster_id, chunk_uid, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(chunk_uid)) AS r FROM chunks WHERE NOT is_noise) WHERE r <= 20")
def stratified_sample(r):
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.md5("chunk_uid")))
    return r.chunks.where("NOT is_noise").select("cluster_id", "chunk_uid").withColumn("r", rank).where("r <= 20").drop("r")


@query("a30_language_entropy", "SELECT cluster_id, round(-sum(p * log2(p)), 6) AS entropy_bits FROM (SELECT cluster_id, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY cluster_id) AS p FROM chunks GROUP BY cluster_id, detected_language) GROUP BY 1")
def language_entropy(r):
    return clusters.entropy(r.chunks, "cluster_id", "detected_language")


# --- aggregations of the notebooks ----------------------------------------------------------------------------------
@query("a24_crosstab", "SELECT category, count(*) FILTER (WHERE rating_score = -1) AS negative, count(*) FILTER (WHERE rating_score = 0) AS unrated, count(*) FILTER (WHERE rating_score = 1) AS positive FROM (SELECT coalesce(category, 'none') AS category, rating_score FROM docs) GROUP BY 1")
def crosstab(r):
    p = r.docs.groupBy(F.coalesce("category", F.lit("none")).alias("category")).pivot("rating_score", [-1, 0, 1]).agg(F.count(F.lit(1))).na.fill(0)
    return p.select("category", F.col("-1").alias("negative"), F.col("0").alias("unrated"), F.col("1").alias("positive"))


@query("a25_weekly_pivot", """
SELECT week_start, en, fr, de, es, round(100.0::DOUBLE * en / (en + fr + de + es), 4) AS en_share FROM (SELECT (CAST(conversation_start_date AS DATE) - CAST(dayofweek(CAST(conversation_start_date AS DATE)) AS INTEGER)) AS week_start,
  count(*) FILTER (WHERE detected_language = 'en') AS en, count(*) FILTER (WHERE detected_language = 'fr') AS fr, count(*) FILTER (WHERE detected_language = 'de') AS de, count(*) FILTER (WHERE detected_language = 'es') AS es FROM docs GROUP BY 1)""")
def weekly_pivot(r):
    langs = ["en", "fr", "de", "es"]
    p = r.docs.groupBy(week_start(F.col("conversation_start_date")).alias("week_start")).pivot("detected_language", langs).agg(F.count(F.lit(1))).na.fill(0)
    whole = sum((F.col(x) for x in langs[1:]), F.col(langs[0]))
    return p.withColumn("en_share", pct(F.col("en"), whole, 4))


@query("a27_flag_correlations", """
SELECT round(corr(a, b), 6) AS rep_by_agent, round(corr(a, c), 6) AS rep_by_confirmed, count(*) FILTER (WHERE a = 1 AND c = 1) AS both, count(*) FILTER (WHERE a = 1 OR c = 1) AS either
FROM (SELECT is_repetition_loop::INT::DOUBLE AS a, requested_agent::INT::DOUBLE AS b, is_confirmed_failure::INT::DOUBLE AS c FROM flags)""")
def flag_correlations(r):
    x = r.flags.select(*[F.col(c).cast("int").cast("double").alias(k) for c, k in [("is_repetition_loop", "a"), ("requested_agent", "b"), ("is_confirmed_failure", "c")]])
    return x.agg(F.round(F.corr("a", "b"), 6).alias("rep_by_agent"), F.round(F.corr("a", "c"), 6).alias("rep_by_confirmed"), F.count_if((F.col("a") == 1) & (F.col("c") == 1)).alias("both"), F.count_if((F.col("a") == 1) | (F.col("c") == 1)).alias("either"))


@query("a28_describe", "SELECT count(*) AS n, round(avg(conversation_text_length), 6) AS mean, round(stddev_samp(conversation_text_length), 6) AS std, min(conversation_text_length) AS least, quantile_cont(conversation_text_length, 0.25) AS p25, quantile_cont(conversation_text_length, 0.5) AS p50, quantile_cont(conversation_text_length, 0.75) AS p75, quantile_cont(conversation_text_length, 0.95) AS p95, max(conversation_text_length) AS most FROM flags")
def describe(r):
    x = "conversation_text_length"
    p = lambda v: F.percentile(x, F.lit(v))
    return r.flags.agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("least"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.95).alias("p95"), F.max(x).alias("most"))


@query("a29_group_arg_max", "SELECT cluster_id, arg_max(chunk_uid, (hdbscan_prob, chunk_uid)) AS chunk_uid, max(hdbscan_prob) AS hdbscan_prob FROM chunks GROUP BY 1")
def group_arg_max(r):
    return r.chunks.groupBy("cluster_id").agg(F.max_by("chunk_uid", F.struct("hdbscan_prob", "chunk_uid")).alias("chunk_uid"), F.max("hdbscan_prob").alias("hdbscan_prob"))


@query("s04_array_relation", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN (SELECT unnest(['1-URGENT', '2-HIGH']) AS p) ON p = o_orderpriority GROUP BY 1")
def array_relation(r):
    p = r.spark.range(1).select(F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("p"))
    return r.table("orders").join(F.broadcast(p), F.col("o_orderpriority") == F.col("p")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("s18_upsert", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 3 = 0")
def upsert(r):
    from talkloom.sources.tables import upsert

    old = r.table("customer").select("c_custkey", "c_mktsegment")
    return upsert(old, old.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])


@query("s03_registry", """SELECT model, kind, dim, n FROM (VALUES ('hashed-ngrams-384', 'HashedNgramEmbedder', 384), ('hashed-ngrams-64', 'HashedNgramEmbedder', 64)) t(model, kind, dim)
JOIN (SELECT len(embedding) AS d, count(*) AS n FROM embeddings GROUP BY 1) ON d <= dim""")
def registry(r):
    """The registered models, with how many of the table's vectors each could hold."""
    from talkloom.plugins import registered

    sizes = r.table("embeddings").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    return registered(r.spark).join(sizes, F.col("d") <= F.col("dim")).drop("d")


# --- series ---------------------------------------------------------------------------------------------------------
DAILY = """dl AS (SELECT event_type AS key, CAST(ts AS DATE) AS ds, count(*) AS y FROM events GROUP BY 1, 2),
sp AS (SELECT k.key, d.ds::DATE AS ds, coalesce(dl.y, 0)::DOUBLE AS y FROM (SELECT DISTINCT key FROM dl) k CROSS JOIN (SELECT unnest(generate_series((SELECT min(ds) FROM dl)::TIMESTAMP, (SELECT max(ds) FROM dl)::TIMESTAMP, INTERVAL 1 DAY)) AS ds) d LEFT JOIN dl ON dl.key = k.key AND dl.ds = d.ds::DATE)"""
WEEKLY = "wk AS (SELECT o_orderpriority AS key, CAST(date_trunc('week', o_orderdate) AS DATE) AS ds, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2), ix AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM wk)"


def daily(r) -> DataFrame:
    g = r.table("events").groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("ds")).agg(F.count("*").alias("y"))
    return series.spine(g, "key", "ds", "y")


def weekly(r) -> DataFrame:
    return r.table("orders").groupBy(F.col("o_orderpriority").alias("key"), week_start(F.col("o_orderdate"), "monday").alias("ds")).agg(F.count("*").cast("double").alias("y"))


@query("z06_date_spine", f"WITH {DAILY} SELECT * FROM sp")
def date_spine(r):
    return daily(r)


@query("z01_trend", f"WITH {DAILY}, x AS (SELECT *, date_diff('day', (SELECT min(ds) FROM sp), ds)::DOUBLE AS x FROM sp) SELECT key, sum(y) AS total, round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2, count(*) AS n FROM x GROUP BY 1")
def trend(r):
    return series.trend(daily(r)).select("key", "total", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "n")


TREND = """x AS (SELECT *, date_diff('day', (SELECT min(ds) FROM sp), ds)::DOUBLE AS x FROM sp), f AS (SELECT key, sum(y) AS total, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, count(*) AS n FROM x GROUP BY 1)"""


@query("z01b_trend_labels", f"""WITH {DAILY}, {TREND}, p AS (SELECT *, {t_p_sql('t', 'nu')} AS p FROM (SELECT *, sqrt(r2 * (n - 2) / (1 - r2)) * sign(slope) AS t, n - 2 AS nu FROM f))
SELECT key, total, round(slope, 3) AS slope_per_week, round(r2, 3) AS r_squared, round(p, 4) AS p_value, CASE WHEN slope > 0.05 AND p < 0.05 THEN 'growing ↑' WHEN slope < -0.05 AND p < 0.05 THEN 'declining ↓' ELSE 'stable →' END AS trend FROM p""")
def trend_labels(r):
    return series.trend_labels(daily(r))


@query("z04_decomposition", f"""WITH {DAILY}, i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ds) - 1 AS idx FROM sp),
t AS (SELECT a.key, a.ds, a.y, a.idx, CASE WHEN count(b.y) = 5 THEN (sum(b.y) - (max(b.y) FILTER (WHERE b.idx = a.idx - 2) + max(b.y) FILTER (WHERE b.idx = a.idx + 2)) / 2) / 4 END AS trend FROM i a JOIN i b ON a.key = b.key AND abs(a.idx - b.idx) <= 2 GROUP BY 1, 2, 3, 4),
s AS (SELECT key, idx % 4 AS season, avg(y - trend) AS raw FROM t GROUP BY 1, 2), c AS (SELECT key, season, raw - avg(raw) OVER (PARTITION BY key) AS seasonal FROM s)
SELECT t.key, ds, y, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(y - trend - seasonal, 6) AS resid FROM t JOIN c ON c.key = t.key AND c.season = t.idx % 4""")
def decomposition(r):
    return series.decompose(daily(r))


@query("z05a_autocorrelation", f"""WITH {DAILY}, d AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ds) AS i, count(*) OVER (PARTITION BY key) AS n, y - avg(y) OVER (PARTITION BY key) AS d FROM sp),
a AS (SELECT x.key, k AS lag, x.n, sum(x.d * z.d) / (SELECT sum(d * d) FROM d w WHERE w.key = x.key) AS acf FROM d x, range(1, 5) g(k), d z WHERE z.key = x.key AND z.i = x.i - k GROUP BY x.key, k, x.n)
SELECT key, lag, round(acf, 6) AS acf, round(n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY key ORDER BY lag), 4) AS q FROM a""")
def autocorrelation(r):
    return series.autocorrelation(daily(r))


@query("z05e_partial_autocorrelation", f"""WITH {DAILY}, d AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ds) AS i, y - avg(y) OVER (PARTITION BY key) AS d FROM sp),
a AS (SELECT x.key, k AS lag, round(sum(x.d * z.d) / (SELECT sum(d * d) FROM d w WHERE w.key = x.key), 6) AS acf FROM d x, range(1, 5) g(k), d z WHERE z.key = x.key AND z.i = x.i - k GROUP BY x.key, k),
r AS (SELECT key, max(acf) FILTER (WHERE lag = 1) AS r1, max(acf) FILTER (WHERE lag = 2) AS r2, max(acf) FILTER (WHERE lag = 3) AS r3, max(acf) FILTER (WHERE lag = 4) AS r4 FROM a GROUP BY 1),
s2 AS (SELECT *, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM r), s3 AS (SELECT *, r1 - p2 * r1 AS q1 FROM s2), s4 AS (SELECT *, (r3 - q1 * r2 - p2 * r1) / (1 - q1 * r1 - p2 * r2) AS p3 FROM s3),
s5 AS (SELECT *, q1 - p3 * p2 AS t1, p2 - p3 * q1 AS t2 FROM s4), s6 AS (SELECT *, (r4 - t1 * r3 - t2 * r2 - p3 * r1) / (1 - t1 * r1 - t2 * r2 - p3 * r3) AS p4 FROM s5)
SELECT key, 1::BIGINT AS lag, round(r1, 4) AS pacf FROM s6 UNION ALL SELECT key, 2, round(p2, 4) FROM s6 UNION ALL SELECT key, 3, round(p3, 4) FROM s6 UNION ALL SELECT key, 4, round(p4, 4) FROM s6""")
def partial_autocorrelation(r):
    return series.partial_autocorrelation(daily(r))


@query("z05b_jarque_bera", f"WITH {DAILY}, d AS (SELECT key, y - avg(y) OVER (PARTITION BY key) AS d FROM sp), m AS (SELECT key, count(*) AS n, avg(pow(d, 2)) AS m2, avg(pow(d, 3)) AS m3, avg(pow(d, 4)) AS m4 FROM d GROUP BY 1) SELECT key, round(n / 6 * (m3 * m3 / pow(m2, 3) + pow(m4 / pow(m2, 2) - 3, 2) / 4), 4) AS jb FROM m")
def jarque_bera(r):
    return series.jarque_bera(daily(r))


@query("z05c_adf", f"""WITH {DAILY}, l AS (SELECT key, y - lag(y) OVER w AS d, lag(y) OVER w AS y1, lag(y) OVER w - lag(y, 2) OVER w AS d1 FROM sp WINDOW w AS (PARTITION BY key ORDER BY ds)),
s AS (SELECT key, count(*) AS n, var_pop(y1) * count(*) AS aa, var_pop(d1) * count(*) AS bb, covar_pop(y1, d1) * count(*) AS ab, covar_pop(y1, d) * count(*) AS ay, covar_pop(d1, d) * count(*) AS dy, var_pop(d) * count(*) AS yy FROM l WHERE d1 IS NOT NULL GROUP BY 1),
b AS (SELECT *, (ay * bb - dy * ab) / (aa * bb - ab * ab) AS b1, (dy * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM s)
SELECT key, round(b1 / sqrt((yy - b1 * ay - b2 * dy) / (n - 3) * bb / (aa * bb - ab * ab)), 4) AS adf FROM b""")
def adf(r):
    return series.adf(daily(r))


ARCH_STEPS = ["u0 AS (SELECT key, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY key) AS {c}" for c in ("e", "x1", "x2", "x3", "x4")) + " FROM l)"]
for k in range(1, 5):  # each lag is made orthogonal to those before it
    rest = [f"x{j} - x{k} * sum(x{j} * x{k}) OVER (PARTITION BY key) / sum(x{k} * x{k}) OVER (PARTITION BY key) AS x{j}" for j in range(k + 1, 5)]
    ARCH_STEPS.append(f"u{k} AS (SELECT key, e, " + ", ".join([*[f"x{j}" for j in range(1, k + 1)], *rest]) + f" FROM u{k - 1})")
ARCH = f"""WITH {DAILY}, ev AS (SELECT key, ds, pow(y - avg(y) OVER (PARTITION BY key), 2) AS e FROM sp),
l AS (SELECT * FROM (SELECT key, e, {", ".join(f"lag(e, {k}) OVER w AS x{k}" for k in range(1, 5))} FROM ev WINDOW w AS (PARTITION BY key ORDER BY ds)) WHERE x4 IS NOT NULL), {", ".join(ARCH_STEPS)}
SELECT key, round(count(*) * ({" + ".join(f"pow(sum(e * x{k}), 2) / sum(x{k} * x{k})" for k in range(1, 5))}) / sum(e * e), 4) AS lm FROM u4 GROUP BY 1"""


@query("z05d_arch_lm", ARCH)
def arch_lm(r):
    return series.arch_lm(daily(r))


NAIVE = WEEKLY + """,
f AS (SELECT a.key, t.k AS split, t.k + h AS idx, b.y, c.y AS naive, h, c0.y AS y0 FROM (SELECT DISTINCT key, n FROM ix) a, generate_series(56, a.n - 14, 14) t(k), range(0, 14) g(h)
  JOIN ix b ON b.key = a.key AND b.idx = t.k + h JOIN ix c ON c.key = a.key AND c.idx = t.k - 1 JOIN ix c0 ON c0.key = a.key AND c0.idx = 0),
m AS (SELECT key, idx + 1 AS split, avg(y) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ma4, avg(ch) OVER (PARTITION BY key ORDER BY idx) AS scale FROM (SELECT *, abs(y - lag(y, 7) OVER (PARTITION BY key ORDER BY idx)) AS ch FROM ix)),
nf AS (SELECT f.key, f.split, f.idx, f.y, naive, ma4, naive + (h + 1) * (naive - y0) / (f.split - 1) AS drift, scale FROM f JOIN m ON m.key = f.key AND m.split = f.split)"""


def naive(r) -> DataFrame:
    return series.naive_forecasts(weekly(r), 56, 14, 14)


@query("z08_naive_forecasts", f"WITH {NAIVE} SELECT key, split, idx, y, naive, round(ma4, 6) AS ma4, round(drift, 6) AS drift, round(scale, 6) AS scale FROM nf")
def naive_forecasts(r):
    return naive(r).select("key", "split", "idx", "y", "naive", *[F.round(c, 6).alias(c) for c in ("ma4", "drift", "scale")])


MEASURES = """count(*) AS n, round(avg(abs(y - ma4)), 6) AS mae, round(sqrt(avg(pow(y - ma4, 2))), 6) AS rmse, round(100 * avg(2 * abs(y - ma4) / (abs(y) + abs(ma4) + 1e-8)), 6) AS smape, round(100 * avg(abs((y - ma4) / y)) FILTER (WHERE y <> 0), 6) AS mape,
  round(avg(abs(y - ma4) / scale), 6) AS mase, round(1 - sum(pow(y - ma4, 2)) / (var_pop(y) * count(*)), 6) AS r2"""


@query("z13_measures", f"WITH {NAIVE} SELECT key, {MEASURES} FROM nf GROUP BY 1")
def measures(r):
    return series.measures(naive(r), ["key"], "ma4")


@query("z07_weekly_one_step", f"""WITH {WEEKLY} SELECT key, count(*) AS n, round(avg(abs(y - l)), 6) AS mae FROM (SELECT *, lag(y) OVER (PARTITION BY key ORDER BY idx) AS l FROM ix) WHERE idx >= 8 GROUP BY 1""")
def weekly_one_step(r):
    return series.measures(series.naive_forecasts(weekly(r), 8), ["key"], "naive").select("key", "n", "mae")


@query("z14_diebold_mariano", f"WITH {NAIVE}, d AS (SELECT key, pow(y - naive, 2) - pow(y - ma4, 2) AS d FROM nf) SELECT key, count(*) AS n, CASE WHEN count(*) >= 3 AND var_samp(d) >= 1e-10 THEN round(avg(d) / sqrt(var_samp(d) / count(*)), 3) END AS dm FROM d GROUP BY 1")
def diebold_mariano(r):
    return series.diebold_mariano(naive(r), ["key"], "naive", "ma4")


@query("z14b_diebold_mariano_p", f"""WITH {NAIVE}, dd AS (SELECT key, pow(y - naive, 2) - pow(y - ma4, 2) AS d FROM nf), dm AS (SELECT key, count(*) AS n, CASE WHEN count(*) >= 3 AND var_samp(d) >= 1e-10 THEN round(avg(d) / sqrt(var_samp(d) / count(*)), 3) END AS dm FROM dd GROUP BY 1)
SELECT key, n, dm, round({t_p_sql('dm', '(n - 1)')}, 4) AS p_value FROM dm""")
def diebold_mariano_p(r):
    return series.with_dm_p(series.diebold_mariano(naive(r), ["key"], "naive", "ma4"))


@query("z15_weighted_mae", f"WITH {NAIVE}, k AS (SELECT key, avg(abs(y - naive)) AS a, avg(abs(y - ma4)) AS b, sum(y) AS w FROM nf GROUP BY 1) SELECT round(sum(a * w) / sum(w), 6) AS naive, round(sum(b * w) / sum(w), 6) AS ma4 FROM k")
def weighted_mae(r):
    each = naive(r).groupBy("key").agg(F.avg(F.abs(F.col("y") - F.col("naive"))).alias("a"), F.avg(F.abs(F.col("y") - F.col("ma4"))).alias("b"), F.sum("y").alias("w"))
    return each.agg(F.round(series.weighted_mae(each, "a", "w"), 6).alias("naive"), F.round(series.weighted_mae(each, "b", "w"), 6).alias("ma4"))


@query("z16_best_model", f"""WITH {NAIVE}, k AS (SELECT key, round(avg(abs(y - naive)), 6) AS a, round(avg(abs(y - ma4)), 6) AS b, round(avg(abs(y - drift)), 6) AS c FROM nf GROUP BY 1)
SELECT key, CASE WHEN a <= b AND a <= c THEN 'naive' WHEN b <= c THEN 'ma4' ELSE 'drift' END AS best, least(a, b, c) AS mae FROM k""")
def best_model(r):
    return series.best_model(naive(r), ["naive", "ma4", "drift"])


@query("z17_post_spike", f"WITH {WEEKLY}, p AS (SELECT key, y, lag(y) OVER (PARTITION BY key ORDER BY idx) AS l, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS j FROM ix WHERE idx >= 5) SELECT key, count(*) AS n, round(avg(abs(y - l)), 6) AS mae FROM p WHERE j >= 8 GROUP BY 1")
def post_spike(r):
    later = series.indexed(weekly(r)).where("idx >= 5").drop("idx")
    return series.measures(series.naive_forecasts(later, 8), ["key"], "naive").select("key", "n", "mae")


@query("z19_interval_scores", f"""WITH {NAIVE} SELECT key, round(avg(CASE WHEN y BETWEEN ma4 - scale AND ma4 + scale THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS coverage,
  round(avg(2 * scale + 40 * (greatest(ma4 - scale - y, 0) + greatest(y - ma4 - scale, 0))), 4) AS winkler, round(avg(ln(scale * scale + 1e-8) + y * y / (scale * scale + 1e-8)), 6) AS qlike FROM nf GROUP BY 1""")
def interval_scores(r):
    s = F.col("scale")
    return series.interval_scores(naive(r).withColumns({"lo": F.col("ma4") - s, "hi": F.col("ma4") + s, "var": s * s}), ["key"])


@query("z20_top_by_volume", f"WITH {WEEKLY} SELECT key, sum(y)::BIGINT AS total, {pct_sql('sum(y)', 'sum(sum(y)) OVER ()', 2)} AS share_pct FROM wk GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_by_volume(r):
    t = weekly(r).groupBy("key").agg(F.sum("y").cast("long").alias("total"))
    return t.withColumn("share_pct", pct(F.col("total"), F.sum("total").over(Window.partitionBy()), 2)).orderBy(F.desc("total"), "key").limit(3)


@query("w08_changes", f"WITH {WEEKLY} SELECT key, ds, y - lag(y) OVER w AS diff, round((y / lag(y) OVER w - 1), 6) AS pct_change FROM wk WINDOW w AS (PARTITION BY key ORDER BY ds)")
def changes(r):
    before = F.lag("y").over(Window.partitionBy("key").orderBy("ds"))
    return weekly(r).select("key", "ds", (F.col("y") - before).alias("diff"), F.round(F.col("y") / before - 1, 6).alias("pct_change"))


@query("z09_fitted_forecasts")
def fitted_forecasts(r):
    f = series.fitted_forecasts(daily(r), 14, 7, 7)
    return f.groupBy("key").agg(*[F.round(F.avg(F.abs(F.col("y") - F.col(m))), 2).alias(f"{m}_mae") for m in ("ets", "damped", "line", "ensemble")])


@query("z10_arima")
def arima(r):
    """One-step forecasts of each fold, orders by AICc; ``spike``: the first five weeks have a level of their own."""
    w = weekly(r)
    plain = fitted.arima_forecasts(w, 56, 1, 14, 2, 2)
    spike = fitted.arima_forecasts(w, 56, 1, 14, 2, 2, 5).select("key", "split", F.col("arima").alias("spike"))
    return plain.join(spike, ["key", "split"]).select("key", "split", "idx", "y", *[F.round(c, 2).alias(c) for c in ("arima", "spike")], "p", "d", "q")


@query("z11_changepoint_trend")
def changepoint_trend(r):
    f = fitted.change_forecasts(daily(r), 14, 7, 7)
    hit = F.col("y").between(F.col("lo"), F.col("hi")).cast("double")
    return f.groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("trend"))), 4).alias("mae"), F.round(F.avg(hit), 6).alias("coverage"))


@query("z18_garch")
def garch(r):
    g = fitted.garch(weekly(r))
    each = g.select("key", F.explode(F.arrays_zip("changes", "variances")).alias("e"), "mu")
    s = F.sqrt("e.variances")
    scored = series.interval_scores(each.select("key", (F.col("e.changes") - F.col("mu")).alias("y"), (-1.96 * s).alias("lo"), (1.96 * s).alias("hi"), F.col("e.variances").alias("var")), ["key"])
    return g.select("key", "n", *[F.round(c, 3).alias(c) for c in ("omega", "alpha", "beta", "persistence", "aic", "nu", "next_variance")]).join(scored, "key")


# --- terms ----------------------------------------------------------------------------------------------------------
WORDS = "list_filter(regexp_extract_all(lower(coalesce(conversation_text_translated, '')), '[\\p{L}\\p{N}_]{2,}'), lambda x: true)"
TFIDF = f"""wd AS (SELECT conversation_id AS d, {WORDS} AS w FROM docs),
tm AS (SELECT d, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wd), tf AS (SELECT d, term, count(*) AS tf FROM tm GROUP BY 1, 2),
dfq AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 3 ORDER BY 3 DESC, 1 LIMIT 2000), rw AS (SELECT d, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + df)) + 1) AS raw FROM tf JOIN dfq USING (term)),
ti AS (SELECT d, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY d)) AS weight FROM rw)"""


def weights(r) -> DataFrame:
    return terms.tf_idf(r.docs, "conversation_id", "conversation_text_translated", 3, 2000)


@query("v24_tf_idf", f"WITH {TFIDF} SELECT d AS conversation_id, term, round(weight, 8) AS weight FROM ti")
def tf_idf(r):
    return weights(r).select("conversation_id", "term", F.round("weight", 8).alias("weight"))


@query("v27_top_terms", f"""WITH {TFIDF}, g AS (SELECT conversation_id AS d, coalesce(category, 'none') AS g FROM docs), n AS (SELECT g, count(*) AS n FROM g GROUP BY 1)
SELECT grp, term, mean, rank FROM (SELECT g AS grp, term, mean, row_number() OVER (PARTITION BY g ORDER BY mean DESC, term) AS rank FROM (SELECT g.g, term, round(sum(weight) / max(n.n), 8) AS mean FROM ti JOIN g USING (d) JOIN n ON n.g = g.g GROUP BY 1, 2)) WHERE rank <= 5""")
def top_terms(r):
    groups = r.docs.select("conversation_id", F.coalesce("category", F.lit("none")).alias("grp"))
    return terms.top_terms(weights(r), groups, "conversation_id", "grp")


@query("o24_failed_keywords", f"""WITH {TFIDF}, g AS (SELECT conversation_id AS d, is_any_failure AS f FROM flags), df2 AS (SELECT term, round(coalesce(sum(weight) FILTER (WHERE f), 0) / (SELECT count(*) FROM g WHERE f) - coalesce(sum(weight) FILTER (WHERE NOT f), 0) / (SELECT count(*) FROM g WHERE NOT f), 8) AS difference FROM ti JOIN g USING (d) GROUP BY 1)
SELECT * FROM (SELECT term, difference, 'with' AS side FROM df2 ORDER BY 2 DESC, 1 LIMIT 15) UNION ALL SELECT * FROM (SELECT term, difference, 'without' FROM df2 ORDER BY 2, 1 LIMIT 15)""")
def failed_keywords(r):
    return terms.contrast(weights(r), r.flags.select("conversation_id", "is_any_failure"), "conversation_id", "is_any_failure")


@query("v32_class_tf_idf", f"""WITH tm AS (SELECT coalesce(category, 'none') AS grp, unnest({WORDS}) AS term FROM docs), tf AS (SELECT grp, term, count(*) AS tf FROM tm GROUP BY 1, 2), a AS (SELECT sum(tf)::DOUBLE / count(DISTINCT grp) AS a FROM tf), w AS (SELECT grp, sum(tf) AS words FROM tf GROUP BY 1), f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1)
SELECT * FROM (SELECT grp, term, weight, row_number() OVER (PARTITION BY grp ORDER BY weight DESC, term) AS rank FROM (SELECT grp, term, round(tf::DOUBLE / words * ln(1 + a / f), 8) AS weight FROM tf JOIN w USING (grp) JOIN f USING (term), a)) WHERE rank <= 5""")
def class_tf_idf(r):
    docs = r.docs.select(F.coalesce("category", F.lit("none")).alias("grp"), "conversation_text_translated")
    return terms.class_tf_idf(docs, "grp", "conversation_text_translated")


# --- further predicates and reports ---------------------------------------------------------------------------------
@query("f28_json_path", """SELECT event_type, json_extract_string('[' || props || ']', '$[0].k') AS k, count(*) AS n, count(json_extract_string('[' || props || ']', '$[1].k')) AS second FROM events GROUP BY 1, 2""")
def json_path(r):
    e = r.table("events").withColumn("j", F.concat(F.lit("["), "props", F.lit("]")))
    e = e.withColumns({"k": F.get_json_object("j", "$[0].k"), "k2": F.get_json_object("j", "$[1].k")})
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.count("k2").alias("second"))


@query("p04_between_dates", """SELECT count(*) AS n, count(DISTINCT conversation_id) AS conversations, count(*) FILTER (WHERE CAST(conversation_start_date AS DATE) = DATE '2025-08-31') AS on_last_day
FROM messages_raw WHERE content IS NOT NULL AND conversation_start_date BETWEEN TIMESTAMP '2025-05-11' AND TIMESTAMP '2025-08-31'""")
def between_dates(r):
    """The upper bound is midnight: all but the first instant of its day is cut."""
    m = r.messages.where(F.col("content").isNotNull() & F.col("conversation_start_date").between("2025-05-11", "2025-08-31"))
    return m.agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("conversations"), F.count_if(F.to_date("conversation_start_date") == F.lit("2025-08-31").cast("date")).alias("on_last_day"))


@query("p14_length_range", f"SELECT lang, count(*) AS n_before, count(*) FILTER (WHERE length(text) BETWEEN 200 AND 5000) AS n_kept, {pct_sql('count(*) FILTER (WHERE length(text) BETWEEN 200 AND 5000)', 'count(*)', 1)} AS kept_pct FROM documents GROUP BY 1")
def length_range(r):
    kept = F.count_if(F.length("text").between(200, 5000))
    return r.table("documents").groupBy("lang").agg(F.count("*").alias("n_before"), kept.alias("n_kept")).withColumn("kept_pct", pct(F.col("n_kept"), F.col("n_before"), 1))


@query("p16_valid_configs", SWEEP + " SELECT pipeline_track, selection_method, n_clusters FROM s WHERE n_clusters BETWEEN 30 AND 250 AND noise_pct <= 55 AND silhouette_embed_cosine IS NOT NULL")
def valid_configs(r):
    return clusters.valid_configs(sweep_rows(r)).select("pipeline_track", "selection_method", "n_clusters")


@query("t02_nulls_last", "SELECT conversation_id, category FROM docs ORDER BY category DESC NULLS LAST, conversation_id LIMIT 40")
def nulls_last(r):
    return r.docs.select("conversation_id", "category").orderBy(F.desc_nulls_last("category"), "conversation_id").limit(40)


@query("v28_cluster_cards", """
WITH c AS (SELECT * FROM chunks WHERE cluster_id <> -1), w AS (SELECT cluster_id, unnest(regexp_extract_all(lower(translated_chunk_text), '[a-z]{4,}')) AS word FROM c),
k AS (SELECT cluster_id, string_agg(word, ', ' ORDER BY n DESC, word) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, word) AS r FROM (SELECT cluster_id, word, count(*) AS n FROM w GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1),
s AS (SELECT cluster_id, string_agg(chunk_uid, ', ' ORDER BY hdbscan_prob DESC, chunk_uid) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY hdbscan_prob DESC, chunk_uid) AS r FROM c) WHERE r <= 3 GROUP BY 1),
l AS (SELECT cluster_id, string_agg(detected_language || ':' || n, ', ' ORDER BY n DESC, detected_language) AS languages FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, detected_language) AS r FROM (SELECT cluster_id, detected_language, count(*) AS n FROM c GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1)
SELECT t.cluster_id, t.n_chunks, keywords, samples, languages FROM (SELECT cluster_id, count(*) AS n_chunks FROM c GROUP BY 1) t LEFT JOIN k USING (cluster_id) LEFT JOIN s USING (cluster_id) LEFT JOIN l USING (cluster_id)""")
def cluster_cards(r):
    return clusters.cards(r.chunks)
