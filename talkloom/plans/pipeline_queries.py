"""Queries for the tables of the pipeline: de-identification, documents, failures, trends, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.functions.semantics import mean, month_start, pct
from talkloom.operators import deidentify, failure, trends
from talkloom.operators import docs as docs_op
from talkloom.operators import profile as profile_op
from talkloom.operators.failure import any_failure, confirmed, probable, rated, suspected, n_if
from talkloom.plans import fixed
from talkloom.plans.oracle import N_ANY, N_ASK, N_CONFIRMED, N_ESC, N_PROBABLE, N_RATED, N_SUSPECTED, decode_sql, pct_sql, q, scrub_sql, trim_sql
from talkloom.plans.registry import query


def rows():
    return F.count(F.lit(1))


@query("d01_raw_load_summary", """
SELECT count(*) AS total_rows, count(DISTINCT conversation_id) AS unique_conversations, min(CAST(message_date AS DATE)) AS first_day, max(CAST(message_date AS DATE)) AS last_day,
  count(DISTINCT date_trunc('month', message_date)) AS distinct_months FROM messages_raw""")
def raw_load_summary(r):
    d = F.col("message_date")
    return r.messages.agg(rows().alias("total_rows"), F.count_distinct("conversation_id").alias("unique_conversations"), F.min(F.to_date(d)).alias("first_day"), F.max(F.to_date(d)).alias("last_day"), F.count_distinct(month_start(d)).alias("distinct_months"))


@query("o01_pseudonymise_and_scrub", f"""
SELECT sha256(conversation_id) AS conversation_id, sha256(client_id) AS client_id, sha256(lower({trim_sql("coalesce(clients_email, 'no_email')")})) AS client_id_email_hash,
  CASE WHEN agent IN ('Answer Bot') THEN agent WHEN agent IS NULL THEN NULL ELSE sha256(lower({trim_sql('agent')})) END AS agent,
  CASE WHEN client_name IS NOT NULL THEN sha256(lower({trim_sql('client_name')})) END AS client_name,
  conversation_start_date, rating, agreements_subscription, category, message_date, agent_or_bot, {scrub_sql('content')} AS content
FROM messages_raw""")
def pseudonymise_and_scrub(r):
    return deidentify.pseudonymise(r.messages)


@query("o01b_scrub_codes_variant", f"SELECT doc_id, {scrub_sql('text', fixed.SCRUB_CODES)} AS scrubbed FROM documents")
def scrub_codes_variant(r):
    return r.table("documents").select("doc_id", deidentify.scrub(F.col("text"), "codes").alias("scrubbed"))


@query("o01d_entity_patterns", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, {q(fixed.UUID)}, '[ACCOUNT_ID]', 'g'), {q(fixed.ACCOUNT)}, '[ACCOUNT_ID]', 'g'), {q(fixed.DOMAIN)}, '[DOMAIN]', 'g') AS masked FROM documents""")
def entity_patterns(r):
    return r.table("documents").select("doc_id", deidentify.entities(F.col("text")).alias("masked"))


@query("o01e_number_placeholders", rf"""
SELECT conversation_id, regexp_replace(string_agg({scrub_sql('content')}, ' ' ORDER BY message_date), '\[(PERSON|EMAIL|PHONE|LOCATION|DOMAIN|ACCOUNT_ID|CREDENTIAL|URL|IP|API_KEY|OTP)\]', '[\1_1]', 'g') AS numbered FROM messages_raw GROUP BY 1""")
def number_placeholders(r):
    from talkloom.functions.semantics import string_agg

    scrubbed = string_agg(deidentify.scrub(F.col("content")), F.col("message_date"), " ")
    return r.messages.groupBy("conversation_id").agg(scrubbed.alias("t")).select("conversation_id", deidentify.number_placeholders(F.col("t")).alias("numbered"))


@query("o01f_residual_scan", "SELECT risk_type, hits, CASE WHEN hits = 0 THEN 'CLEAN' ELSE 'REVIEW' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS risk_type, count(*) FILTER (WHERE regexp_matches(content, {q(p)})) AS hits FROM messages_raw" for k, p in fixed.RESIDUAL) + ")")
def residual_scan(r):
    return deidentify.residual_scan(r.messages, "content")


@query("d02_deidentified_summary", f"""
SELECT count(*) AS total_messages, count(DISTINCT id) AS unique_conversations, min(length(id)) AS id_len_min, max(length(id)) AS id_len_max, round(avg(length(c)), 0) AS avg_content_length,
  count(*) FILTER (WHERE regexp_matches(c, {q(fixed.EMAIL)})) AS residual_emails FROM (SELECT sha256(conversation_id) AS id, {scrub_sql('content')} AS c FROM messages_raw)""")
def deidentified_summary(r):
    d = deidentify.pseudonymise(r.messages)
    n = F.length("conversation_id").cast("long")
    return d.agg(rows().alias("total_messages"), F.count_distinct("conversation_id").alias("unique_conversations"), F.min(n).alias("id_len_min"), F.max(n).alias("id_len_max"), mean(F.length("content"), 0).alias("avg_content_length"), n_if(F.col("content").rlike(fixed.EMAIL)).alias("residual_emails"))


@query("o02_conversation_docs", f"""
SELECT conversation_id, client_id, agent, client_name, conversation_start_date, rating, agreements_subscription, category, detected_language, conversation_text_multilingual, conversation_text_translated,
  (SELECT {trim_sql("string_agg(w, ' ' ORDER BY i)")} FROM (SELECT unnest(string_split(lower(conversation_text_translated), ' ')) AS w, generate_subscripts(string_split(lower(conversation_text_translated), ' '), 1) AS i) WHERE {trim_sql('w')} <> '' AND w NOT IN ({', '.join(q(s) for s in fixed.STOP_WORDS)})) AS conversation_text_stopword_filtered,
  client_text_raw AS conversation_text_client_original, bot_text_raw AS conversation_text_bot_original, full_text_raw AS conversation_text_full_original,
  client_message_count, total_message_count, was_escalated_to_agent, rating_score, last_author, ended_without_resolution, is_probable_loop FROM docs""")
def conversation_docs(r):
    return r.docs


@query("o03_entity_decode", f"SELECT page_id, {trim_sql('regexp_replace(' + decode_sql('html') + ', ' + q('[\\t\\n\\f\\r ]+') + ", ' ', 'g')")} AS cleaned FROM pages")
def entity_decode(r):
    return r.table("pages").select("page_id", docs_op.clean(F.col("html")).alias("cleaned"))


@query("o05_stop_words", f"""
SELECT doc_id, (SELECT regexp_replace(string_agg(w, ' ' ORDER BY i), '[\\t\\n\\f\\r ]+', ' ', 'g') FROM (SELECT unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(lower(text), ' '), 1) AS i) WHERE {trim_sql('w')} <> '' AND w NOT IN ({', '.join(q(s) for s in fixed.STOP_WORDS)})) AS filtered FROM documents""")
def stop_words(r):
    return r.table("documents").select("doc_id", docs_op.remove_stop_words(F.col("text")).alias("filtered"))


@query("o07_translation_log", "SELECT * FROM tlog")
def translation_log(r):
    return r.log.drop("conversation_start_date")


@query("d03_docs_summary", f"""
SELECT count(*) AS total_conversations, count(DISTINCT detected_language) AS distinct_languages, count(*) FILTER (WHERE detected_language = 'en') AS english, count(*) FILTER (WHERE detected_language <> 'en') AS non_english,
  {pct_sql("count(*) FILTER (WHERE detected_language <> 'en')", 'count(*)', 1)} AS pct_non_english, count(conversation_text_translated) AS has_translation, {N_ESC} AS escalated,
  min(CAST(conversation_start_date AS DATE)) AS earliest, max(CAST(conversation_start_date AS DATE)) AS latest FROM docs""")
def docs_summary(r):
    lang, d = F.col("detected_language"), F.to_date("conversation_start_date")
    return r.docs.agg(rows().alias("total_conversations"), F.count_distinct(lang).alias("distinct_languages"), n_if(lang == "en").alias("english"), n_if(lang != "en").alias("non_english"), pct(n_if(lang != "en"), rows(), 1).alias("pct_non_english"), F.count("conversation_text_translated").alias("has_translation"), failure.escalated().alias("escalated"), F.min(d).alias("earliest"), F.max(d).alias("latest"))


@query("d04_translation_mix", f"""
SELECT translation_source, count(*) AS conversations, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct, sum(original_char_count)::BIGINT AS total_original_chars, sum(translated_char_count)::BIGINT AS total_translated_chars,
  count(*) FILTER (WHERE text_was_changed) AS actually_translated FROM tlog GROUP BY 1""")
def translation_mix(r):
    from pyspark.sql import Window

    g = r.log.groupBy("translation_source").agg(rows().alias("conversations"), F.sum("original_char_count").alias("total_original_chars"), F.sum("translated_char_count").alias("total_translated_chars"), n_if(F.col("text_was_changed")).alias("actually_translated"))
    return g.withColumn("pct", pct(F.col("conversations"), F.sum("conversations").over(Window.partitionBy()), 2))


@query("o27_combined_text", f"""
SELECT conversation_id, CASE WHEN b <> '' THEN conversation_text_multilingual || chr(10) || b ELSE conversation_text_multilingual END AS content
FROM (SELECT *, {trim_sql('regexp_replace(' + decode_sql("coalesce(bot_text_raw, '')") + ', ' + q('[\\t\\n\\f\\r ]+') + ", ' ', 'g')")} AS b FROM docs)""")
def combined_text(r):
    return docs_op.combined_text(r.docs)


@query("o09_repetition", "SELECT * FROM repetition")
def repetition(r):
    return failure.repetition(r.messages)


@query("o10_agent_request", f"SELECT conversation_id, regexp_matches(lower(coalesce(conversation_text_translated, '')), {q(fixed.AGENT_REQUEST)}) AS requested_agent FROM docs")
def agent_request(r):
    return r.docs.select("conversation_id", failure.requests_agent(F.col("conversation_text_translated")).alias("requested_agent"))


SIGNALS = "conversation_id, conversation_start_date, detected_language, client_message_count, total_message_count, rating_score, was_escalated_to_agent, ended_without_resolution, last_author, category, agreements_subscription, conversation_text_length, exact_repeat_pairs, near_repeat_pairs, requested_agent, is_repetition_loop, is_agent_request_unserved, is_agent_request_served"


@query("o11_failure_signals", f"SELECT {SIGNALS} FROM signals")
def failure_signals(r):
    return r.signals


@query("o12_failure_flags", f"SELECT {SIGNALS}, failure_type, is_confirmed_failure, is_probable_failure, is_suspected_failure, is_any_failure, is_probable_repetition_signal, is_probable_agent_signal FROM flags")
def failure_flags(r):
    return r.flags


@query("d06_failure_type_distribution", f"""
SELECT failure_type, count(*) AS n, {pct_sql('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_all, {N_CONFIRMED} AS n_confirmed, {N_PROBABLE} AS n_probable, {N_SUSPECTED} AS n_suspected FROM flags GROUP BY 1""")
def failure_type_distribution(r):
    from pyspark.sql import Window

    g = r.flags.groupBy("failure_type").agg(rows().alias("n"), confirmed().alias("n_confirmed"), probable().alias("n_probable"), suspected().alias("n_suspected"))
    return g.withColumn("pct_of_all", pct(F.col("n"), F.sum("n").over(Window.partitionBy()), 2))


@query("d07_failure_kpis", f"""
SELECT count(*) AS total_conversations, {N_RATED} AS rated_conversations, {N_CONFIRMED} AS confirmed_failures, {pct_sql(N_CONFIRMED, N_RATED, 2)} AS confirmed_failure_rate_pct, {N_PROBABLE} AS probable_failures, {pct_sql(N_PROBABLE, 'count(*)', 2)} AS probable_failure_rate_pct,
  {N_ANY} AS headline_failures, {pct_sql(N_ANY, 'count(*)', 2)} AS headline_failure_rate_pct, {N_SUSPECTED} AS suspected_failures, {pct_sql(N_SUSPECTED, 'count(*)', 2)} AS suspected_failure_rate_pct FROM flags""")
def failure_kpis(r):
    return r.flags.agg(rows().alias("total_conversations"), rated().alias("rated_conversations"), confirmed().alias("confirmed_failures"), pct(confirmed(), rated(), 2).alias("confirmed_failure_rate_pct"), probable().alias("probable_failures"), pct(probable(), rows(), 2).alias("probable_failure_rate_pct"), any_failure().alias("headline_failures"), pct(any_failure(), rows(), 2).alias("headline_failure_rate_pct"), suspected().alias("suspected_failures"), pct(suspected(), rows(), 2).alias("suspected_failure_rate_pct"))


@query("d08_signal_totals", f"""
SELECT count(*) FILTER (WHERE is_repetition_loop) AS repetition_loops, {N_ASK} AS agent_requests, count(*) FILTER (WHERE is_agent_request_unserved) AS agent_requests_unserved, count(*) FILTER (WHERE is_agent_request_served) AS agent_requests_served,
  {N_ESC} AS escalated, count(*) FILTER (WHERE rating_score = -1) AS neg_rating, count(*) FILTER (WHERE rating_score = 1) AS pos_rating, count(*) AS total FROM signals""")
def signal_totals(r):
    has, score = lambda c: n_if(F.col(c)), F.col("rating_score")
    return r.signals.agg(has("is_repetition_loop").alias("repetition_loops"), has("requested_agent").alias("agent_requests"), has("is_agent_request_unserved").alias("agent_requests_unserved"), has("is_agent_request_served").alias("agent_requests_served"), has("was_escalated_to_agent").alias("escalated"), n_if(score == -1).alias("neg_rating"), n_if(score == 1).alias("pos_rating"), rows().alias("total"))


@query("o14_failure_by_chunk_cluster", "SELECT * FROM by_cluster")
def failure_by_chunk_cluster(r):
    return r.by_cluster


@query("o15_failure_weekly", "SELECT * FROM weekly_failures")
def failure_weekly(r):
    return failure.failure_weekly(r.flags)


RATES = {"avg_weekly_confirmed_pct": "confirmed_failure_rate_pct", "avg_weekly_headline_pct": "headline_failure_rate_pct", "avg_weekly_suspected_pct": "suspected_failure_rate_pct", "avg_weekly_escalation_pct": "escalation_rate_pct", "avg_weekly_agent_request_pct": "agent_request_rate_pct"}


@query("d09_weekly_averages", "SELECT count(DISTINCT week_start) AS distinct_weeks, min(week_start) AS earliest_week, max(week_start) AS latest_week, " + ", ".join(f"round(avg(round({v}, 2)::DECIMAL(18,2)), 2) AS {k}" for k, v in RATES.items()) + " FROM weekly_failures")
def weekly_averages(r):
    # rates have two decimals, so they are summed as decimals, whose order doesn't matter
    exact = lambda c: F.round((F.sum(F.col(c).cast("decimal(18,2)")) / F.count(c)).cast("double"), 2)
    return failure.failure_weekly(r.flags).agg(F.count_distinct("week_start").alias("distinct_weeks"), F.min("week_start").alias("earliest_week"), F.max("week_start").alias("latest_week"), *[exact(v).alias(k) for k, v in RATES.items()])


@query("o16a_weekly_volume", "SELECT * FROM volume")
def weekly_volume(r):
    return trends.weekly_volume(r.flags)


COURSE = f"{N_ESC} AS escalated_count, count(*) FILTER (WHERE rating_score = -1) AS negative_count, {N_ANY} AS headline_failures, count(*) FILTER (WHERE is_repetition_loop) AS repetition_loops, {N_ASK} AS agent_requests, round(avg(client_message_count), 2) AS avg_client_messages"
WEEK_OF = "(CAST(conversation_start_date AS DATE) - CAST(dayofweek(CAST(conversation_start_date AS DATE)) AS INTEGER))"


@query("o16b_chunk_cluster_trends", f"""
SELECT {WEEK_OF} AS week_start, cluster_id, count(*) AS conversation_count, sum(k)::BIGINT AS chunk_count, {COURSE}
FROM (SELECT cluster_id, conversation_id, count(*) AS k FROM chunks WHERE NOT is_noise GROUP BY 1, 2) JOIN flags USING (conversation_id) GROUP BY 1, 2""")
def chunk_cluster_trends(r):
    return trends.chunk_cluster_trends(r.chunks, r.flags)


@query("o16c_language_trends", f"""
SELECT CAST(date_trunc('month', conversation_start_date) AS DATE) AS month_start, detected_language, count(*) AS conversation_count,
  {pct_sql('count(*)', "sum(count(*)) OVER (PARTITION BY CAST(date_trunc('month', conversation_start_date) AS DATE))", 2)} AS pct_of_month FROM docs GROUP BY 1, 2""")
def language_trends(r):
    return trends.language_trends(r.docs)


@query("d10_volume_summary", "SELECT min(week_start) AS first_week, max(week_start) AS last_week, count(*) AS total_weeks, sum(total_conversations)::BIGINT AS grand_total FROM volume")
def volume_summary(r):
    return trends.weekly_volume(r.flags).agg(F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week"), rows().alias("total_weeks"), F.sum("total_conversations").alias("grand_total"))


@query("o17_cluster_profile", "SELECT * FROM profile")
def cluster_profile(r):
    return r.profile


@query("o19_prompts", """
SELECT cluster_id, 'Describe one topic of support conversations.' || chr(10) || 'conversations: ' || n_conversations || chr(10) || 'chunks: ' || n_chunks || chr(10) || 'languages: ' || languages_in_cluster || chr(10) ||
  'failed, weighted by chunks: ' || printf('%.2f', chunk_headline_failure_rate_pct) || '%' || chr(10) || 'escalated: ' || printf('%.1f', escalation_rate_pct) || '%' || chr(10) ||
  CASE WHEN avg_hdbscan_prob < 0.75 THEN 'NOTE: low confidence, a broad cluster.' || chr(10) ELSE '' END || CASE WHEN avg_chunks_per_conv > 2.5 THEN 'NOTE: high overlap with other topics.' || chr(10) ELSE '' END ||
  'Answer with the headings Theme, Failure diagnosis, Suggested action, Evidence quotes.' || chr(10) || 'Excerpts:' || chr(10) || coalesce(sample_texts, '') AS prompt FROM profile""")
def prompts(r):
    return profile_op.prompts(r.profile)


@query("o21_business_impact", f"""
SELECT cluster_id, CASE {' '.join(f"WHEN cluster_id IN ({', '.join(map(str, ids))}) THEN {q(team)}" for team, ids in fixed.TEAMS.items())} ELSE 'Support / KB' END AS team, n_chunks, chunk_headline_failure_rate_pct, i AS failure_impact,
  round(80 + 820 * coalesce((i - min(i) OVER ()) / nullif(max(i) OVER () - min(i) OVER (), 0), 0), 3) AS bubble_size
FROM (SELECT *, round(n_chunks * chunk_headline_failure_rate_pct / 100, 6) AS i FROM by_cluster)""")
def business_impact(r):
    return failure.business_impact(r.by_cluster)


@query("o22_exploratory_flags", "SELECT max(p) AS p75, count(*) FILTER (WHERE client_message_count > p AND rating_score = 0) AS long_unresolved, count(*) FILTER (WHERE client_message_count = 1 AND rating_score = 0) AS short_abandon FROM docs, (SELECT quantile_cont(client_message_count, 0.75)::DOUBLE AS p FROM docs)")
def exploratory_flags(r):
    return failure.exploratory_flags(r.docs)


Z = 1.959964


@query("o23_failure_by_language", f"""
SELECT detected_language, n AS total, k AS failures, {pct_sql('k', 'n', 2)} AS failure_rate_pct, n >= 30 AS reliable,
  CASE WHEN n >= 30 THEN round(100 * (p + {Z} * {Z} / (2 * n) - {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4.0::DOUBLE * n * n))) / (1 + {Z} * {Z} / n), 3) END::DOUBLE AS ci_low_pct,
  CASE WHEN n >= 30 THEN round(100 * (p + {Z} * {Z} / (2 * n) + {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4.0::DOUBLE * n * n))) / (1 + {Z} * {Z} / n), 3) END::DOUBLE AS ci_high_pct
FROM (SELECT detected_language, count(*) AS n, {N_ANY} AS k, k::DOUBLE / n AS p FROM flags GROUP BY 1) WHERE n >= 5""".replace(str(Z), f"{Z}::DOUBLE"))
def failure_by_language(r):
    return failure.failure_by_language(r.flags)


@query("o25_escalation_phrases", "SELECT phrase, n_chunks, round(100.0::DOUBLE * n_chunks / greatest(1, n), 1) AS pct FROM (" + " UNION ALL ".join(f"SELECT {q(k)} AS phrase, count(*) FILTER (WHERE regexp_matches(t, {q(p)})) AS n_chunks, count(*) AS n FROM asked" for k, p in fixed.ESCALATION_PHRASES) + ")")
def escalation_phrases(r):
    return failure.escalation_phrases(r.chunks, r.flags)


@query("d11a_description_audit", """
SELECT count(*) AS total_clusters, count(*) FILTER (WHERE cluster_description IS NULL) AS null_descriptions, count(*) FILTER (WHERE is_routing_cluster) AS routing_clusters,
  count(*) FILTER (WHERE cluster_description IS NULL AND NOT is_routing_cluster) AS unexpected_nulls,
  string_agg('C' || cluster_id || ':' || gemini_status, ' | ' ORDER BY cluster_id) FILTER (WHERE cluster_description IS NULL) AS null_cluster_errors FROM descriptions""")
def description_audit(r):
    from talkloom.functions.semantics import string_agg

    missing = F.col("cluster_description").isNull()
    error = F.when(missing, F.concat(F.lit("C"), F.col("cluster_id").cast("string"), F.lit(":"), F.col("gemini_status")))
    return r.descriptions.agg(rows().alias("total_clusters"), n_if(missing).alias("null_descriptions"), n_if(F.col("is_routing_cluster")).alias("routing_clusters"), n_if(missing & ~F.col("is_routing_cluster")).alias("unexpected_nulls"), string_agg(error, F.col("cluster_id"), " | ").alias("null_cluster_errors"))


@query("d11b_merge_titles", """
SELECT cluster_id, n_chunks, CASE WHEN cluster_id % 2 = 0 AND cluster_description IS NOT NULL THEN 'title ' || cluster_id ELSE 'untitled' END AS cluster_title, left(cluster_description, 80) AS desc_preview FROM descriptions""")
def merge_titles(r):
    from talkloom.sources.tables import add_column, merge_update

    target = add_column(r.descriptions, "cluster_title", "string").withColumn("cluster_title", F.lit("untitled"))
    new = r.descriptions.where("cluster_id % 2 = 0 AND cluster_description IS NOT NULL").select("cluster_id", F.concat(F.lit("title "), F.col("cluster_id").cast("string")).alias("cluster_title"))
    return merge_update(target, new, ["cluster_id"], ["cluster_title"]).select("cluster_id", "n_chunks", "cluster_title", F.left("cluster_description", F.lit(80)).alias("desc_preview"))


@query("d42a_failure_by_cluster", f"""
SELECT pipeline_track, l.cluster_id, count(*) AS total_conversations, {N_CONFIRMED} AS confirmed_failures, {N_PROBABLE} AS probable_failures, {N_SUSPECTED} AS suspected_failures, {N_ANY} AS headline_failures, {N_RATED} AS rated_conversations,
  count(*) FILTER (WHERE rating_score = 1) AS positive_ratings, {pct_sql(N_CONFIRMED, N_RATED, 2)} AS confirmed_failure_rate_pct, {pct_sql(N_ANY, 'count(*)', 2)} AS headline_failure_rate_pct, {pct_sql(N_SUSPECTED, 'count(*)', 2)} AS suspected_failure_rate_pct,
  {N_RATED} >= 20 AS reliable_tier1_estimate, {', '.join(f"count(*) FILTER (WHERE failure_type = '{t}') AS {t}" for t in fixed.FAILURE_TYPES)},
  {pct_sql(N_ASK, 'count(*)', 2)} AS agent_request_rate_pct, {pct_sql(N_ESC, 'count(*)', 2)} AS escalation_rate_pct, round(avg(client_message_count), 2) AS avg_client_messages, round(avg(rating_score), 3) AS avg_rating_score
FROM labels l JOIN flags USING (conversation_id) WHERE l.cluster_id <> -1 GROUP BY 1, 2""")
def failure_by_cluster(r):
    return failure.failure_by_cluster(r.labels, r.flags)


@query("d42b_cluster_trends", f"SELECT {WEEK_OF} AS week_start, pipeline_track, l.cluster_id, count(*) AS conversation_count, {COURSE} FROM labels l JOIN flags USING (conversation_id) WHERE l.cluster_id <> -1 GROUP BY 1, 2, 3")
def cluster_trends(r):
    return trends.cluster_trends(r.labels, r.flags)


@query("d45_weekday_counts", f"SELECT dayname(conversation_start_date) AS weekday, count(*) AS n, {pct_sql('count(*) FILTER (WHERE rating_score = -1)', N_RATED, 2)} AS negative_rate_pct FROM docs GROUP BY 1")
def weekday_counts(r):
    return trends.weekday_counts(r.docs)


@query("d46_monthly_volume", "SELECT month_start, n, round(100.0::DOUBLE * (n - lag(n) OVER (ORDER BY month_start)) / lag(n) OVER (ORDER BY month_start), 2) AS mom_pct FROM (SELECT CAST(date_trunc('month', conversation_start_date) AS DATE) AS month_start, count(*) AS n FROM docs GROUP BY 1)")
def monthly_volume(r):
    return trends.monthly_volume(r.docs)


@query("d47_top_languages", """
WITH tl AS (SELECT detected_language AS top FROM docs GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
SELECT CAST(date_trunc('month', conversation_start_date) AS DATE) AS month_start, coalesce(top, 'other') AS language, count(*) AS n FROM docs LEFT JOIN tl ON detected_language = top GROUP BY 1, 2""")
def top_languages(r):
    return trends.top_languages(r.docs)


@query("d48_impact_ranking", "SELECT row_number() OVER (ORDER BY round(n_chunks * chunk_headline_failure_rate_pct / 100, 6) DESC, cluster_id) AS rank, cluster_id, n_chunks, headline_failures, chunk_headline_failure_rate_pct FROM by_cluster ORDER BY 1 LIMIT 5")
def impact_ranking(r):
    from pyspark.sql import Window

    top = r.by_cluster.withColumn("i", F.round(F.col("n_chunks") * F.col("chunk_headline_failure_rate_pct") / 100, 6)).orderBy(F.desc("i"), "cluster_id").limit(5)
    rank = F.row_number().over(Window.orderBy(F.desc("i"), "cluster_id")).cast("long").alias("rank")
    return top.select(rank, "cluster_id", "n_chunks", "headline_failures", "chunk_headline_failure_rate_pct")


@query("d49_high_escalation", "SELECT p.cluster_id, p.n_chunks, p.escalation_rate_pct, d.gemini_status FROM profile p JOIN descriptions d USING (cluster_id) WHERE p.escalation_rate_pct > 20")
def high_escalation(r):
    return r.profile.where("escalation_rate_pct > 20").select("cluster_id", "n_chunks", "escalation_rate_pct").join(r.descriptions.select("cluster_id", "gemini_status"), "cluster_id")


@query("w07_rolling_means", """
SELECT week_start, headline_failure_rate_pct, round(avg(headline_failure_rate_pct) OVER (ORDER BY week_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS headline_failure_rate_pct_ma3,
  round(avg(headline_failure_rate_pct) OVER (ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS headline_failure_rate_pct_ma4 FROM weekly_failures""")
def rolling_means(r):
    w = failure.failure_weekly(r.flags).select("week_start", "headline_failure_rate_pct")
    return trends.rolling_mean(trends.rolling_mean(w, "headline_failure_rate_pct", "week_start", 3), "headline_failure_rate_pct", "week_start", 4)


@query("z02_peaks", """
SELECT cluster_id, max(c) AS peak, min(week_start) FILTER (WHERE c = m) AS peak_date, arg_max(c, week_start) AS last, round(100.0::DOUBLE * (max(c) - arg_max(c, week_start)) / max(c), 2) AS drop_pct
FROM (SELECT *, max(c) OVER (PARTITION BY cluster_id) AS m FROM (SELECT cluster_id, (CAST(conversation_start_date AS DATE) - CAST(dayofweek(CAST(conversation_start_date AS DATE)) AS INTEGER)) AS week_start, count(*) AS c FROM chunks JOIN flags USING (conversation_id) WHERE NOT chunks.is_noise GROUP BY 1, 2)) GROUP BY 1""")
def peaks(r):
    return trends.peaks(trends.chunk_cluster_trends(r.chunks, r.flags), "cluster_id", "week_start", "chunk_count")
