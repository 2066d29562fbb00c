"""DuckDB SQL of the base relations, written by itself from their definitions, to hold the registered queries against."""

from __future__ import annotations

import re

from talkloom.plans import fixed
from talkloom.plans.base import MARKUP, PII, WEEKS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scrub_sql(x: str, rules=None) -> str:
    for p, r in rules or fixed.SCRUB_SQL:
        x = f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
    return x


def decode_sql(x: str) -> str:
    for a, b in fixed.ENTITIES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{b}}\\x{{a0}}]+|[\\s\\x{{b}}\\x{{a0}}]+$', '', 'g')"


def pct_sql(part: str, whole: str, digits: int) -> str:
    return f"round(100.0::DOUBLE * ({part}) / nullif(({whole})::DOUBLE, 0), {digits})"


WEEK = "(CAST({0} AS DATE) - CAST(dayofweek(CAST({0} AS DATE)) AS INTEGER))"
STARTED = f"(TIMESTAMP '2025-05-01 00:00:00' + to_minutes(((conv_id * 37) % {7 * WEEKS}) * 1440 + (conv_id * 91) % 1440))"
TYPES = ",\n".join(f"count(*) FILTER (WHERE failure_type = '{t}') AS {t}" for t in fixed.FAILURE_TYPES)
N_CONFIRMED, N_ANY, N_SUSPECTED, N_PROBABLE = (f"count(*) FILTER (WHERE is_{k}_failure)" for k in ("confirmed", "any", "suspected", "probable"))
N_RATED = "count(*) FILTER (WHERE rating_score <> 0)"
N_ESC, N_ASK = "count(*) FILTER (WHERE was_escalated_to_agent)", "count(*) FILTER (WHERE requested_agent)"

CTES = {
    "messages_raw": f"""
SELECT conv_id::VARCHAR AS conversation_id, (conv_id % 40)::VARCHAR AS client_id,
  CASE role WHEN 'assistant' THEN 'Answer Bot' WHEN 'system' THEN ' Dana ' END AS agent,
  CASE WHEN conv_id % 6 <> 0 THEN ' Client ' || (conv_id % 40) END AS client_name,
  CASE WHEN conv_id % 4 <> 0 THEN ' User' || (conv_id % 40) || '@Example.com ' END AS clients_email,
  {STARTED} AS conversation_start_date,
  CASE conv_id % 5 WHEN 0 THEN {q(fixed.SAD)} WHEN 1 THEN {q(fixed.HEART)} END AS rating,
  CASE conv_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'agency' END AS agreements_subscription,
  CASE conv_id % 4 WHEN 0 THEN 'billing' WHEN 1 THEN 'domains' WHEN 2 THEN 'editor' END AS category,
  {STARTED} + to_minutes(turn) AS message_date,
  CASE role WHEN 'user' THEN 'Client' WHEN 'assistant' THEN 'Bot' ELSE 'Agent' END AS agent_or_bot,
  CASE WHEN role <> 'user' THEN text
       WHEN conv_id % 14 = 3 THEN 'my site is still broken, please help'
       WHEN conv_id % 14 = 5 AND turn <= 1 THEN 'please let me talk to an agent about my order'
       WHEN conv_id % 14 = 9 THEN 'ok'
       WHEN conv_id % 14 = 11 THEN text || {q(MARKUP).replace(chr(9), "' || chr(9) || '")}
       WHEN conv_id % 14 = 12 THEN text || {q(PII)}
       ELSE text END AS content
FROM conversations""",
    "cache": """
SELECT doc_id::VARCHAR AS conversation_id, lang AS cached_language,
  CASE WHEN doc_id % 3 = 1 AND lang <> 'en' THEN 'cached translation of conversation ' || doc_id END AS cached_translation
FROM documents WHERE doc_id % 3 <> 0""",
    "aggregated": f"""
SELECT conversation_id, max(client_id) AS client_id, max(agent) AS agent, max(client_name) AS client_name, max(conversation_start_date) AS conversation_start_date,
  max(rating) AS rating, max(agreements_subscription) AS agreements_subscription, max(category) AS category,
  string_agg(content, ' ' ORDER BY message_date) FILTER (WHERE agent_or_bot = 'Client') AS client_text_raw,
  string_agg(content, ' ' ORDER BY message_date) FILTER (WHERE agent_or_bot = 'Bot') AS bot_text_raw,
  string_agg(content, ' ' ORDER BY message_date) AS full_text_raw,
  count(*) FILTER (WHERE agent_or_bot = 'Client') AS client_message_count, count(*) AS total_message_count,
  count(*) FILTER (WHERE agent_or_bot = 'Agent') > 0 AS was_escalated_to_agent,
  CASE max(rating) WHEN {q(fixed.HEART)} THEN 1 WHEN {q(fixed.SAD)} THEN -1 ELSE 0 END AS rating_score,
  arg_max(agent_or_bot, message_date) AS last_author
FROM messages_raw WHERE content IS NOT NULL GROUP BY conversation_id HAVING count(*) FILTER (WHERE agent_or_bot = 'Client') > 0""",
    "cleaned": f"""
SELECT * FROM (SELECT *, {trim_sql(f"regexp_replace({decode_sql('client_text_raw')}, '[\\t\\n\\f\\r ]+', ' ', 'g')")} AS txt FROM aggregated WHERE client_text_raw IS NOT NULL) WHERE length(txt) >= 10""",
    "docs": f"""
SELECT a.*, coalesce(det, cached_language, 'en') AS detected_language, txt AS conversation_text_multilingual,
  CASE WHEN coalesce(det, cached_language, 'en') = 'en' THEN txt
       ELSE coalesce(cached_translation, CASE WHEN det <> 'en' THEN {decode_sql("'[en] ' || txt")} END, txt) END AS conversation_text_translated,
  last_author = 'Client' AS ended_without_resolution,
  client_message_count >= 5 AND rating_score <= 0 AND NOT was_escalated_to_agent AS is_probable_loop
FROM (SELECT c.*, k.cached_language, k.cached_translation,
        CASE WHEN NOT (coalesce(k.cached_language = 'en', false) OR k.cached_translation IS NOT NULL) THEN l.lang END AS det
      FROM cleaned c LEFT JOIN cache k USING (conversation_id) LEFT JOIN documents l ON l.doc_id::VARCHAR = c.conversation_id) a""",
    "tlog": """
SELECT d.conversation_id, d.detected_language,
  CASE WHEN d.detected_language = 'en' AND c.cached_language = 'en' THEN 'confirmed_english_cache'
       WHEN d.detected_language = 'en' AND c.cached_language IS NULL THEN 'api_detected_english'
       WHEN d.detected_language <> 'en' AND c.cached_translation IS NOT NULL THEN 'translated_from_cache'
       WHEN d.detected_language <> 'en' AND c.cached_translation IS NULL THEN 'translated_via_api' ELSE 'other' END AS translation_source,
  length(conversation_text_multilingual) AS original_char_count, length(conversation_text_translated) AS translated_char_count,
  conversation_text_translated <> conversation_text_multilingual AS text_was_changed
FROM docs d LEFT JOIN cache c USING (conversation_id)""",
    "repetition": f"""
SELECT conversation_id, count(*) FILTER (WHERE lower({trim_sql('content')}) = lower({trim_sql('prev')})) AS exact_repeat_pairs,
  count(*) FILTER (WHERE length(content) >= 10 AND length(prev) >= 10 AND levenshtein(lower(content), lower(prev)) < 5) AS near_repeat_pairs
FROM (SELECT conversation_id, content, lag(content) OVER (PARTITION BY conversation_id ORDER BY message_date) AS prev
      FROM messages_raw WHERE agent_or_bot = 'Client' AND content IS NOT NULL AND {trim_sql('content')} <> '')
WHERE prev IS NOT NULL GROUP BY conversation_id""",
    "signals": f"""
SELECT d.*, length(coalesce(conversation_text_translated, '')) AS conversation_text_length,
  coalesce(r.exact_repeat_pairs, 0) AS exact_repeat_pairs, coalesce(r.near_repeat_pairs, 0) AS near_repeat_pairs,
  regexp_matches(lower(coalesce(conversation_text_translated, '')), {q(fixed.AGENT_REQUEST)}) AS requested_agent,
  coalesce(r.near_repeat_pairs, 0) >= 1 AS is_repetition_loop,
  requested_agent AND NOT was_escalated_to_agent AS is_agent_request_unserved,
  requested_agent AND was_escalated_to_agent AS is_agent_request_served
FROM docs d LEFT JOIN repetition r USING (conversation_id)""",
    "flags": """
SELECT *, CASE WHEN rating_score = -1 AND NOT was_escalated_to_agent THEN 'explicit_negative_bot'
    WHEN rating_score = -1 THEN 'explicit_negative_escalated'
    WHEN is_repetition_loop AND NOT was_escalated_to_agent AND rating_score = 0 THEN 'repetition_loop'
    WHEN is_agent_request_unserved AND rating_score = 0 THEN 'agent_request_unserved'
    WHEN was_escalated_to_agent AND rating_score = 0 THEN 'escalated_no_feedback'
    WHEN conversation_text_length >= 30 AND rating_score = 0 AND client_message_count <= 3 THEN 'abandoned_inquiry'
    WHEN rating_score = 1 THEN 'resolved_positive'
    WHEN conversation_text_length < 30 AND rating_score = 0 THEN 'trivial_noise'
    ELSE 'resolved_or_unknown' END AS failure_type,
  rating_score = -1 AS is_confirmed_failure,
  rating_score = 0 AND NOT was_escalated_to_agent AND (is_repetition_loop OR is_agent_request_unserved) AS is_probable_failure,
  rating_score = 0 AND (was_escalated_to_agent OR (conversation_text_length >= 30 AND client_message_count <= 3 AND NOT is_repetition_loop AND NOT is_agent_request_unserved)) AS is_suspected_failure,
  rating_score = -1 OR (rating_score = 0 AND NOT was_escalated_to_agent AND (is_repetition_loop OR is_agent_request_unserved)) AS is_any_failure,
  rating_score = 0 AND NOT was_escalated_to_agent AND is_repetition_loop AS is_probable_repetition_signal,
  rating_score = 0 AND NOT was_escalated_to_agent AND is_agent_request_unserved AS is_probable_agent_signal
FROM signals""",
    "chunks": """
SELECT c.conv_id || '__c' || lpad(c.turn::VARCHAR, 4, '0') AS chunk_uid, c.conv_id::VARCHAR AS conversation_id, c.turn AS chunk_id, coalesce(l.lang, 'en') AS detected_language,
  length(o) AS chunk_char_count, o AS original_chunk_text,
  CASE WHEN l.lang IN ('fr', 'de') AND c.turn % 2 = 0 THEN '[translated] ' || o ELSE o END AS translated_chunk_text,
  CASE WHEN e.label = 9 THEN -1 ELSE e.label END::BIGINT AS cluster_id,
  CASE WHEN e.label = 9 THEN 0.0 ELSE least(1.0::DOUBLE, abs(e.embedding[3]::DOUBLE) * 6) END::DOUBLE AS hdbscan_prob,
  e.label = 9 AS is_noise, e.label <> 9 AND hdbscan_prob >= 0.70::DOUBLE AS is_high_conf,
  e.embedding[1]::DOUBLE * 10 AS umap_x, e.embedding[2]::DOUBLE * 10 AS umap_y, e.vec_id, e.embedding
FROM (SELECT *, CASE WHEN role = 'user' THEN '[USER]: ' ELSE '[AI]: ' END || text || CASE WHEN turn % 3 = 1 THEN chr(10) || '[AI]: thank you for contacting us' ELSE '' END AS o FROM conversations) c
JOIN embeddings e ON e.vec_id = (c.conv_id * 31 + c.turn * 17) % (SELECT count(*) FROM embeddings) LEFT JOIN documents l ON l.doc_id = c.conv_id""",
    "votes": """
SELECT conversation_id, cluster_id, count(*) AS n, row_number() OVER (PARTITION BY conversation_id ORDER BY count(*) DESC, cluster_id) AS rk
FROM chunks WHERE is_high_conf GROUP BY conversation_id, cluster_id""",
    "topics": """
SELECT a.conversation_id, coalesce(v.primary_topic, -1) AS primary_topic, coalesce(v.secondary_topics, '') AS secondary_topics, a.n_chunks, a.n_high_conf_chunks, a.n_noise_chunks,
  CASE WHEN v.first_n IS NULL THEN 0.0 ELSE round(v.first_n::DOUBLE / a.n_high_conf_chunks, 3) END::DOUBLE AS topic_confidence,
  CASE WHEN v.first_n IS NULL THEN true ELSE coalesce(v.second_n * 2 >= v.first_n, false) END AS is_mixed_topic,
  v.first_n IS NULL AND a.n_noise_chunks = a.n_chunks AS is_noise
FROM (SELECT conversation_id, count(*) AS n_chunks, count(*) FILTER (WHERE is_high_conf) AS n_high_conf_chunks, count(*) FILTER (WHERE is_noise) AS n_noise_chunks FROM chunks GROUP BY 1) a
LEFT JOIN (SELECT conversation_id, max(cluster_id) FILTER (WHERE rk = 1) AS primary_topic, max(n) FILTER (WHERE rk = 1) AS first_n, max(n) FILTER (WHERE rk = 2) AS second_n,
             string_agg(cluster_id::VARCHAR, ',' ORDER BY rk) FILTER (WHERE rk BETWEEN 2 AND 4) AS secondary_topics FROM votes GROUP BY 1) v USING (conversation_id)""",
    "labels": """
SELECT conv_id::VARCHAR AS conversation_id, CASE t WHEN 0 THEN 'multilingual' ELSE 'translated' END AS pipeline_track,
  CASE WHEN label = 9 THEN -1 ELSE label % 6 END::BIGINT AS cluster_id, embedding[1]::DOUBLE * 10 AS umap_x, embedding[2]::DOUBLE * 10 AS umap_y,
  CASE WHEN label = 9 THEN 0.0 ELSE least(1.0::DOUBLE, abs(embedding[3]::DOUBLE) * 6) END::DOUBLE AS membership_prob
FROM (SELECT DISTINCT conv_id FROM conversations) c, (VALUES (0), (1)) v(t) JOIN embeddings e ON e.vec_id = (conv_id * (13 + t * 6)) % (SELECT count(*) FROM embeddings)""",
    "by_cluster": f"""
SELECT g.cluster_id, sum(k)::BIGINT AS n_chunks, count(failure_type) AS total_conversations,
  {N_CONFIRMED} AS confirmed_failures, {N_PROBABLE} AS probable_failures, {N_SUSPECTED} AS suspected_failures, {N_ANY} AS headline_failures, {N_RATED} AS rated_conversations,
  count(*) FILTER (WHERE rating_score = 1) AS positive_ratings,
  {pct_sql(N_CONFIRMED, N_RATED, 2)} AS confirmed_failure_rate_pct, {pct_sql(N_ANY, 'count(failure_type)', 2)} AS headline_failure_rate_pct, {pct_sql(N_SUSPECTED, 'count(failure_type)', 2)} AS suspected_failure_rate_pct,
  {pct_sql(N_ESC, 'count(failure_type)', 2)} AS escalation_rate_pct, {pct_sql(N_ASK, 'count(failure_type)', 2)} AS agent_request_rate_pct,
  {pct_sql('coalesce(sum(k) FILTER (WHERE is_confirmed_failure), 0)', 'sum(k)', 2)} AS chunk_confirmed_failure_rate_pct,
  {pct_sql('coalesce(sum(k) FILTER (WHERE is_any_failure), 0)', 'sum(k)', 2)} AS chunk_headline_failure_rate_pct,
  {pct_sql('coalesce(sum(k) FILTER (WHERE is_probable_failure), 0)', 'sum(k)', 2)} AS chunk_probable_failure_rate_pct,
  {pct_sql('coalesce(sum(k) FILTER (WHERE was_escalated_to_agent), 0)', 'sum(k)', 2)} AS chunk_escalation_rate_pct,
  {pct_sql('coalesce(sum(k) FILTER (WHERE requested_agent), 0)', 'sum(k)', 2)} AS chunk_agent_request_rate_pct,
  {N_RATED} >= 20 AS reliable_tier1_estimate, {TYPES},
  round(avg(client_message_count), 2) AS avg_client_messages, round(avg(rating_score), 3) AS avg_rating_score, round(sum(k)::DOUBLE / count(failure_type), 2) AS avg_chunks_per_conv
FROM (SELECT cluster_id, conversation_id, count(*) AS k FROM chunks WHERE NOT is_noise GROUP BY 1, 2) g LEFT JOIN flags f USING (conversation_id)
GROUP BY 1 HAVING count(failure_type) > 0""",
    "weekly_failures": f"""
SELECT {WEEK.format('conversation_start_date')} AS week_start, count(*) AS total_conversations, {N_CONFIRMED} AS confirmed_failures, {N_RATED} AS rated_conversations, {pct_sql(N_CONFIRMED, N_RATED, 2)} AS confirmed_failure_rate_pct,
  {N_ANY} AS headline_failures, {pct_sql(N_ANY, 'count(*)', 2)} AS headline_failure_rate_pct, {N_SUSPECTED} AS suspected_failures, {pct_sql(N_SUSPECTED, 'count(*)', 2)} AS suspected_failure_rate_pct,
  {TYPES}, {pct_sql(N_ESC, 'count(*)', 2)} AS escalation_rate_pct, {pct_sql(N_ASK, 'count(*)', 2)} AS agent_request_rate_pct
FROM flags GROUP BY 1""",
    "volume": f"""
SELECT {WEEK.format('conversation_start_date')} AS week_start, count(*) AS total_conversations, count(*) FILTER (WHERE detected_language = 'en') AS english_conversations,
  count(*) FILTER (WHERE detected_language <> 'en') AS non_english_conversations, count(DISTINCT detected_language) AS distinct_languages, {N_ESC} AS escalated_count,
  count(*) FILTER (WHERE rating_score = -1) AS negative_ratings, count(*) FILTER (WHERE rating_score = 1) AS positive_ratings, count(*) FILTER (WHERE is_repetition_loop) AS repetition_loops, {N_ASK} AS agent_requests,
  {N_CONFIRMED} AS confirmed_failures, {N_ANY} AS headline_failures, {pct_sql(N_ANY, 'count(*)', 2)} AS headline_failure_rate_pct, {pct_sql(N_ESC, 'count(*)', 2)} AS escalation_rate_pct,
  {pct_sql('count(*) FILTER (WHERE rating_score = -1)', N_RATED, 2)} AS negative_rating_pct, round(avg(client_message_count), 2) AS avg_client_messages, round(avg(total_message_count), 2) AS avg_total_messages
FROM flags GROUP BY 1""",
    "scored": f"""
SELECT c.cluster_id, c.conversation_id, c.chunk_uid, substr(c.translated_chunk_text, 1, 900) AS snippet, c.hdbscan_prob, sqrt(pow(c.umap_x - m.x, 2) + pow(c.umap_y - m.y, 2)) AS dist,
  CASE WHEN f.failure_type IS NULL THEN 'no_failure_flags' WHEN f.failure_type IN ('explicit_negative_bot', 'explicit_negative_escalated') THEN 'negative'
       WHEN f.failure_type IN ('repetition_loop', 'agent_request_unserved') THEN 'probable_failure' WHEN f.failure_type = 'resolved_positive' THEN 'positive'
       WHEN f.failure_type IN ('abandoned_inquiry', 'escalated_no_feedback', 'resolved_or_unknown', 'trivial_noise') THEN f.failure_type ELSE 'unmapped_failure' END AS stratum
FROM chunks c LEFT JOIN flags f USING (conversation_id)
JOIN (SELECT cluster_id, round(avg(umap_x), 9) AS x, round(avg(umap_y), 9) AS y FROM chunks WHERE NOT is_noise GROUP BY 1) m ON m.cluster_id = c.cluster_id
WHERE NOT c.is_noise AND length({trim_sql('c.translated_chunk_text')}) >= 20 AND NOT regexp_matches(lower(c.translated_chunk_text), {q(fixed.SAMPLE_BOILERPLATE)})""",
    "sampled": f"""
SELECT cluster_id, string_agg('[ring' || ring || '|' || stratum || '] ' || snippet, chr(10) ORDER BY ring, rn_ring, array_position([{', '.join(q(s) for s in fixed.STRATA)}], stratum), chunk_uid) AS sample_texts
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, stratum ORDER BY hdbscan_prob DESC, chunk_uid) AS rn_stratum, row_number() OVER (PARTITION BY cluster_id, ring ORDER BY hdbscan_prob DESC, chunk_uid) AS rn_ring,
        row_number() OVER (PARTITION BY cluster_id ORDER BY hdbscan_prob DESC, chunk_uid) AS rn_global
      FROM (SELECT *, ntile(5) OVER (PARTITION BY cluster_id ORDER BY round(dist, 6), chunk_uid) AS ring FROM scored))
WHERE rn_ring <= 2 OR rn_stratum <= 1 OR rn_global <= 10 GROUP BY 1""",
    "profile": f"""
SELECT b.*, s.sample_texts,
  round(0.8::DOUBLE * (chunk_headline_failure_rate_pct / 100) + 0.1::DOUBLE * (chunk_escalation_rate_pct / 100) + 0.1::DOUBLE * (abandoned_inquiry::DOUBLE / n_conversations), 4) AS failure_risk_proxy,
  escalated_count::DOUBLE / n_conversations >= 0.95::DOUBLE AND headline_failures::DOUBLE / n_conversations < 0.05::DOUBLE AS is_routing_cluster
FROM (SELECT g.cluster_id, a.n_chunks, a.n_conversations, a.avg_hdbscan_prob,
    count(*) FILTER (WHERE d.detected_language = 'en') AS english_count, count(*) FILTER (WHERE d.detected_language <> 'en') AS non_english_count, {pct_sql("count(*) FILTER (WHERE d.detected_language <> 'en')", 'count(*)', 1)} AS pct_non_english,
    array_to_string(list_sort(list(DISTINCT d.detected_language))[1:10], ',') AS languages_in_cluster,
    {N_CONFIRMED} AS confirmed_failures, {N_PROBABLE} AS probable_failures, {N_SUSPECTED} AS suspected_failures, {N_ANY} AS headline_failures, {N_RATED} AS rated_conversations,
    {pct_sql(N_CONFIRMED, N_RATED, 2)} AS confirmed_failure_rate_pct, {pct_sql(N_ANY, 'count(*)', 2)} AS headline_failure_rate_pct, {pct_sql(N_SUSPECTED, 'count(*)', 2)} AS suspected_failure_rate_pct,
    {pct_sql('coalesce(sum(g.k) FILTER (WHERE is_confirmed_failure), 0)', 'a.n_chunks', 2)} AS chunk_confirmed_failure_rate_pct, {pct_sql('coalesce(sum(g.k) FILTER (WHERE is_any_failure), 0)', 'a.n_chunks', 2)} AS chunk_headline_failure_rate_pct,
    {pct_sql('coalesce(sum(g.k) FILTER (WHERE was_escalated_to_agent), 0)', 'a.n_chunks', 2)} AS chunk_escalation_rate_pct, {pct_sql('coalesce(sum(g.k) FILTER (WHERE requested_agent), 0)', 'a.n_chunks', 2)} AS chunk_agent_request_rate_pct,
    {TYPES}, {N_ESC} AS escalated_count, {N_ASK} AS agent_requests, {pct_sql(N_ESC, 'count(*)', 1)} AS escalation_rate_pct, {pct_sql(N_ASK, 'count(*)', 1)} AS agent_request_rate_pct,
    min(CAST(d.conversation_start_date AS DATE)) AS first_conversation, max(CAST(d.conversation_start_date AS DATE)) AS last_conversation,
    round(avg(d.client_message_count), 2) AS avg_client_messages, round(avg(d.total_message_count), 2) AS avg_total_messages, round(a.n_chunks::DOUBLE / a.n_conversations, 2) AS avg_chunks_per_conv
  FROM (SELECT cluster_id, conversation_id, count(*) AS k FROM chunks WHERE NOT is_noise GROUP BY 1, 2) g
  JOIN (SELECT cluster_id, count(*) AS n_chunks, count(DISTINCT conversation_id) AS n_conversations, round(avg(hdbscan_prob), 3) AS avg_hdbscan_prob FROM chunks WHERE NOT is_noise GROUP BY 1) a USING (cluster_id)
  JOIN flags d USING (conversation_id) GROUP BY g.cluster_id, a.n_chunks, a.n_conversations, a.avg_hdbscan_prob) b LEFT JOIN sampled s USING (cluster_id)""",
    "asked": """
SELECT lower(coalesce(translated_chunk_text, '')) AS t FROM chunks WHERE conversation_id IN (SELECT conversation_id FROM flags WHERE requested_agent)""",
    "descriptions": """
SELECT cluster_id, n_chunks, n_conversations, languages_in_cluster, avg_hdbscan_prob, avg_chunks_per_conv, escalation_rate_pct, agent_request_rate_pct, confirmed_failures, headline_failures, confirmed_failure_rate_pct, headline_failure_rate_pct,
  suspected_failure_rate_pct, chunk_confirmed_failure_rate_pct, chunk_headline_failure_rate_pct, chunk_escalation_rate_pct, chunk_agent_request_rate_pct, failure_risk_proxy, is_routing_cluster,
  CASE WHEN cluster_id % 5 <> 4 THEN '### Theme' || chr(10) || CASE WHEN cluster_id % 3 = 0 THEN 'General technical issues' ELSE 'Topic number ' || cluster_id END || chr(10) ||
    CASE WHEN cluster_id <> 7 THEN '### Failure diagnosis' || chr(10) || CASE WHEN cluster_id = 1 THEN 'Many chats fail' ELSE 'About ' || (cluster_id * 9 + 3) || '% of chats fail' END || chr(10) ELSE '' END ||
    '### Suggested action' || chr(10) || 'Fix item ' || cluster_id || chr(10) || '### Evidence quotes' || chr(10) || CASE WHEN cluster_id % 2 = 0 THEN '"quote ' || cluster_id || '"' ELSE 'none' END END AS cluster_description,
  CASE WHEN cluster_id % 5 <> 4 THEN '' ELSE 'quota' END AS gemini_status
FROM profile""",
}


def assemble(body: str) -> str:
    """``body`` after the relations that it names, and those that these name, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    ctes = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in CTES.items() if k in needed)
    if not ctes:
        return body
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if not head:
        return f"WITH {ctes} {body}"
    return f"WITH {head[1] or ''}{ctes}, {body[head.end():]}"


def t_p_sql(t: str, nu: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom, by its finite series of cosines."""
    theta = f"atan(abs({t}) / sqrt({nu}))"
    series = lambda last, up, down, power: f"coalesce(list_sum(list_transform(range(0, ({last})::BIGINT), lambda j: coalesce(list_product(list_transform(range(1, j + 1), lambda i: ({up})::DOUBLE / ({down}))), 1) * pow(cos({theta}), {power}))), 0)"
    odd = f"2 / pi() * ({theta} + sin({theta}) * {series(f'({nu} - 1) // 2', '2 * i', '2 * i + 1', '2 * j + 1')})"
    even = f"sin({theta}) * {series(f'{nu} // 2', '2 * i - 1', '2 * i', '2 * j')}"
    return f"(1 - CASE WHEN {nu} % 2 = 1 THEN {odd} ELSE {even} END)"
