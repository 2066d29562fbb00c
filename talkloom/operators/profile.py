"""Profiles of topic clusters: counts, rates, rings about the centre, stratified samples, risk, prompts, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.semantics import ascii_regex, distinct_agg, extract_or_null, mean, pct, trim_all
from talkloom.operators.failure import any_failure, asked, confirmed, escalated, probable, rated, suspected, n_if, type_counts
from talkloom.plans.fixed import SAMPLE_BOILERPLATE, STRATA, VAGUE_THEME

SNIPPET, MIN_SAMPLE, RINGS = 900, 20, 5


def stratum(kind: Column) -> Column:
    same = ["abandoned_inquiry", "escalated_no_feedback", "resolved_or_unknown", "trivial_noise"]
    return (
        F.when(kind.isNull(), "no_failure_flags")
        .when(kind.isin("explicit_negative_bot", "explicit_negative_escalated"), "negative")
        .when(kind.isin("repetition_loop", "agent_request_unserved"), "probable_failure")
        .when(kind == "resolved_positive", "positive")
        .when(kind.isin(same), kind)
        .otherwise("unmapped_failure")
    )


def rank_of(name: Column, names: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(at == 0, 99).otherwise(at)


def samples(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """(cluster_id, sample_texts): chunks of every ring, stratum and of the surest, in order of ring."""
    real = chunks.where(~F.col("is_noise"))
    centre = real.groupBy("cluster_id").agg(F.round(F.avg("umap_x"), 9).alias("x"), F.round(F.avg("umap_y"), 9).alias("y"))
    text = F.col("translated_chunk_text")
    fit = real.where((F.length(trim_all(text)) >= MIN_SAMPLE) & ~F.lower(text).rlike(SAMPLE_BOILERPLATE))
    placed = fit.join(flags.select("conversation_id", "failure_type"), "conversation_id", "left").join(centre, "cluster_id")
    dist = F.sqrt(F.pow(F.col("umap_x") - F.col("x"), 2) + F.pow(F.col("umap_y") - F.col("y"), 2))
    placed = placed.select("cluster_id", "chunk_uid", "hdbscan_prob", F.substring(text, 1, SNIPPET).alias("snippet"), dist.alias("dist"), stratum(F.col("failure_type")).alias("stratum"))
    by = Window.partitionBy("cluster_id")
    ringed = placed.withColumn("ring", F.ntile(RINGS).over(by.orderBy(F.round("dist", 6), "chunk_uid")))
    best = [F.desc("hdbscan_prob"), F.col("chunk_uid")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy("cluster_id", *keys).orderBy(*best))
    ranked = ringed.withColumns({"rn_stratum": rank("stratum"), "rn_ring": rank("ring"), "rn_global": rank()})
    chosen = ranked.where("rn_ring <= 2 OR rn_stratum <= 1 OR rn_global <= 10")
    line = F.concat(F.lit("[ring"), F.col("ring").cast("string"), F.lit("|"), F.col("stratum"), F.lit("] "), F.col("snippet"))
    entry = F.struct("ring", "rn_ring", rank_of(F.col("stratum"), STRATA).alias("rank"), "chunk_uid", line.alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"]), "\n")
    return chosen.groupBy("cluster_id").agg(joined.alias("sample_texts"))


def cluster_profile(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """A row per cluster. ``flags`` has a row per document with its signals."""
    real = chunks.where(~F.col("is_noise"))
    sizes = real.groupBy("cluster_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("conversation_id").alias("n_conversations"), mean(F.col("hdbscan_prob"), 3).alias("avg_hdbscan_prob"))
    grain = real.groupBy("cluster_id", "conversation_id").agg(F.count("*").alias("k"))
    n, lang = F.count(F.lit(1)), F.col("detected_language")
    weighted = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("k"))), F.lit(0))
    base = grain.join(flags, "conversation_id").groupBy("cluster_id").agg(
        n_if(lang == "en").alias("english_count"), n_if(lang != "en").alias("non_english_count"), pct(n_if(lang != "en"), n, 1).alias("pct_non_english"), distinct_agg(lang, ",", 10).alias("languages_in_cluster"),
        confirmed().alias("confirmed_failures"), probable().alias("probable_failures"), suspected().alias("suspected_failures"), any_failure().alias("headline_failures"), rated().alias("rated_conversations"),
        pct(confirmed(), rated(), 2).alias("confirmed_failure_rate_pct"), pct(any_failure(), n, 2).alias("headline_failure_rate_pct"), pct(suspected(), n, 2).alias("suspected_failure_rate_pct"),
        weighted("is_confirmed_failure").alias("w_confirmed"), weighted("is_any_failure").alias("w_headline"), weighted("was_escalated_to_agent").alias("w_escalated"), weighted("requested_agent").alias("w_asked"),
        *type_counts(), escalated().alias("escalated_count"), asked().alias("agent_requests"), pct(escalated(), n, 1).alias("escalation_rate_pct"), pct(asked(), n, 1).alias("agent_request_rate_pct"),
        F.min(F.to_date("conversation_start_date")).alias("first_conversation"), F.max(F.to_date("conversation_start_date")).alias("last_conversation"),
        mean(F.col("client_message_count"), 2).alias("avg_client_messages"), mean(F.col("total_message_count"), 2).alias("avg_total_messages"),
    )
    rates = {f"chunk_{name}_rate_pct": pct(F.col(w), F.col("n_chunks"), 2) for name, w in [("confirmed_failure", "w_confirmed"), ("headline_failure", "w_headline"), ("escalation", "w_escalated"), ("agent_request", "w_asked")]}
    full = base.join(sizes, "cluster_id").withColumns(rates).drop("w_confirmed", "w_headline", "w_escalated", "w_asked")
    full = full.withColumn("avg_chunks_per_conv", F.round(F.col("n_chunks") / F.col("n_conversations"), 2))
    return with_risk(full.join(samples(chunks, flags), "cluster_id", "left"))


def with_risk(profile: DataFrame) -> DataFrame:
    """Adds the risk proxy, and whether the cluster is one that is only routed on."""
    n = F.col("n_conversations")
    over = lambda c: F.try_divide(F.col(c).cast("double"), n)
    risk = 0.8 * (F.col("chunk_headline_failure_rate_pct") / 100) + 0.1 * (F.col("chunk_escalation_rate_pct") / 100) + 0.1 * over("abandoned_inquiry")
    return profile.withColumns({"failure_risk_proxy": F.round(risk, 4), "is_routing_cluster": (over("escalated_count") >= 0.95) & (over("headline_failures") < 0.05)})


def prompts(profile: DataFrame) -> DataFrame:
    """(cluster_id, prompt) for a text generator: the figures, warnings for loose and overlapping clusters, the samples."""
    show = lambda c, f: F.format_string(f, F.col(c))
    loose = F.when(F.col("avg_hdbscan_prob") < 0.75, "NOTE: low confidence, a broad cluster.\n").otherwise("")
    overlap = F.when(F.col("avg_chunks_per_conv") > 2.5, "NOTE: high overlap with other topics.\n").otherwise("")
    text = F.concat(
        F.lit("Describe one topic of support conversations.\n"), F.lit("conversations: "), show("n_conversations", "%d"), F.lit("\nchunks: "), show("n_chunks", "%d"), F.lit("\nlanguages: "), F.coalesce("languages_in_cluster", F.lit("")),
        F.lit("\nfailed, weighted by chunks: "), show("chunk_headline_failure_rate_pct", "%.2f"), F.lit("%\nescalated: "), show("escalation_rate_pct", "%.1f"), F.lit("%\n"), loose, overlap,
        F.lit("Answer with the headings Theme, Failure diagnosis, Suggested action, Evidence quotes.\n"), F.lit("Excerpts:\n"), F.coalesce("sample_texts", F.lit("")),
    )
    return profile.select("cluster_id", text.alias("prompt"))


DESCRIBED = [
    "cluster_id", "n_chunks", "n_conversations", "languages_in_cluster", "avg_hdbscan_prob", "avg_chunks_per_conv", "escalation_rate_pct", "agent_request_rate_pct", "confirmed_failures", "headline_failures",
    "confirmed_failure_rate_pct", "headline_failure_rate_pct", "suspected_failure_rate_pct", "chunk_confirmed_failure_rate_pct", "chunk_headline_failure_rate_pct", "chunk_escalation_rate_pct",
    "chunk_agent_request_rate_pct", "failure_risk_proxy", "is_routing_cluster",
]


def describe(profile: DataFrame, generator) -> DataFrame:
    """Profiles with ``cluster_description`` and ``gemini_status`` from a text generator."""
    made = generator.generate(prompts(profile), "prompt", "result", "gemini_status")
    return profile.select(*DESCRIBED).join(made.select("cluster_id", trim_all(F.col("result")).alias("cluster_description"), "gemini_status"), "cluster_id")


def section(description: Column, heading: str) -> Column:
    """The text under a heading up to the next #, or null."""
    return extract_or_null(description, rf"### {heading}\n([^#]*)")


def first_line(description: Column, heading: str) -> Column:
    return trim_all(extract_or_null(description, rf"### {heading}\n([^\n#]+)"))


def validated(descriptions: DataFrame) -> DataFrame:
    """Descriptions of clusters that aren't routed on, with the failure rate they cite judged against the true one."""
    d = descriptions.where(~F.col("is_routing_cluster") & F.col("cluster_description").isNotNull())
    cited = F.expr("try_cast(cited_text AS DOUBLE)")
    d = d.withColumn("cited_text", extract_or_null(section(F.col("cluster_description"), "Failure diagnosis"), r"(\d+\.?\d*)[\t\n\f\r ]*%")).withColumn("cited_pct", cited)
    true = F.col("headline_failure_rate_pct")
    flag = F.when(F.col("cited_text").isNull(), "NO NUMBER CITED").when(F.abs(F.col("cited_pct") - true) <= 10, "ACCURATE").when(F.col("cited_pct") > true, "OVERSTATED").otherwise("UNDERSTATED")
    return d.select(
        "cluster_id", "n_conversations", F.round("failure_risk_proxy", 3).alias("failure_risk_proxy"), F.round(true, 1).alias("actual_failure_pct"), "cited_pct", flag.alias("accuracy_flag"),
        section(F.col("cluster_description"), "Evidence quotes").rlike('"[^"]+').alias("has_quotes"),
        F.lower(section(F.col("cluster_description"), "Theme")).rlike(ascii_regex(VAGUE_THEME)).alias("theme_is_vague"),
    )
