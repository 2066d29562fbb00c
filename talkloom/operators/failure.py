"""Signals of failed conversations, their types and tiers, and rates by topic cluster and week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.semantics import ascii_regex, mean, pct, trim_all, week_start
from talkloom.plans.fixed import AGENT_REQUEST, ESCALATION_PHRASES, FAILURE_TYPES, TEAMS

NEAR_MIN, NEAR_BELOW = 10, 5
TRIVIAL_CHARS, FEW_MESSAGES = 30, 3
RELIABLE = 20
n_if = F.count_if


def repetition(messages: DataFrame) -> DataFrame:
    """Consecutive client messages that are equal, or nearly so: by conversation."""
    own = messages.where((F.col("agent_or_bot") == "Client") & F.col("content").isNotNull() & (trim_all(F.col("content")) != ""))
    before = F.lag("content").over(Window.partitionBy("conversation_id").orderBy("message_date", "content"))
    pairs = own.select("conversation_id", "content", before.alias("before")).where("before IS NOT NULL")
    now, was = F.col("content"), F.col("before")
    near = (F.length(now) >= NEAR_MIN) & (F.length(was) >= NEAR_MIN) & (F.levenshtein(F.lower(now), F.lower(was), NEAR_BELOW - 1) >= 0)
    return pairs.groupBy("conversation_id").agg(n_if(F.lower(trim_all(now)) == F.lower(trim_all(was))).alias("exact_repeat_pairs"), n_if(near).alias("near_repeat_pairs"))


def requests_agent(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(ascii_regex(AGENT_REQUEST))


def failure_signals(docs: DataFrame, messages: DataFrame) -> DataFrame:
    d = docs.join(repetition(messages), "conversation_id", "left")
    d = d.withColumn("requested_agent", requests_agent(F.col("conversation_text_translated")))
    asked, helped = F.col("requested_agent"), F.col("was_escalated_to_agent")
    zero = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    return d.select(
        "conversation_id", "conversation_start_date", "detected_language", "client_message_count", "total_message_count", "rating_score",
        "was_escalated_to_agent", "ended_without_resolution", "last_author", "category", "agreements_subscription",
        F.length(F.coalesce("conversation_text_translated", F.lit(""))).cast("long").alias("conversation_text_length"),
        zero("exact_repeat_pairs"), zero("near_repeat_pairs"), "requested_agent",
        (F.coalesce("near_repeat_pairs", F.lit(0)) >= 1).alias("is_repetition_loop"),
        (asked & ~helped).alias("is_agent_request_unserved"),
        (asked & helped).alias("is_agent_request_served"),
    )


def failure_flags(signals: DataFrame) -> DataFrame:
    """The first type that applies, and the tiers: confirmed by rating, probable by signals, suspected by course."""
    r, helped, loop, unserved = (F.col(c) for c in ("rating_score", "was_escalated_to_agent", "is_repetition_loop", "is_agent_request_unserved"))
    long, few, unrated = F.col("conversation_text_length") >= TRIVIAL_CHARS, F.col("client_message_count") <= FEW_MESSAGES, r == 0
    kind = (
        F.when((r == -1) & ~helped, FAILURE_TYPES[0])
        .when((r == -1) & helped, FAILURE_TYPES[1])
        .when(loop & ~helped & unrated, FAILURE_TYPES[2])
        .when(unserved & unrated, FAILURE_TYPES[3])
        .when(helped & unrated, FAILURE_TYPES[4])
        .when(long & unrated & ~helped & few, FAILURE_TYPES[5])
        .when(r == 1, FAILURE_TYPES[6])
        .when(~long & unrated & ~helped, FAILURE_TYPES[7])
        .otherwise(FAILURE_TYPES[8])
    )
    probable = unrated & ~helped & (loop | unserved)
    suspected = unrated & (helped | (long & ~helped & few & ~loop & ~unserved))
    return signals.select(
        "*", kind.alias("failure_type"), (r == -1).alias("is_confirmed_failure"), probable.alias("is_probable_failure"), suspected.alias("is_suspected_failure"),
        ((r == -1) | probable).alias("is_any_failure"), (unrated & ~helped & loop).alias("is_probable_repetition_signal"), (unrated & ~helped & unserved).alias("is_probable_agent_signal"),
    )


def type_counts(names: list[str] | None = None) -> list[Column]:
    return [n_if(F.col("failure_type") == t).alias(t) for t in names or FAILURE_TYPES]


def rated() -> Column:
    return n_if(F.col("rating_score") != 0)


def confirmed() -> Column:
    return n_if(F.col("is_confirmed_failure"))


def any_failure() -> Column:
    return n_if(F.col("is_any_failure"))


def suspected() -> Column:
    return n_if(F.col("is_suspected_failure"))


def probable() -> Column:
    return n_if(F.col("is_probable_failure"))


def escalated() -> Column:
    return n_if(F.col("was_escalated_to_agent"))


def asked() -> Column:
    return n_if(F.col("requested_agent"))


def failure_by_chunk_cluster(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """Rates by cluster: per conversation, and weighted by its chunks, which is the primary measure."""
    real = chunks.where(~F.col("is_noise")).select("cluster_id", "conversation_id")
    # one row per cluster and conversation with its chunks serves both grains
    grain = real.groupBy("cluster_id", "conversation_id").agg(F.count("*").alias("k"))
    joined = grain.join(flags, "conversation_id", "left").withColumn("known", F.col("failure_type").isNotNull())
    n, k = n_if(F.col("known")), F.col("k")
    weighted = lambda c: F.coalesce(F.sum(F.when(F.col(c), k)), F.lit(0))
    per_chunk = lambda c: pct(weighted(c), F.sum(k), 2)
    out = joined.groupBy("cluster_id").agg(
        F.sum(k).alias("n_chunks"), n.alias("total_conversations"), confirmed().alias("confirmed_failures"), probable().alias("probable_failures"), suspected().alias("suspected_failures"), any_failure().alias("headline_failures"), rated().alias("rated_conversations"),
        n_if(F.col("rating_score") == 1).alias("positive_ratings"),
        pct(confirmed(), rated(), 2).alias("confirmed_failure_rate_pct"), pct(any_failure(), n, 2).alias("headline_failure_rate_pct"), pct(suspected(), n, 2).alias("suspected_failure_rate_pct"), pct(escalated(), n, 2).alias("escalation_rate_pct"), pct(asked(), n, 2).alias("agent_request_rate_pct"),
        per_chunk("is_confirmed_failure").alias("chunk_confirmed_failure_rate_pct"), per_chunk("is_any_failure").alias("chunk_headline_failure_rate_pct"), per_chunk("is_probable_failure").alias("chunk_probable_failure_rate_pct"), per_chunk("was_escalated_to_agent").alias("chunk_escalation_rate_pct"), per_chunk("requested_agent").alias("chunk_agent_request_rate_pct"),
        (rated() >= RELIABLE).alias("reliable_tier1_estimate"), *type_counts(),
        mean(F.col("client_message_count"), 2).alias("avg_client_messages"), mean(F.col("rating_score"), 3).alias("avg_rating_score"), F.round(F.sum(k) / F.nullif(n, F.lit(0)), 2).alias("avg_chunks_per_conv"),
    )
    return out.where("total_conversations > 0")


def failure_weekly(flags: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return flags.groupBy(week_start(F.col("conversation_start_date")).alias("week_start")).agg(
        n.alias("total_conversations"), confirmed().alias("confirmed_failures"), rated().alias("rated_conversations"), pct(confirmed(), rated(), 2).alias("confirmed_failure_rate_pct"),
        any_failure().alias("headline_failures"), pct(any_failure(), n, 2).alias("headline_failure_rate_pct"), suspected().alias("suspected_failures"), pct(suspected(), n, 2).alias("suspected_failure_rate_pct"),
        *type_counts(), pct(escalated(), n, 2).alias("escalation_rate_pct"), pct(asked(), n, 2).alias("agent_request_rate_pct"),
    )


def failure_by_cluster(labels: DataFrame, flags: DataFrame) -> DataFrame:
    """The same per conversation cluster and track."""
    n = F.count(F.lit(1))
    return labels.where("cluster_id != -1").select("pipeline_track", "cluster_id", "conversation_id").join(flags, "conversation_id").groupBy("pipeline_track", "cluster_id").agg(
        n.alias("total_conversations"), confirmed().alias("confirmed_failures"), probable().alias("probable_failures"), suspected().alias("suspected_failures"), any_failure().alias("headline_failures"), rated().alias("rated_conversations"),
        n_if(F.col("rating_score") == 1).alias("positive_ratings"), pct(confirmed(), rated(), 2).alias("confirmed_failure_rate_pct"), pct(any_failure(), n, 2).alias("headline_failure_rate_pct"), pct(suspected(), n, 2).alias("suspected_failure_rate_pct"),
        (rated() >= RELIABLE).alias("reliable_tier1_estimate"), *type_counts(), pct(asked(), n, 2).alias("agent_request_rate_pct"), pct(escalated(), n, 2).alias("escalation_rate_pct"),
        mean(F.col("client_message_count"), 2).alias("avg_client_messages"), mean(F.col("rating_score"), 3).alias("avg_rating_score"),
    )


def failure_by_language(flags: DataFrame, least: int = 5, reliable: int = 30, z: float = 1.959964) -> DataFrame:
    """Failure rate by language with Wilson's interval where the language is frequent enough."""
    n = F.col("total").cast("double")
    p = F.col("failures") / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    out = flags.groupBy("detected_language").agg(F.count("*").alias("total"), any_failure().alias("failures")).where(F.col("total") >= least)
    sure = F.col("total") >= reliable
    bound = lambda x: F.when(sure, F.round(100 * x / (1 + z * z / n), 3))
    return out.select("detected_language", "total", "failures", pct(F.col("failures"), F.col("total"), 2).alias("failure_rate_pct"), sure.alias("reliable"), bound(centre - spread).alias("ci_low_pct"), bound(centre + spread).alias("ci_high_pct"))


def escalation_phrases(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """(phrase, n_chunks, pct): chunks with each phrase among those of conversations that asked for an agent."""
    texts = chunks.join(flags.where("requested_agent").select("conversation_id"), "conversation_id", "left_semi").select(F.lower(F.coalesce("translated_chunk_text", F.lit(""))).alias("t"))
    counts = texts.agg(F.count("*").alias("n"), *[n_if(F.col("t").rlike(ascii_regex(p))).alias(f"p{i}") for i, (_, p) in enumerate(ESCALATION_PHRASES)])
    long = counts.select("n", F.stack(F.lit(len(ESCALATION_PHRASES)), *[x for i, (k, _) in enumerate(ESCALATION_PHRASES) for x in (F.lit(k), F.col(f"p{i}"))]).alias("phrase", "n_chunks"))
    return long.select("phrase", "n_chunks", F.round(100.0 * F.col("n_chunks") / F.greatest(F.lit(1), "n"), 1).alias("pct"))


def team_of(cluster: Column) -> Column:
    default, *others = TEAMS
    out = F.lit(default)
    for team in others:
        out = F.when(cluster.isin(TEAMS[team]), team).otherwise(out)
    return out


def business_impact(by_cluster: DataFrame) -> DataFrame:
    """Clusters with their team, failed chunks, and a bubble size scaled to 80 to 900."""
    impact = F.round(F.col("n_chunks") * F.col("chunk_headline_failure_rate_pct") / 100, 6)
    rows = by_cluster.select("cluster_id", team_of(F.col("cluster_id")).alias("team"), "n_chunks", "chunk_headline_failure_rate_pct", impact.alias("failure_impact"))
    bounds = rows.agg(F.min("failure_impact").alias("lo"), F.max("failure_impact").alias("hi"))
    span = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return rows.crossJoin(F.broadcast(bounds)).select(*rows.columns, F.round(80 + 820 * F.coalesce((F.col("failure_impact") - F.col("lo")) / span, F.lit(0.0)), 3).alias("bubble_size"))


def exploratory_flags(docs: DataFrame) -> DataFrame:
    """Counts of unrated conversations longer than the third quartile, and of unrated single messages."""
    q = docs.agg(F.percentile("client_message_count", F.lit(0.75)).alias("p75"))
    return docs.crossJoin(F.broadcast(q)).agg(F.max("p75").alias("p75"), n_if((F.col("client_message_count") > F.col("p75")) & (F.col("rating_score") == 0)).alias("long_unresolved"), n_if((F.col("client_message_count") == 1) & (F.col("rating_score") == 0)).alias("short_abandon"))
