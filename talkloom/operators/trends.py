"""Weekly and monthly volumes and cluster trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.semantics import mean, month_start, pct, week_start
from talkloom.operators.failure import any_failure, asked, confirmed, escalated, rated, n_if


def weekly_volume(flags: DataFrame) -> DataFrame:
    """``flags`` has a row per document with its signals, so one aggregation serves."""
    n, r, lang = F.count(F.lit(1)), F.col("rating_score"), F.col("detected_language")
    return flags.groupBy(week_start(F.col("conversation_start_date")).alias("week_start")).agg(
        n.alias("total_conversations"), n_if(lang == "en").alias("english_conversations"), n_if(lang != "en").alias("non_english_conversations"), F.count_distinct(lang).alias("distinct_languages"),
        escalated().alias("escalated_count"), n_if(r == -1).alias("negative_ratings"), n_if(r == 1).alias("positive_ratings"), n_if(F.col("is_repetition_loop")).alias("repetition_loops"), asked().alias("agent_requests"),
        confirmed().alias("confirmed_failures"), any_failure().alias("headline_failures"), pct(any_failure(), n, 2).alias("headline_failure_rate_pct"), pct(escalated(), n, 2).alias("escalation_rate_pct"), pct(n_if(r == -1), rated(), 2).alias("negative_rating_pct"),
        mean(F.col("client_message_count"), 2).alias("avg_client_messages"), mean(F.col("total_message_count"), 2).alias("avg_total_messages"),
    )


def _course(n) -> list:
    return [
        escalated().alias("escalated_count"), n_if(F.col("rating_score") == -1).alias("negative_count"), any_failure().alias("headline_failures"), n_if(F.col("is_repetition_loop")).alias("repetition_loops"),
        asked().alias("agent_requests"), mean(F.col("client_message_count"), 2).alias("avg_client_messages"),
    ]


def chunk_cluster_trends(chunks: DataFrame, flags: DataFrame) -> DataFrame:
    """Conversations and chunks by cluster and week; chunks are counted per conversation first, so nothing fans out."""
    grain = chunks.where(~F.col("is_noise")).groupBy("cluster_id", "conversation_id").agg(F.count("*").alias("k"))
    dated = flags.withColumn("week_start", week_start(F.col("conversation_start_date")))
    return grain.join(dated, "conversation_id").groupBy("week_start", "cluster_id").agg(F.count("*").alias("conversation_count"), F.sum("k").alias("chunk_count"), *_course("k"))


def cluster_trends(labels: DataFrame, flags: DataFrame) -> DataFrame:
    dated = flags.withColumn("week_start", week_start(F.col("conversation_start_date")))
    real = labels.where("cluster_id != -1").select("conversation_id", "pipeline_track", "cluster_id")
    return real.join(dated, "conversation_id").groupBy("week_start", "pipeline_track", "cluster_id").agg(F.count("*").alias("conversation_count"), *_course("1"))


def language_trends(docs: DataFrame) -> DataFrame:
    monthly = docs.groupBy(month_start(F.col("conversation_start_date")).alias("month_start"), "detected_language").agg(F.count("*").alias("conversation_count"))
    whole = F.sum("conversation_count").over(Window.partitionBy("month_start"))
    return monthly.withColumn("pct_of_month", pct(F.col("conversation_count"), whole, 2))


def monthly_volume(docs: DataFrame) -> DataFrame:
    """Months with their change against the month before, in percent."""
    monthly = docs.groupBy(month_start(F.col("conversation_start_date")).alias("month_start")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("month_start"))  # a row per month
    return monthly.withColumn("mom_pct", F.round(100.0 * (F.col("n") - before) / before, 2))


def top_languages(docs: DataFrame, k: int = 2) -> DataFrame:
    """Monthly counts of the ``k`` most frequent languages and of all others together."""
    top = docs.groupBy("detected_language").count().orderBy(F.desc("count"), "detected_language").limit(k).select(F.col("detected_language").alias("top"))
    named = docs.join(F.broadcast(top), F.col("detected_language") == F.col("top"), "left").withColumn("language", F.coalesce("top", F.lit("other")))
    return named.groupBy(month_start(F.col("conversation_start_date")).alias("month_start"), "language").agg(F.count("*").alias("n"))


def weekday_counts(docs: DataFrame) -> DataFrame:
    r = F.col("rating_score")
    return docs.groupBy(F.date_format("conversation_start_date", "EEEE").alias("weekday")).agg(F.count("*").alias("n"), pct(n_if(r == -1), n_if(r != 0), 2).alias("negative_rate_pct"))


def rolling_mean(weekly: DataFrame, value: str, order: str, rows: int, by: list[str] | None = None) -> DataFrame:
    """Adds ``{value}_ma{rows}``: the mean of the row and up to ``rows`` - 1 before it."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-(rows - 1), 0)
    return weekly.withColumn(f"{value}_ma{rows}", F.round(F.avg(value).over(w), 6))


def peaks(trend: DataFrame, by: str, date: str, value: str) -> DataFrame:
    """By group: the highest value and its first date, the last value, and the drop from peak to last in percent."""
    first_peak = F.min_by(date, F.struct(-F.col(value), F.col(date)))
    out = trend.groupBy(by).agg(F.max(value).alias("peak"), first_peak.alias("peak_date"), F.max_by(value, date).alias("last"))
    return out.withColumn("drop_pct", F.round(100.0 * (F.col("peak") - F.col("last")) / F.col("peak"), 2))
