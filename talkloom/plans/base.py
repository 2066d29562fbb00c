"""The relations of the conversation domain over the tables on disk.

``conversations`` has the turns; languages come from ``documents`` with the same number, vectors and cluster labels from
``embeddings``. As the turns hold no repeats, requests, personal data or markup, fixed texts are laid over some of them by
conversation number, so that every branch of the detectors is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.plans.fixed import HEART, SAD
from talkloom.sources.scratch import table

WEEKS = 31
PII = " mail joe.doe@example.com or call +1-800-555-1234, site http://10.0.0.1/wp-admin/ password is Hunter22!"
MARKUP = " Tom &amp; Jerry &amp;lt;b&gt; say &quot;hi&quot;&nbsp;&mdash; it&#39;s  \t ok"


def _content() -> Column:
    c, mine = F.col("conv_id"), F.col("role") == "user"
    return (
        F.when(mine & (c % 14 == 3), "my site is still broken, please help")
        .when(mine & (c % 14 == 5) & (F.col("turn") <= 1), "please let me talk to an agent about my order")
        .when(mine & (c % 14 == 9), "ok")
        .when(mine & (c % 14 == 11), F.concat("text", F.lit(MARKUP)))
        .when(mine & (c % 14 == 12), F.concat("text", F.lit(PII)))
        .otherwise(F.col("text"))
    )


def started(conv: Column) -> Column:
    """When conversation ``conv`` began: spread over WEEKS weeks from May 2025."""
    minutes = F.pmod(conv * 37, F.lit(7 * WEEKS)) * 1440 + F.pmod(conv * 91, F.lit(1440))
    return F.timestamp_add("MINUTE", minutes, F.lit("2025-05-01 00:00:00").cast("timestamp"))


def messages_raw(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conv_id")
    return table(spark, d, "conversations").select(
        c.cast("string").alias("conversation_id"),
        (c % 40).cast("string").alias("client_id"),
        F.when(F.col("role") == "assistant", "Answer Bot").when(F.col("role") == "system", " Dana ").alias("agent"),
        F.when(c % 6 != 0, F.concat(F.lit(" Client "), (c % 40).cast("string"))).alias("client_name"),
        F.when(c % 4 != 0, F.concat(F.lit(" User"), (c % 40).cast("string"), F.lit("@Example.com "))).alias("clients_email"),
        started(c).alias("conversation_start_date"),
        F.when(c % 5 == 0, SAD).when(c % 5 == 1, HEART).alias("rating"),
        F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("agency")), (c % 3 + 1).cast("int")).alias("agreements_subscription"),
        F.when(c % 4 == 0, "billing").when(c % 4 == 1, "domains").when(c % 4 == 2, "editor").alias("category"),
        F.timestamp_add("MINUTE", F.col("turn"), started(c)).alias("message_date"),
        F.when(F.col("role") == "user", "Client").when(F.col("role") == "assistant", "Bot").otherwise("Agent").alias("agent_or_bot"),
        _content().alias("content"),
    )


def languages(spark: SparkSession, d: str) -> DataFrame:
    """(conversation_id, lang): what a language detector says of each conversation."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("conversation_id"), "lang")


def translation_cache(spark: SparkSession, d: str) -> DataFrame:
    """Two of three conversations: their language, and for half of the foreign ones a translation."""
    n = F.col("doc_id")
    return table(spark, d, "documents").where(n % 3 != 0).select(
        n.cast("string").alias("conversation_id"),
        F.col("lang").alias("cached_language"),
        F.when((n % 3 == 1) & (F.col("lang") != "en"), F.concat(F.lit("cached translation of conversation "), n.cast("string"))).alias("cached_translation"),
    )


def chunk_labels(spark: SparkSession, d: str) -> DataFrame:
    """A chunk per turn with the vector, label and confidence of a row of ``embeddings``; label 9 is noise."""
    vectors = table(spark, d, "embeddings")
    n = vectors.count()
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    named = vectors.select("vec_id", "embedding", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("long").alias("cluster_id"), e(0).alias("e0"), e(1).alias("e1"), e(2).alias("e2"))
    turns = table(spark, d, "conversations").withColumn("vec_id", F.pmod(F.col("conv_id") * 31 + F.col("turn") * 17, F.lit(n)))
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "lang")
    who = F.when(F.col("role") == "user", "[USER]: ").otherwise("[AI]: ")
    original = F.concat(who, F.col("text"), F.when(F.col("turn") % 3 == 1, "\n[AI]: thank you for contacting us").otherwise(""))
    joined = turns.join(named, "vec_id").join(lang, "conv_id", "left").withColumn("original", original)
    noise = F.col("cluster_id") == -1
    prob = F.when(noise, 0.0).otherwise(F.least(F.lit(1.0), F.abs("e2") * 6))
    return joined.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("__c"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("chunk_uid"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("turn").alias("chunk_id"),
        F.coalesce("lang", F.lit("en")).alias("detected_language"),
        F.length("original").cast("long").alias("chunk_char_count"),
        F.col("original").alias("original_chunk_text"),
        F.when(F.col("lang").isin("fr", "de") & (F.col("turn") % 2 == 0), F.concat(F.lit("[translated] "), "original")).otherwise(F.col("original")).alias("translated_chunk_text"),
        "cluster_id",
        prob.alias("hdbscan_prob"),
        noise.alias("is_noise"),
        (~noise & (prob >= 0.70)).alias("is_high_conf"),
        (F.col("e0") * 10).alias("umap_x"),
        (F.col("e1") * 10).alias("umap_y"),
        "vec_id",
        "embedding",
    )


def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    """Conversation-level clusters of two tracks."""
    c = F.col("conv_id")
    vectors = table(spark, d, "embeddings")
    n = vectors.count()
    convs = table(spark, d, "conversations").select("conv_id").distinct()
    tracks = convs.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("vec_id", F.pmod(c * (13 + F.col("t") * 6), F.lit(n)))
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    joined = tracks.join(vectors, "vec_id")
    cluster = F.when(F.col("label") == 9, -1).otherwise(F.col("label") % 6).cast("long")
    return joined.select(
        c.cast("string").alias("conversation_id"),
        F.when(F.col("t") == 0, "multilingual").otherwise("translated").alias("pipeline_track"),
        cluster.alias("cluster_id"),
        (e(0) * 10).alias("umap_x"),
        (e(1) * 10).alias("umap_y"),
        F.when(cluster == -1, 0.0).otherwise(F.least(F.lit(1.0), F.abs(e(2)) * 6)).alias("membership_prob"),
    )


class CannedGenerator:
    """Descriptions by cluster number that take every branch of the checks on them: missing, vague, without a figure."""

    def generate(self, df: DataFrame, prompt: str, result: str, status: str) -> DataFrame:
        c = F.col("cluster_id")
        n = c.cast("string")
        theme = F.when(c % 3 == 0, "General technical issues").otherwise(F.concat(F.lit("Topic number "), n))
        says = F.when(c == 1, "Many chats fail").otherwise(F.concat(F.lit("About "), (c * 9 + 3).cast("string"), F.lit("% of chats fail")))
        diagnosis = F.when(c != 7, F.concat(F.lit("### Failure diagnosis\n"), says, F.lit("\n"))).otherwise("")
        quotes = F.when(c % 2 == 0, F.concat(F.lit('"quote '), n, F.lit('"'))).otherwise("none")
        text = F.concat(F.lit("### Theme\n"), theme, F.lit("\n"), diagnosis, F.lit("### Suggested action\nFix item "), n, F.lit("\n### Evidence quotes\n"), quotes, F.lit("\n"))
        made = c % 5 != 4
        return df.withColumn(result, F.when(made, text)).withColumn(status, F.when(made, "").otherwise("quota"))
