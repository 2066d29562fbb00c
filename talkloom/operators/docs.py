"""One document per conversation, its language and translation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.semantics import collapse_space, string_agg, trim_all
from talkloom.plans.fixed import ENTITIES, HEART, SAD, STOP_WORDS
from talkloom.plugins import MarkingTranslator, Translator

MIN_CHARS = 10
DETECT_CHARS = 150


def decode_entities(text: Column) -> Column:
    """The thirteen character references replaced one after the other, so a decoded & can form a later one."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def clean(text: Column) -> Column:
    return trim_all(collapse_space(decode_entities(text)))


def remove_stop_words(text: Column) -> Column:
    """Lower-cased words split at spaces, without blank ones and stop words; null if none is left."""
    words = F.filter(F.split(F.lower(text), " "), lambda t: (trim_all(t) != "") & ~t.isin(STOP_WORDS))
    return F.when(F.size(words) > 0, trim_all(collapse_space(F.array_join(words, " "))))


def aggregate(messages: DataFrame) -> DataFrame:
    """A row per conversation with a client message: texts in order of date, counts, rating score, last author."""
    role, date, content = F.col("agent_or_bot"), F.col("message_date"), F.col("content")
    keep = ["client_id", "agent", "client_name", "conversation_start_date", "rating", "agreements_subscription", "category"]
    a = messages.where(content.isNotNull()).groupBy("conversation_id").agg(
        *[F.max(k).alias(k) for k in keep],
        string_agg(F.when(role == "Client", content), date, " ").alias("client_text_raw"),
        string_agg(F.when(role == "Bot", content), date, " ").alias("bot_text_raw"),
        string_agg(content, date, " ").alias("full_text_raw"),
        F.count_if(role == "Client").alias("client_message_count"),
        F.count(F.lit(1)).alias("total_message_count"),
        (F.count_if(role == "Agent") > 0).alias("was_escalated_to_agent"),
        F.max_by(role, date).alias("last_author"),
    )
    score = F.when(F.col("rating") == HEART, 1).when(F.col("rating") == SAD, -1).otherwise(0)
    return a.where("client_message_count > 0").withColumn("rating_score", score)


def conversation_docs(messages: DataFrame, cache: DataFrame, detector: DataFrame, translator: Translator | None = None) -> DataFrame:
    """Documents of conversations with ten or more characters of client text.

    ``cache`` (conversation_id, cached_language, cached_translation) spares detection and translation; ``detector``
    (conversation_id, lang) stands for a model that sees the first 150 characters; only texts whose detected language
    isn't English go to the translator.
    """
    cleaned = aggregate(messages).where(F.col("client_text_raw").isNotNull() & (trim_all(F.col("client_text_raw")) != ""))
    cleaned = cleaned.withColumn("text", clean(F.col("client_text_raw"))).where(F.length("text") >= MIN_CHARS)
    known = cleaned.join(cache, "conversation_id", "left")
    needs = ~(F.coalesce(F.col("cached_language") == "en", F.lit(False)) | F.col("cached_translation").isNotNull())
    asked = known.withColumn("needs_detection", needs).join(detector, "conversation_id", "left")
    asked = asked.withColumn("detected", F.when(F.col("needs_detection") & (F.col("text") != ""), F.col("lang")))
    foreign = asked.where(F.coalesce(F.col("detected") != "en", F.lit(False)))
    fresh = (translator or MarkingTranslator()).translate(foreign, "text", "fresh", "fresh_status")
    rest = asked.where(F.coalesce(F.col("detected") == "en", F.lit(True))).withColumn("fresh", F.lit(None).cast("string")).withColumn("fresh_status", F.lit(""))
    both = fresh.unionByName(rest).withColumn("fresh", F.when(F.col("fresh_status") == "", decode_entities(F.col("fresh"))))
    language = F.coalesce("detected", "cached_language", F.lit("en"))
    both = both.withColumn("detected_language", language)
    english = F.when(F.col("detected_language") == "en", F.col("text")).otherwise(F.coalesce("cached_translation", "fresh", "text"))
    both = both.withColumn("translated", english)
    return both.select(
        "conversation_id", "client_id", "agent", "client_name", "conversation_start_date", "rating", "agreements_subscription", "category", "detected_language",
        F.col("text").alias("conversation_text_multilingual"),
        F.col("translated").alias("conversation_text_translated"),
        remove_stop_words(F.col("translated")).alias("conversation_text_stopword_filtered"),
        F.col("client_text_raw").alias("conversation_text_client_original"),
        F.col("bot_text_raw").alias("conversation_text_bot_original"),
        F.col("full_text_raw").alias("conversation_text_full_original"),
        "client_message_count", "total_message_count", "was_escalated_to_agent", "rating_score", "last_author",
        (F.col("last_author") == "Client").alias("ended_without_resolution"),
        ((F.col("client_message_count") >= 5) & (F.col("rating_score") <= 0) & ~F.col("was_escalated_to_agent")).alias("is_probable_loop"),
    )


def translation_log(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Where each document's English text came from."""
    d, lang = docs.join(cache, "conversation_id", "left"), F.col("detected_language")
    source = (
        F.when((lang == "en") & (F.col("cached_language") == "en"), "confirmed_english_cache")
        .when((lang == "en") & F.col("cached_language").isNull(), "api_detected_english")
        .when((lang != "en") & F.col("cached_translation").isNotNull(), "translated_from_cache")
        .when((lang != "en") & F.col("cached_translation").isNull(), "translated_via_api")
        .otherwise("other")
    )
    before, after = F.col("conversation_text_multilingual"), F.col("conversation_text_translated")
    return d.select("conversation_id", "detected_language", "conversation_start_date", source.alias("translation_source"), F.length(before).cast("long").alias("original_char_count"), F.length(after).cast("long").alias("translated_char_count"), (after != before).alias("text_was_changed"))


def combined_text(docs: DataFrame) -> DataFrame:
    """Client text, with the decoded bot text on a new line where that isn't blank."""
    bot = clean(F.coalesce("conversation_text_bot_original", F.lit("")))
    client = F.col("conversation_text_multilingual")
    return docs.select("conversation_id", F.when(bot != "", F.concat(client, F.lit("\n"), bot)).otherwise(client).alias("content"))
