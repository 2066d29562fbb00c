"""Conversations cut into chunks of consecutive messages.

Messages that say nothing, or have fewer than two tokens, are left out. Going through the rest, a window is closed before a
message that would take it over ``most`` tokens, if it has ``least`` already; the last message of a closed window is the first
of the next. With an encoder, a window of ``least`` tokens is closed also before a message unlike it. Tokens are words
between white space, or what the given counter counts (``tokens.token_count``: byte pairs). As a window is a run of messages, its state is where it starts and how many tokens it has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.semantics import trim_all
from talkloom.plans.fixed import EMPTY_BEGINNINGS, EMPTY_MESSAGES

LEAST, MOST, LIKENESS = 200, 700, 0.55


def says_nothing(text: Column) -> Column:
    t = F.regexp_replace(F.lower(trim_all(text)), "[!.,?]+$", "")
    begins = F.exists(F.array(*[F.lit(p) for p in EMPTY_BEGINNINGS]), lambda p: F.startswith(t, p))
    return (t == "") | t.isin(EMPTY_MESSAGES) | begins


def n_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[\\s\\u00a0]+"), lambda x: x != ""))


def numbered(messages: DataFrame) -> DataFrame:
    """Adds message_id: the position in the conversation from 0, before any message is left out."""
    w = Window.partitionBy("conversation_id").orderBy("message_date", "content")
    return messages.withColumn("message_id", F.row_number().over(w) - 1)


def _spans(ms: Column, least: int, most: int) -> Column:
    """Array of (lo, hi), positions in ``ms`` of the first and last message of each chunk."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("tokens"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        tc = F.get(ms, i)["tc"]
        close = (s["tokens"] + tc > most) & (s["tokens"] >= least)
        lo = F.when(close, i - 1).otherwise(s["lo"])
        tokens = F.when(close, F.get(ms, i - 1)["tc"]).otherwise(s["tokens"]) + tc
        out = F.when(close, F.concat(s["out"], F.array(F.struct(s["lo"].alias("lo"), (i - 1).alias("hi"))))).otherwise(s["out"])
        return F.struct(lo.alias("lo"), tokens.alias("tokens"), out.alias("out"))

    last = F.size(ms) - 1
    return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda s: F.concat(s["out"], F.array(F.struct(s["lo"].alias("lo"), last.alias("hi")))))


def _kept(messages: DataFrame, counter: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """Conversations with their messages that count, in order, as an array ``ms``.

    ``messages``: conversation_id, message_id, message_date, role, original_text, translated_text, translation_granularity, language.
    """
    original = F.coalesce("original_text", F.lit(""))
    whole = F.coalesce(F.col("translation_granularity") == "conversation_level", F.lit(False))
    text = F.when(whole, original).otherwise(F.coalesce(F.when(F.col("translated_text") != "", F.col("translated_text")), original))
    m = messages.withColumns({"_orig": original, "_trans": text, "_whole": whole}).where(~says_nothing(F.col("_trans"))).withColumn("tc", counter(F.col("_trans"))).where("tc >= 2")
    who = F.when(F.lower(F.coalesce("role", F.lit(""))).isin("client", "user"), "[USER]").otherwise("[AI]")
    entry = F.struct("message_id", "tc", F.concat(who, F.lit(": "), F.col("_orig")).alias("orig"), F.concat(who, F.lit(": "), F.col("_trans")).alias("trans"), F.col("_whole").alias("whole"), F.coalesce("language", F.lit("en")).alias("language"), "message_date")
    return m.groupBy("conversation_id").agg(F.array_sort(F.collect_list(entry)).alias("ms"))


def _records(spans: DataFrame) -> DataFrame:
    """Chunks from conversations with ``ms`` and ``spans``."""
    each = spans.select("conversation_id", "ms", F.posexplode("spans").alias("chunk_seq", "span"))
    each = each.withColumn("part", F.slice("ms", F.col("span.lo") + 1, F.col("span.hi") - F.col("span.lo") + 1))
    lines = lambda k: F.array_join(F.transform("part", lambda m: m[k]), "\n")
    original = lines("orig")
    return each.select(
        "conversation_id",
        F.concat(F.col("conversation_id"), F.lit("__c"), F.lpad(F.col("chunk_seq").cast("string"), 4, "0")).alias("chunk_id"),
        F.col("chunk_seq").cast("long").alias("chunk_seq"),
        F.get("part", F.lit(0))["message_id"].cast("long").alias("message_start_idx"),
        F.element_at("part", -1)["message_id"].cast("long").alias("message_end_idx"),
        F.size("part").cast("long").alias("num_messages"),
        F.length(original).cast("long").alias("chunk_char_count"),
        original.alias("original_chunk_text"),
        lines("trans").alias("translated_chunk_text"),
        F.when(F.exists("part", lambda m: m["whole"]), "conversation_level").otherwise("message_level").alias("translation_granularity"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("part", lambda m: m["language"]))), ",").alias("languages"),
        F.array_min(F.transform("part", lambda m: m["message_date"])).alias("min_message_date"),
    )


def chunk(messages: DataFrame, least: int = LEAST, most: int = MOST, counter: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """Chunks by size only, in column functions."""
    kept = _kept(messages, counter)
    return _records(kept.withColumn("spans", _spans(F.col("ms"), least, most)))


def semantic_spans(texts: list[str], tokens: list[int], encode: Callable[[str], np.ndarray], least: int, most: int, likeness: float) -> list[tuple[int, int]]:
    """(first, last) of each chunk. An encoder that fails leaves the decision to size."""
    out, lo, size = [], 0, 0
    for i, tc in enumerate(tokens):
        if i > lo and size >= least:
            try:
                a, b = encode(" ".join(texts[lo:i])), encode(texts[i])
                n = float(np.linalg.norm(a) * np.linalg.norm(b))
                unlike = n >= 1e-9 and float(a @ b) / n < likeness
            except Exception:  # noqa: BLE001
                unlike = False
            if unlike:
                out.append((lo, i - 1))
                lo, size = i - 1, tokens[i - 1]
        if size + tc > most and size >= least and i > 0:
            out.append((lo, i - 1))
            lo, size = i - 1, tokens[i - 1]
        size += tc
    if tokens:
        out.append((lo, len(tokens) - 1))
    return out


def chunk_with_encoder(messages: DataFrame, encode: Callable[[str], np.ndarray], least: int = LEAST, most: int = MOST, likeness: float = LIKENESS, counter: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """Chunks by size and by likeness of each message to the window before it."""
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))

    @F.pandas_udf(kind)
    def spans(texts: pd.Series, tokens: pd.Series) -> pd.Series:
        bare = lambda t: t.split(": ", 1)[1]
        return pd.Series([[{"lo": a, "hi": b} for a, b in semantic_spans([bare(x) for x in t], [int(n) for n in k], encode, least, most, likeness)] for t, k in zip(texts, tokens, strict=True)], dtype=object)

    kept = _kept(messages, counter)
    texts, tokens = F.transform("ms", lambda m: m["trans"]), F.transform("ms", lambda m: m["tc"])
    return _records(kept.withColumn("spans", spans(texts, tokens)))
