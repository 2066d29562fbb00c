"""Weighted terms of texts, in DataFrame functions: term frequencies are combined before each shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]{2,}"


def ngrams(text: Column, longest: int = 2) -> Column:
    """Lower-cased words of two or more characters, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    if longest == 1:
        return words
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def tf_idf(docs: DataFrame, doc: str, text: str, least_docs: int = 3, most_terms: int = 15000, longest: int = 2, sublinear: bool = True) -> DataFrame:
    """(doc, term, weight): smoothed idf ln((1 + n) / (1 + df)) + 1, times 1 + ln(tf) or tf, each document at length 1.

    Terms in fewer than ``least_docs`` documents go; of the rest the ``most_terms`` most frequent stay.
    """
    tf = docs.select(doc, F.explode(ngrams(F.col(text), longest)).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least_docs)
    kept = df.orderBy(F.desc("total"), "term").limit(most_terms)
    n = docs.count()
    idf = F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    raw = (1 + F.ln("tf")) if sublinear else F.col("tf").cast("double")
    weighted = tf.join(F.broadcast(kept.select("term", idf.alias("idf"))), "term").withColumn("raw", raw * F.col("idf"))
    size = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc)))
    return weighted.select(doc, "term", (F.col("raw") / size).alias("weight"))


def top_terms(weights: DataFrame, groups: DataFrame, doc: str, group: str, k: int = 5) -> DataFrame:
    """The ``k`` terms of highest mean weight over the documents of each group (absent terms count as 0)."""
    n = groups.groupBy(group).agg(F.count("*").alias("n"))
    sums = weights.join(groups, doc).groupBy(group, "term").agg(F.sum("weight").alias("s")).join(n, group)
    means = sums.select(group, "term", F.round(F.col("s") / F.col("n"), 8).alias("mean"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("mean"), "term")).cast("long")
    return means.withColumn("rank", rank).where(F.col("rank") <= k)


def contrast(weights: DataFrame, groups: DataFrame, doc: str, flag: str, k: int = 15) -> DataFrame:
    """Terms whose mean weight differs most between rows with and without ``flag``: ``k`` each way."""
    n = groups.agg(F.count_if(flag).alias("n1"), F.count_if(~F.col(flag)).alias("n0"))
    s = weights.join(groups, doc).groupBy("term").agg(F.coalesce(F.sum(F.when(F.col(flag), F.col("weight"))), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(F.when(~F.col(flag), F.col("weight"))), F.lit(0.0)).alias("s0"))
    over = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    diff = s.crossJoin(F.broadcast(n)).select("term", F.round(over("s1", "n1") - over("s0", "n0"), 8).alias("difference"))
    high = diff.orderBy(F.desc("difference"), "term").limit(k).withColumn("side", F.lit("with"))
    low = diff.orderBy("difference", "term").limit(k).withColumn("side", F.lit("without"))
    return high.unionByName(low)


def class_tf_idf(docs: DataFrame, group: str, text: str, k: int = 5) -> DataFrame:
    """Terms by topic with each topic as one document: tf * ln(1 + average words a topic / frequency in all)."""
    tf = docs.select(group, F.explode(ngrams(F.col(text), 1)).alias("term")).groupBy(group, "term").agg(F.count("*").alias("tf"))
    total = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    avg = tf.agg((F.sum("tf") / F.count_distinct(group)).alias("a"))
    words = F.sum("tf").over(Window.partitionBy(group))
    w = tf.withColumn("words", words).join(total, "term").crossJoin(F.broadcast(avg)).select(group, "term", F.round(F.col("tf") / F.col("words") * F.ln(1 + F.col("a") / F.col("f")), 8).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "term")).cast("long")
    return w.withColumn("rank", rank).where(F.col("rank") <= k)


def _window_sums(width: int, least: float):
    """Sums of cosines by topic over the windows of each document, from the places, weights and topics of its known words: a
    document at a time, as its windows times topics are many more than its words."""

    def sums(pos: pd.Series, term: pd.Series, idf: pd.Series, topics: pd.Series, wts: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for p, t, i, of, wt, e in zip(pos, term, idf, topics, wts, end, strict=True):
            last = max(e + 1 - width, 0)
            lo, hi = np.minimum(np.maximum(p - width + 1, 0), last), np.minimum(p, last)
            at = np.repeat(np.arange(len(p)), hi - lo + 1)  # a word in each of its windows
            win = np.arange(len(at)) - np.repeat((hi - lo + 1).cumsum() - hi - 1, hi - lo + 1)
            first, same = np.unique(t.astype(str), return_index=True, return_inverse=True)[1:]
            key, n = np.unique(same[at] * (last + 1) + win, return_counts=True)
            word, win = first[key // (last + 1)], key % (last + 1)
            ww = n * i[word]
            length = np.sqrt(np.bincount(win, ww * ww, last + 1))
            many = np.array([len(of[w]) for w in word])
            row = np.repeat(np.arange(len(word)), many)
            names, topic = np.unique(np.concatenate([of[w] for w in word]), return_inverse=True)
            pair, inverse = np.unique(win[row] * len(names) + topic, return_inverse=True)
            dots = np.bincount(inverse, ww[row] * np.concatenate([wt[w] for w in word]))
            s = np.round(dots / length[pair // len(names)], 9)
            topic, s = (pair % len(names))[s >= least], s[s >= least]
            total = np.bincount(topic, s, len(names))
            out.append([{"topic": names[c], "s": total[c]} for c in np.unique(topic)])
        return pd.Series(out, dtype=object)

    return sums


def window_topics(docs: DataFrame, doc: str, text: str, group: str, width: int = 4, least: float = 0.1, noise: int = -1) -> DataFrame:
    """(doc, topic, share): how much of each document its windows of ``width`` words give to each topic.

    Topics are those of documents other than ``noise``, each with the class weights of its words (see ``class_tf_idf``, without
    rounding). A window's words weigh by the same inverse frequency; its cosine with a topic counts if it is ``least`` or more
    (rounded to 9 digits), and a document's sums are made shares. Documents without such a window have no row.
    """
    words = docs.select(doc, F.col(group).alias("topic"), F.posexplode(ngrams(F.col(text), 1)).alias("pos", "term"))
    tf = words.where(F.col("topic") != noise).groupBy("topic", "term").agg(F.count("*").alias("tf"))
    mean = tf.agg((F.sum("tf") / F.count_distinct("topic")).alias("a"))
    idf = tf.groupBy("term").agg(F.sum("tf").alias("f")).crossJoin(mean).select("term", F.ln(1 + F.col("a") / F.col("f")).alias("idf"))  # one row of a mean
    weights = tf.join(tf.groupBy("topic").agg(F.sum("tf").alias("words")), "topic").join(idf, "term").withColumn("wt", F.col("tf") / F.col("words") * F.col("idf"))
    size = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("wt") * F.col("wt"))).alias("nt"))
    topics = weights.join(size, "topic").select("topic", "term", (F.col("wt") / F.col("nt")).alias("wt"))
    of_term = topics.groupBy("term").agg(F.collect_list("topic").alias("topics"), F.collect_list("wt").alias("wts")).join(idf, "term")
    each = words.select(doc, "pos", "term").join(of_term, "term").select(doc, F.struct("pos", "term", "idf", "topics", "wts").alias("x"))
    ends = words.groupBy(doc).agg(F.max("pos").alias("end"))
    of_doc = each.groupBy(doc).agg(F.collect_list("x").alias("x")).join(ends, doc)
    kind = docs.schema[group].dataType.simpleString()
    sums = F.pandas_udf(_window_sums(width, least), f"array<struct<topic: {kind}, s: double>>")("x.pos", "x.term", "x.idf", "x.topics", "x.wts", "end")
    near = of_doc.select(doc, sums.alias("l")).withColumn("_all", F.aggregate("l", F.lit(0.0), lambda a, x: a + x["s"]))
    return near.select(doc, "_all", F.explode("l").alias("x")).select(doc, "x.topic", F.round(F.col("x.s") / F.col("_all"), 8).alias("share"))
