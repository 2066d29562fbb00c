"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their first bytes (``PREFIXES``), hashed to ``BUCKETS``; the machine has a
weight and ``FACTORS`` factors per bucket, so it scores pairs of terms (an insult and a group that is mentioned) beyond
the sum of their weights. It is trained in numpy with Adagrad on the logistic loss.

Training takes at most ``MAX_TRAIN`` labelled documents, those of the smallest hash of doc_id. Terms enter by either of two screens, both over
terms that ``MIN_DOCS`` or more of these hold. By themselves: the share of label 1 among their documents differs from that of all by
``MIN_Z`` standard errors. In pairs: the documents that hold both words of a pair have other labels than a machine of the first terms says, by
``MIN_PAIR_Z`` standard errors; so an insult and a group name that each tell nothing alone enter together. Words by chance in a few documents
would else be learnt by heart. The screen of pairs covers all pairs of words that can pass at all (a bound on each word's sum shows which), in
blocks of words over the Spark tasks; the sample's words, a bounded number, are sent along. Equal documents count once there.
Scoring reads whole texts and shuffles nothing.

Defined cases: null and empty texts have no terms and score by the bias; of labels that repeat a doc_id the largest
counts; rows without doc_id are scored and not learnt from; without labels of both kinds every score is the share of
label 1 in training, or 0.5 if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.bytewords import ALNUM, Words, as_bytes, blocks
from talkloom.llm.quality import bounded, held_out, training_rows

PREFIXES = (4, 5, 6, 7, 8)
BUCKETS = 1 << 18
FACTORS = 4
MAX_TRAIN = 20000
MIN_DOCS, MIN_Z, MIN_PAIR_Z = 5, 4.0, 8.0
#: Least variance of a label that a machine has learnt.
MIN_VAR = 0.01
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 64, 0.2, 1e-5, 11
#: Pairwise terms are scaled down, as a text has about the square of its terms in pairs.
SCALE = 0.1
BLOCK_BYTES = 4 << 20


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, by text: two arrays."""
    w = Words(texts, ALNUM)
    return _distinct(w, PREFIXES)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same of whole words only."""
    return _distinct(Words(texts, ALNUM), ())


def _distinct(w: Words, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = [w.doc], [w.hash]
    for longer, value in w.prefixes(sizes) if sizes else ():
        docs.append(w.doc[longer])
        hashes.append(value)
    bucket = np.concatenate(hashes) % np.uint64(BUCKETS)
    pair = np.unique(np.concatenate(docs) * BUCKETS + bucket.astype(np.int64))
    return pair // BUCKETS, pair % BUCKETS


def scores(p: dict, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of texts 0 .. n - 1."""
    known = p["slot"][bucket]
    on = known >= 0
    doc, known = doc[on], known[on]
    linear = np.bincount(doc, p["w"][known], n)
    v = p["v"][known]
    pairs = np.zeros(n)
    for f in range(v.shape[1]):
        s = np.bincount(doc, v[:, f], n)
        pairs += s * s - np.bincount(doc, v[:, f] ** 2, n)
    return p["bias"] + linear + SCALE * 0.5 * pairs


def telling(held: np.ndarray, held_1: np.ndarray, share: float) -> np.ndarray:
    """Buckets that enter: ``held`` by how many documents, ``held_1`` of them with label 1, whose share in all is ``share``."""
    z = np.abs(held_1 - held * share) / np.sqrt(np.maximum(1e-9, held * share * (1 - share)))
    return np.flatnonzero((held >= MIN_DOCS) & (z >= MIN_Z))


def train(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, enter: np.ndarray | None = None) -> dict:
    """Parameters from the terms of documents 0, 1, ... (ascending) and their labels; ``enter``: buckets that do, or those that tell alone."""
    n = len(label)
    share = float(label.mean()) if n else 0.5
    if not 0 < share < 1:
        return {"constant": share}
    rng = np.random.default_rng(SEED)
    frequent = telling(np.bincount(bucket, minlength=BUCKETS), np.bincount(bucket, label[doc], BUCKETS), share) if enter is None else enter
    slot = np.full(BUCKETS, -1, np.int32)
    slot[frequent] = np.arange(len(frequent))
    on = slot[bucket] >= 0
    doc, term = doc[on], slot[bucket[on]]
    first = np.searchsorted(doc, np.arange(n + 1))
    k = len(frequent)
    w, v, bias = np.zeros(k), rng.normal(0, 0.03, (k, FACTORS)), np.log(share / (1 - share))
    gw, gv, gb = np.full(k, 1e-2), np.full((k, FACTORS), 1e-2), 1e-2
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, n, BATCH):
            some = order[i : i + BATCH]
            size = first[some + 1] - first[some]
            rows = np.concatenate([np.arange(first[j], first[j + 1]) for j in some])
            t, d = term[rows], np.repeat(np.arange(len(some)), size)
            vt = v[t]
            s = np.stack([np.bincount(d, vt[:, f], len(some)) for f in range(FACTORS)], 1)
            sq = np.stack([np.bincount(d, vt[:, f] ** 2, len(some)) for f in range(FACTORS)], 1)
            z = bias + np.bincount(d, w[t], len(some)) + SCALE * 0.5 * (s * s - sq).sum(1)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]
            u, inv = np.unique(t, return_inverse=True)
            e = err[d]
            dw = np.bincount(inv, e, len(u)) + DECAY * len(some) * w[u]
            dv = np.stack([np.bincount(inv, SCALE * e * (s[d, f] - vt[:, f]), len(u)) for f in range(FACTORS)], 1) + DECAY * len(some) * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            w[u] -= rate * dw / np.sqrt(gw[u])
            v[u] -= rate * 0.3 * dv / np.sqrt(gv[u])
            gb += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(gb)
    return {"slot": slot, "w": w, "v": v, "bias": bias}


def score_texts(p: dict, texts: list[bytes]) -> np.ndarray:
    if "constant" in p:
        return np.full(len(texts), p["constant"])
    out = np.empty(len(texts))
    for begin, part in blocks(texts, BLOCK_BYTES):
        out[begin : begin + len(part)] = _share(scores(p, *terms(part), len(part)))
    return out


def _share(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pair_words(first: np.ndarray, word: np.ndarray, residual: np.ndarray, var: np.ndarray, some: range) -> np.ndarray:
    """Words in pairs that tell, for pairs with a word of ``some``: document d has the words word[first[d] : first[d + 1]], numbered from 0,
    and ``residual`` is its label less what was expected, with variance ``var``."""
    n_words = int(word.max(initial=-1)) + 1
    size = np.diff(first)
    order = np.argsort(word, kind="stable")
    holder, at = np.repeat(np.arange(len(size)), size)[order], np.searchsorted(word[order], np.arange(n_words + 1))
    found = np.zeros(n_words, bool)
    for a in some:
        held = holder[at[a] : at[a + 1]] if a < n_words else ()
        if len(held) < MIN_DOCS:
            continue
        n = size[held]
        other = word[np.repeat(first[held] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        doc = np.repeat(held, n)
        z = np.bincount(other, residual[doc], n_words) / np.sqrt(np.maximum(np.bincount(other, var[doc], n_words), 1e-9))
        hit = (np.bincount(other, minlength=n_words) >= MIN_DOCS) & (np.abs(z) >= MIN_PAIR_Z)
        hit[a] = False
        if hit.any():
            found |= hit
            found[a] = True
    return np.flatnonzero(found)


def _bags_of(bags: DataFrame, column: str, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number and label of the documents, by doc_id, and where each one's buckets of ``enter`` begin (one more at the end), and these."""
    sent = bags.sparkSession.sparkContext.broadcast(enter)

    @F.pandas_udf("binary")
    def known(b: pd.Series) -> pd.Series:
        on = np.zeros(BUCKETS, bool)
        on[sent.value] = True
        return pd.Series([np.asarray(x)[on[np.asarray(x, np.int64)]].astype(np.int32).tobytes() for x in b], dtype=object)

    got = bags.select("nth", "doc_id", "label", known(column).alias("b")).collect()
    got.sort(key=lambda r: (r.doc_id, r.nth))
    kept = [np.frombuffer(r.b, np.int32) for r in got]
    first = np.cumsum([0, *map(len, kept)])
    return np.array([r.nth for r in got]), np.array([r.label for r in got]), first, np.concatenate(kept)


def telling_pairs(bags: DataFrame, nth: np.ndarray, label: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Buckets of words in pairs that tell."""
    spark = bags.sparkSession
    residual, var = label - expected, np.maximum(expected * (1 - expected), MIN_VAR)
    # by Cauchy and Schwarz, no set of a word's documents has more standard errors than the root of this sum over those of one sign
    most = residual**2 / var
    told = spark.createDataFrame(pd.DataFrame({"nth": nth, "up": np.where(residual > 0, most, 0), "down": np.where(residual < 0, most, 0)}))
    sums = bags.join(told, "nth").select("up", "down", F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    able = sums.where((F.col("n") >= MIN_DOCS) & (F.greatest("up", "down") >= MIN_PAIR_Z**2)).select("w").toArrow().column("w").to_numpy().astype(np.int64)
    able = np.sort(able)
    if len(able) < 2:
        return able[:0]
    _, _, first, word = _bags_of(bags, "w", able)
    word = np.searchsorted(able, word)
    once = {word[first[d] : first[d + 1]].tobytes(): d for d in reversed(range(len(nth)))}
    keep = np.array(sorted(once.values()))
    size = np.diff(first)[keep]
    rows = np.repeat(first[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    sent = spark.sparkContext.broadcast((np.concatenate([[0], np.cumsum(size)]), word[rows], residual[keep], var[keep]))
    n_blocks = max(1, min(len(able), 4 * spark.sparkContext.defaultParallelism))

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["id"]:
                yield pd.DataFrame({"w": pair_words(*sent.value, range(int(b), len(able), n_blocks))})

    found = spark.range(0, n_blocks, 1, n_blocks).mapInPandas(screen, "w long").distinct().toArrow().column("w").to_numpy()
    return able[np.sort(found)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAIN) -> dict:
    """Parameters trained on a bounded sample.

    Which terms enter is counted in Spark (a row per bucket); only those terms of the sample come to the driver.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, part in blocks(as_bytes(batch["text"]), BLOCK_BYTES):
                some = batch.iloc[begin : begin + len(part)]
                out = {"doc_id": some["doc_id"].to_numpy(), "label": some["_label"].to_numpy()}
                for name, (doc, bucket) in (("b", terms(part)), ("w", words(part))):
                    first = np.searchsorted(doc, np.arange(len(part) + 1))
                    out[name] = pd.Series([bucket[first[j] : first[j + 1]].astype(np.int32) for j in range(len(part))], dtype=object)
                yield pd.DataFrame(out)

    bags = bounded(training_rows(docs, labels, label, most).mapInPandas(features, "doc_id long, label double, b array<int>, w array<int>"), most, "toxicity-terms")
    n, ones = bags.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return {"constant": ones / n if n else 0.5}
    counts = bags.select("label", F.explode("b").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("label").alias("n1")).where(F.col("n") >= MIN_DOCS).toArrow()
    held, held_1 = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    at = counts.column("b").to_numpy()
    held[at], held_1[at] = counts.column("n").to_numpy(), counts.column("n1").to_numpy()
    enter = telling(held, held_1, ones / n)
    nth, truth, first, term = _bags_of(bags, "b", enter)
    doc = np.repeat(np.arange(len(truth)), np.diff(first))
    p = train(doc, term, truth, enter)
    paired = telling_pairs(bags, nth, truth, _share(scores(p, doc, term, len(truth))))
    if not np.isin(paired, enter).all():
        enter = np.union1d(enter, paired)
        _, _, first, term = _bags_of(bags, "b", enter)
        p = train(np.repeat(np.arange(len(truth)), np.diff(first)), term, truth, enter)
    return p


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(sent.value, as_bytes(texts)), dtype="float64")

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
