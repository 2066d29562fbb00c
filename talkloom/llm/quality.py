"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Every text is cut into passages of ``PASSAGE_WORDS`` words. A passage is described by shares of its bytes and words,
encoded by one tanh layer, and weighted by a gated attention (tanh times sigmoid) whose weights are a softmax over the
document's passages; the weighted sum is scored by a logistic unit. Labels are of documents only; all layers are trained
together in numpy with Adam.

Training takes at most ``MAX_TRAIN`` labelled documents, those of the smallest hash of doc_id, each with all its passages, and of
these as many as have ``MAX_PASSAGES`` passages together, in that order; one that doesn't fit any more is left out.
Scoring encodes every passage of every whole text and shuffles nothing.

Defined cases: null and empty texts have one empty passage and so a score; of labels that repeat a doc_id the largest
counts; rows without doc_id are scored and not learnt from; without labels of both kinds every score is the share of
label 1 in training, or 0.5 if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.bytewords import SPACED, Words, as_bytes, blocks
from talkloom.llm.rows import packed, unpacked
from talkloom.sources.scratch import cut

PASSAGE_WORDS = 48
MAX_TRAIN = 6000
MAX_PASSAGES = 200_000
ENCODED, ATTENTION = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 128, 0.01, 1e-4, 5
THRESHOLD = 0.3
BLOCK_BYTES = 2 << 20

#: Classes of bytes; those not listed share the last but one, and bytes beyond ASCII have the last.
GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "|", "#", "$", "%", "&", "*", "!", "?", ":;", "\"'", "()[]{}<>", "=_/\\", "-+@~^`"]
CLASS = np.full(256, len(GROUPS), np.int64)
for _i, _g in enumerate(GROUPS):
    for _c in _g:
        CLASS[ord(_c)] = _i
CLASS[128:] = len(GROUPS) + 1
N_CLASS = len(GROUPS) + 2
#: After the byte shares: mean and spread of word length, share of distinct words, share of distinct word pairs, line breaks a word, long words, passage length, is empty.
N_FEATURES = N_CLASS + 8


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32), and the index of each passage's text, ascending; every text has one or more."""
    w = Words(texts, SPACED)
    n_words = np.bincount(w.doc, minlength=len(texts)).astype(np.int64)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    begin = np.cumsum(n_pass) - n_pass
    at = np.arange(len(w.hash)) - (np.cumsum(n_words) - n_words)[w.doc]
    of = begin[w.doc] + at // PASSAGE_WORDS
    total = int(n_pass.sum())
    inside = SPACED[w.raw] != 0
    counts = np.bincount(np.repeat(of, w.length) * N_CLASS + CLASS[w.raw[inside]], minlength=total * N_CLASS).reshape(total, N_CLASS).astype(np.float64)
    n = np.bincount(of, minlength=total).astype(np.float64)
    size = np.maximum(1, counts.sum(1))
    some = np.maximum(1, n)
    mean = size / some
    spread = np.sqrt(np.maximum(0, np.bincount(of, w.length.astype(np.float64) ** 2, total) / some - mean**2))
    distinct = _distinct(of, w.hash, total) / some
    same = of[1:] == of[:-1]
    with np.errstate(over="ignore"):
        pair = w.hash[:-1] * np.uint64(3) + w.hash[1:]
    pairs = _distinct(of[1:][same], pair[same], total) / np.maximum(1, n - 1)
    broke = np.bincount(of[np.searchsorted(w.start, np.flatnonzero(w.raw == 10)).clip(0, max(0, len(of) - 1))], minlength=total) if len(of) else np.zeros(total)
    more = [np.log1p(mean), np.log1p(spread), distinct, pairs, np.minimum(1, broke / some), np.bincount(of, w.length > 18, total) / some, np.log1p(n) / 4, n == 0]
    return np.hstack([counts / size[:, None], np.stack(more, 1)]).astype(np.float32), np.repeat(np.arange(len(texts)), n_pass)


def _distinct(of: np.ndarray, value: np.ndarray, total: int) -> np.ndarray:
    if not len(of):
        return np.zeros(total)
    order = np.lexsort((value, of))
    o, v = of[order], value[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=total)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, x: np.ndarray, first: np.ndarray) -> dict:
    """x: features of the passages, those of a document together; first: where each document's begin."""
    x = (x - p["mean"]) / p["scale"]
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    e = (t * g) @ p["a"]
    size = np.diff(np.append(first, len(x)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
    attend = e / np.repeat(np.add.reduceat(e, first), size)
    z = np.add.reduceat(attend[:, None] * h, first, 0)
    return {"x": x, "h": h, "t": t, "g": g, "attend": attend, "z": z, "size": size, "y": _sigmoid(z @ p["c"] + p["d"][0])}


def train(x: np.ndarray, doc: np.ndarray, label: np.ndarray) -> dict:
    """Parameters from passage features, their documents (0, 1, ...) and the documents' labels."""
    rng = np.random.default_rng(SEED)
    share = float(label.mean()) if len(label) else 0.5
    if not 0 < share < 1:
        return {"constant": share}
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"W": normal(N_FEATURES, ENCODED), "b": np.zeros(ENCODED, np.float32), "V": normal(ENCODED, ATTENTION), "U": normal(ENCODED, ATTENTION), "a": normal(ATTENTION), "c": normal(ENCODED), "d": np.array([np.log(share / (1 - share))], np.float32)}
    fixed = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    first, step = np.searchsorted(doc, np.arange(len(label))), 0
    size = np.diff(np.append(first, len(x)))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            rows = np.concatenate([np.arange(first[j], first[j] + size[j]) for j in some])
            f = forward(p | fixed, x[rows], np.cumsum(size[some]) - size[some])
            grad, step = _gradient(p, f, label[some]), step + 1
            for k, g in grad.items():
                g = g + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def _gradient(p: dict, f: dict, label: np.ndarray) -> dict:
    dy = (f["y"] - label) / len(label)
    dz = dy[:, None] * p["c"]
    rep = np.repeat(dz, f["size"], 0)
    dattend = (rep * f["h"]).sum(1)
    first = np.cumsum(f["size"]) - f["size"]
    de = f["attend"] * (dattend - np.repeat(np.add.reduceat(f["attend"] * dattend, first), f["size"]))
    dt, dg = de[:, None] * p["a"] * f["g"], de[:, None] * p["a"] * f["t"]
    dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
    dh = rep * f["attend"][:, None] + dt @ p["V"].T + dg @ p["U"].T
    dh = dh * (1 - f["h"] ** 2)
    return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": np.array([dy.sum()])}


def score_texts(p: dict, texts: list[bytes]) -> np.ndarray:
    if "constant" in p:
        return np.full(len(texts), p["constant"])
    out = np.empty(len(texts))
    for begin, part in blocks(texts, BLOCK_BYTES):
        x, doc = passage_features(part)
        out[begin : begin + len(part)] = forward(p, x, np.searchsorted(doc, np.arange(len(part))))["y"]
    return out


def held_out(doc_id, folds: int = 5):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` labelled documents outside the held-out fold, by hash of doc_id."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("double").alias("_label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "_label", "text")


def bounded(rows: DataFrame, most: int, name: str) -> DataFrame:
    """``rows`` in a table, numbered by ``nth``; where repeated ids make them more than ``most``, that many by hash of doc_id."""
    rows = cut(rows.withColumn("nth", F.monotonically_increasing_id()), name)
    if rows.count() > most:
        chosen = rows.select("nth", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "nth").limit(most).select("nth")
        rows = cut(rows.join(chosen, "nth", "left_semi"), name)
    return rows


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN, most_passages: int = MAX_PASSAGES) -> dict:
    """Parameters trained on a bounded sample; only features of its passages come to the driver."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, part in blocks(as_bytes(batch["text"]), BLOCK_BYTES):
                x, doc = passage_features(part)
                first = np.searchsorted(doc, np.arange(len(part) + 1))
                some = batch.iloc[begin : begin + len(part)]
                bags = pd.Series([x[first[j] : first[j + 1]].tobytes() for j in range(len(part))], dtype=object)
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "label": some["_label"].to_numpy(), "n": np.diff(first), "x": bags})

    rows = bounded(training_rows(docs, labels, label, most).mapInPandas(features, "doc_id long, label double, n long, x binary"), most, "quality-passages")
    left, fitting = most_passages, []
    for r in rows.select("nth", "n").orderBy(F.xxhash64("doc_id"), "doc_id", "nth").collect():
        if r.n <= left:
            left -= r.n
            fitting.append((r.nth,))
    chosen = docs.sparkSession.createDataFrame(fitting, "nth long")
    got = rows.join(F.broadcast(chosen), "nth", "left_semi").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got]
    if not bags:
        return {"constant": 0.5}
    return train(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([r.label for r in got]))


def scorer(spark, params: dict):
    sent = spark.sparkContext.broadcast(params)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(sent.value, as_bytes(texts)), dtype="float64")

    return score


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those scored below the threshold."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    scored = packed(docs, _text=F.col("text")).withColumn("_score", score("_text"))
    return unpacked(scored.where(F.col("_score") >= THRESHOLD), docs)
