"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, over all training documents.

The model predicts a token from the two before it: predicted vector = C1 r(t-1) + C2 r(t-2), score of output w = predicted . q(w) +
b(w). Outputs are whole words: those with ``MIN_OUT`` or more training occurrences have a vector and a bias of their own, up to ``OUT`` of them; so
the vocabulary grows with the corpus up to a memory bound. All other tokens, unknown ones too, are ``SHARED`` outputs by a hash of
their last bytes, and within such an output a token has its smoothed share of the output's training tokens, one part being kept for
unknown ones. As contexts, the ``OWN`` most frequent words have vectors of their own and the others those of their shared class. The scores of all outputs
are made for all pairs of contexts by matrix products, block by block over Spark tasks; only the logarithm of each pair's sum is
kept. With it, the probabilities of a context add up to 1 over all outputs, and over all tokens.

What is learnt covers the whole training corpus and grows with it: token counts, and the counts of all triples of two contexts and an output,
added up in Spark, dealt by a hash into shares of some ``SHARE`` triples, and kept as a table of a row a share. Training passes over that
whole table ``ROUNDS`` times: from the same parameters there is a descent along each share (again over all of it while that is under
``LEAST_STEPS`` steps), and changes are averaged between rounds, each row weighted by how often a share met it. Shares, their order and
their random numbers hang on the triples alone, so scores are the same for any partitions and after a task is run again. Passes over the texts: token counts; triples; scores. The ``HEAD`` most frequent tokens
are sent along (those of over ``HEAD_BYTES`` as a digest); the rest of a document's tokens are joined to the table of counts by token.

Defined cases: null and empty texts are one end token; rows without doc_id are scored and not learnt from, and not held
out; rows that repeat a doc_id are reported each; without training documents all counts are 0.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.quality import held_out
from talkloom.sources.scratch import cut, drop_cut

FOLDS = 10
OWN, SHARED = 224, 30
#: Contexts, and the first outputs: 0 stands before a text, 1 is its end.
CLASSES = 2 + OWN + SHARED
OUT, MIN_OUT = 32_768, 20
HEAD, HEAD_BYTES = 50_000, 64
DIM, NOISE, BATCH, RATE, SEED = 24, 64, 4096, 0.08, 3
ROUNDS, LEAST_STEPS = 4, 100
SHARE = 500_000
#: What the sums of squared gradients begin with: rows that are seldom met move little.
FLOOR = 1e-4
ADD = 0.1
FLUSH = 200_000
SUFFIX = 2
#: Rows of outputs that are added up as one, and groups of shares that are added up first.
ROWS, GROUPS = 512, 16


def tokens(text) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def short(token: bytes) -> bytes:
    """A token as the head holds it."""
    return token if len(token) <= HEAD_BYTES else hashlib.md5(token).digest()


class IdOf(dict):
    """Token to its output; shared ones are worked out as they come up, and forgotten when too many."""

    def __init__(self, words: list[bytes]):
        self.words = words
        super().__init__()
        self._start()

    def _start(self) -> None:
        self.update((t, output(i)) for i, t in enumerate(self.words))

    def __missing__(self, token: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
            self._start()
            if token in self:
                return self[token]
        if len(token) > HEAD_BYTES and (held := self.get(short(token))) is not None:
            return held
        c = self[token] = shared(token)
        return c


def output(rank: int) -> int:
    """The output of the word of this rank; the most frequent words are contexts as well, and stand before the shared outputs."""
    return rank + 2 if rank < OWN else rank + 2 + SHARED


def shared(token: bytes) -> int:
    return 2 + OWN + zlib.crc32(token[-SUFFIX:]) % SHARED


def contexts(words: list[bytes]) -> np.ndarray:
    """The context of each output."""
    more = np.fromiter(map(shared, words[OWN:]), np.int64, max(0, len(words) - OWN))
    return np.concatenate([np.arange(CLASSES), more])


def _texts(batch: pa.RecordBatch):
    for x in batch.column("text"):
        yield x.as_py()


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, ends = Counter(), 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

    for batch in batches:
        for text in _texts(batch):
            seen.update(tokens(text))
            ends += 1
            if len(seen) > FLUSH:
                yield out()
                seen.clear()
    if seen:
        yield out()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["token", "c"])


def _ids(toks: list[bytes], ids: IdOf) -> np.ndarray:
    """Outputs, with two of 0 before and the end after."""
    out = np.zeros(len(toks) + 3, np.int64)
    out[2:-1] = np.fromiter(map(ids.__getitem__, toks), np.int64, len(toks))
    out[-1] = 1
    return out


def _cells(out: np.ndarray, of: np.ndarray, n_out: int) -> np.ndarray:
    """(older context, newer context, output) of each token as one number."""
    c = of[out]
    return (c[:-2] * CLASSES + c[1:-1]) * n_out + out[2:]


def _triple_counter(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        ids, of, part, size = IdOf(words), contexts(words), [], 0

        def out():
            cells, n = np.unique(np.concatenate(part), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], ["cell", "n"])

        for batch in batches:
            for text in _texts(batch):
                part.append(_cells(_ids(tokens(text), ids), of, len(of)))
                size += len(part[-1])
                if size > 1 << 21:
                    yield out()
                    part, size = [], 0
        if part:
            yield out()

    return count


def started(unigram: np.ndarray) -> dict:
    """Parameters to begin with: every context predicts by frequency; ``unigram`` counts the outputs."""
    rng = np.random.default_rng(SEED)
    noise = unigram + 1.0
    noise[0] = 0
    noise /= noise.sum()
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    eye = np.eye(DIM, dtype=np.float32)
    bias = np.log(np.maximum(noise, 1e-12)).astype(np.float32)
    return {"r": small(CLASSES, DIM), "q": small(len(noise), DIM), "c1": eye * 0.5 + small(DIM, DIM) * 0.1, "c2": eye * 0.3 + small(DIM, DIM) * 0.1, "b": bias, "noise": noise}


def _by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    wide = rows.shape[1]
    flat = (index[:, None] * wide + np.arange(wide)).ravel()
    return np.bincount(flat, rows.ravel(), n * wide).reshape(n, wide).astype(np.float32)


def _chance(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in the place of ``x``."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _added_up(index: np.ndarray, values: tuple) -> tuple[np.ndarray, tuple]:
    """The distinct numbers of ``index`` (under 2**16) and, for each of ``values``, the sums of its rows by them."""
    order = np.argsort(index.astype(np.uint16), kind="stable")  # by digits, as numbers have 16 bits
    held = index[order]
    begin = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    size = np.diff(begin, append=len(held))
    # most stand alone, and only the others need adding
    more = np.flatnonzero(size > 1)
    some = order[np.repeat(size > 1, size)]
    at = np.cumsum(size[more]) - size[more]
    out = []
    for x in values:
        total = x[order[begin]]
        if len(more):
            total[more] = np.add.reduceat(x[some], at, axis=0)
        out.append(total)
    return held[begin], tuple(out)


class Descent:
    """Noise-contrastive steps from given parameters, by Adagrad."""

    def __init__(self, p: dict, seed: int, rate: float):
        self.p = {k: a.copy() for k, a in p.items()}
        self.rng, self.rate, self.steps = np.random.default_rng(seed), rate, 0
        self.upto = np.cumsum(p["noise"])
        self.log_noise = np.log(np.maximum(p["noise"], 1e-12) * NOISE).astype(np.float32)
        self.sum = {k: np.full(self.p[k].shape, FLOOR, np.float32) for k in ("r", "q", "c1", "c2", "b")}
        # places of a step's rows, taken once
        self.h, self.qw, self.g, self.z = (np.empty((BATCH + extra, wide), np.float32) for extra, wide in ((0, DIM), (0, DIM), (NOISE, DIM), (0, NOISE)))

    def _move(self, k: str, rows, g: np.ndarray) -> None:
        s = self.sum[k][rows] + g * g
        self.sum[k][rows] = s
        self.p[k][rows] -= self.rate * g / np.sqrt(s)

    def step(self, cell: np.ndarray, n: np.ndarray) -> None:
        p, n_out, size = self.p, len(self.p["q"]), len(cell)
        pair = cell // n_out
        w, u2 = cell - pair * n_out, pair // CLASSES
        u1 = pair - u2 * CLASSES
        weight = (n / n.sum()).astype(np.float32)
        false = np.searchsorted(self.upto, self.rng.random(NOISE) * self.upto[-1], side="right").clip(1, n_out - 1)
        h, qw, qf = self.h[:size], self.qw[:size], p["q"][false]
        np.take(p["r"] @ p["c2"], u2, 0, out=h, mode="clip")
        np.take(p["r"] @ p["c1"], u1, 0, out=qw, mode="clip")
        h += qw
        np.take(p["q"], w, 0, out=qw, mode="clip")
        true, d_false = np.einsum("ij,ij->i", h, qw), np.matmul(h, qf.T, out=self.z[:size])
        true += p["b"][w] - self.log_noise[w]
        d_false += p["b"][false] - self.log_noise[false]
        d_true = (weight * (_chance(true) - 1))[:, None]
        _chance(d_false)
        d_false *= weight[:, None]
        # gradients of the outputs, then those of the contexts
        g = self.g[: size + NOISE]
        np.multiply(d_true, h, out=g[:size])
        np.matmul(d_false.T, h, out=g[size:])
        dh = np.matmul(d_false, qf, out=h)
        qw *= d_true
        dh += qw
        rows, (g_q, g_b) = _added_up(np.concatenate([w, false]), (g, np.concatenate([d_true[:, 0], d_false.sum(0)])))
        self._move("q", rows, g_q)
        self._move("b", rows, g_b)
        ga, gb = _by(u1, dh, CLASSES), _by(u2, dh, CLASSES)
        g_r, g_1, g_2 = ga @ p["c1"].T + gb @ p["c2"].T, p["r"].T @ ga, p["r"].T @ gb
        every = slice(None)
        self._move("r", every, g_r)
        self._move("c1", every, g_1)
        self._move("c2", every, g_2)
        self.steps += 1

    def over(self, cell: np.ndarray, n: np.ndarray) -> None:
        """One pass over ``cell`` (with counts) in random order."""
        order = self.rng.permutation(len(cell))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            self.step(cell[some], n[some])


def train(cell: np.ndarray, n: np.ndarray, n_out: int = CLASSES) -> dict:
    """Parameters from the triples of one place, by the steps that the tasks make."""
    p = started(np.bincount(cell % n_out, n, n_out) if len(cell) else np.zeros(n_out))
    for turn in range(ROUNDS if len(cell) else 0):
        d = Descent(p, SEED + turn, RATE / (1 + turn) ** 0.5)
        while d.steps < LEAST_STEPS:
            d.over(cell, n)
        p = d.p
    return p


SHARES = "share int, cell binary, n binary"


def _share(t: pa.Table) -> pa.Table:
    """The triples of a share as one row, by cell."""
    cell, n = t.column("cell").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(cell)
    # CLASSES ** 2 contexts times OUT + CLASSES outputs are under 2 ** 32
    return pa.table({"share": pa.array([t.column("share")[0].as_py()], pa.int32()), "cell": pa.array([cell[order].astype(np.uint32).tobytes()], pa.binary()), "n": pa.array([n[order].tobytes()], pa.binary())})


def shares(triples: DataFrame, size: int = SHARE) -> DataFrame:
    """The table of ``SHARES`` of (cell, n)."""
    many = max(1, -(-triples.count() // size))
    dealt = triples.withColumn("share", F.pmod(F.xxhash64("cell"), F.lit(many)).cast("int"))
    return cut(dealt.groupBy("share").applyInArrow(_share, SHARES), "lbl-shares")


UPDATE = "block int, task int, payload binary"


def _trainer(sent, turn: int):
    """Changes of the parameters along each share: a row per block of outputs (their vectors and biases) and one, -1, of the rest; weighted, with the weights."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        n_out = len(p["q"])
        for batch in batches:
            for row in range(batch.num_rows):
                share = batch.column("share")[row].as_py()
                cell = np.frombuffer(batch.column("cell")[row].as_py(), np.uint32).astype(np.int64)
                n = np.frombuffer(batch.column("n")[row].as_py(), np.int64)
                d = Descent(p, SEED + 1_000_003 * turn + share, RATE / (1 + turn) ** 0.5)
                while d.steps < LEAST_STEPS or not d.steps:
                    d.over(cell, n)
                met = np.bincount(cell % n_out, n, n_out)
                weight = (met + 1e-4 * met.sum() * p["noise"] + 1e-9).astype(np.float32)[:, None]
                change = np.hstack([(d.p["q"] - p["q"]) * weight, (d.p["b"] - p["b"])[:, None] * weight, weight])
                parts = [change[i : i + ROWS].tobytes() for i in range(0, n_out, ROWS)]
                rest = np.concatenate([(d.p[k] - p[k]).ravel() for k in ("r", "c1", "c2")]) * np.float32(met.sum())
                parts.append(np.append(rest, np.float32(met.sum())).astype(np.float32).tobytes())
                blocks = np.append(np.arange(len(parts) - 1), -1).astype(np.int32)
                for i in range(0, len(parts), 8):
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[i : i + 8]), pa.array(np.full(len(parts[i : i + 8]), share, np.int32)), pa.array(parts[i : i + 8], pa.binary())], ["block", "task", "payload"])

    return descend


def _added(t: pa.Table) -> pa.Table:
    """The payloads of a block as one, in the order of shares."""
    rows = sorted(zip(t.column("task").to_pylist(), t.column("payload").to_pylist(), strict=True))
    total = np.sum([np.frombuffer(x, np.float32) for _, x in rows], axis=0, dtype=np.float64).astype(np.float32)
    return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "task": pa.array([rows[0][0]], pa.int32()), "payload": pa.array([total.tobytes()], pa.binary())})


def fitted(dealt: DataFrame, unigram: np.ndarray) -> dict:
    """Parameters after ROUNDS passes over the table of ``shares``."""
    spark, p = dealt.sparkSession, started(unigram)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(p)
        changes = dealt.mapInArrow(_trainer(sent, turn), UPDATE)
        # in two steps, so that no task has the changes of very many shares
        some = changes.groupBy("block", F.pmod("task", F.lit(GROUPS))).applyInArrow(_added, UPDATE)
        got = cut(some.groupBy("block").applyInArrow(_added, UPDATE), "lbl-changes").collect()
        new = {k: a.copy() for k, a in p.items()}
        for r in got:
            x = np.frombuffer(r.payload, np.float32)
            if r.block < 0:
                at = 0
                for k in ("r", "c1", "c2"):
                    new[k] += (x[at : at + new[k].size] / x[-1]).reshape(new[k].shape)
                    at += new[k].size
            else:
                x = x.reshape(-1, DIM + 2)
                rows = slice(r.block * ROWS, r.block * ROWS + len(x))
                new["q"][rows] += x[:, :DIM] / x[:, -1:]
                new["b"][rows] += x[:, DIM] / x[:, -1]
        sent.unpersist()
        p = new
    return p


def log_sums(p: dict, older) -> np.ndarray:
    """For each context in ``older`` and each newer one, the logarithm of the sum over all outputs but 0."""
    a, b, q, bias = p["r"] @ p["c2"], p["r"] @ p["c1"], p["q"][1:], p["b"][1:]
    out = np.empty((len(older), CLASSES))
    for i, o in enumerate(older):
        s = (a[o] + b) @ q.T + bias
        top = s.max(1, keepdims=True)
        out[i] = (top + np.log(np.exp(s - top).sum(1, keepdims=True, dtype=np.float64)))[:, 0]
    return out


def all_log_sums(spark, p: dict) -> np.ndarray:
    """``log_sums`` of all pairs, older * CLASSES + newer, a block of older ones a task."""
    sent = spark.sparkContext.broadcast({k: a for k, a in p.items() if k != "noise"})

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([o], pa.int64()), pa.array([log_sums(sent.value, [o])[0].tobytes()], pa.binary())], ["older", "sums"])

    got = spark.range(0, CLASSES, 1, 16).mapInArrow(block, "older long, sums binary").collect()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(got)])


def class_log10(p: dict) -> np.ndarray:
    """log10 P(output | two contexts before), a row for each pair (older * CLASSES + newer); rows sum to 1 over outputs but 0."""
    a, b = p["r"] @ p["c2"], p["r"] @ p["c1"]
    out = np.empty((CLASSES * CLASSES, len(p["q"])), np.float32)
    for older in range(CLASSES):
        s = (a[older] + b) @ p["q"].T + p["b"] - log_sums(p, [older])[0][:, None]
        s[:, 0] = -np.inf
        out[older * CLASSES : (older + 1) * CLASSES] = s / np.log(10)
    return out


SCORED = "rid long, doc_id long, n_tokens long, s double, known long, model double, tail array<binary>, times array<int>"


def _text_scorer(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        n_own, of, p = len(model["words"]), contexts(model["words"]), model["p"]
        size = len(model["head"])
        place = dict(zip(model["head"], range(size), strict=True))
        # by place in the head, and one more for tokens that aren't there
        out_of = np.array([output(i) if i < n_own else shared(t) for i, t in enumerate(model["head"])] + [0], np.int64)
        log_c = np.append(model["log_c"], 0.0)
        in_shared = (out_of >= 2 + OWN) & (out_of < CLASSES)
        log_shared = np.where(in_shared, log_c, 0.0)
        h = ((p["r"] @ p["c2"])[:, None] + p["r"] @ p["c1"]).reshape(CLASSES * CLASSES, DIM)
        log_sum, part, end = model["log_sums"], model["log_z"], model["end"]
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                toks = tokens(text)
                at = np.fromiter(map(place.get, toks, repeat(size)), np.int64, len(toks))
                rare = np.flatnonzero(at == size)
                out = np.zeros(len(at) + 3, np.int64)
                out[2:-1] = out_of[at]
                out[-1] = 1
                s, known = np.log10(end + ADD) + log_c[at].sum(), int(end > 0) + len(at) - len(rare)
                # a token without an output of its own has its share of the shared one
                lbl = log_shared[at].sum()
                others = list(map(toks.__getitem__, rare.tolist()))
                tail = Counter(others)
                outs, long_own = list(map(shared, others)), {}
                for t in [t for t in tail if len(t) > HEAD_BYTES]:
                    held = place.get(short(t), size)
                    if held < size:
                        k = tail.pop(t)
                        s += k * log_c[held]
                        known += k
                        if held >= n_own:
                            lbl += k * log_c[held]
                        else:
                            long_own[t] = output(held)
                if long_own:
                    outs = [long_own.get(t, w) for t, w in zip(others, outs, strict=True)]
                out[2 + rare] = outs
                c = of[out]
                pairs = c[:-2] * CLASSES + c[1:-1]
                for i in range(0, len(pairs), 1 << 18):
                    pair, w = pairs[i : i + (1 << 18)], out[2 + i : 2 + i + (1 << 18)]
                    lbl += float((np.einsum("ij,ij->i", h[pair], p["q"][w]) + p["b"][w] - log_sum[pair]).sum(dtype=np.float64)) / np.log(10)
                rest = out[2:]
                rest = rest[(rest >= 2 + OWN) & (rest < CLASSES)]
                lbl -= part[rest].sum()
                for col, x in zip(cols, (rid, doc_id, len(toks) + 1, float(s), known, float(lbl), list(tail), list(tail.values())), strict=True):
                    col.append(x)
                rid += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCORED.split(", ")])

    return score


def fit(docs: DataFrame):
    """(table of training counts by token, model to send along, N, V) from the documents outside the held-out fold."""
    spark = docs.sparkSession
    training = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS)).select("text")
    counted = cut(training.mapInArrow(count_tokens, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "lbl-counts")
    end = counted.where("token IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    counts = counted.where("token IS NOT NULL")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + end, v + (end > 0)
    held = F.when(F.octet_length("token") <= HEAD_BYTES, F.col("token")).otherwise(F.unhex(F.md5("token")))
    top = counts.orderBy(F.desc("c"), "token").limit(HEAD).select(held.alias("token"), "c").toArrow()
    words, c = top.column("token").to_pylist(), top.column("c").to_numpy()
    own = words[: int(np.searchsorted(-c[:OUT], -MIN_OUT, side="right"))] if len(c) > OWN else words
    sent_own = spark.sparkContext.broadcast(own)
    triples = cut(training.mapInArrow(_triple_counter(sent_own), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "lbl-triples")

    def rest_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = IdOf(sent_own.value)
        for batch in batches:
            k = np.fromiter((ids[t] for t in batch.column("token").to_pylist()), np.int64, batch.num_rows)
            rest = (k >= 2 + OWN) & (k < CLASSES)
            total, kinds = np.bincount(k[rest], batch.column("c").to_numpy()[rest], CLASSES), np.bincount(k[rest], minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total.astype(np.int64)), pa.array(kinds.astype(np.int64))], ["k", "n", "v"])

    n_of, v_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, a, b in counts.mapInArrow(rest_sums, "k long, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():
        n_of[k], v_of[k] = a, b
    unigram = np.zeros(len(contexts(own)))
    unigram[:CLASSES] = n_of
    unigram[1] = end
    unigram[2 : 2 + min(OWN, len(own))] = c[:OWN][: len(own)]
    unigram[CLASSES:] = c[OWN : len(own)]
    dealt = shares(triples)
    drop_cut(triples)
    p = fitted(dealt, unigram)
    model = {
        "words": own, "head": words, "log_c": np.log10(c + ADD), "p": {k: a for k, a in p.items() if k != "noise"}, "log_sums": all_log_sums(spark, p),
        "log_z": np.log10(n_of + ADD * (v_of + 1)), "end": int(end),
    }
    return counts, model, int(n), int(v)


def op5(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts, model, n, v = fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = cut(docs.mapInArrow(_text_scorer(sent), SCORED), "lbl-scored")
    tail = scored.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("rid", F.col("x.tail").alias("token"), F.col("x.times").alias("k"))
    c = F.coalesce("c", F.lit(0))
    sums = tail.join(counts, "token", "left").groupBy("rid").agg(F.sum(F.col("k") * F.log10(c + ADD)).alias("s_tail"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("k_tail"))
    out = scored.drop("tail", "times").join(sums, "rid", "left")
    s = F.col("s") + F.coalesce("s_tail", F.lit(0.0))
    floor = float(np.log10(n + ADD * (v + 1)))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("k_tail", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (s - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("model") + F.coalesce("s_tail", F.lit(0.0))).alias("score"),
    )
