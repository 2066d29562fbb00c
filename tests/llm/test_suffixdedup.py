"""Repeated byte windows against a plain scan over all of them."""

import hashlib
import random

import pyarrow as pa
import pytest

from talkloom.llm import suffixdedup as s

SCHEMA = "doc_id long, text string"


def plain(rows, depth):
    """doc_id -> (bytes, removed, spans, digest), by a set of the windows seen so far."""
    seen, out = set(), {}
    for name, text in sorted(rows, key=lambda r: r[0]):
        body = (text or "").encode()
        off = [False] * len(body)
        for p in range(len(body) - depth + 1):
            w = body[p : p + depth]
            if w in seen:
                off[p : p + depth] = [True] * depth
            seen.add(w)
        spans = sum(x and not y for x, y in zip(off, [False, *off], strict=False))
        kept = bytes(x for x, gone in zip(body, off, strict=True) if not gone)
        out[name] = (len(body), sum(off), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus(seed, n):
    """Texts of few words with passages, copies, near copies, constant stretches, and letters of several bytes."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéß漢", k=r.randint(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(r.choices(words, k=k))
    passages = [prose(30) for _ in range(4)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 200]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.4:
            texts.append(prose(r.randint(1, 80)))
        elif kind < 0.6:
            texts.append(prose(r.randint(0, 20)) + " " + r.choice(passages) + " " + prose(r.randint(0, 20)))
        elif kind < 0.75:
            texts.append(r.choice(texts))
        else:
            old = list(r.choice(texts) or "y")
            old[r.randrange(len(old))] = "#"
            texts.append("".join(old))
    ids = r.sample(range(10 * n), n)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("batch,share", [(10_000, s.HOT), (3, s.HOT), (5, 10**9)])
def test_equals_a_plain_scan(spark, batch, share):
    rows = corpus(batch, 150)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert found(s.deduped(df, share=share)) == plain(rows, s.DEPTH)
        assert found(s.deduped(df, depth=20, pivot=7, share=share)) == plain(rows, 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_long_text_is_cut_into_pieces(monkeypatch):
    texts = pa.array([(t or "").encode() for _, t in corpus(11, 60)], pa.binary())
    windows = lambda: {(d, a + j, h) for d, a, n, h, _ in zip(*s.batch_runs(texts), strict=True) for j in range(n)}
    whole = windows()
    monkeypatch.setattr(s, "BLOCK", 64)
    assert windows() == whole
    assert len({w[:2] for w in whole}) == sum(max(0, len(t.as_py()) - s.DEPTH + 1) for t in texts)


def test_rows_stated_again_and_null_ids(spark):
    a, b = "first words " * 3 + "z" * 120, "other words " * 12
    rows = [(1, a), (1, a), (2, b), (2, a), (None, b), (None, None)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in s.op13(spark.createDataFrame(rows, SCHEMA)).collect())
    once = plain([(1, a)], 100)[1][1]
    # the row stated again isn't its own repeat; doc 2 is two documents; a null doc_id comes last
    assert got[2:4] == [(1, len(a), once)] * 2
    assert got[0] == (0, 0, 0) and got[1] == (0, len(b), len(b))
    assert sorted(x[2] for x in got[4:]) == sorted([plain([(2, b)], 100)[2][1], len(a)])


def test_empty_table_and_clashing_columns(spark):
    assert s.op13(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "t" * 100, 5, 6, "x")], SCHEMA + ", at int, doc int, body string")
    assert [tuple(r)[:4] for r in s.op13(df).collect()] == [(1, 100, 0, 0)]
