"""Layouts keep neighbours and don't hang on partitions; byte-pair counts equal plain merging."""

import base64
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.functions import tokens
from talkloom.operators import chunker, density, layout


def test_list_weights():
    d = np.array([[0.1, 0.3, 0.5, 0.9], [0.2, 0.2, np.nan, np.nan], [0.4, np.nan, np.nan, np.nan]])
    w = layout.list_weights(d)
    assert w[0, 0] == 1 and w[0].sum() == pytest.approx(2, abs=1e-6) and (np.diff(w[0]) < 0).all()
    assert w[1].tolist() == [1, 1, 0, 0] and w[2].tolist() == [1, 0, 0, 0]


def test_layout_keeps_neighbours_for_any_partitions(spark):
    r = np.random.default_rng(1)
    centres, y = r.normal(size=(20, 30)), r.integers(0, 20, 500)
    x = centres[y] + r.normal(size=(500, 30)) * 0.25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    at = lambda d: {p.vec_id: tuple(p.position) for p in d.collect()}
    one = at(layout.layout(df.repartition(1), rounds=2, share=200))
    assert len(one) == 500 and one == at(layout.layout(df.repartition(7), rounds=2, share=200)) == at(layout.layout(df.repartition(50), rounds=2, share=200))
    made = spark.createDataFrame([(k, list(v)) for k, v in one.items()], "vec_id long, position array<double>")
    flat = density.reduce_dims(df, 2).select("vec_id", F.col("embedding").alias("position"))
    assert layout.preservation(df, made).first().kept > layout.preservation(df, flat).first().kept + 0.05
    some = df.where("vec_id % 3 > 0")
    put = at(layout.placed(df, some, made.where("vec_id % 3 > 0")))
    assert set(put) == set(range(500))
    middle = np.array([np.mean([one[i] for i in np.flatnonzero(y == c) if i % 3], axis=0) for c in range(20)])
    near = [int(((middle - np.array(put[i])) ** 2).sum(1).argmin()) == y[i] for i in range(0, 500, 3)]
    assert np.mean(near) > 0.85


def test_places_are_added_over_single_numbers(monkeypatch):
    """As by rows, bit for bit, in several times less time."""
    r = np.random.default_rng(3)
    y, at, more = r.normal(size=(40, 10)), r.integers(0, 40, 3000), r.normal(size=(3000, 10))
    want = y.copy()
    np.add.at(want, at, more)
    layout._add(y, at, more)
    assert y.tobytes() == want.tobytes()


def test_tiny_layout(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r.position) for r in layout.layout(df).collect()] == [(0.0, 0.0)] * 2


def plain_tokens(text, ranks):
    n = 0
    for word in re.findall(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+", text):
        parts = [bytes([b]) for b in word.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        n += len(parts)
    return n


def test_token_counts(spark):
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    texts = ["", None, "It's the customer's 3rd refund, isn't it?  ", "Größe 漢字 émigré\n\n\tend", "<|endoftext|> x", "a" * 300, *[r.text[:800] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect() if r.text]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("n", tokens.token_count(F.col("t")))
    assert {r.i: r.n for r in df.collect()} == {i: plain_tokens(t, ranks) if t else 0 for i, t in enumerate(texts)}


def test_chunker_takes_a_counter(spark):
    m = spark.createDataFrame([("c", i, f"2025-01-0{i + 1}", "Client", f"word{i} " * 10, f"word{i} " * 10, "message_level", "en") for i in range(6)], "conversation_id string, message_id int, message_date string, role string, original_text string, translated_text string, translation_granularity string, language string")
    by_words, by_pairs = chunker.chunk(m, 5, 25).count(), chunker.chunk(m, 5, 25, tokens.token_count).count()
    assert by_words < by_pairs
