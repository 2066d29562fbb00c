"""Scores don't hang on partitions, and a model of several shares learns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import lbl


@pytest.fixture(scope="module")
def docs():
    r = np.random.default_rng(2)
    after = {w: r.choice(40, 3, replace=False) for w in range(40)}
    rows = []
    for i in range(300):
        w, words = int(r.integers(40)), []
        for _ in range(60):
            words.append(f"w{w}")
            w = int(r.choice(after[w]))
        rows.append((i, " ".join(words)))
    return rows


def test_scores_are_the_same_for_any_partitions(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in (1, 7, 50):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append({r.doc_id: (r.score, r.base_score) for r in lbl.op5(df.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    for other in got[1:]:
        assert max(abs(other[k][0] - got[0][k][0]) for k in got[0]) < 1e-6 * 60
        assert max(abs(other[k][1] - got[0][k][1]) for k in got[0]) < 1e-9 * 60


def test_the_chain_is_learnt(spark, docs):
    r = lbl.op5(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.sum("n_tokens").alias("n")).first()
    # three equally likely followers of forty words: log10(3) against log10(40)
    assert r.base / r.n < -1.4 and r.score / r.n > r.base / r.n + 0.7


def test_shares_hold_all_triples_once(spark):
    rows = [(int(c), int(c) % 7 + 1) for c in range(0, 5000, 3)]
    table = lbl.shares(spark.createDataFrame(rows, "cell long, n long").repartition(9), 300).collect()
    assert len(table) == 6
    back = [(int(c), int(n)) for t in table for c, n in zip(np.frombuffer(t.cell, np.uint32), np.frombuffer(t.n, np.int64), strict=True)]
    assert sorted(back) == rows
