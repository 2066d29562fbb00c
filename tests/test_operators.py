"""Chunker, topics, clusters, series and tables on small rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.functions import stats
from talkloom.operators import chunker, clusters, density, profile, series, terms, topics
from talkloom.sources import tables

DAY = dt.datetime(2025, 5, 1)


def messages(spark, texts, conv="c"):
    rows = [(conv, i, DAY + dt.timedelta(minutes=i), "user" if i % 2 == 0 else "bot", t, None, "message_level", "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "conversation_id string, message_id int, message_date timestamp, role string, original_text string, translated_text string, translation_granularity string, language string")


def words(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_chunker_windows(spark):
    texts = [words(6, "a"), "thanks!", words(6, "b"), words(4, "c"), "I'd be happy to look at it for you", "x", words(30, "d"), words(3, "e")]
    got = sorted(((r.chunk_seq, r.message_start_idx, r.message_end_idx, r.num_messages) for r in chunker.chunk(messages(spark, texts), 10, 16).collect()))
    assert got == [(0, 0, 3, 3), (1, 3, 6, 2), (2, 6, 7, 2)]


def test_chunker_matches_plain_loop(spark):
    rng = np.random.default_rng(1)
    texts = [words(int(n), f"m{i}_") for i, n in enumerate(rng.integers(2, 40, 30))]
    want, lo, size = [], 0, 0
    tokens = [len(t.split()) for t in texts]
    for i, n in enumerate(tokens):
        if size + n > 60 and size >= 25:
            want.append((lo, i - 1))
            lo, size = i - 1, tokens[i - 1]
        size += n
    want.append((lo, len(texts) - 1))
    got = sorted((r.message_start_idx, r.message_end_idx) for r in chunker.chunk(messages(spark, texts), 25, 60).collect())
    assert got == sorted(want)
    assert chunker.semantic_spans(texts, tokens, lambda t: np.zeros(2), 25, 60, 0.5) == want


def test_semantic_chunks_split_at_a_change_of_topic(spark):
    enc = lambda t: np.array([t.count("cat"), t.count("dog")], float)
    got = chunker.chunk_with_encoder(messages(spark, ["cat cat cat cat", "cat cat cat cat", "dog dog dog", "dog dog dog dog"]), enc, 6, 100, 0.5)
    assert sorted((r.message_start_idx, r.message_end_idx) for r in got.collect()) == [(0, 1), (1, 3)]


def test_empty_chunker(spark):
    assert chunker.chunk(messages(spark, ["ok", "thanks"])).count() == 0


def test_topic_votes(spark):
    rows = [("tie", 2, True), ("tie", 1, True), ("half", 5, True), ("half", 5, True), ("half", 7, True), ("none", 3, False), ("noise", -1, False), *[("many", c, True) for c in (1, 1, 1, 1, 2, 2, 3, 4, 5)]]
    df = spark.createDataFrame(rows, "conversation_id string, cluster_id long, is_high_conf boolean").withColumn("is_noise", F.col("cluster_id") == -1)
    got = {r.conversation_id: (r.primary_topic, r.secondary_topics, r.topic_confidence, r.is_mixed_topic, r.is_noise) for r in topics.conversation_topics(df).collect()}
    assert got["tie"] == (1, "2", 0.5, True, False)
    assert got["half"] == (5, "7", 0.667, True, False)
    assert got["none"] == (-1, "", 0.0, True, False) and got["noise"] == (-1, "", 0.0, True, True)
    assert got["many"] == (1, "2,3,4", 0.444, True, False)


def blobs(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(0, 0.05, 3) + np.eye(3)[i % 3]], i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster_id long"), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def test_validity_against_numpy(spark):
    df, x, y = blobs(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    s = []
    for i in range(len(x)):
        a = d[i][(y == y[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d[i][y == c].mean() for c in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    assert clusters.silhouette(df).first().silhouette == pytest.approx(np.mean(s), abs=1e-5)
    c = np.array([x[y == k].mean(0) for k in range(3)])
    within = sum(((x[y == k] - c[k]) ** 2).sum() for k in range(3))
    between = sum((y == k).sum() * ((c[k] - x.mean(0)) ** 2).sum() for k in range(3))
    assert clusters.calinski_harabasz(df).first()[0] == pytest.approx(between / 2 / (within / (len(x) - 3)), rel=1e-5)
    for r in clusters.cohesion(df).collect():
        own = u[y == r.cluster_id]
        n = len(own)
        assert r.mean_cosine == pytest.approx((own @ own.T).sum() / (n * (n - 1)) - 1 / (n - 1), abs=1e-5)


def test_agreement(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) + 5) for i in range(30)], "a int, b int")
    assert clusters.agreement(same, "a", "b").first()[:2] == (1.0, 1.0)


def test_merges(spark):
    df, _, _ = blobs(spark)
    assert clusters.merge_by_links(df, 0.99) == {0: 0, 1: 1, 2: 2}
    assert clusters.merge_by_links(df, -0.5 + 0.4) == {0: 0, 1: 1, 2: 2}  # thresholds of 0 or less do nothing
    near = df.withColumn("cluster_id", F.when(F.col("vec_id") == 0, 9).otherwise(F.col("cluster_id")).cast("long"))
    assert clusters.merge_by_links(near, 0.9) == {0: 0, 1: 1, 2: 2, 9: 0}
    assert clusters.merge_by_average(near, 0.9) == {0: 0, 1: 1, 2: 2, 9: 0}
    assert clusters.merge_by_average(df, -1.0) == {0: 0, 1: 0, 2: 0}


def test_t_distribution():
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_two_sided(0, 5) == pytest.approx(1)
    assert stats.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)


def test_trend_labels(spark):
    rows = [(k, dt.date(2025, 1, 1) + dt.timedelta(days=7 * i), f(i)) for k, f in [("up", lambda i: 3.0 * i + i % 2), ("down", lambda i: 90 - 3.0 * i + i % 2), ("flat", lambda i: 5.0 + i % 2)] for i in range(20)]
    got = {r.key: r.trend for r in series.trend_labels(spark.createDataFrame(rows, "key string, ds date, y double")).collect()}
    assert got == {"up": "growing ↑", "down": "declining ↓", "flat": "stable →"}


def test_measures_and_tests_guard(spark):
    rows = [("a", 0, 0.0, 1.0, 2.0, None), ("a", 1, 0.0, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "key string, idx int, y double, p double, o double, scale double")
    m = series.measures(df, ["key"], "p").first()
    assert (m.mae, m.mape, m.mase, m.r2) == (1.0, None, None, None)
    assert series.diebold_mariano(df, ["key"], "p", "o").first().dm is None


def test_holt_winters():
    y = np.tile([1, 2, 3, 4, 5, 6, 7.0], 8) + np.arange(56) * 0.5
    f = series.holt_winters(y, 7, 7)
    assert np.abs(f - (np.array([1, 2, 3, 4, 5, 6, 7]) + np.arange(56, 63) * 0.5)).max() < 1.0
    assert (series.holt_winters(np.array([5.0, 3, 1]), 5) >= 0).all() and len(series.holt_winters(np.array([2.0]), 3)) == 3


def test_short_series_has_no_fold(spark):
    df = spark.createDataFrame([("a", dt.date(2025, 1, 1), 1.0)], "key string, ds date, y double")
    assert series.folds(df, 8, 1, 1).count() == 0


def test_wilson_reference(spark):
    from talkloom.operators.failure import failure_by_language

    df = spark.createDataFrame([("en", i < 10) for i in range(50)] + [("fr", False)] * 3 + [("de", True)] * 6, "detected_language string, is_any_failure boolean")
    got = {r.detected_language: r for r in failure_by_language(df).collect()}
    assert set(got) == {"en", "de"} and got["de"].ci_low_pct is None
    assert (got["en"].ci_low_pct, got["en"].ci_high_pct) == (pytest.approx(11.244, abs=2e-3), pytest.approx(33.036, abs=2e-3))


def test_validator(spark):
    head = "### Theme\n{0}\n### Failure diagnosis\n{1}\n### Evidence quotes\n{2}\n"
    rows = [(i, 10, 0.2, 20.0, False, head.format(*x)) for i, x in enumerate([("Various things", "none", "x"), ("DNS", "about 25% fail", '"a"'), ("DNS", "45 % fail", ""), ("DNS", "only 3%", "")])] + [(9, 10, 0.2, 20.0, False, "no heading")]
    df = spark.createDataFrame(rows, "cluster_id int, n_conversations int, failure_risk_proxy double, headline_failure_rate_pct double, is_routing_cluster boolean, cluster_description string")
    got = {r.cluster_id: (r.accuracy_flag, r.has_quotes, r.theme_is_vague) for r in profile.validated(df).collect()}
    assert got == {0: ("NO NUMBER CITED", False, True), 1: ("ACCURATE", True, False), 2: ("OVERSTATED", False, False), 3: ("UNDERSTATED", False, False), 9: ("NO NUMBER CITED", None, None)}


def test_strata_are_all_reached(spark):
    from talkloom.plans.fixed import FAILURE_TYPES, STRATA

    kinds = [*FAILURE_TYPES, None, "something else"]
    got = {r[0] for r in spark.createDataFrame([(k,) for k in kinds], "k string").select(profile.stratum(F.col("k"))).collect()}
    assert got == set(STRATA)


def test_terms(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, "red pear"), (3, "green pear pear")], "d int, t string")
    w = {(r.d, r.term): r.weight for r in terms.tf_idf(df, "d", "t", 1, 100).collect()}
    assert sum(v * v for (d, _), v in w.items() if d == 3) == pytest.approx(1)
    assert (3, "green pear") in w and (3, "pear pear") in w


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    df.write.parquet(path)
    tables.replace_table(spark.read.parquet(path).withColumn("v", F.upper("v")), path)
    assert sorted(spark.read.parquet(path).collect()) == [(1, "A"), (2, "B")]
    swapped = f"file://{tmp_path}/swapped"
    tables.swap_table(df, swapped)
    begun = tables.current_table(spark, swapped)
    for _ in range(3):
        before = tables.current_table(spark, swapped)
        tables.swap_table(before.withColumn("k", F.col("k") + 1), swapped)
    assert sorted(tables.current_table(spark, swapped).collect()) == [(4, "a"), (5, "b")]
    assert sorted(before.collect()) == [(3, "a"), (4, "b")]  # the version before is still there, older ones aren't
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        begun.collect()
    merged = tables.merge_update(df, spark.createDataFrame([(2, None)], "k int, v string"), ["k"], ["v"])
    assert sorted(merged.collect()) == [(1, "a"), (2, None)]
    up = tables.upsert(df, spark.createDataFrame([(2, "z", 1.0), (3, "c", 2.0)], "k int, v string, w double"), ["k"])
    assert sorted(up.collect()) == [(1, "a", None), (2, "z", 1.0), (3, "c", 2.0)]
    assert tables.fingerprint({"a": 1, "b": 2}) == tables.fingerprint({"b": 2, "a": 1}) and len(tables.fingerprint({})) == 10
    parts = f"file://{tmp_path}/p"
    for v in ("x", "y"):
        tables.replace_partitions(spark.createDataFrame([(1, v)], "k int, v string").withColumn("track", F.lit("m")), parts, "track")
    assert [r.v for r in spark.read.parquet(parts).collect()] == ["y"]
    calls = []

    def make():
        calls.append(1)
        return spark.read.parquet(path)

    for _ in range(2):
        tables.cached(spark, make, path, f"file://{tmp_path}/cache", {"a": 1}).collect()
    assert len(calls) == 1
    tables.append_table(df, path)
    tables.cached(spark, make, path, f"file://{tmp_path}/cache", {"a": 1}).collect()
    assert len(calls) == 2
    assert tables.read_or(spark, f"file://{tmp_path}/none", "k int", [(7,)]).first().k == 7
    tables.write_csv(df, f"file://{tmp_path}/csv")
    assert sorted(tables.read_csv(spark, f"file://{tmp_path}/csv", "k int, v string").collect()) == [(1, "a"), (2, "b")]


def test_plugins(spark):
    from talkloom.plugins import HashedNgramEmbedder, MarkingTranslator, TemplateGenerator

    df = spark.createDataFrame([("hello world",), (None,)], "t string")
    got = HashedNgramEmbedder(16).embed(df, "t", "v", "s").collect()
    assert np.linalg.norm(got[0].v) == pytest.approx(1, abs=1e-5) and got[1].s == "no text"
    assert MarkingTranslator().translate(df, "t", "r", "s").first().r == "[en] hello world"
    assert "### Theme" in TemplateGenerator().generate(df, "t", "r", "s").first().r


def test_streams(spark, tmp_path):
    from talkloom.streaming import events

    (tmp_path / "in").mkdir()
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.write.mode("overwrite").parquet(f"{tmp_path}/in/e")
    stream = events.daily_counts(events.read_events(spark, f"{tmp_path}/in/e"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == batch.count()


def test_window_topics_keep_windows_inside_a_document(spark):
    """No table of windows times topics is shuffled: one row a document goes in and out of the sums."""
    from talkloom.operators import terms

    rows = [(i, " ".join(f"w{(i * 7 + j) % 23}" for j in range(i % 9)), i % 3 - 1) for i in range(60)]
    found = terms.window_topics(spark.createDataFrame(rows, "doc int, text string, topic int"), "doc", "text", "topic")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "win" not in plan.replace("_window", "").replace("Window", "").replace("window", "")
    shares: dict = {}
    for r in found.collect():
        shares.setdefault(r.doc, []).append(r.share)
    assert shares and all(abs(sum(s) - 1) < 1e-6 for s in shares.values())


def test_byte_pairs_are_counted_once(spark):
    from talkloom.functions.tokens import token_count

    df = spark.createDataFrame([("a b c",), ("d",)], "text string").withColumn("n", token_count(F.col("text"))).where("n >= 2")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
