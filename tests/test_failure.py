"""Signals, types and tiers on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talkloom.functions.semantics import week_start
from talkloom.operators import docs as docs_op
from talkloom.operators import failure
from talkloom.plans.fixed import FAILURE_TYPES

FLAGS = "conversation_id string, rating_score int, was_escalated_to_agent boolean, is_repetition_loop boolean, is_agent_request_unserved boolean, conversation_text_length long, client_message_count long"
ROWS = [
    ("a", -1, False, True, False, 90, 2, "explicit_negative_bot"),
    ("b", -1, True, False, False, 90, 2, "explicit_negative_escalated"),
    ("c", 0, False, True, True, 90, 2, "repetition_loop"),
    ("d", 0, False, False, True, 90, 2, "agent_request_unserved"),
    ("e", 0, True, False, False, 5, 1, "escalated_no_feedback"),
    ("f", 0, False, False, False, 30, 3, "abandoned_inquiry"),
    ("g", 1, False, True, True, 30, 3, "resolved_positive"),
    ("h", 0, False, False, False, 29, 3, "trivial_noise"),
    ("i", 0, False, False, False, 30, 4, "resolved_or_unknown"),
]


@pytest.fixture(scope="module")
def flags(spark):
    return failure.failure_flags(spark.createDataFrame([r[:-1] for r in ROWS], FLAGS)).collect()


def test_every_type_and_precedence(flags):
    assert {r.conversation_id: r.failure_type for r in flags} == {r[0]: r[-1] for r in ROWS}
    assert {r[-1] for r in ROWS} == set(FAILURE_TYPES)


def test_tiers_are_disjoint(flags):
    for r in flags:
        assert not (r.is_confirmed_failure and r.is_probable_failure)
        assert r.is_any_failure == (r.is_confirmed_failure or r.is_probable_failure)
        assert not (r.is_suspected_failure and r.is_probable_failure)


def test_repetition(spark):
    d = dt.datetime(2025, 5, 1)
    msgs = [("x", t, d + dt.timedelta(minutes=i)) for i, t in enumerate(["hello", "hello", "  ", "the printer is broken", "the printer is br0ken!", "the printer is working"])]
    msgs += [("one", "only one message", d), ("acc", "où est ma facture", d), ("acc", "ou est ma facture", d + dt.timedelta(minutes=1))]
    df = spark.createDataFrame(msgs, "conversation_id string, content string, message_date timestamp").withColumn("agent_or_bot", F.lit("Client"))
    got = {r.conversation_id: (r.exact_repeat_pairs, r.near_repeat_pairs) for r in failure.repetition(df).collect()}
    assert got == {"x": (1, 1), "acc": (0, 1)}


@pytest.mark.parametrize("text,want", [
    ("please talk to an agent", True), ("talk_to-agent now", True), ("can I speak with a human", True), ("connect me to support", True), ("I need an operator", True), ("i want a real person", True),
    ("live chat?", True), ("human help", True), ("a real person", True), ("need agents", False), ("éneed agent", True), ("agenda", False), (None, False),
])
def test_agent_request(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(failure.requests_agent(F.col("t"))).first()[0] is want


def test_week_starts(spark):
    days = [dt.date(2025, 5, 24), dt.date(2025, 5, 25), dt.date(2025, 5, 26)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select(week_start(F.col("d")), week_start(F.col("d"), "monday")).collect()
    assert [tuple(r) for r in got] == [(dt.date(2025, 5, 18), dt.date(2025, 5, 19)), (dt.date(2025, 5, 25), dt.date(2025, 5, 19)), (dt.date(2025, 5, 25), dt.date(2025, 5, 26))]


def test_entities_in_order(spark):
    raw = "&amp;lt;b&gt; &amp;#39; &quot;x&quot; a&nbsp;b &hellip; &copy;&reg; &ndash;&mdash; c\t\n d "
    got = spark.createDataFrame([(raw,)], "t string").select(docs_op.clean(F.col("t"))).first()[0]
    assert got == "<b> &#39; \"x\" a b ... (c)(R) -- c d"


def test_stop_words(spark):
    got = spark.createDataFrame([("The  printer IS not very good",), ("the a",)], "t string").select(docs_op.remove_stop_words(F.col("t"))).collect()
    assert [r[0] for r in got] == ["printer not good", None]


def test_routing_and_risk(spark):
    from talkloom.operators.profile import with_risk

    df = spark.createDataFrame([(100, 96, 4, 2.0, 95.0, 10), (100, 96, 5, 50.0, 95.0, 0)], "n_conversations int, escalated_count int, headline_failures int, chunk_headline_failure_rate_pct double, chunk_escalation_rate_pct double, abandoned_inquiry int")
    got = [(r.failure_risk_proxy, r.is_routing_cluster) for r in with_risk(df).collect()]
    assert got == [(0.121, True), (0.495, False)]
