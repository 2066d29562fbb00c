"""The registered queries, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from talkloom.operators import docs as docs_op
from talkloom.operators import failure, profile, topics
from talkloom.plans import base
from talkloom.plans.oracle import assemble
from talkloom.sources.scratch import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Relations:
    """The domain's relations over the tables of one folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def messages(self):
        return base.messages_raw(self.spark, self.dir)

    @cached_property
    def cache(self):
        return base.translation_cache(self.spark, self.dir)

    @cached_property
    def docs(self):
        return docs_op.conversation_docs(self.messages, self.cache, base.languages(self.spark, self.dir))

    @cached_property
    def log(self):
        return docs_op.translation_log(self.docs, self.cache)

    @cached_property
    def signals(self):
        return failure.failure_signals(self.docs, self.messages)

    @cached_property
    def flags(self):
        return failure.failure_flags(self.signals)

    @cached_property
    def chunks(self):
        return base.chunk_labels(self.spark, self.dir)

    @cached_property
    def topics(self):
        return topics.conversation_topics(self.chunks)

    @cached_property
    def labels(self):
        return base.cluster_labels(self.spark, self.dir)

    @cached_property
    def by_cluster(self):
        return failure.failure_by_chunk_cluster(self.chunks, self.flags)

    @cached_property
    def profile(self):
        return profile.cluster_profile(self.chunks, self.flags)

    @cached_property
    def descriptions(self):
        return profile.describe(self.profile, base.CannedGenerator())


def query(name: str, sql: str | None = None):
    """Registers f(relations) -> DataFrame; ``sql`` names relations of the oracle module freely."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if sql is not None:
            SQL[name] = assemble(sql)
        return f

    return add
