"""Corpus preparation as stages, each over all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkloom.llm import decontaminate, linededup, mixing, quality, simhash
from talkloom.sources.scratch import cut, drop_all, scope, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.with_deduped_text(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix)]

#: The classifier and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what only earlier ones needed is deleted as soon as a stage is written."""
    docs = table(spark, sf_dir, "documents")
    with scope():
        for name, stage in STAGES[:-1]:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            drop_all(spark, (docs,))
        return STAGES[-1][1](spark, docs, sf_dir)
