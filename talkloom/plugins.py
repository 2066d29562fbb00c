"""Interfaces to outside models, with deterministic offline defaults.

Each takes rows and adds a result and a status column; a status of '' means success. The defaults stand in for models that
are not available offline and claim nothing about language.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions.hashed import hash_tokens


class Translator(Protocol):
    def translate(self, df: DataFrame, text: str, result: str, status: str) -> DataFrame: ...


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, df: DataFrame, text: str, result: str, status: str) -> DataFrame: ...


class TextGenerator(Protocol):
    def generate(self, df: DataFrame, prompt: str, result: str, status: str) -> DataFrame: ...


class MarkingTranslator:
    """Marks a text as translated."""

    def translate(self, df, text, result, status):
        return df.withColumn(result, F.concat(F.lit("[en] "), F.col(text))).withColumn(status, F.lit(""))


class HashedNgramEmbedder:
    """Unit vectors of hashed words and word pairs; no semantics."""

    def __init__(self, dim: int = 384):
        self.name, self.dim = f"hashed-ngrams-{dim}", dim

    def embed(self, df, text, result, status):
        dim = self.dim

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def vector(texts: pd.Series) -> pd.Series:
            return pd.Series([hash_tokens(t, dim) if isinstance(t, str) else None for t in texts], dtype=object)

        return df.withColumn(result, vector(F.col(text))).withColumn(status, F.when(F.col(text).isNull(), "no text").otherwise(""))


class TemplateGenerator:
    """The four sections that a description has, filled from nothing but the prompt's length."""

    def generate(self, df, prompt, result, status):
        n = F.length(prompt).cast("string")
        text = F.concat(F.lit("### Theme\nTopic of a prompt of "), n, F.lit(" characters\n### Failure diagnosis\nAbout 10% fail\n### Suggested action\nReview it\n### Evidence quotes\n\"quote\"\n"))
        return df.withColumn(result, F.when(F.col(prompt).isNotNull(), text)).withColumn(status, F.when(F.col(prompt).isNull(), "no prompt").otherwise(""))


REGISTRY = {"hashed-ngrams-384": HashedNgramEmbedder(384), "hashed-ngrams-64": HashedNgramEmbedder(64)}


def registered(spark: SparkSession) -> DataFrame:
    """The embedders at hand, in order of name."""
    rows = [(k, type(e).__name__, e.dim) for k, e in sorted(REGISTRY.items())]
    return spark.createDataFrame(rows, "model string, kind string, dim int")


def cosine_rows(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors; 1 if either is zero."""
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n else 1.0
