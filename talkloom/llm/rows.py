"""Whole rows kept aside as one column, so that no column of theirs can clash with those an operator adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` as one struct column, beside columns made from it."""
    return df.select(F.struct("*").alias(ROW), *[c.alias(k) for k, c in more.items()])


def unpacked(df: DataFrame, like: DataFrame, **more: Column) -> DataFrame:
    """The columns of ``like`` from the struct, with those of ``more`` in their place or after them."""
    own = [more.pop(c).alias(c) if c in more else F.col(ROW).getField(c).alias(c) for c in like.columns]
    return df.select(*own, *[c.alias(k) for k, c in more.items()])
