"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def unit(a: Column, least: float = 1e-10) -> Column:
    """``a`` at length 1; divided by ``least`` if it is shorter than that."""
    return scale(a, 1 / F.greatest(norm(a), F.lit(least)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 1 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n < 1e-9, 1.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def mean_vectors(df: DataFrame, by: list[str], vector: str, into: str = "centroid", digits: int | None = None) -> DataFrame:
    """The mean vector of each group: summed by dimension before the shuffle, and put together after it."""
    long = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    m = F.col("_m") if digits is None else F.round("_m", digits)
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", m.alias("m")))), lambda s: s["m"]).alias(into))
