"""Mixing sources to target weights by Poisson replication.

Each document's copies are a Poisson draw with mean target repetition rate of its source, by inverting the distribution
at a uniform number hashed from seed and doc_id: the draw doesn't depend on partitions, retries or other documents. Rows
are exploded by their count and dealt out by a hash of (seed, doc_id, copy), then sorted by it within partitions.

Rates: source s with n_s documents and weight w_s (default: n_s ** ``TEMPERATURE``) gets ``EPOCHS`` * N * w_s / (sum of
w) / n_s copies per document in the mean. Only one row per source is aggregated and joined back, by
sending it along where there are up to ``SENT_SOURCES``, so texts are shuffled once, to their places in the mix.

Defined cases: a null source is a source of its own; rows without doc_id draw as doc_id '' ; repeated rows draw the same
number each; an empty table gives an empty mix. Rates are drawn however high, of given weights as of default ones, unless
``max_rate`` is given: a source above it is then an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.rows import ROW, packed, unpacked
from talkloom.sources.scratch import cut

SEED = 17
EPOCHS = 1.0
TEMPERATURE = 0.5
#: Rates of up to so many are drawn by adding up the terms from 0; of more, by their logarithms.
DIRECT, NEAR = 100.0, 50
#: Rates of up to so many sources are sent to all executors; more are joined by source.
SENT_SOURCES = 100_000
#: 13 hex digits are 52 bits, exact in a double.
DIGITS = 13


def uniform(tag: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(tag), *parts)), 1, DIGITS), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """The smallest k with P(X <= k) > u, for X of mean ``rate``."""
    return F.when(rate <= DIRECT, _summed(rate, u)).otherwise(_summed_in_logs(rate, u))


def _summed_in_logs(rate: Column, u: Column) -> Column:
    """The same where exp(-rate) may be 0: terms by their logarithms, from 12 standard deviations below the mean."""
    first = F.greatest(F.lit(0), F.floor(rate - 12 * F.sqrt(rate) - 30)).cast("long")
    # log k! by Stirling's series, from where its rest is below a double's digits
    x = first + F.lit(1.0)
    far = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    near = F.aggregate(F.sequence(F.lit(1), F.least(first, F.lit(NEAR)).cast("int") + 1), F.lit(0.0), lambda acc, i: acc + F.when(i <= first, F.log(i.cast("double"))).otherwise(F.lit(0.0)))
    log_p = first * F.log(rate) - rate - F.when(first <= NEAR, near).otherwise(far)
    start = F.struct(log_p.alias("p"), F.exp(log_p).alias("c"), first.alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] + F.log(rate / i)
        return F.when(acc["c"] > u, acc).otherwise(F.struct(p.alias("p"), (acc["c"] + F.exp(p)).alias("c"), i.alias("k")))

    terms = F.sequence(first + 1, F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long"))
    return F.aggregate(terms, start, step, lambda acc: acc["k"]).cast("int")


def _summed(rate: Column, u: Column) -> Column:
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        return F.when(acc["c"] > u, acc).otherwise(F.struct(p.alias("p"), (acc["c"] + p).alias("c"), i.alias("k")))

    # as many terms as the rate can need: beyond rate + 12 * sqrt(rate) + 30 the tail is below 2 ** -60
    terms = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    return F.aggregate(terms, start, step, lambda acc: acc["k"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate); ``weights`` (source, weight) or n ** temperature."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        w = n.join(weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("w")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["w"])
    # a correction of the last digits, so that rates don't hang on the order of a floating-point sum
    total = w.agg(F.sum("n").alias("n_all"), F.round(F.sum("w"), 6).alias("w_all"))
    rate = F.lit(epochs) * F.col("n_all") * F.col("w") / F.col("w_all") / F.col("n")
    return w.crossJoin(F.broadcast(total)).select("source", F.round(rate, 9).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED, epochs: float = EPOCHS, temperature: float = TEMPERATURE, max_rate: float | None = None) -> DataFrame:
    """``docs`` replicated and globally shuffled, with ``mix_copy`` (from 0) and ``mix_order`` (the shuffle key)."""
    rates = source_rates(docs, weights, epochs, temperature).select(F.col("source").alias("_s"), "rate")
    if max_rate is not None:
        over = F.raise_error(F.concat(F.lit(f"repetition rate over {max_rate} for source "), F.coalesce("_s", F.lit("null"))))
        rates = rates.withColumn("rate", F.when(F.col("rate") > max_rate, over).otherwise(F.col("rate")))
    rates = cut(rates, "mixing-rates")
    if rates.count() <= SENT_SOURCES:
        rates = F.broadcast(rates)
    rows = packed(docs, _of=F.col("source"), _name=F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    joined = rows.join(rates, F.col("_of").eqNullSafe(F.col("_s")))
    copies = poisson(F.col("rate"), uniform(f"{seed}:n", F.col("_name")))
    out = joined.withColumn("_n", copies).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    out = out.withColumn("_order", F.md5(F.concat_ws(":", F.lit(f"{seed}:o"), F.col("_name"), F.col("_copy").cast("string"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = out.select(ROW, "_copy", "_order").repartition(parts, "_order").sortWithinPartitions("_order")
    return unpacked(dealt, docs, mix_copy=F.col("_copy").cast("long"), mix_order=F.col("_order"))


def op9(docs: DataFrame) -> DataFrame:
    """The whole mix of ``documents``: its columns, mix_copy and mix_order."""
    return mix(docs)


def mix_sql(docs: str = "documents", columns: str = "d.doc_id, d.text, d.lang, d.source, d.n_chars") -> str:
    """DuckDB's equal of ``mix``: the draw is a count of cumulative probabilities at or below u."""
    u = f"('0x' || substr(md5('{SEED}:n:' || coalesce(d.doc_id::VARCHAR, '')), 1, {DIGITS}))::BIGINT / {float(1 << 52)}"
    return f"""
n AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, {TEMPERATURE}) AS w FROM n),
t AS (SELECT sum(n) AS n_all, round(sum(w), 6) AS w_all FROM w),
rates AS (SELECT source, round({EPOCHS} * n_all * w / w_all / n, 9) AS rate FROM w, t),
most AS (SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 30)::BIGINT AS m FROM rates),
terms AS (SELECT source, rate, k, CASE WHEN rate = 0 THEN (k = 0)::INT ELSE exp(k * ln(CASE WHEN rate > 0 THEN rate ELSE 1 END) - rate - lgamma(k + 1)) END AS p FROM rates, (SELECT unnest(range(0, m)) AS k FROM most)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT {columns}, {u} AS u FROM {docs} d),
counted AS (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS copies FROM drawn d),
exploded AS (SELECT *, unnest(range(0, copies)) AS mix_copy FROM counted)
SELECT * EXCLUDE (u, copies), md5('{SEED}:o:' || coalesce(doc_id::VARCHAR, '') || ':' || mix_copy::VARCHAR) AS mix_order FROM exploded
"""


OP9_SQL = "WITH " + mix_sql()
