"""The topics of a conversation by the votes of its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECONDARY = 3


def conversation_topics(chunks: DataFrame) -> DataFrame:
    """Sure chunks vote: the most frequent cluster is primary, up to three more are secondary; ties go to the lower number.

    Confidence is the primary's share of sure chunks; mixed if the second has half as many as the first. Without sure
    chunks: topic -1, confidence 0, mixed, and noise if all chunks are noise.
    """
    votes = chunks.groupBy("conversation_id", "cluster_id").agg(F.count("*").alias("n"), F.count_if("is_high_conf").alias("sure"), F.count_if("is_noise").alias("noise"))
    one = F.when(F.col("sure") > 0, F.struct((-F.col("sure")).alias("less"), "cluster_id"))
    each = votes.groupBy("conversation_id").agg(F.array_sort(F.collect_list(one)).alias("v"), F.sum("n").alias("n_chunks"), F.sum("sure").alias("n_high_conf_chunks"), F.sum("noise").alias("n_noise_chunks"))
    v, none = F.col("v"), F.size("v") == 0
    first, second = -F.get(v, F.lit(0))["less"], -F.get(v, F.lit(1))["less"]
    others = F.transform(F.slice(v, 2, SECONDARY), lambda x: x["cluster_id"].cast("string"))
    return each.select(
        "conversation_id",
        F.coalesce(F.get(v, F.lit(0))["cluster_id"], F.lit(-1)).alias("primary_topic"),
        F.array_join(others, ",").alias("secondary_topics"),
        "n_chunks", "n_high_conf_chunks", "n_noise_chunks",
        F.when(none, 0.0).otherwise(F.round(first / F.nullif(F.col("n_high_conf_chunks"), F.lit(0)), 3)).alias("topic_confidence"),
        F.when(none, True).otherwise(F.coalesce(second * 2 >= first, F.lit(False))).alias("is_mixed_topic"),
        (none & (F.col("n_noise_chunks") == F.col("n_chunks"))).alias("is_noise"),
    )
