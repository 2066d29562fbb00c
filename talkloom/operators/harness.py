"""Comparisons of settings: stability over seeds, embedders side by side, and outliers given to their nearest topic."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators import clusters, density, neighbours, terms
from talkloom.sources.scratch import cut


def stability(df: DataFrame, k: int, seeds: list[int], uid: str = "vec_id") -> DataFrame:
    """(seed_a, seed_b, ari, nmi) of clusterings of the same rows under different seeds."""
    runs = None
    for s in seeds:
        one = density.k_means(df, k, [s]).select(uid, F.col("cluster").alias(f"s{s}"))
        runs = one if runs is None else runs.join(one, uid)
    out = None
    for i, a in enumerate(seeds):
        for b in seeds[i + 1 :]:
            pair = clusters.agreement(runs, f"s{a}", f"s{b}").select(F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), "ari", "nmi")
            out = pair if out is None else out.unionByName(pair)
    return out


def compare_embedders(texts: DataFrame, embedders: list, uid: str, text: str, k: int = 5) -> DataFrame:
    """A row per embedder: dimensions, seconds to encode, and silhouette of its own clusters."""
    rows = []
    for e in embedders:
        began = time.time()
        made = e.embed(texts.select(uid, text), text, "embedding", "status").where("status = ''").select(uid, "embedding").persist()
        n = made.count()
        took = time.time() - began
        grouped = density.k_means(made, k, [1]).withColumnRenamed("cluster", "cluster_id").withColumn("cluster_id", F.col("cluster_id").cast("long"))
        s = clusters.silhouette(grouped, uid).first().silhouette if n > k else None
        rows.append((e.name, e.dim, n, round(took, 3), s))
        made.unpersist()
    return texts.sparkSession.createDataFrame(rows, "model string, dim int, n long, encode_s double, silhouette double")


def reduce_outliers(df: DataFrame, least: float, strategy: str = "centroid", uid: str = "vec_id") -> DataFrame:
    """Noise rows given to a cluster if they are ``least`` alike: to the nearest centre, or to that of the nearest row
    (``neighbour``); by term weights, use the vectors of terms as embeddings. Others stay noise."""
    noise, real = df.where("cluster_id = -1"), df.where("cluster_id != -1")
    if strategy == "centroid":
        best = density.nearest_centre(noise, clusters.centroids(df), uid).withColumnRenamed("cluster_id", "_new")
    elif strategy == "neighbour":
        ix = neighbours.build(cut(neighbours.prepared(real, uid, "embedding", "cluster_id"), "outlier-rows"))
        if ix is None:
            return df
        near = neighbours.nearest(ix, neighbours.prepared(noise, uid, "embedding", "cluster_id"), 1)
        best = near.join(real.select(F.col(uid).alias("other"), F.col("cluster_id").alias("_new")), "other").select(F.col("anchor").alias(uid), "_new", (-F.col("value")).alias("cosine"))
    else:
        raise ValueError(f"no strategy {strategy}")
    given = noise.join(best, uid, "left").withColumn("cluster_id", F.when(F.col("cosine") >= least, F.col("_new")).otherwise(F.lit(-1)).cast("long"))
    return real.unionByName(given.select(*df.columns))


def reduce_by_distribution(df: DataFrame, least: float, uid: str, text: str, cluster: str = "cluster_id") -> DataFrame:
    """(uid, cluster) with noise rows given to the topic that their windows of words share most, if that is ``least`` or more; of equal
    ones to the smaller number."""
    shares = terms.window_topics(df, uid, text, cluster)
    best = shares.groupBy(uid).agg(F.max(F.struct("share", (-F.col("topic")).alias("less"))).alias("b"))
    given = (F.col(cluster) == -1) & (F.col("b.share") >= least)
    return df.select(uid, cluster).join(best, uid, "left").select(uid, F.when(given, -F.col("b.less")).otherwise(F.col(cluster)).alias(cluster))


def perplexities(df: DataFrame, uid: str = "vec_id", k: int = 5) -> DataFrame:
    """(anchor, other, p): each row's nearest rows of any cluster weighted by a softmax of cosine, the graph of its neighbourhood."""
    own = df.select(uid, F.col(uid).alias("cluster_id"), "embedding")  # every row a cluster of its own, so all others count
    near = clusters.hard_negatives(own, uid, k)
    w = F.exp("cosine")
    return near.select("anchor", "other", F.round(w / F.sum(w).over(Window.partitionBy("anchor")), 6).alias("p"))
