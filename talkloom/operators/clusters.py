"""Clusters of vectors: centres, merging, representatives, validity, agreement, sweeps and training pairs.

Pairwise steps work on centres (few) or go through an index; what runs over all vectors is linear in them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.vectors import dot, mean_vectors, scale, unit
from talkloom.operators import neighbours
from talkloom.sources.scratch import cut

DIGITS = 9


def centroids(df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """(cluster, centroid) of clusters other than noise."""
    return mean_vectors(df.where(F.col(cluster) != -1), [cluster], vector, digits=DIGITS)


def unit_centroids(df: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    return centroids(df, cluster, vector).withColumn("centroid", unit(F.col("centroid")))


def overlap(df: DataFrame) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of cluster centres."""
    c = unit_centroids(df)
    a, b = c.select(F.col("cluster_id").alias("a"), F.col("centroid").alias("va")), c.select(F.col("cluster_id").alias("b"), F.col("centroid").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("cosine"))


def representatives(df: DataFrame, uid: str = "chunk_uid", k: int = 3) -> DataFrame:
    """The ``k`` rows of each cluster nearest to its centre by cosine."""
    c = unit_centroids(df)
    near = df.join(c, "cluster_id").select("cluster_id", uid, F.round(dot(unit(F.col("embedding")), F.col("centroid")), 6).alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("cosine"), uid)).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def merge_by_links(df: DataFrame, threshold: float) -> dict[int, int]:
    """New number of each cluster: clusters whose centres are alike are joined, links of links too; roots are the lowest
    numbers, renumbered from 0. Nothing is renumbered if nothing is joined."""
    pairs = [(r.a, r.b) for r in overlap(df).where(F.col("cosine") >= threshold).collect()]
    ids = sorted(r[0] for r in df.where("cluster_id != -1").select("cluster_id").distinct().collect())
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    if threshold <= 0 or not pairs:
        return parent
    for a, b in sorted(pairs):
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    order = {r: i for i, r in enumerate(sorted({root(i) for i in ids}))}
    return {i: order[root(i)] for i in ids}


def merge_by_average(df: DataFrame, threshold: float = 0.85) -> dict[int, int]:
    """New number of each cluster by average linkage of centres, cut at a cosine distance of 1 - threshold."""
    rows = sorted((r.cluster_id, np.array(r.centroid)) for r in unit_centroids(df).collect())
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows])
    groups, d = [[i] for i in range(len(ids))], np.clip(1 - v @ v.T, 0, 2)
    while len(groups) > 1:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])), key=lambda x: (x[0], x[2], x[1]))
        if best[0] > 1 - threshold:
            break
        _, i, j = best
        groups[j] += groups.pop(i)
    return {ids[m]: n for n, g in enumerate(sorted(groups, key=min)) for m in g}


def relabel(df: DataFrame, numbers: dict[int, int], cluster: str = "cluster_id") -> DataFrame:
    """``cluster`` renumbered; noise stays."""
    pairs = [x for kv in sorted(numbers.items()) for x in (F.lit(kv[0]).cast("long"), F.lit(kv[1]).cast("long"))]
    return df.withColumn(cluster, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(cluster)), F.col(cluster))) if pairs else df


def soft_assign(df: DataFrame, least: float = 0.1, temperature: float = 0.1) -> DataFrame:
    """Noise rows given to their likeliest cluster by a softmax of cosines to centres, if that is ``least`` or more.

    An approximation of membership vectors, which need the fitted density model.
    """
    c = unit_centroids(df).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("cs"))
    noise = df.where("cluster_id = -1").crossJoin(F.broadcast(c))  # one row of few centres
    weights = F.transform("cs", lambda x: F.struct(F.exp(dot(unit(F.col("embedding")), x["centroid"]) / temperature).alias("w"), (-x["cluster_id"]).alias("less")))
    noise = noise.withColumn("_ws", weights).withColumn("_best", F.array_max("_ws")).withColumn("_p", F.col("_best.w") / F.aggregate("_ws", F.lit(0.0), lambda s, x: s + x["w"]))
    given = F.col("_p") >= least
    noise = noise.withColumn("cluster_id", F.when(given, -F.col("_best.less")).otherwise(F.lit(-1)).cast("long")).withColumn("soft_assigned", given)
    return df.where("cluster_id != -1").withColumn("soft_assigned", F.lit(False)).unionByName(noise.select(*df.columns, "soft_assigned"))


def noise_summary(df: DataFrame) -> DataFrame:
    """Length percentiles and spread of noise against the rest."""
    p = lambda x: F.round(F.percentile("chunk_char_count", F.lit(x)), 6)
    return df.groupBy("is_noise").agg(F.count("*").alias("n"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.75).alias("p75"), F.round(F.stddev_pop("umap_x"), 6).alias("spread_x"), F.round(F.stddev_pop("umap_y"), 6).alias("spread_y"))


def cohesion(df: DataFrame) -> DataFrame:
    """Mean cosine of the pairs of each cluster, without forming them: (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    u = df.where("cluster_id != -1").select("cluster_id", unit(F.col("embedding")).alias("u"))
    sums = mean_vectors(u, ["cluster_id"], "u", "m").join(u.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id")
    n = F.col("n").cast("double")
    total = dot(F.col("m"), F.col("m")) * n * n
    return sums.select("cluster_id", "n", F.round((total - n) / F.nullif(n * (n - 1), F.lit(0.0)), 6).alias("mean_cosine"))


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def davies_bouldin(df: DataFrame) -> DataFrame:
    """One row: the mean over clusters of the worst ratio of their spreads to the distance of their centres."""
    c = centroids(df)
    spread = df.join(c, "cluster_id").groupBy("cluster_id").agg(F.avg(F.sqrt(_square(F.col("embedding"), F.col("centroid")))).alias("s")).join(c, "cluster_id")
    a, b = (spread.select(*[F.col(x).alias(f"{x}_{k}") for x in ("cluster_id", "s", "centroid")]) for k in "ab")
    pairs = a.join(b, F.col("cluster_id_a") != F.col("cluster_id_b"))
    ratio = (F.col("s_a") + F.col("s_b")) / F.nullif(F.sqrt(_square(F.col("centroid_a"), F.col("centroid_b"))), F.lit(0.0))
    return pairs.groupBy("cluster_id_a").agg(F.max(ratio).alias("worst")).agg(F.round(F.avg("worst"), 6).alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """One row: dispersion between clusters over that within, each by its degrees of freedom."""
    real = df.where("cluster_id != -1")
    c = centroids(df)
    within = real.join(c, "cluster_id").agg(F.sum(_square(F.col("embedding"), F.col("centroid"))).alias("w"), F.count("*").alias("n"))
    middle = mean_vectors(real.withColumn("_all", F.lit(0)), ["_all"], "embedding", "middle", DIGITS).drop("_all")
    sizes = real.groupBy("cluster_id").agg(F.count("*").alias("k"))
    between = c.join(sizes, "cluster_id").crossJoin(F.broadcast(middle)).agg(F.sum(F.col("k") * _square(F.col("centroid"), F.col("middle"))).alias("b"), F.count("*").alias("g"))
    value = F.col("b") / (F.col("g") - 1) / (F.col("w") / (F.col("n") - F.col("g")))
    return within.crossJoin(between).select(F.round(value, 4).alias("calinski_harabasz"))


def silhouette(df: DataFrame, uid: str = "vec_id", many: int = 512) -> DataFrame:
    """One row: mean silhouette by cosine distance over all clustered rows.

    The mean distance of a row to a cluster follows from the sum of the cluster's unit vectors, so one aggregation and one pass
    over the rows do, without pairs. Sums come to the tasks ``many`` clusters a pass; a row keeps its distance to its own
    cluster and to the best of the others. A row alone in its cluster has width 0; without a second cluster the mean is null.
    """
    rows = df.where("cluster_id != -1").select(F.col(uid).alias("id"), F.col("cluster_id").cast("long").alias("c"), unit(F.col("embedding")).alias("v"))
    sizes = rows.groupBy("c").agg(F.count("*").alias("n"))
    sums = cut(mean_vectors(rows, ["c"], "v", "m").join(sizes, "c").withColumn("b", F.pmod(F.xxhash64("c"), F.lit(max(1, math.ceil(sizes.count() / many))))), "silhouette-sums")
    found = None
    for b in [r.b for r in sums.select("b").distinct().collect()]:
        block = sorted(sums.where(F.col("b") == b).collect(), key=lambda r: r.c)
        found = _distances(rows, block) if found is None else found.unionByName(_distances(rows, block))
    if found is None:
        return df.sparkSession.createDataFrame([(None, 0)], "silhouette double, n_rows long")
    each = found.groupBy("id").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("alone").alias("alone"))
    width = F.when(F.col("alone"), F.when(F.col("b").isNotNull(), 0.0)).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    width = F.when(F.col("b").isNotNull(), F.coalesce(width, F.lit(0.0)))
    return each.agg(F.round(F.avg(width), 6).alias("silhouette"), F.count("*").alias("n_rows"))


def _distances(rows: DataFrame, block: list) -> DataFrame:
    """(id, a, b, alone): mean distance to the own cluster, if it is in ``block``, and the least one to another of it."""
    ids, sizes, sums = np.array([r.c for r in block]), np.array([float(r.n) for r in block]), np.array([np.array(r.m) * r.n for r in block])

    def of(frames):
        for f in frames:
            if not len(f):
                continue
            v, c = np.stack([np.asarray(x, float) for x in f.v]), f.c.to_numpy()
            s, own = v @ sums.T, c[:, None] == ids[None]
            far = np.where(own, np.inf, 1 - s / sizes)
            mine = own.any(1)
            k = own.argmax(1)
            n = sizes[k]
            self_dot = (v * v).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                a = ((n - 1) - (s[np.arange(len(v)), k] - self_dot)) / (n - 1)
            b = far.min(1)
            yield pd.DataFrame({"id": f.id, "a": pd.Series(a).where(mine & (n > 1), None), "b": pd.Series(b).where(np.isfinite(b), None), "alone": pd.Series(mine & (n == 1))})

    return rows.mapInPandas(of, f"id {rows.schema['id'].dataType.simpleString()}, a double, b double, alone boolean")


def silhouette_sampled(df: DataFrame, uid: str = "vec_id", most: int = 2000) -> DataFrame:
    """One row: mean silhouette by euclidean distance over a sample of ``most`` clustered rows, those of the smallest hash:
    there is no closed form of it. A sample row's distances are summed within the sample, so work is bounded by its square.
    """
    s = df.where("cluster_id != -1").orderBy(F.xxhash64(uid), uid).limit(most).select(F.col(uid).alias("id"), "cluster_id", F.col("embedding").alias("v"))
    a, b = s, s.select(F.col("id").alias("id2"), F.col("cluster_id").alias("c2"), F.col("v").alias("v2"))
    d = F.sqrt(_square(F.col("v"), F.col("v2")))
    sums = a.join(b, F.col("id") != F.col("id2")).groupBy("id", "cluster_id", "c2").agg(F.sum(d).alias("sum"), F.count("*").alias("n"))
    own, mean = F.col("cluster_id") == F.col("c2"), F.col("sum") / F.col("n")
    each = sums.groupBy("id").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    width = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return each.agg(F.round(F.avg(width), 6).alias("silhouette"), F.count("*").alias("n_sampled"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information of two labelings, from their contingency table."""
    t = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    two = lambda x: x * (x - 1) / 2
    n = F.col("n")
    by_a, by_b = (t.groupBy(k).agg(F.sum("n").alias("m")) for k in (a, b))
    total = t.agg(F.sum("n").alias("N"), F.sum(two(n)).alias("ij"), F.sum(n * F.ln(n)).alias("h"))
    side = lambda d, k: d.agg(F.sum(two(F.col("m"))).alias(f"s{k}"), F.sum(F.col("m") * F.ln("m")).alias(f"h{k}"))
    one = total.crossJoin(side(by_a, "a")).crossJoin(side(by_b, "b"))
    expected = F.col("sa") * F.col("sb") / F.nullif(two(F.col("N")), F.lit(0.0))
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / F.nullif(most - expected, F.lit(0.0)))
    N, lnN = F.col("N"), F.ln("N")
    ha, hb = lnN - F.col("ha") / N, lnN - F.col("hb") / N
    mi = ha + hb - (lnN - F.col("h") / N)
    nmi = F.when(ha + hb == 0, 1.0).otherwise(2 * mi / F.nullif(ha + hb, F.lit(0.0)))
    return one.select(F.round(ari, 6).alias("ari"), F.round(nmi, 6).alias("nmi"), N.cast("long").alias("n"))


def cross_track(labels: DataFrame, track_a: str, track_b: str) -> DataFrame:
    """Agreement of two tracks on the conversations they share, and how many each has alone."""
    a, b = (labels.where(F.col("pipeline_track") == t).select("conversation_id", F.col("cluster_id").alias(k)) for t, k in ((track_a, "a"), (track_b, "b")))
    both = a.join(b, "conversation_id", "full").select(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 0).when(F.col("a").isNotNull(), 1).otherwise(2).alias("w"), "a", "b")
    counts = both.agg(*[F.count_if(F.col("w") == i).alias(k) for i, k in enumerate(("n_shared", "n_only_a", "n_only_b"))])
    return agreement(both.where("w = 0"), "a", "b").drop("n").crossJoin(counts)


def blend(a: DataFrame, b: DataFrame, key: str, weight: float = 0.7, dim: int = 64) -> DataFrame:
    """Unit vectors of weight * a + (1 - weight) * b; rows that ``b`` lacks are blended with zeros."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    j = a.select(key, F.col("embedding").alias("va")).join(b.select(key, F.col("embedding").alias("vb")), key, "left")
    mixed = F.zip_with(scale(F.col("va"), F.lit(weight)), scale(F.coalesce(F.col("vb").cast("array<double>"), zeros), F.lit(1 - weight)), lambda x, y: x + y)
    return j.select(key, unit(mixed).alias("embedding"))


def composite(sweep: DataFrame) -> DataFrame:
    """Sweep rows with a composite score, marks of the thresholds they meet, and their rank by track."""
    c = lambda k, d: F.coalesce(k, F.lit(d))
    score = 0.20 * c("silhouette_embed_cosine", 0.0) + 0.25 * c("silhouette_umap", 0.0) + 0.30 * F.coalesce((F.col("dbcv_umap") + 1) / 2, F.lit(0.0)) + 0.20 * c("cluster_persistence_mean", 0.0) + 0.05 * F.greatest(F.lit(0.0), (50.0 - c("noise_pct", 50.0)) / 50.0)
    high = lambda k, name, hi, mid: F.when(F.col(k) > hi, f"{name}✓✓").when(F.col(k) > mid, f"{name}✓").when(F.col(k).isNotNull(), f"{name}✗")
    noise = F.when(F.col("noise_pct") < 40, "noise✓").when(F.col("noise_pct") < 50, "noise~").when(F.col("noise_pct").isNotNull(), "noise✗")
    flags = F.concat_ws("  ", high("dbcv_umap", "DBCV", 0.5, 0.3), high("silhouette_umap", "sil", 0.5, 0.25), noise, high("cluster_persistence_mean", "pers", 0.12, 0.10))
    out = sweep.withColumns({"composite": F.round(score, 6), "quality": flags})
    keys = [c for c in ("n_components", "selection_method", "min_cluster_size", "min_samples", "epsilon") if c in sweep.columns]
    return out.withColumn("rank_in_track", F.row_number().over(Window.partitionBy("pipeline_track").orderBy(F.desc("composite"), *keys)))


def valid_configs(sweep: DataFrame) -> DataFrame:
    return sweep.where(F.col("n_clusters").between(30, 250) & (F.col("noise_pct") <= 55) & F.col("silhouette_embed_cosine").isNotNull())


def sweep_grid(spark, grid: dict[str, list]) -> DataFrame:
    """All combinations of parameter values, in order."""
    df = spark.range(1).drop("id")
    for k, values in grid.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(k))
    return df


def pair_pool(chunks: DataFrame, least_prob: float = 0.70, least_size: int = 10) -> DataFrame:
    """Sure chunks of clusters with enough of them."""
    sure = chunks.where(~F.col("is_noise") & (F.col("hdbscan_prob") >= least_prob))
    return sure.withColumn("_n", F.count("*").over(Window.partitionBy("cluster_id"))).where(F.col("_n") >= least_size).drop("_n")


def training_pairs(chunks: DataFrame, positives: int = 2, seed: str = "pairs", least_size: int = 10) -> DataFrame:
    """(anchor, other, label): up to twice ``positives`` anchors a cluster, each with ``positives`` chunks of its own cluster and
    one of another. Chunks stand in the order of a seeded hash, round a ring within the cluster; the easy negative of an
    anchor is the chunk of its rank in the next cluster."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_uid")))
    w = Window.partitionBy("cluster_id")
    pool = pair_pool(chunks, least_size=least_size).select("cluster_id", "chunk_uid", (F.row_number().over(w.orderBy(h)) - 1).alias("r"), F.count("*").over(w).alias("n"))
    order = pool.select("cluster_id").distinct().withColumn("c", F.row_number().over(Window.orderBy("cluster_id")) - 1)  # one row per cluster
    k = order.count()
    pool = pool.join(order, "cluster_id")
    anchors = pool.where(F.col("r") < 2 * positives).select("cluster_id", F.col("chunk_uid").alias("anchor"), F.col("r").alias("ar"), "n", "c")
    other = pool.select(F.col("c").alias("oc"), F.col("chunk_uid").alias("other"), F.col("r").alias("pr"), F.col("n").alias("on"))
    wanted = anchors.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(positives)))).withColumn("want", (F.col("ar") + F.col("step")) % F.col("n"))
    same = wanted.where("step < n").join(other, (F.col("c") == F.col("oc")) & (F.col("want") == F.col("pr"))).select("anchor", "other", F.lit(1).alias("label"))
    easy = anchors.withColumn("nc", (F.col("c") + 1) % k).join(other, (F.col("nc") == F.col("oc")) & (F.col("ar") % F.col("on") == F.col("pr")) & (F.col("c") != F.col("oc"))).select("anchor", "other", F.lit(0).alias("label"))
    return same.unionByName(easy)


def hard_negatives(df: DataFrame, uid: str = "vec_id", k: int = 3, probes: int | None = None) -> DataFrame:
    """(anchor, other, cosine, rank): the ``k`` rows of other clusters most like each row, by the index of ``neighbours``: exactly,
    or from ``probes`` cells alone."""
    rows = cut(neighbours.prepared(df.where("cluster_id != -1"), uid, "embedding", "cluster_id"), "negatives")
    ix = neighbours.build(rows)
    if ix is None:
        kind = df.schema[uid].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"anchor {kind}, other {kind}, cosine double, rank long")
    return neighbours.nearest(ix, rows, k, probes).select("anchor", "other", (-F.col("value")).alias("cosine"), "rank")


def entropy(df: DataFrame, by: str, value: str) -> DataFrame:
    """Shannon entropy in bits of the shares of ``value`` by group."""
    n = df.groupBy(by, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    return n.withColumn("p", p).groupBy(by).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy_bits"))


def cards(chunks: DataFrame, words: int = 5, samples: int = 3, languages: int = 3) -> DataFrame:
    """(cluster_id, n_chunks, keywords, samples, languages) of each cluster: its commonest words, surest chunks and commonest languages.

    Words and languages are counted before they are ranked, so a window holds one row a word; the surest chunks are kept by
    an aggregate of bounded size.
    """
    c = chunks.where("cluster_id != -1")

    def first(counted: DataFrame, name: str, most: int, shown: Column) -> DataFrame:
        ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), name))).where(F.col("r") <= most)
        return ranked.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", shown.alias("x")))), lambda z: z["x"]), ", ").alias(f"{name}s"))

    said = c.select("cluster_id", F.explode(F.regexp_extract_all(F.lower("translated_chunk_text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("keyword"))
    keywords = first(said.groupBy("cluster_id", "keyword").agg(F.count("*").alias("n")), "keyword", words, F.col("keyword"))
    spoken = c.groupBy("cluster_id", F.col("detected_language").alias("language")).agg(F.count("*").alias("n"))
    spoken = first(spoken, "language", languages, F.concat_ws(":", "language", F.col("n").cast("string")))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("hdbscan_prob"), "chunk_uid"))
    sure = c.select("cluster_id", "chunk_uid", "hdbscan_prob").withColumn("r", rank).where(F.col("r") <= samples)
    sure = sure.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_uid"))), lambda z: z["chunk_uid"]), ", ").alias("samples"))
    sizes = c.groupBy("cluster_id").agg(F.count("*").alias("n_chunks"))
    return sizes.join(keywords, "cluster_id", "left").join(sure, "cluster_id", "left").join(spoken, "cluster_id", "left").select("cluster_id", "n_chunks", "keywords", "samples", "languages")
