"""Density clusters of all rows, their validity, memberships of noise, sweeps of settings, and baselines.

Clusters come from the minimum spanning forest of mutual reachability and its cluster tree (``forest``): one rule for any
number of rows. The forest hangs on ``min_samples`` alone, so a sweep builds it once for each.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.functions.vectors import dot, unit
from talkloom.operators import forest as forests
from talkloom.operators import neighbours
from talkloom.sources.scratch import cut, drop_cut


def _named(labels: DataFrame, uid: str) -> DataFrame:
    sure = (F.col("cluster_id") >= 0) & (F.col("prob") >= 0.70)
    return labels.select(F.col("id").alias(uid), "cluster_id", F.col("prob").alias("hdbscan_prob"), (F.col("cluster_id") < 0).alias("is_noise"), sure.alias("is_high_conf"))


def density_clusters(df: DataFrame, uid: str = "vec_id", vector: str = "embedding", min_cluster_size: int = 5, min_samples: int = 5, method: str = "eom") -> DataFrame:
    """(uid, cluster_id, hdbscan_prob, is_noise, is_high_conf) of all rows. ``method``: eom (most stable) or leaf clusters."""
    found = forests.spanning_forest(df, uid, vector, min_samples)
    return _named(forests.labelled(found, forests.cluster_tree(found, min_cluster_size), method), uid)


def few_clusters(df: DataFrame, size: int, most_clusters: int = 40, tries: int = 3, uid: str = "vec_id", vector: str = "embedding", min_samples: int = 5) -> tuple[DataFrame, int]:
    """``density_clusters`` at ``size``, doubled up to ``tries`` times until there are fewer than ``most_clusters``, over one forest;
    and the size taken."""
    found = forests.spanning_forest(df, uid, vector, min_samples)
    for n in range(tries):
        tree = forests.cluster_tree(found, size)
        if n == tries - 1 or tree is None or len(tree.chosen()) < most_clusters:
            break
        size *= 2
    return _named(forests.labelled(found, tree), uid), size


#: Settings of a sweep whose validity is found at once.
AT_ONCE = 4


def sweep(df: DataFrame, sizes: list[int], samples: list[int], methods: list[str], uid: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(min_cluster_size, min_samples, selection_method, n_clusters, noise_pct, dbcv) of each setting, over all rows.

    Validity takes many small jobs one after the other, so it is found for ``AT_ONCE`` settings side by side."""
    settings = []
    for k in samples:
        found = forests.spanning_forest(df, uid, vector, k)
        for s in sizes:
            tree = forests.cluster_tree(found, s)
            for m in methods:
                labels = cut(forests.labelled(found, tree, m), "sweep-labels")
                count = labels.agg(F.max("cluster_id"), F.avg((F.col("cluster_id") < 0).cast("double"))).first()
                joined = df.select(F.col(uid).alias("id"), F.col(vector).alias("embedding")).join(labels, "id")
                settings.append((s, k, m, int(count[0]) + 1 if count[0] is not None else 0, round(100 * (count[1] or 0.0), 2), joined))
    with ThreadPoolExecutor(AT_ONCE) as pool:
        values = [pool.submit(inheritable_thread_target(df.sparkSession)(copy_context().run), dbcv, x[-1], "id") for x in settings]
    rows = [(*x[:-1], None if (v := value.result()) is None else round(v, 6)) for x, value in zip(settings, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "min_cluster_size int, min_samples int, selection_method string, n_clusters int, noise_pct double, dbcv double")


# --- memberships ------------------------------------------------------------------------------------------------------
#: Pairs whose distances are made exactly at once; heights held at once.
EXACT, HELD = 1 << 15, 2_000_000


def _heights(parent: np.ndarray, birth: np.ndarray, children: list[list[int]], nodes: list[int]):
    """For a node of the tree the density at which it meets each of ``nodes`` (none inside another): that at which their branches part."""
    chosen, count = set(nodes), np.zeros(len(parent), int)
    for i in range(len(parent)):  # children come before their parents
        count[i] = (i in chosen) + sum(count[k] for k in children[i])
    first, free = np.zeros(len(parent), int), 0
    for i in range(len(parent) - 1, -1, -1):  # what lies in a node stands together
        if parent[i] < 0:
            first[i], free = free, free + count[i]
        at = first[i] + (i in chosen)
        for k in children[i]:
            first[k], at = at, at + count[k]
    place, known = first[nodes], {}

    def spread(out: np.ndarray, at: int) -> None:
        if at in chosen:
            out[first[at]] = np.inf
        for k in children[at]:
            out[first[k] : first[k] + count[k]] = birth[k]

    def of(node: int) -> np.ndarray:
        """As that of the nearest node above that is known, but for what lies in the branches between; so nodes are best asked for from above."""
        way, at = [], node
        while at >= 0 and at not in known:
            way.append(at)
            at = parent[at]
        if not way:
            return known[node][place]
        out = known[at].copy() if at >= 0 else np.full(free, np.inf)
        for at in reversed(way):
            if (up := parent[at]) >= 0:
                if up in chosen:
                    out[first[up]] = birth[at]
                for k in children[up]:
                    out[first[k] : first[k] + count[k]] = min(birth[at], birth[k])
            spread(out, at)
        if (len(known) + 1) * free > HELD:
            known.clear()
        known[node] = out
        return out[place]

    return of


def _by_cluster(shape: tuple, cluster_node: dict, largest: dict, take):
    """Calls ``take(ids, clusters, d, h)`` with some rows of noise and the clusters of a part: distances to the nearest exemplar, and shares by height."""
    look, digits = neighbours.LOOK, neighbours.DIGITS["euclidean"]

    def nearest(q: np.ndarray, x: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Distances to the nearest exemplar of each cluster, from products of matrices where these are good to 1e-11, else made exactly."""
        m = (q * q).sum(1)
        rough = (-2 * q) @ x.T
        rough += n
        least = np.minimum.reduceat(rough, starts, axis=1) + m[:, None]
        d = np.sqrt(np.maximum(least, 0))
        r, c = np.nonzero(d <= 5e-4 * (m + n.max())[:, None])
        d_rough, d[r, c] = d[r, c], np.inf
        ends = sizes[c].cumsum()
        for i in range(0, int(ends[-1]) if len(ends) else 0, EXACT):
            nth = np.arange(i, min(i + EXACT, int(ends[-1])))
            pair = np.searchsorted(ends, nth, "right")
            a, b = r[pair], starts[c[pair]] + nth - ends[pair] + sizes[c[pair]]
            on = np.sqrt(np.maximum(rough[a, b] + m[a], 0)) <= d_rough[pair] + 1e-5
            a, b = a[on], b[on]
            np.minimum.at(d, (a, c[pair[on]]), np.sqrt(((q[a] - x[b]) ** 2).sum(1)))
        return np.round(d, digits)

    def of(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g", ignore_index=True)
        asks = asks.sort_values(["node", "id"], ascending=[False, True], ignore_index=True)
        names, starts, sizes = np.unique(rows.g.to_numpy(np.int64), return_index=True, return_counts=True)
        top = np.array([largest[c] for c in names], float)
        height = _heights(*shape, [cluster_node[c] for c in names]) if len(names) else None
        x, out = np.stack(rows.v) if len(rows) else None, [take(asks.id.to_numpy()[:0], names, np.zeros((0, len(names))), np.zeros((0, len(names))))]
        n = (x * x).sum(1) if len(rows) else None
        step = max(1, look // max(1, len(rows)))
        for i in range(0, len(asks) if len(rows) else 0, step):
            part = asks.iloc[i : i + step]
            d = nearest(np.stack(part.v), x, n, starts, sizes)
            nodes, at = np.unique(-part.node.to_numpy(), return_inverse=True)
            h = np.minimum(np.stack([height(-k) for k in nodes.tolist()])[at], part.density.to_numpy(float)[:, None])
            out.append(take(part.id.to_numpy(), names, d, np.where(top > 0, h / np.where(top > 0, top, 1), 1.0)))
        return pd.concat(out, ignore_index=True)

    return of


def _pairs(ids, clusters, d, h) -> pd.DataFrame:
    return pd.DataFrame({"anchor": np.repeat(ids, len(clusters)), "other": np.tile(clusters, len(ids)), "d": d.ravel(), "h": h.ravel()})


def _largest(ids, clusters, d, h) -> pd.DataFrame:
    """Of each row whether it is at distance 0 of a cluster, the sum of its scores, and the largest with its cluster."""
    touch = (d == 0).any(1)
    with np.errstate(divide="ignore"):
        m = np.where(touch[:, None], d == 0, 1 / d) * h
    best = m.argmax(1) if len(clusters) and len(ids) else np.zeros(len(ids), int)
    return pd.DataFrame({"anchor": ids, "touch": touch, "total": m.sum(1), "top": m[np.arange(len(ids)), best], "other": clusters[best]})


def _compared(df: DataFrame, found: forests.Forest, tree: forests.Tree, method: str, uid: str, vector: str, take, schema: str, block: int | None = None) -> DataFrame:
    """What ``take`` makes of the noise rows and the clusters: exemplars (equal ones of a cluster once) are dealt into parts by cluster,
    noise rows into slices, and each slice meets each part in one task."""
    heirs = tree.heirs(tree.chosen(method))
    labels = cut(forests.labelled(found, tree, method), "member-labels")
    leaf = np.array([not c for c in tree.children])
    own = cut(tree.rows.join(labels.select("id", "cluster_id"), "id"), "member-rows")
    tops = own.where("cluster_id >= 0").groupBy("node").agg(F.max("density").alias("_top"), F.min("cluster_id").alias("_cluster"))
    tops = cut(tops, "member-tops")
    cluster_node, largest = {}, {}
    for r in tops.collect():  # a row a cluster of the tree, as many as the tree holds
        cluster_node[r["_cluster"]] = int(heirs[r.node])
        largest[r["_cluster"]] = max(largest.get(r["_cluster"], 0.0), r["_top"])
    is_leaf = F.pandas_udf(lambda n: pd.Series(leaf[n.to_numpy()]), "boolean")
    vectors = df.select(F.col(uid).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    exemplars = own.join(tops, "node").where(F.col("density") == F.col("_top")).where(is_leaf("node")).join(vectors, "id")
    exemplars = cut(exemplars.select(F.col("cluster_id").alias("g"), "v").distinct(), "member-exemplars")
    noise = cut(own.where("cluster_id < 0").join(vectors, "id").select("id", "v", "node", "density"), "member-noise")
    n = noise.count()
    parts = max(1, -(-exemplars.count() // (block or neighbours.LEAST_BLOCK * 2)))
    slices = max(1, -(-n // (block or min(max(n // neighbours.GROUPS, neighbours.LEAST_BLOCK), neighbours.MOST_BLOCK))))
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = exemplars.select("g", "v", F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int").alias("part"), upto(slices).alias("slice"))
    right = noise.select("*", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), upto(parts).alias("part"))
    return left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInPandas(_by_cluster((tree.parent, tree.birth, tree.children), cluster_node, largest, take), schema)


def memberships(df: DataFrame, found: forests.Forest, tree: forests.Tree | None, method: str = "eom", uid: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster_id, membership) of each noise row for each cluster; memberships of a row sum to 1.

    A membership is the product of two shares, made to sum to 1: by distance, the reciprocal of that to the cluster's nearest
    exemplar (the densest rows of the leaves in it; at distance 0 only such clusters count), and by height, the density at
    which the row and the cluster come together over the cluster's largest.
    """
    kind = df.schema[uid].dataType.simpleString()
    if tree is None or not tree.chosen(method):
        return df.sparkSession.createDataFrame([], f"id {kind}, cluster_id long, membership double")
    scored = _compared(df, found, tree, method, uid, vector, _pairs, f"anchor {kind}, other long, d double, h double")
    from pyspark.sql import Window

    w = Window.partitionBy("anchor")
    touch = F.max(F.when(F.col("d") == 0, 1).otherwise(0)).over(w) == 1
    by_distance = F.when(touch, F.when(F.col("d") == 0, 1.0).otherwise(0.0)).otherwise(1 / F.nullif("d", F.lit(0.0)))
    scored = scored.withColumn("_m", by_distance * F.col("h"))
    return scored.select(F.col("anchor").alias("id"), F.col("other").alias("cluster_id"), (F.col("_m") / F.nullif(F.sum("_m").over(w), F.lit(0.0))).alias("membership"))


def largest_memberships(df: DataFrame, found: forests.Forest, tree: forests.Tree | None, method: str = "eom", uid: str = "vec_id", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """(id, cluster_id, membership): the largest of ``memberships`` of each noise row, of equal ones that of the smaller number; a task sends
    on one row for each of noise, whatever the number of clusters."""
    kind = df.schema[uid].dataType.simpleString()
    if tree is None or not tree.chosen(method):
        return df.sparkSession.createDataFrame([], f"id {kind}, cluster_id long, membership double")
    each = _compared(df, found, tree, method, uid, vector, _largest, f"anchor {kind}, touch boolean, total double, top double, other long", block)
    total = lambda touch: F.sum(F.when(F.col("touch") == touch, F.col("total")))
    best = each.groupBy("anchor").agg(F.max(F.struct("touch", "top", (-F.col("other")).alias("less"))).alias("b"), total(True).alias("_near"), total(False).alias("_all"))
    return best.select(F.col("anchor").alias("id"), (-F.col("b.less")).alias("cluster_id"), (F.col("b.top") / F.nullif(F.when(F.col("b.touch"), F.col("_near")).otherwise(F.col("_all")), F.lit(0.0))).alias("membership"))


def assign_noise(df: DataFrame, least: float = 0.1, min_cluster_size: int = 5, min_samples: int = 5, method: str = "eom", uid: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(uid, cluster_id, hdbscan_prob, soft_assigned): ``density_clusters`` whose noise rows join the cluster of their largest
    membership, if that is ``least`` or more; of equal ones that of the smaller number."""
    found = forests.spanning_forest(df, uid, vector, min_samples)
    tree = forests.cluster_tree(found, min_cluster_size)
    labels = forests.labelled(found, tree, method)
    best = largest_memberships(df, found, tree, method, uid, vector).withColumnRenamed("cluster_id", "_best")
    given = F.coalesce((F.col("cluster_id") < 0) & (F.col("membership") >= least), F.lit(False))
    out = labels.join(best, "id", "left").withColumn("_given", given)
    return out.select(F.col("id").alias(uid), F.when(F.col("_given"), F.col("_best")).otherwise(F.col("cluster_id")).alias("cluster_id"), F.when(F.col("_given"), F.col("membership")).otherwise(F.col("prob")).alias("hdbscan_prob"), F.col("_given").alias("soft_assigned"))


# --- validity ---------------------------------------------------------------------------------------------------------
def dbcv(df: DataFrame, uid: str = "vec_id", vector: str = "embedding", cluster: str = "cluster_id") -> float | None:
    """Density-based validity in [-1, 1] over all rows (noise weighs, with validity 0); None with fewer than two clusters of two rows.

    A row's core distance is the power mean of the distances to all other rows of its cluster, with exponent -dimension (rows
    at distance 0 add nothing). Sparseness of a cluster is the longest edge of its spanning forest between rows with two
    edges or more (of all edges if there is none), separation the least mutual reachability from such rows (all rows if
    there are none) to those of another cluster.
    """
    n = df.count()
    real = df.where(F.col(cluster) >= 0).select(F.col(uid).alias("id"), F.col(cluster).cast("long").alias("g"), F.col(vector).cast("array<double>").alias("v"))
    counts = real.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    real = cut(real.join(counts, "g"), "dbcv-rows")
    if real.select("g").distinct().limit(2).count() < 2:
        return None
    dim = F.size("v")
    sums = neighbours.power_sums(real.select("id", "g", "v"))
    core = F.round(F.when(F.col("s").isNull(), 0.0).otherwise(F.exp(-(F.col("s") - F.ln(F.col("n") - 1)) / dim)), neighbours.DIGITS["euclidean"])
    cored = cut(real.join(sums, "id", "left").select("id", "g", "v", core.alias("core")), "dbcv-cores")
    edges = cut(forests.inner_forest(cored).join(cored.select(F.col("id").alias("lo"), "g"), "lo"), "dbcv-edges")
    inner = edges.select("g", F.explode(F.array("lo", "hi")).alias("id")).groupBy("g", "id").count().where("count > 1").select("id", F.lit(True).alias("inner"))
    marked = edges.join(inner.select(F.col("id").alias("lo"), F.lit(1).alias("_a")), "lo", "left").join(inner.select(F.col("id").alias("hi"), F.lit(1).alias("_b")), "hi", "left")
    sparse = marked.groupBy("g").agg(F.coalesce(F.max(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.col("w"))), F.max("w")).alias("sparse"))
    has = cored.join(inner, "id", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    none = has.groupBy("g").agg(F.max("inner").alias("_any")).where("NOT _any").select("g", F.lit(True).alias("_all"))
    ends = cut(has.join(none, "g", "left").where("inner OR _all").select("id", "v", "g", "core"), "dbcv-ends")
    ix = neighbours.build(ends, "euclidean")
    apart = neighbours.nearest(ix, ends, 1).join(ends.select(F.col("id").alias("anchor"), "g"), "anchor").groupBy("g").agg(F.min("value").alias("apart"))
    each = sparse.join(apart, "g").join(counts, "g")
    value = (F.col("apart") - F.col("sparse")) / F.greatest("apart", "sparse", F.lit(1e-12))
    return each.agg(F.sum(value * F.col("n")) / n).first()[0]


# --- baselines --------------------------------------------------------------------------------------------------------
def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of ``k`` clusters by Ward's linkage."""
    groups = [[i] for i in range(len(x))]
    centre, size = x.astype(float).copy(), np.ones(len(x))
    alive = list(range(len(x)))
    while len(alive) > k:
        c, s = centre[alive], size[alive]
        d = ((c[:, None] - c[None]) ** 2).sum(2) * (s[:, None] * s[None]) / (s[:, None] + s[None])
        np.fill_diagonal(d, np.inf)
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        a, b = alive[i], alive[j]
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        groups[a] += groups[b]
        alive.pop(j)
    out = np.empty(len(x), int)
    for n, g in enumerate(sorted((groups[a] for a in alive), key=min)):
        out[g] = n
    return out


def nearest_centre(df: DataFrame, centres: DataFrame, uid: str = "vec_id") -> DataFrame:
    """(uid, cluster_id, cosine): the centre most like each row; ``centres``: cluster_id, centroid, few."""
    c = centres.agg(F.array_sort(F.collect_list(F.struct("cluster_id", unit(F.col("centroid")).alias("u")))).alias("cs"))
    best = F.array_max(F.transform("cs", lambda x: F.struct(F.round(dot(unit(F.col("embedding")), x["u"]), 9).alias("s"), (-x["cluster_id"]).alias("less"))))
    return df.crossJoin(F.broadcast(c)).select(uid, (-best["less"]).alias("cluster_id"), F.round(best["s"], 6).alias("cosine"))


def k_means(df: DataFrame, k: int, seeds: list[int], vector: str = "embedding") -> DataFrame:
    """``df`` with ``cluster``: the best by cost of a run for each seed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    models = [KMeans(k=k, seed=s, featuresCol="_v", predictionCol="cluster").fit(data) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("_v")


def reduce_dims(df: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """``vector`` reduced by principal components: the deterministic stand-in for a non-linear layout."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=dims, inputCol="_v", outputCol="_r").fit(data).transform(data).withColumn(vector, vector_to_array("_r")).drop("_v", "_r")


def student_t(x: np.ndarray, centres: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Soft assignments by Student's t to centres, and the sharpened target that they are trained towards."""
    q = (1 + ((x[:, None] - centres[None]) ** 2).sum(2) / alpha) ** (-(alpha + 1) / 2)
    q /= q.sum(1, keepdims=True)
    p = q**2 / q.sum(0)
    return q, p / p.sum(1, keepdims=True)
