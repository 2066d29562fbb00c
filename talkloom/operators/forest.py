"""Density clusters of all rows: a minimum spanning forest of mutual reachability in rounds, and the cluster tree from its edges.

The forest (``spanning_forest``): each round every component picks its lightest edge to another one, and picks join
components. Edges are ordered by (weight, smaller id, larger id), which makes them unique, so picks form no cycle but pairs
that pick the same edge. Candidates come from each row's list of nearest rows; only rows whose list ends below their
component's best candidate are searched further, in the cells of the index that can hold a lighter edge and don't belong to
the component alone.

The cluster tree (``cluster_tree``): merging by ascending weight gives each edge two sides. The rounds tell them without any
sorted pass: an edge picked in a round belongs to the chain of the first later component that has it inside and is left by a
heavier edge; in a chain, sorted by weight, each edge joins what is below it to the component that picked it. So sizes are
sums by chain, level by level. Clusters are born where a chain's first rows reach ``min_cluster_size`` (that many rows a
chain are looked at), and split where two sides of at least that size meet; everything else is rows that leave a cluster.

What reaches the driver is a row for each chain that holds a cluster and for each split, ``most_clusters`` at most (checked;
a larger ``min_cluster_size`` makes fewer); selection by excess of mass runs there. Rows, edges and chains stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators import neighbours
from talkloom.sources.scratch import cut, drop_cut

#: Density is the reciprocal of a weight, this at most.
DENSEST = 1e12
MOST_CLUSTERS = 1_000_000
EDGE = ["w", "lo", "hi"]


@dataclass
class Forest:
    """``rows``: (id, core); ``picks`` of each level: (c, w, lo, hi), the lightest edge of component c; ``ups``: (c, up)."""

    rows: DataFrame
    picks: list[DataFrame] = field(default_factory=list)
    ups: list[DataFrame] = field(default_factory=list)

    def edges(self) -> DataFrame:
        out = self.picks[0].select(*EDGE)
        for p in self.picks[1:]:
            out = out.unionByName(p.select(*EDGE))
        return out.distinct()


def _both_ways(pairs: DataFrame) -> DataFrame:
    ends = F.struct(F.least("anchor", "other").alias("lo"), F.greatest("anchor", "other").alias("hi"))
    p = pairs.select("w", ends.alias("e"), "anchor", "other")
    each = [p.select(F.col(a).alias("a"), F.col(b).alias("b"), "w", "e.lo", "e.hi") for a, b in (("anchor", "other"), ("other", "anchor"))]
    return each[0].unionByName(each[1])


def _lightest(candidates: DataFrame) -> DataFrame:
    """(c, w, lo, hi, to) of candidates (c, to, w, lo, hi)."""
    best = candidates.where("c != to").groupBy("c").agg(F.min(F.struct("w", "lo", "hi", "to")).alias("e"))
    return best.select("c", "e.w", "e.lo", "e.hi", "e.to")


def _roots(picked: DataFrame) -> DataFrame:
    """(c, up): the component each component becomes part of, by pointers that are doubled until they end."""
    back = picked.select(F.col("c").alias("to"), F.col("to").alias("_back"))
    now = picked.select("c", "to").join(back, "to", "left")
    now = cut(now.select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up")), "forest-up")
    while True:
        further = now.select(F.col("c").alias("up"), F.col("up").alias("_up2"))
        after = cut(now.join(further, "up", "left").select("c", F.coalesce("_up2", "up").alias("_next"), "up"), "forest-up")
        drop_cut(now)
        now = after.select("c", F.col("_next").alias("up"))
        now._scratch_path = after._scratch_path
        if after.where("up != _next").isEmpty():
            return now


def spanning_forest(df: DataFrame, uid: str = "vec_id", vector: str = "embedding", min_samples: int = 5, lists: int | None = None) -> Forest:
    """The forest of all rows of ``df`` (one tree; none for an empty table). A core distance is that to the
    ``min_samples``-th other row, or to the last one if there are fewer."""
    rows = cut(neighbours.prepared(df, uid, vector, metric="euclidean"), "forest-rows")
    ix = neighbours.build(rows, "euclidean")
    if ix is None:
        return Forest(rows.select("id", "core"))
    k = lists or max(2 * min_samples, 16)
    near = neighbours.nearest(ix, rows, k)
    core = near.where(F.col("rank") <= min_samples).groupBy(F.col("anchor").alias("id")).agg(F.max("value").alias("core"))
    cores = rows.drop("core").join(core, "id", "left").select("id", F.coalesce("core", F.lit(0.0)).alias("core"))
    return _forest(rows, ix, near, cut(cores, "forest-cores"), k)


def inner_forest(rows: DataFrame, lists: int = 16) -> DataFrame:
    """(w, lo, hi): the edges of a spanning tree of mutual reachability within each ``g`` (an integer) of ``rows`` (id, g, v, core);
    core distances are rounded as distances are, so that equal weights are equal however they were found."""
    p = cut(rows.select("id", "v", F.col("id").alias("g"), F.lit(0.0).alias("core"), F.col("g").cast("long").alias("p")), "forest-rows")
    ix = neighbours.build(p, "euclidean", part="p")
    found = _forest(p, ix, neighbours.nearest(ix, p, lists), rows.select("id", F.round("core", neighbours.DIGITS["euclidean"]).alias("core")), lists)
    return found.edges() if found.picks else rows.sparkSession.createDataFrame([], "w double, lo long, hi long")


def _forest(rows: DataFrame, ix: neighbours.Index, near: DataFrame, cores: DataFrame, k: int) -> Forest:
    """``near``: the ``k`` nearest of each row; rows of an index with parts only meet their own part."""
    bound = near.where(F.col("rank") == k).select(F.col("anchor").alias("id"), F.col("value").alias("bound"))
    side = lambda c, name: cores.select(F.col("id").alias(name), F.col("core").alias(c))
    pairs = near.join(side("_a", "anchor"), "anchor").join(side("_b", "other"), "other").withColumn("w", F.greatest("value", "_a", "_b"))
    edges = cut(_both_ways(pairs).select(F.col("a").alias("c"), F.col("b").alias("to"), *EDGE).distinct(), "forest-edges")
    filed = cut(ix.rows.drop("core").join(cores, "id"), "forest-index")
    least = np.full(len(ix.centres), np.inf)
    for r in filed.groupBy("cell").agg(F.min("core").alias("c")).collect():
        least[r.cell] = r.c
    ix = replace(ix, rows=filed, core=least)
    asks = rows.drop("core", "g").join(cores, "id").join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    asks = cut(asks, "forest-asks")
    of_row = cut(rows.select("id", F.col("id").alias("c")), "forest-components")
    out = Forest(cores.select("id", "core"))
    many = rows.count()
    while many > (0 if ix.part is not None else 1):
        picked = _pick(ix, asks, of_row, edges)
        if picked.isEmpty():
            break
        ups = _roots(picked)
        out.picks.append(picked.drop("to"))
        out.ups.append(ups)
        many = ups.where("c = up").count()
        after = cut(of_row.join(ups, "c").select("id", F.col("up").alias("c")), "forest-components")  # without what is complete
        drop_cut(of_row)
        of_row = after
        a, b = ups.select("c", F.col("up").alias("_a")), ups.select(F.col("c").alias("to"), F.col("up").alias("_b"))
        inside = edges.join(a, "c").join(b, "to").where("_a != _b").groupBy(F.col("_a").alias("c"), F.col("_b").alias("to")).agg(F.min(F.struct(*EDGE)).alias("e"))
        after = cut(inside.select("c", "to", "e.w", "e.lo", "e.hi"), "forest-edges")
        drop_cut(edges)
        edges = after
    ix.drop()
    return out


def _pick(ix: neighbours.Index, asks: DataFrame, of_row: DataFrame, edges: DataFrame) -> DataFrame:
    """(c, w, lo, hi, to): the lightest edge of each component to another one."""
    known = cut(_lightest(edges), "forest-known")
    all_asks = asks.join(of_row, "id").withColumnRenamed("c", "g").join(known.select(F.col("c").alias("g"), F.col("w").alias("tau")), "g", "left")
    cols = ["id", "v", "g", "core", "tau", *(["p"] if ix.part is not None else [])]
    left = cut(all_asks.where("tau IS NULL OR bound <= tau").select(*cols), "forest-left")
    if left.isEmpty():
        return known
    filed = cut(ix.rows.drop("g").join(of_row.withColumnRenamed("c", "g"), "id"), "forest-filed")
    owner = [None] * len(ix.centres)
    for r in filed.groupBy("cell").agg(F.min("g").alias("a"), F.max("g").alias("b")).collect():
        owner[r.cell] = r.a if r.a == r.b else None
    now = replace(ix, rows=filed)

    def candidates(found: DataFrame) -> DataFrame:
        ends = found.select("anchor", "other", F.col("value").alias("w"))
        a, b = of_row.select(F.col("id").alias("a"), "c"), of_row.select(F.col("id").alias("b"), F.col("c").alias("to"))
        return _both_ways(ends).join(a, "a").join(b, "b").select("c", "to", *EDGE)

    found = known.select("c", "to", *EDGE)
    lost = left.where("tau IS NULL")
    if not lost.isEmpty():  # a first bound from the nearest cells
        found = cut(found.unionByName(candidates(neighbours.ask(now, lost, 1, 0, 4, owner, shared=True))), "forest-found")
        bounds = _lightest(found).select(F.col("c").alias("g"), F.col("w").alias("tau"))
        left = left.drop("tau").join(bounds, "g", "left").select(*cols)
    found = found.unionByName(candidates(neighbours.ask(now, left, 1, 0, None, owner, shared=True)))
    out = cut(_lightest(found), "forest-picks")
    for x in (known, filed):
        drop_cut(x)
    return out


# --- the cluster tree -------------------------------------------------------------------------------------------------
@dataclass
class Tree:
    """Clusters numbered from the leaves up, the root last: parent, birth and stability of each; ``rows``: (id, node, density)."""

    parent: np.ndarray
    birth: np.ndarray
    stability: np.ndarray
    rows: DataFrame
    children: list[list[int]]

    def chosen(self, method: str = "eom") -> list[int]:
        """The most stable clusters, or the leaves; never the root."""
        n = len(self.parent)
        if method == "leaf":
            return [i for i in range(n - 1) if not self.children[i]]
        value, taken = np.zeros(n), np.zeros(n, bool)
        for i in range(n - 1):  # children come before their parents
            below = sum(value[j] for j in self.children[i])
            taken[i], value[i] = self.stability[i] >= below, max(self.stability[i], below)
        out = []
        covered = np.zeros(n, bool)
        for i in range(n - 2, -1, -1):
            covered[i] = covered[self.parent[i]] or False
            if taken[i] and not covered[i]:
                out.append(i)
                covered[i] = True
        return sorted(out)

    def heirs(self, chosen: list[int]) -> np.ndarray:
        """For each cluster the chosen one that it is or lies in, else -1."""
        out = np.full(len(self.parent), -1)
        out[chosen] = chosen
        for i in range(len(self.parent) - 2, -1, -1):
            if out[i] < 0:
                out[i] = out[self.parent[i]]
        return out


def _chains(forest: Forest) -> DataFrame:
    """(level, c, w, lo, hi, chain_level, chain): what each component hangs from, and the chain of that edge."""
    top, last = len(forest.picks), None
    done = None
    for j in range(1, top + 1):
        fresh = forest.picks[j - 1].join(forest.ups[j - 1], "c").select(F.lit(j - 1).alias("level"), "c", *EDGE, F.col("up").alias("at"))
        pending = fresh if last is None else fresh.unionByName(last)
        if j == top:
            here, last = pending, None
        else:
            leave = forest.picks[j].select(F.col("c").alias("at"), F.struct(*EDGE).alias("_out"))
            pending = cut(pending.join(leave, "at").join(forest.ups[j].withColumnRenamed("c", "at"), "at").withColumn("_here", F.struct(*EDGE) < F.col("_out")), "chains-pending")
            here, last = pending.where("_here"), pending.where("NOT _here").select("level", "c", *EDGE, F.col("up").alias("at"))
        here = here.select("level", "c", *EDGE, F.lit(j).alias("chain_level"), F.col("at").alias("chain"))
        done = here if done is None else done.unionByName(here)
    return done


def _sized(forest: Forest) -> DataFrame:
    """``_chains`` with the number of rows of each component's side (``n``) and of its whole chain (``total``)."""
    links = cut(_chains(forest), "chains")
    sizes = links.where("level = 0").select(F.lit(0).alias("level"), "c", F.lit(1).cast("long").alias("n"))
    sizes = cut(sizes, "chain-sizes")
    for j in range(1, len(forest.picks) + 1):
        here = links.where(F.col("chain_level") == j).join(sizes, ["level", "c"]).groupBy("chain").agg(F.sum("n").alias("n"))
        sizes = sizes.unionByName(cut(here.select(F.lit(j).alias("level"), F.col("chain").alias("c"), "n"), "chain-sizes"))
    totals = sizes.select(F.col("level").alias("chain_level"), F.col("c").alias("chain"), F.col("n").alias("total"))
    return cut(links.join(sizes, ["level", "c"]).join(totals, ["chain_level", "chain"]), "chains-sized")


def _key(r) -> tuple:
    return (r.w, r.lo, r.hi, r.level, r.c)


def cluster_tree(forest: Forest, min_cluster_size: int = 5, most_clusters: int = MOST_CLUSTERS) -> Tree | None:
    """The condensed tree; None if there are fewer than ``min_cluster_size`` rows."""
    from pyspark.sql import Window

    m = max(2, min_cluster_size)
    if not forest.picks:
        return None
    links = _sized(forest)
    big = links.where(F.col("total") >= m)
    order = [*EDGE, "level", "c"]
    by = Window.partitionBy("chain_level", "chain").orderBy(*order)
    first = big.withColumn("_i", F.row_number().over(by)).where(F.col("_i") <= m)
    first = first.withColumn("_sum", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    born = first.where((F.col("_sum") >= m) & (F.col("_sum") - F.col("n") < m)).select("chain_level", "chain", *order, "n")
    born = cut(born, "tree-born")
    splits = cut(big.where(F.col("n") >= m).select("chain_level", "chain", *order, "n"), "tree-splits")
    if born.count() + splits.count() > most_clusters:
        raise ValueError(f"more than {most_clusters} clusters and splits; ask for a larger min_cluster_size")
    if not born.count():
        return None
    parent: list[int] = []
    birth: list[float] = []
    children: list[list[int]] = []
    stability: list[float] = []

    def add(kids: list[int], density: float) -> int:
        parent.append(-1)
        birth.append(0.0)
        stability.append(0.0)
        children.append(kids)
        for kid in kids:
            parent[kid], birth[kid] = len(parent) - 1, density
        return len(parent) - 1

    def density(w: float) -> float:
        return min(1 / w, DENSEST) if w > 0 else DENSEST

    top: dict[tuple, int] = {}
    spans: dict[tuple, tuple] = {}  # chain -> its beginning, whether a cluster goes on there, its clusters and the splits between them
    of_chain: dict[tuple, list] = {}
    for r in splits.collect():
        of_chain.setdefault((r.chain_level, r.chain), []).append(r)
    for b in sorted(born.collect(), key=lambda r: (r.chain_level, r.chain)):
        chain = (b.chain_level, b.chain)
        goes_on = b.n >= m
        now = top[(b.level, b.c)] if goes_on else add([], 0.0)
        nodes, keys = [now], []
        for s in sorted(of_chain.get(chain, []), key=_key):
            if _key(s) <= _key(b):
                continue
            now = add([now, top[(s.level, s.c)]], density(s.w))
            nodes.append(now)
            keys.append(_key(s))
        top[chain] = now
        spans[chain] = (_key(b), nodes, keys)

    def fate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cluster that the rows of a small component leave, and the density at which they do."""
        from bisect import bisect_left

        for f in frames:
            node, level = [], []
            for r in f.itertuples():
                start, nodes, keys = spans[(r.chain_level, r.chain)]
                key = (r.w, r.lo, r.hi, r.level, r.c)
                if key <= start:  # all that is there when the cluster begins leaves with it
                    node.append(nodes[0])
                    level.append(density(start[0]))
                else:
                    node.append(nodes[bisect_left(keys, key)])
                    level.append(density(r.w))
            yield pd.DataFrame({"level": f.level, "c": f.c, "n": f.n, "node": np.array(node, np.int64), "density": np.array(level, float)})

    kind = links.schema["c"].dataType.simpleString()
    small = big.where(F.col("n") < m).select("chain_level", "chain", *order, "n")
    fates = cut(small.mapInPandas(fate, f"level int, c {kind}, n long, node long, density double"), "tree-fates")
    for r in fates.groupBy("node").agg(F.sum(F.col("n") * F.col("density")).alias("d"), F.sum("n").alias("n")).collect():
        stability[r.node] += r.d - r.n * birth[r.node]
    sizes = np.zeros(len(parent))
    for r in fates.groupBy("node").agg(F.sum("n").alias("n")).collect():
        sizes[r.node] = r.n
    for i in range(len(parent)):
        for kid in children[i]:  # a split takes all rows of both sides
            sizes[i] += sizes[kid]
            stability[i] += sizes[kid] * (birth[kid] - birth[i])
    known = fates.select("level", "c", "node", "density")
    for j in range(len(forest.picks) - 1, -1, -1):  # what hangs in a small chain shares the fate of the chain's component
        inside = links.where((F.col("level") == j) & (F.col("total") < m)).select("level", "c", "chain_level", "chain")
        above = known.select(F.col("level").alias("chain_level"), F.col("c").alias("chain"), "node", "density")
        known = cut(known.unionByName(inside.join(above, ["chain_level", "chain"]).select("level", "c", "node", "density")), "tree-known")
    rows = known.where("level = 0").select(F.col("c").alias("id"), "node", "density")
    return Tree(np.array(parent), np.array(birth), np.array(stability), rows, children)


def labelled(forest: Forest, tree: Tree | None, method: str = "eom") -> DataFrame:
    """(id, cluster_id, prob): clusters numbered by their smallest id, noise -1; the probability is a row's density over
    the largest of its cluster."""
    if tree is None or not (chosen := tree.chosen(method)):
        return forest.rows.select("id", F.lit(-1).cast("long").alias("cluster_id"), F.lit(0.0).alias("prob"))
    heirs = tree.heirs(chosen)

    def heir(nodes: pd.Series) -> pd.Series:
        return pd.Series(heirs[nodes.to_numpy()])

    own = tree.rows.withColumn("_c", F.pandas_udf(heir, "long")("node"))
    own = cut(own, "labels")
    of = own.where("_c >= 0").groupBy("_c").agg(F.min("id").alias("_first"), F.max("density").alias("_top"))
    from pyspark.sql import Window

    numbers = cut(of.withColumn("_number", F.row_number().over(Window.orderBy("_first")) - 1), "label-numbers")  # one row a cluster
    out = own.join(numbers, "_c", "left")
    return out.select("id", F.coalesce(F.col("_number").cast("long"), F.lit(-1).cast("long")).alias("cluster_id"), F.coalesce(F.col("density") / F.col("_top"), F.lit(0.0)).alias("prob"))
