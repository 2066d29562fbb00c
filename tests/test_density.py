"""Neighbours, spanning forest, cluster tree, memberships and validity against plain versions over all pairs."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talkloom.operators import clusters, density, forest, neighbours

SCHEMA = "vec_id long, embedding array<double>, cluster_id long"


def blobs(n, dim, k, seed, noise=0.2):
    """Rows round ``k`` centres (their number), scattered rows (-1), and some rows repeated."""
    r = np.random.default_rng(seed)
    c = r.normal(size=(k, dim)) * 3
    y = np.where(r.random(n) < noise, -1, r.integers(0, k, n))
    x = np.where((y >= 0)[:, None], c[np.maximum(y, 0)] + r.normal(size=(n, dim)) * r.choice([0.3, 0.6], size=(n, 1)), r.normal(size=(n, dim)) * 3)
    x[1:5], y[1:5] = x[0], y[0]
    return x, y


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], SCHEMA).repartition(parts)


def apart(x):
    return np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)


def plain_edges(w, allowed=None):
    """Edges of the minimum spanning forest by (weight, ends), lightest first."""
    n = len(w)
    a, b = np.triu_indices(n, 1)
    if allowed is not None:
        ok = allowed[a, b]
        a, b = a[ok], b[ok]
    at, out = list(range(n)), []

    def root(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i in np.lexsort((b, a, w[a, b])):
        p, q = root(a[i]), root(b[i])
        if p != q:
            at[p] = q
            out.append((float(w[a[i], b[i]]), int(a[i]), int(b[i])))
    return out


def plain_mutual(x, k):
    d = apart(x)
    core = np.sort(d, axis=1)[:, min(k, len(x) - 1)]
    return np.maximum(d, np.maximum(core[:, None], core[None]))


def plain_labels(n, edges, m, method):
    """Condensed tree from the top down, by sides of the edges from the heaviest to the lightest."""
    groups = {i: [i] for i in range(n)}
    of, merges = list(range(n)), []
    for w, a, b in edges:
        p, q = of[a], of[b]
        merges.append((w, p, q, len(groups[p]), len(groups[q])))
        new = n + len(merges) - 1
        groups[new] = groups.pop(p) + groups.pop(q)
        for i in groups[new]:
            of[i] = new
    rows = {i: [i] for i in range(n)}
    for j, (_, p, q, _, _) in enumerate(merges):
        rows[n + j] = rows[p] + rows[q]
    density_of = lambda w: min(1 / w, 1e12) if w > 0 else 1e12
    tree, leaves, todo = [dict(up=-1, birth=0.0, kids=[], value=0.0)], {}, [(2 * n - 2, 0)]
    while todo:
        t, c = todo.pop()
        w, p, q, np_, nq = merges[t - n]
        level = density_of(w)
        if np_ >= m and nq >= m:
            for side, size in ((p, np_), (q, nq)):
                tree.append(dict(up=c, birth=level, kids=[], value=0.0))
                tree[c]["kids"].append(len(tree) - 1)
                tree[c]["value"] += size * (level - tree[c]["birth"])
                todo.append((side, len(tree) - 1))
            continue
        for side, size in ((p, np_), (q, nq)):
            if size >= m:
                todo.append((side, c))
                continue
            for i in rows[side]:
                leaves[i] = (c, level)
                tree[c]["value"] += level - tree[c]["birth"]
    taken = set()

    def choose(c):
        below = sum(choose(k) for k in tree[c]["kids"])
        if c and tree[c]["value"] >= below:
            taken.add(c)
            return tree[c]["value"]
        return max(below, tree[c]["value"])

    choose(0)
    own, level = np.full(n, -1), np.zeros(n)
    for i, (c, d) in leaves.items():
        best = -1
        while c > 0:
            if (method == "eom" and c in taken) or (method == "leaf" and not tree[c]["kids"]):
                best = c
            c = tree[c]["up"]
        if best > 0:
            own[i], level[i] = best, d
    number = {c: j for j, c in enumerate(sorted({*own} - {-1}, key=lambda c: np.flatnonzero(own == c)[0]))}
    top = {c: level[own == c].max() for c in number}
    return [(number.get(c, -1), level[i] / top[c] if c in top else 0.0) for i, c in enumerate(own)]


@pytest.mark.parametrize("n,dim,m,k,parts", [(2000, 8, 15, 5, 7), (160, 2, 6, 3, 1)])
def test_labels_equal_a_plain_version(spark, n, dim, m, k, parts):
    x, y = blobs(n, dim, 6, n)
    found = forest.spanning_forest(frame(spark, x, y, parts), min_samples=k)
    edges = plain_edges(plain_mutual(x, k))
    assert sorted(map(tuple, found.edges().collect())) == sorted(edges)
    tree = forest.cluster_tree(found, m)
    for method in ("eom", "leaf"):
        got = {r.id: (r.cluster_id, r.prob) for r in forest.labelled(found, tree, method).collect()}
        want = plain_labels(n, edges, m, method)
        assert [got[i][0] for i in range(n)] == [c for c, _ in want]
        assert max(abs(got[i][1] - p) for i, (_, p) in enumerate(want)) < 1e-9
        assert len({c for c, _ in want}) > 3


def test_few_rows(spark):
    df = frame(spark, np.zeros((1, 3)), np.zeros(1))
    assert [tuple(r)[:4] for r in density.density_clusters(df).collect()] == [(0, -1, 0.0, True)]
    assert density.density_clusters(df.where("vec_id < 0")).collect() == []
    same = frame(spark, np.ones((12, 3)), np.zeros(12))
    assert {r.cluster_id for r in density.density_clusters(same, min_cluster_size=3, min_samples=2).collect()} == {-1}


def test_too_many_clusters_is_an_error(spark):
    x, y = blobs(60, 2, 3, 1)
    found = forest.spanning_forest(frame(spark, x, y), min_samples=2)
    with pytest.raises(ValueError, match="min_cluster_size"):
        forest.cluster_tree(found, 2, most_clusters=3)


def test_memberships(spark):
    r = np.random.default_rng(4)
    centres, y = 3.0 * np.eye(3), np.arange(240) % 3
    away = np.repeat(np.eye(3), 4, axis=0) * 9 + r.normal(size=(12, 3))  # behind a centre, as seen from the others
    x, y = np.vstack([centres[y] + r.normal(size=(240, 3)) * 0.3, away]), np.append(y, np.repeat(range(3), 4))
    df = frame(spark, x, y)
    found = forest.spanning_forest(df, min_samples=5)
    tree = forest.cluster_tree(found, 12)
    labels = {r.id: r.cluster_id for r in forest.labelled(found, tree).collect()}
    truth = {labels[i]: y[i] for i in range(240) if labels[i] >= 0}
    assert set(truth.values()) == {0, 1, 2}
    rows = density.memberships(df, found, tree).toPandas()
    assert set(rows.id) == {i for i, c in labels.items() if c < 0}
    assert np.allclose(rows.groupby("id").membership.sum(), 1)
    best = rows.sort_values("membership").groupby("id").tail(1)
    right = [truth[r.cluster_id] == y[r.id] for r in best.itertuples()]
    assert len(right) > 5 and np.mean(right) == 1
    given = {r.vec_id: r for r in density.assign_noise(df, 0.4, 12, 5).collect()}
    for r in best.itertuples():
        assert (given[r.id].cluster_id, given[r.id].soft_assigned) == ((r.cluster_id, True) if r.membership >= 0.4 else (-1, False))


def plain_dbcv(x, y):
    ends, sparse, total = {}, {}, 0.0
    for c in [c for c in np.unique(y) if c >= 0 and (y == c).sum() > 1]:
        own = x[y == c]
        d = apart(own)
        with np.errstate(divide="ignore"):
            powers = np.where(d > 0, d ** -float(x.shape[1]), 0).sum(1) / (len(own) - 1)
        core = np.round(powers ** (-1 / x.shape[1]), 9)
        edges = plain_edges(np.maximum(d, np.maximum(core[:, None], core[None])))
        degree = np.bincount([i for _, *e in edges for i in e], minlength=len(own))
        inner = [w for w, a, b in edges if degree[a] > 1 and degree[b] > 1]
        sparse[c] = max(inner or [w for w, _, _ in edges])
        at = degree > 1 if (degree > 1).any() else degree > 0
        ends[c] = own[at], core[at]
    for c, (p, core) in ends.items():
        sep = min(np.maximum(np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)), np.maximum(core[:, None], other[None])).min() for o, (q, other) in ends.items() if o != c)
        total += (y == c).mean() * (sep - sparse[c]) / max(sep, sparse[c])
    return total


def test_dbcv_equals_a_plain_version(spark):
    x, y = blobs(1000, 4, 5, 9)
    y[np.flatnonzero(y == 4)[2:]] = -1  # a cluster of two rows
    assert density.dbcv(frame(spark, x, y)) == pytest.approx(plain_dbcv(x, y), abs=1e-7)
    assert density.dbcv(frame(spark, x, np.where(y == 0, 0, -1))) is None


def test_cells_of_parts_are_looked_up_by_spark(spark):
    x, y = blobs(300, 4, 3, 5)
    rows = frame(spark, x, y).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("vec_id").alias("g"), F.lit(0.0).alias("core"), (F.col("cluster_id") + 1).cast("int").alias("p"))
    ix = neighbours.build(rows, "euclidean", part="p")
    assert "Python" not in ix.rows._jdf.queryExecution().executedPlan().toString()
    own = {r.id: r.p for r in rows.collect()}
    got = ix.rows.collect()
    assert sorted(r.id for r in got) == sorted(own) and all(ix.part[r.cell] == own[r.id] and 0 <= r.block < ix.blocks[ix.group[r.cell]] for r in got)


@pytest.mark.parametrize("core", [0.0, 2.0])
def test_ties_are_not_held_all_at_once(core):
    # copies (core 0), or rows whose core distances hide the distances: every pair of a block is as good as the best
    rng = np.random.default_rng(4)
    v = np.tile(rng.normal(0, 0.1, 64), (2000, 1)) + (rng.normal(0, 0.01, (2000, 64)) if core else 0)
    rows = pd.DataFrame({"cell": 0, "id": rng.permutation(2000), "v": list(v), "g": -1, "core": core})
    asks = pd.DataFrame({"id": np.arange(500), "v": list(v[:500]), "g": -2, "core": core, "tau": np.nan, "cells": None})
    ix = neighbours.Index(None, v[:1].copy(), np.array([10.0]), np.array([1]), np.array([0.0]), "euclidean", np.array([0]), 2000)
    tracemalloc.start()
    got = neighbours._pieces(ix, None, neighbours._answers("euclidean", 3))(rows, asks)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6
    assert got.groupby("anchor").other.apply(list).tolist() == [[0, 1, 2]] * 500 and set(got.value) == {core}


def test_neighbours_exact_and_probed(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PROBES", 3)
    x, y = blobs(700, 6, 9, 2)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    s[y[:, None] == y[None]] = -9
    want = {i: [(int(j), s[i, j]) for j in np.lexsort((np.arange(700), -s[i]))[:4]] for i in range(700)}
    df = frame(spark, x, np.where(y == -1, 50, y))
    got: dict = {}
    for r in clusters.hard_negatives(df, k=4).orderBy("anchor", "rank").collect():
        got.setdefault(r.anchor, []).append((r.other, r.cosine))
    assert got == want
    rows = neighbours.prepared(df, "vec_id", "embedding")
    small = neighbours.build(rows, block=40)  # many blocks to a cell, few questions to a slice
    assert small.blocks.max() > 1
    asks = rows.withColumn("tau", F.lit(None).cast("double"))
    each = neighbours.best(neighbours.ask(small, asks, 2, slice_rows=30), 2).collect()
    d = np.round(u @ u.T, 6)
    np.fill_diagonal(d, -9)
    assert {(r.anchor, r["rank"]): (r.other, -r.value) for r in each} == {(i, k + 1): (int(j), d[i, j]) for i in range(700) for k, j in enumerate(np.lexsort((np.arange(700), -d[i]))[:2])}
    some = neighbours.nearest(neighbours.build(rows), rows, 5, probes=4)
    best = {i: set(np.lexsort((np.arange(700), -d[i]))[:5].tolist()) for i in range(700)}
    hits = sum(r.other in best[r.anchor] for r in some.collect())
    assert hits / 3500 >= 0.9


def test_silhouette_in_blocks_of_clusters(spark):
    x, y = blobs(150, 3, 7, 3)
    y[0:5], y[7] = 5, 9  # a cluster of one row
    df = frame(spark, x, y)
    assert clusters.silhouette(df, many=2).first() == clusters.silhouette(df).first()
    assert tuple(clusters.silhouette(df.where("cluster_id = -1")).first()) == (None, 0)
    assert clusters.silhouette(df.where("cluster_id = 3")).first().silhouette is None


def test_questions_are_sent_once_a_group_of_cells(spark):
    """Scattered rows, which no cell can be ruled out for: what is shuffled and held at once is bounded by groups, not by cells."""
    import pandas as pd

    x = np.random.default_rng(3).normal(size=(900, 12))
    rows = neighbours.prepared(frame(spark, x, np.zeros(900, int)), "vec_id", "embedding")
    ix = neighbours.build(rows, cells=30)
    assert len(ix.centres) == 30
    asks = pd.DataFrame({"id": np.arange(900), "v": list(x / np.linalg.norm(x, axis=1, keepdims=True)), "g": np.arange(900), "core": 0.0, "tau": np.nan})
    sent = [len(f) for f in neighbours._visits(ix, 0, None, None)(iter([asks]))]
    assert sum(sent) == 900  # a group of all rows; 27,000 if each cell is visited
    small = neighbours.build(rows, cells=30, block=100)
    sent = [len(f) for f in neighbours._visits(small, 0, None, None)(iter([asks] * 2))]
    assert sum(sent) <= 2 * 900 * 18 and max(sent) <= neighbours.SENT


def test_questions_need_no_further_python_process(spark):
    """What Spark can look up itself isn't looked up in Python: each such function is one more process a task, beside the two that compare."""
    x, y = blobs(120, 3, 4, 5)
    rows = neighbours.prepared(frame(spark, x, y), "vec_id", "embedding", metric="euclidean").localCheckpoint()
    ix = neighbours.build(rows, "euclidean", block=20)
    plan = neighbours.ask(ix, rows.withColumn("tau", F.lit(None).cast("double")), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInPandas") == 1
    assert ix.rows.select("id").distinct().count() == 120 and len(ix.blocks) > 1


def test_largest_memberships_without_a_row_a_pair(spark):
    """Those of ``memberships``, from one row a part and row of noise, whatever the number of clusters; heights as by climbing."""
    x, y = blobs(500, 3, 12, 9, 0.4)
    x[480:490] = x[:10]  # copies
    df = frame(spark, x, y)
    found = forest.spanning_forest(df, min_samples=3)
    tree = forest.cluster_tree(found, 4)
    nodes = tree.chosen("leaf")
    height = density._heights(tree.parent, tree.birth, tree.children, nodes)

    def up(v):
        out, last = {}, np.inf
        while v >= 0:
            out[v], last, v = last, tree.birth[v], tree.parent[v]
        return out

    for v in range(len(tree.parent)):
        mine = up(v)
        if len(set(mine) & set(nodes)) == 0:
            meets = [next((mine[a], up(c)[a]) for a in mine if a in up(c)) for c in nodes]
            assert height(v).tolist() == [min(m) for m in meets]
    rows = density.memberships(df, found, tree, "leaf").toPandas()
    assert rows.cluster_id.nunique() > 5 and np.allclose(rows.groupby("id").membership.sum(), 1)
    want = rows.sort_values(["membership", "cluster_id"], ascending=[True, False]).groupby("id").tail(1).set_index("id")
    for block in (None, 6):
        got = density.largest_memberships(df, found, tree, "leaf", block=block).toPandas().set_index("id").loc[want.index]
        assert np.allclose(got.membership, want.membership) and (got.cluster_id == want.cluster_id).all()
    schema = "anchor long, touch boolean, total double, top double, other long"
    sent = density._compared(df, found, tree, "leaf", "vec_id", "embedding", density._largest, schema)
    assert sent.count() == rows.id.nunique() < len(rows)


@pytest.mark.parametrize("metric,scale,shift", [("euclidean", 1.0, 0.0), ("euclidean", 1e-4, 3.0), ("euclidean", 1e9, 0.0), ("euclidean", 1e-20, 0.0), ("cosine", 1.0, 0.0)])
def test_questions_with_bounds_are_sifted_in_single_precision(monkeypatch, metric, scale, shift):
    """Answers are those of all pairs made in double precision, which few pairs need; no whole block of distances is made."""
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(450, 16)), 2, 0) * scale + shift  # each row twice
    if metric == "cosine":
        x /= np.sqrt((x * x).sum(1))[:, None]
    d = np.round(-(x[:, None] * x[None]).sum(2) if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), neighbours.DIGITS[metric])
    core = np.sort(d, 1)[:, 4] if metric == "euclidean" else np.zeros(len(x))
    if metric == "euclidean":
        d = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d))[:, :3]
    tau = np.take_along_axis(d, order, 1)[:, -1]
    rows = pd.DataFrame({"cell": 0, "id": np.arange(len(x)), "v": neighbours._packed(x), "g": np.arange(len(x)), "core": core})
    ix = neighbours.Index(None, x.mean(0)[None], np.array([np.inf]), np.array([1]), np.array([0.0]), metric, np.array([0]), len(x))
    asked = rows.assign(tau=tau, cells=None)
    made, whole = [0], neighbours._apart
    monkeypatch.setattr(neighbours, "_apart", lambda a, b: made.__setitem__(0, made[0] + (len(b) > 1) * len(a) * len(b)) or whole(a, b))
    got = neighbours._pieces(ix, None, neighbours._answers(metric, 3))(rows, asked).sort_values(["anchor", "value", "other"])
    assert got.other.tolist() == order.ravel().tolist() and got.value.tolist() == np.take_along_axis(d, order, 1).ravel().tolist()
    assert scale < 1e-4 or shift or made[0] == 0


def test_index_and_questions_hold_vectors_as_bytes(spark):
    x, y = blobs(300, 4, 3, 5)
    rows = neighbours.prepared(frame(spark, x, y), "vec_id", "embedding", metric="euclidean")
    ix = neighbours.build(rows, "euclidean")
    assert ix.rows.schema["v"].dataType.simpleString() == "binary"
    assert {r.id: np.frombuffer(r.v).tolist() for r in ix.rows.collect()} == {i: v.tolist() for i, v in enumerate(x)}


def test_heights_of_a_long_tree_take_one_step_a_node():
    class Counted(list):
        looked = 0

        def __getitem__(self, i):
            Counted.looked += 1
            return super().__getitem__(i)

    n = 1500
    parent, birth, children, now = np.full(2 * n - 1, -1), np.zeros(2 * n - 1), [[] for _ in range(2 * n - 1)], 0
    for i in range(1, n):
        up = n + i - 1
        children[up], parent[[now, i]], birth[[now, i]], now = [now, i], up, 2 - i / n, up
    height = density._heights(parent, birth, Counted(children), list(range(n)))
    Counted.looked = 0
    got = [height(k) for k in range(2 * n - 2, n - 1, -1)]
    assert Counted.looked < 20 * n
    for k in (0, 700, n - 2):  # the split that took leaf i off has the density of both sides
        split = n + len(got) - 1 - k
        assert got[k].tolist() == [2 - max(i, split - n + 1, 1) / n for i in range(n)]


def test_settings_of_a_sweep_are_judged_side_by_side(spark, monkeypatch):
    import threading

    x, y = blobs(90, 3, 3, 8)
    both = threading.Barrier(2, timeout=60)
    found = density.dbcv
    monkeypatch.setattr(density, "dbcv", lambda *a: both.wait() * 0.0 + found(*a))
    rows = density.sweep(frame(spark, x, y), [5], [3], ["eom", "leaf"]).collect()
    assert [r.selection_method for r in rows] == ["eom", "leaf"] and all(r.dbcv is not None for r in rows)
