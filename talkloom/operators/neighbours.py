"""Nearest rows by an inverted-file index of vectors: approximate with a number of cells to probe, or exact.

Cells are fitted on a hash sample of at most ``SAMPLE`` rows; every row is filed in the cell of its nearest centre, with its
distance to it. A question visits cells in the order of the least distance that any of a cell's rows can have to it (distance
to the centre less the cell's radius, by the triangle inequality; of equal ones the nearer centre first). The approximate mode
ends after the first cells; the exact mode then asks all cells that could still better a question's last answer. Cells near each
other make groups of some ``GROUPS``-th of the rows, and questions meet rows by an equality join on the group: a question is sent
once a group, not once a cell, so what is shuffled is at most some ``GROUPS`` times the rows. Inside, cells are compared one
at a time, each with the questions that it can still better. Groups and their questions are dealt into blocks of bounded size, so
a hot cell is many tasks. All rows are filed and every question is answered; nothing is collected but centres and one summary
a cell.

Answers are rounded values (cosine to 6 digits, distance to 9), ties to the smaller id, and so don't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.sources.scratch import cut, drop_cut

SAMPLE = 16_384
MOST_CELLS = 1024
#: Rows of a group, and questions that it is asked at once: a part of all, between these bounds.
GROUPS, LEAST_BLOCK, MOST_BLOCK = 24, 2000, 32_768
#: Rows and questions compared at once; rows and questions looked at together for cells; questions sent on at once.
PIECE, STEP, LOOK, SENT = 1024, 1000, 2_000_000, 10_000
#: Pairs of a question and a row that are held at once, and those whose distances are made exactly at once.
HITS, EXACT = 1 << 18, 1 << 15
#: One pair in so many, at most, is looked at alone; else distances of all are made together.
FEW = 16
PROBES = 8
SLACK = 1e-8
#: Answers are compared as these values, smaller is better.
DIGITS = {"cosine": 6, "euclidean": 9}


@dataclass
class Index:
    """``rows``: (cell, block, id, v, g, core), ``v`` as bytes; by cell: centre, radius, least core distance, group; by group: number of blocks.
    ``part``: whose rows a cell holds, where each part has cells of its own and questions (with a column ``p``) stay in theirs.
    ``block``: rows of a block, about."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    core: np.ndarray
    metric: str
    group: np.ndarray
    block: int
    part: np.ndarray | None = None

    def drop(self) -> None:
        drop_cut(self.rows)


def _looked_up(values, place: str) -> Column:
    """The integer of ``values`` at the place that a column holds: by Spark itself, as each function in Python is one more process a task."""
    return F.get(F.array(*[F.lit(int(x)) for x in values]), F.col(place))


def _stack(values) -> np.ndarray:
    """Vectors, as arrays or as the bytes of doubles: an index and the questions sent to it have bytes, which cost Spark and Arrow far less."""
    values = list(values)
    if values and isinstance(values[0], bytes):
        return np.frombuffer(b"".join(values)).reshape(len(values), -1)
    return np.stack([np.asarray(v, float) for v in values])


def _packed(x: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in x]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by one product of matrices; good to 1e-7 or so."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def _centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of the sample ``x``, spread first and then moved to the means."""
    picked, far = [0], np.full(len(x), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
        picked.append(int(far.argmax()))
    c = x[np.unique(picked)]
    for _ in range(rounds):
        at = _apart(x, c).argmin(1)
        for i in range(len(c)):
            if (at == i).any():
                c[i] = x[at == i].mean(0)
    return c


def prepared(df: DataFrame, uid: str, vector: str, group: str | None = None, core: str | None = None, metric: str = "cosine") -> DataFrame:
    """(id, v, g, core) for an index or for questions. ``g``: rows of an equal one don't answer each other (default: the id)."""
    v = F.col(vector).cast("array<double>")
    if metric == "cosine":
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        v = F.transform(v, lambda x: x / F.greatest(length, F.lit(1e-10)))
    return df.select(F.col(uid).alias("id"), v.alias("v"), F.col(group or uid).alias("g"), F.col(core).cast("double").alias("core") if core else F.lit(0.0).alias("core"))


def _grouped(centres: np.ndarray, n: np.ndarray, block: int, part: np.ndarray | None) -> np.ndarray:
    """The group of each cell: cells are halved along the axis on which they differ most until at most ``block`` rows are left;
    those of parts follow each other instead."""
    if part is not None:
        order = np.argsort(part, kind="stable")
        out = np.empty(len(n), int)
        out[order] = (n[order].cumsum() - 1) // block
        return np.unique(out, return_inverse=True)[1]
    out, left, found = np.zeros(len(n), int), [np.arange(len(n))], 0
    while left:
        c = left.pop()
        if len(c) == 1 or n[c].sum() <= block:
            out[c], found = found, found + 1
            continue
        c = c[np.argsort(centres[c][:, centres[c].var(0).argmax()], kind="stable")]
        half = n[c].cumsum()
        at = min(max(int(np.searchsorted(half, half[-1] / 2)), 1), len(c) - 1)
        left += [c[:at], c[at:]]
    return out


def build(rows: DataFrame, metric: str = "cosine", cells: int | None = None, block: int | None = None, part: str | None = None) -> Index | None:
    """The index over ``prepared`` rows: the square root of their number of cells, ``MOST_CELLS`` at most, or so many for each
    value of ``part``, a column of integers. None without rows."""
    n = rows.count()
    if not n:
        return None
    block = block or min(max(n // GROUPS, LEAST_BLOCK), MOST_BLOCK)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    base = _centres(_stack(r.v for r in sample), min(cells or MOST_CELLS, max(1, math.isqrt(n)), len(sample)))

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), STEP):
                x = _stack((one := f.iloc[i : i + STEP].copy()).v)
                one["v"], one["at"] = _packed(x), _apart(x, base).argmin(1).astype(np.int32)
                one["r"] = np.sqrt(((x - base[one["at"]]) ** 2).sum(1))
                yield one

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"v": "binary"}
    names = ["id", "v", "g", "core"]
    of = F.col(part) if part else F.lit(0)
    filed = rows.select(*names, of.cast("long").alias("p"))
    filed = cut(filed.mapInPandas(file, ", ".join(f"{c} {kinds[c]}" for c in names) + ", p long, at int, r double"), "index")
    found = sorted(filed.groupBy("p", "at").agg(F.max("r").alias("r"), F.count("*").alias("n"), F.min("core").alias("c")).collect(), key=lambda r: (r.p, r["at"]))
    number = {(r.p, r["at"]): i for i, r in enumerate(found)}
    arrays = [np.array([f(r) for r in found]) for f in (lambda r: r.r, lambda r: r.c, lambda r: r.p, lambda r: r.n)]
    centres = base[[r["at"] for r in found]]
    group = _grouped(centres, arrays[3], block, arrays[2] if part else None)
    blocks = np.ceil(np.bincount(group, arrays[3]) / block).astype(int)

    if part:
        numbers = [(r.p, r["at"], i, int(blocks[group[i]])) for i, r in enumerate(found)]
        placed = filed.join(rows.sparkSession.createDataFrame(numbers, "p long, at int, cell int, _blocks int"), ["p", "at"])
        of_block = F.col("_blocks")
    else:
        placed = filed.withColumn("cell", _looked_up([number.get((0, i), -1) for i in range(len(base))], "at"))
        of_block = _looked_up(blocks[group], "cell")
    dealt = placed.select(*names, "cell", F.pmod(F.xxhash64("id"), of_block).cast("int").alias("block"))
    dealt._scratch_path = filed._scratch_path
    return Index(dealt, centres, arrays[0], blocks, arrays[1], metric, group, block, arrays[2] if part else None)


def _can(ix: Index, owner: list | None):
    """Least distances of questions to ``cells`` (numbers), inf where there can be no answer, and to their centres; not to other
    parts' cells, and not to one whose rows all belong to the ``owner`` that asks."""
    centres, radius, least, part = ix.centres, ix.radius, ix.core, ix.part
    if owner is not None:
        owned = np.array([x is not None for x in owner])
        owners = np.array([x if x is not None else 0 for x in owner])

    def of(f: pd.DataFrame, v: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = _apart(v, centres[cells])
        low = np.maximum(far - radius[cells] - SLACK, 0)
        low = np.maximum(low, np.maximum(f.core.to_numpy(float)[:, None], least[cells][None]) - SLACK)
        if part is not None:
            low[f.p.to_numpy()[:, None] != part[cells][None]] = np.inf
        if owner is not None:
            low[(f.g.to_numpy()[:, None] == owners[cells][None]) & owned[cells][None]] = np.inf
        return low, far

    return of


def _within(tau: np.ndarray, metric: str) -> np.ndarray:
    """How far rows can be that are as good as ``tau``: a cosine of -tau is so far on the sphere."""
    return np.sqrt(np.maximum(np.where(np.isfinite(tau), 2 + 2 * tau + 2e-6, np.inf), 0)) if metric == "cosine" else tau


def _visits(ix: Index, first: int, last: int | None, owner: list | None, counted: bool = False):
    """Rows of questions for each group with cells, of those ranked ``first`` to ``last``, that can hold an answer as good as
    ``tau``; ``cells`` names them unless all ranks count. ``counted``: the number of such rows by group instead."""
    can, metric, group = _can(ix, owner), ix.metric, ix.group
    parts = None if ix.part is None else {p: np.flatnonzero(ix.part == p) for p in np.unique(ix.part)}
    every, ranked, groups = np.arange(len(ix.centres)), bool(first) or last is not None, len(ix.blocks)

    def seen(f: pd.DataFrame):
        """Questions of one part a time, with (question, cell) of their visits."""
        for p, of_part in [(None, f)] if parts is None else f.groupby("p"):
            cells = every if parts is None else parts.get(p, every[:0])
            step = max(1, LOOK // max(1, len(cells)))
            for i in range(0, len(of_part) if len(cells) else 0, step):
                one = of_part.iloc[i : i + step]
                low, far = can(one, x := _stack(one.v), cells)
                if not counted:
                    one = one.assign(v=_packed(x))
                ok = (low <= _within(one.tau.fillna(np.inf).to_numpy(float), metric)[:, None] + SLACK) & np.isfinite(low)
                if ranked:
                    rank = np.empty(low.shape, np.int32)
                    np.put_along_axis(rank, np.lexsort((far, low), axis=1).astype(np.int32), np.arange(len(cells), dtype=np.int32)[None], 1)
                    ok &= (rank >= first) & (rank < (last or len(every)))
                r, c = np.nonzero(ok)
                yield one, r, cells[c]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(groups, int)
        for f in frames:
            for one, r, c in seen(f):
                by = np.lexsort((c, group[c], r))
                r, c = r[by], c[by]
                new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (group[c[1:]] != group[c[:-1]])]) if len(r) else np.zeros(0, int)
                if counted:
                    counts += np.bincount(group[c[new]], minlength=groups)
                    continue
                end = np.r_[new[1:], len(r)]
                for i in range(0, len(new), SENT):
                    out = one.iloc[r[new[i : i + SENT]]].reset_index(drop=True)
                    out["group"] = group[c[new[i : i + SENT]]].astype(np.int32)
                    out["cells"] = [c[x:y].astype(np.int32) for x, y in zip(new[i : i + SENT], end[i : i + SENT], strict=True)] if ranked else None
                    yield out
        if counted:
            yield pd.DataFrame({"group": np.flatnonzero(counts).astype(np.int32), "n": counts[counts > 0]})

    return of


def _pieces(ix: Index, owner: list | None, take):
    """Calls ``take(rows, asks, pieces)`` with a block's rows in the order of cell and id; ``pieces()`` are (some of the questions, their
    vectors, their least distances to each cell of the block, the beginning and end of its rows, ``PIECE`` a time, distances to
    centres). A cell that isn't a question's is at inf."""
    can = _can(ix, owner)

    def of(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cell", "id"], ignore_index=True)
        if "p" in asks:
            asks = asks.sort_values("p", ignore_index=True)
        cell = rows.cell.to_numpy()
        cells, begin = np.unique(cell, return_index=True)
        spans = [[(a, min(a + PIECE, z)) for a in range(i, z, PIECE)] for i, z in zip(begin, [*begin[1:], len(rows)], strict=True)]

        def pieces():
            step = max(1, min(STEP, LOOK // max(1, len(cells))))
            for i in range(0, len(asks) if len(cells) else 0, step):
                part = asks.iloc[i : i + step]
                q = _stack(part.v)
                low, far = can(part, q, cells)
                if len(part) and part["cells"].iloc[0] is not None:
                    named = np.zeros(low.shape, bool)
                    some, of_ask = np.concatenate(list(part["cells"])), np.repeat(np.arange(len(part)), part["cells"].map(len))
                    at = np.minimum(np.searchsorted(cells, some), len(cells) - 1)
                    on = cells[at] == some
                    named[of_ask[on], at[on]] = True
                    low[~named] = np.inf
                yield part, q, low, spans, far

        return take(rows, asks, pieces)

    return of


def _sieve(x: np.ndarray, metric: str):
    """For questions which rows of ``x`` can be as near as their bounds, by products of matrices in single precision: all that are, and
    few others, as their errors (a sum of ``n`` products is good to n / 2 ** 24 of their sizes; twice that is allowed) count for the
    row. None for values that single precision doesn't hold."""
    middle = x.mean(0) if metric == "euclidean" else np.zeros(x.shape[1])
    y = x - middle
    half = (y * y).sum(1) / 2
    most, error = float(np.sqrt(2 * half.max())), (x.shape[1] + 8) / 2**23
    rows = np.hstack([y, -half[:, None] if metric == "euclidean" else np.zeros((len(y), 1))]).astype(np.float32) if most < 1e15 else None

    def of(q: np.ndarray):
        z = q - middle
        n = (z * z).sum(1)
        if rows is None or not (n < 1e30).all():
            return lambda *_: None
        asks = np.hstack([z, np.ones((len(z), 1))]).astype(np.float32)
        spread = error * (np.sqrt(n) * most + most * most / 2)

        def near(w: np.ndarray, a: int, z: int, bound: np.ndarray) -> np.ndarray | None:
            if not np.isfinite(bound).all():
                return None
            need = (n[w] - (bound + 1e-5) ** 2) / 2 if metric == "euclidean" else -bound - 1e-5
            need = need - spread[w] - error * np.abs(need) - 1e-30
            return asks[w] @ rows[a:z].T >= need.astype(np.float32)[:, None]

        return near

    return of


def _answers(metric: str, k: int, shared: bool = False):
    """The ``k`` best of a block for each question.
    ``shared`` (one answer each): what is best for one question of a ``g`` bounds all of them, worse ones are left out."""
    digits = DIGITS[metric]

    def of(rows: pd.DataFrame, asks: pd.DataFrame, pieces) -> pd.DataFrame:
        none = pd.DataFrame({"anchor": asks.id.iloc[:0], "other": rows.id.iloc[:0], "value": pd.Series([], dtype=float)})
        if rows.empty or asks.empty:
            return none
        x, core, g, ids = _stack(rows.v), rows.core.to_numpy(float), rows.g.to_numpy(), rows.id.to_numpy()
        sieve = _sieve(x, metric)
        found = []
        for part, q, low, spans, far in pieces():
            sifted = sieve(q)
            qcore, anchors = part.core.to_numpy(float), part.id.to_numpy()
            mine = part.g.to_numpy()
            tau = part.tau.fillna(np.inf).to_numpy(float)
            few = np.unique(mine, return_inverse=True)[1] if shared else None
            best, hits, held = np.full((len(part), k), np.inf), [], 0
            kept = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

            def least(r, j, qcore=qcore):
                """What the distance of a pair counts as at least."""
                return np.maximum(qcore[r], core[j]) if metric == "euclidean" else np.full(len(r), -np.inf)

            def exact(r, j, q=q):
                out = np.empty(len(r))
                for i in range(0, len(r), EXACT):
                    a, b = q[r[i : i + EXACT]], x[j[i : i + EXACT]]
                    out[i : i + EXACT] = -(a * b).sum(1) if metric == "cosine" else np.sqrt(((a - b) ** 2).sum(1))
                return out

            def better(w, fresh, best=best):
                best[w] = np.sort(np.partition(np.concatenate([best[w], fresh], 1), k - 1, axis=1)[:, :k], axis=1)

            def near(hits, tau=tau, best=best, least=least):
                r, j, apart = (np.concatenate(h) for h in zip(*hits, strict=True))
                on = np.maximum(apart, least(r, j)) <= np.minimum(tau, best[:, -1])[r] + 1e-5
                return r[on], j[on], apart[on]

            def settled(hits, kept, exact=exact, near=near, least=least):
                """The ``k`` best of each question among ``hits`` and what is ``kept`` of earlier ones, exactly."""
                r, j, apart = near(hits)
                value = least(r, j)
                # distances that are surely under what they count as are never made
                some = np.flatnonzero(apart >= value - 1e-5)
                value[some] = np.maximum(exact(r[some], j[some]), value[some])
                r, j, value = (np.concatenate(h) for h in zip(kept, (r, j, np.round(value, digits)), strict=True))
                order = np.lexsort((ids[j], value, r))
                r, j, value = r[order], j[order], value[order]
                first = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
                return r[first], j[first], value[first]

            for c in np.argsort(np.where(np.isfinite(low), low + 1e-3 * far, np.inf).min(0), kind="stable"):
                for a, z in spans[c]:
                    bound = np.minimum(tau, best[:, -1])
                    w = np.flatnonzero((low[:, c] <= _within(bound, metric) + SLACK) & np.isfinite(low[:, c]))
                    if not len(w):
                        break
                    close = sifted(w, a, z, bound[w])
                    if close is not None and np.count_nonzero(close) * FEW <= close.size:
                        r, j = np.divmod(np.flatnonzero(close), z - a)
                        r, j = w[r], a + j
                        on = (mine[r] != g[j]) & (least(r, j) <= bound[r] + 1e-5)
                        r, j = r[on], j[on]
                        apart = exact(r, j)
                        on = apart <= bound[r] + 1e-5
                        r, j, apart = r[on], j[on], apart[on]
                        if not len(r):
                            continue
                        hits.append((r, j, apart))
                        asked, start, count = np.unique(r, return_index=True, return_counts=True)
                        rough = np.full((len(asked), count.max()), np.inf)
                        rough[np.repeat(np.arange(len(asked)), count), np.arange(len(r)) - np.repeat(start, count)] = np.maximum(apart, least(r, j))
                        better(asked, rough)
                    else:
                        apart = -(q[w] @ x[a:z].T) if metric == "cosine" else _apart(q[w], x[a:z])
                        rough = apart if metric == "cosine" else np.maximum(apart, np.maximum(qcore[w, None], core[None, a:z]))
                        ok = rough <= bound[w, None] + 1e-5
                        some = np.flatnonzero(ok.any(1))
                        if not len(some):
                            continue
                        ok, rough = ok[some] & (mine[w[some], None] != g[None, a:z]), rough[some]
                        r, j = np.nonzero(ok)
                        if not len(r):
                            continue
                        hits.append((w[some[r]], a + j, apart[some[r], j]))
                        rough[~ok] = np.inf
                        better(w[some], rough)
                    if shared:
                        of_all = np.full(few.max() + 1, np.inf)
                        np.minimum.at(of_all, few, best[:, -1])
                        best[:, -1] = of_all[few]
                    held += len(r)
                    if held > HITS:  # equal rows and equal core distances are ties, which may be all pairs of a block
                        hits = [near(hits)]
                        held = len(hits[0][0])
                        if held > HITS // 2:
                            kept, hits, held = settled(hits, kept), [], 0
            if not hits and not len(kept[0]):
                continue
            r, j, value = settled(hits, kept) if hits else kept
            found.append(pd.DataFrame({"anchor": anchors[r], "other": ids[j], "value": value}))
        return pd.concat(found, ignore_index=True) if found else none

    return of


def ask(ix: Index, asks: DataFrame, k: int, first: int = 0, last: int | None = None, owner: list | None = None, slice_rows: int | None = None, shared: bool = False, kernel=None, schema: str | None = None) -> DataFrame:
    """(anchor, other, value): for each of ``asks`` (id, v, g, core, tau) the ``k`` best of each block it visits, as good as ``tau``;
    ``shared``: see ``_answers``. ``kernel`` puts another function of a
    block's rows and questions in place of that."""
    kinds = {f.name: f.dataType.simpleString() for f in asks.schema} | {"v": "binary"}
    other = ix.rows.schema["id"].dataType.simpleString()
    visits = asks.mapInPandas(_visits(ix, first, last, owner), ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", group int, cells array<int>")
    counts = {r.group: r.n for r in asks.mapInPandas(_visits(ix, first, last, owner, True), "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()}
    slices = [math.ceil(counts.get(c, 0) / (slice_rows or ix.block)) for c in range(len(ix.blocks))]
    slices_of, blocks_of, group_of = (lambda place, of=of: _looked_up(of, place) for of in (slices, ix.blocks, ix.group))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = ["group", "block", "slice"]
    left = ix.rows.withColumn("group", group_of("cell")).withColumn("_n", slices_of("group")).where("_n > 0").withColumn("slice", upto(F.col("_n"))).select(*keys, "cell", "id", "v", "g", "core")
    right = visits.withColumns({"_n": slices_of("group"), "_m": blocks_of("group")}).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).withColumn("block", upto(F.col("_m"))).select(*keys, *kinds, "cells")
    take = _pieces(ix, owner, kernel or _answers(ix.metric, k, shared))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(take, schema or f"anchor {kinds['id']}, other {other}, value double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor, with their rank."""
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy("value", "other")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(ix: Index, asks: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(anchor, other, value, rank) of each of ``asks`` (id, v, g, core), exactly; with ``probes``, from so many cells alone."""
    asks = cut(asks.withColumn("tau", F.lit(None).cast("double")), "asks")
    now = cut(best(ask(ix, asks, k, 0, probes or PROBES), k), "answers")
    if probes or len(ix.centres) <= PROBES:
        return now
    kth = now.where(F.col("rank") == k).select(F.col("anchor").alias("id"), F.col("value").alias("tau"))
    bounded = cut(asks.drop("tau").join(kth, "id", "left").select(*asks.columns), "asks")
    after = cut(best(ask(ix, bounded, k), k), "answers")  # finds again what the first cells hold of it
    for x in (asks, now, bounded):
        drop_cut(x)
    return after


def _powers(rows: pd.DataFrame, asks: pd.DataFrame, pieces) -> pd.DataFrame:
    """Of each question the largest exponent and the sum of powers, relative to it, over the rows of a block."""
    none = pd.DataFrame({"anchor": asks.id.iloc[:0], "m": pd.Series([], dtype=float), "t": pd.Series([], dtype=float)})
    if rows.empty or asks.empty:
        return none
    x, out = _stack(rows.v), [none]
    for part, q, low, spans, _ in pieces():
        reach = part.tau.fillna(np.inf).to_numpy(float)
        m, t = np.full(len(part), -np.inf), np.zeros(len(part))
        for c, span in enumerate(spans):
            w = np.flatnonzero((low[:, c] <= reach + SLACK) & np.isfinite(low[:, c]))
            for a, z in span if len(w) else ():
                d = _apart(q[w], x[a:z])
                r, j = np.nonzero(d < 1e-3)  # where the product of matrices isn't exact enough
                d[r, j] = np.sqrt(((q[w[r]] - x[a + j]) ** 2).sum(1))
                with np.errstate(divide="ignore"):
                    e = np.where(d > 0, -q.shape[1] * np.log(d), -np.inf)
                top = np.maximum(m[w], e.max(1))
                safe = np.where(np.isfinite(top), top, 0)
                t[w] = t[w] * np.exp(m[w] - safe) + np.exp(e - safe[:, None]).sum(1)
                m[w] = top
        some = np.isfinite(m)
        out.append(pd.DataFrame({"anchor": part.id.to_numpy()[some], "m": m[some], "t": t[some]}))
    return pd.concat(out, ignore_index=True)


def _added(parts: DataFrame) -> DataFrame:
    top = F.max("m").over(Window.partitionBy("anchor"))
    return parts.withColumn("_top", top).groupBy("anchor").agg((F.max("_top") + F.ln(F.sum(F.col("t") * F.exp(F.col("m") - F.col("_top"))))).alias("s"))


def power_sums(rows: DataFrame, rest: float = 1e-12) -> DataFrame:
    """(id, s): the logarithm of the sum, over the rows of the same ``g`` (an integer) at a distance above 0, of the distance to
    the power -dimension. ``rows``: (id, g, v). Cells so far that all their rows could add but ``rest`` of the sum are left out."""
    p = cut(rows.select("id", "v", "g", F.lit(0.0).alias("core"), F.col("g").cast("long").alias("p")), "powers")
    ix = build(p, "euclidean", part="p")
    kind = p.schema["id"].dataType.simpleString()
    schema = f"anchor {kind}, m double, t double"
    blank = p.withColumn("tau", F.lit(None).cast("double"))
    first = cut(_added(ask(ix, blank, 0, 0, PROBES, kernel=_powers, schema=schema)), "powers-first")
    n = p.groupBy("p").count()
    reach = F.exp((F.ln("count") - F.ln(F.lit(rest)) - F.col("s")) / F.size("v"))
    wide = p.join(n, "p").join(first.withColumnRenamed("anchor", "id"), "id", "left").select(*p.columns, reach.alias("tau"))
    return _added(ask(ix, cut(wide, "powers-asks"), 0, kernel=_powers, schema=schema)).withColumnRenamed("anchor", "id")
