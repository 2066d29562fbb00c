"""Whitened embeddings: principal components by a blockwise TSQR and one-sided Jacobi rotations.

Each task turns its rows, centred exactly, into the triangle R of a QR factorization, block after block; triangles of tasks
are stacked and factorized again, sixteen at a time, until the driver gets the last sixteen or fewer (each as large as the
dimension squared, whatever the rows). Plane rotations then make R's columns orthogonal: their norms are the singular values,
which so are accurate without the covariance ever being formed, and the rotations accumulated give the components.

Rows are integers, so counts, sums and deviations are exact and centring is one rounding an entry. The fit list is each
distinct vector once. A component's sign is such that its entry of largest size (the first of equals) is positive.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped; rows with a null or a
repeated id are reported each; a component without variance (there are fewer distinct vectors than dimensions, or a constant
dimension) is reported with ``whitened`` null and ``explained`` 0, and counts for no ``identity_error``; a vector of d entries
has min(d, 16) components; a deviation that doesn't fit in 64 bits is null; an empty table gives no rows. Vectors of several
lengths, or with entries of 2^40 or more, raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.vectorcodes import _matrix, finite
from talkloom.sources.scratch import cut, drop_cut

UNIT = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Triangles that are stacked in one task.
FAN = 16
ROWS = 4096


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, components as columns) of ``r`` by one-sided rotations.

    The pairs of a round are disjoint (a round-robin tournament of columns) and are rotated together; sweeps end when every
    pair is orthogonal to rounding.
    """
    d = r.shape[1]
    m = d + d % 2
    a = np.zeros((r.shape[0], m))
    a[:, :d] = r
    v = np.eye(m)
    order = np.arange(m)
    close = np.finfo(float).eps
    for _ in range(sweeps):
        rotated = False
        for _ in range(m - 1):
            p, q = order[: m // 2], order[m // 2 :][::-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(xy) > close * np.sqrt(xx * yy)
            if turn.any():
                rotated = True
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    z = (yy - xx) / (2 * xy)
                    t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
                t = np.where(turn, t, 0.0)
                c = 1 / np.hypot(1, t)
                s = c * t
                for w in (a, v):
                    f, g = w[:, p], w[:, q]
                    w[:, p], w[:, q] = c * f - s * g, s * f + c * g
            order = np.concatenate([order[:1], np.roll(order[1:], 1)])
        if not rotated:
            break
    norms = np.sqrt((a * a).sum(0))[:d]
    by = np.argsort(-norms, kind="stable")
    v = v[:d, :d][:, by]
    size = np.abs(v)
    sign = np.sign(v[(size >= size.max(0) * (1 - 1e-9)).argmax(0), np.arange(d)])
    return norms[by], v * np.where(sign == 0, 1, sign)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - total / n with one rounding."""
    return (n * x - total) / float(n)


def _triangles(n: int, total: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64)
            for i in range(0, len(x), ROWS):
                block = centred(x[i : i + ROWS], n, total)
                r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    return of


def _stacked(rows: list, d: int) -> np.ndarray:
    return np.linalg.qr(np.vstack([np.array(r).reshape(-1, d) for r in rows]), mode="r")


def triangle(fit: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """R of the centred rows of ``fit``."""
    d = len(total)
    rs = cut(fit.mapInArrow(_triangles(n, total), "part long, r array<double>"), "whiten-r")
    while rs.count() > FAN:

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            return pd.DataFrame({"part": [pdf.part.iloc[0] // FAN], "r": [_stacked(pdf.r.tolist(), d).ravel()]})

        after = cut(rs.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(merge, "part long, r array<double>"), "whiten-r")
        drop_cut(rs)
        rs = after
    rows = sorted(rs.collect(), key=lambda r: r.part)
    drop_cut(rs)
    return _stacked([r.r for r in rows], d)


def _products(n: int, total: np.ndarray, axes: np.ndarray):
    """Of each task the sums of the whitened entries (i = -1) and of their products."""
    k = axes.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centred(_matrix(batch.column("x"), np.int64), n, total) @ axes
            one += w.sum(0)
            two += w.T @ w
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(k, -1), i.ravel()]), pa.int32()), pa.array(np.concatenate([np.arange(k), j.ravel()]), pa.int32()), pa.array(np.concatenate([one, two.ravel()]))], names=["i", "j", "s"]
        )

    return of


def _deviations(d: np.ndarray) -> list[int | None]:
    if (d.astype(float) ** 2).sum(1).max(initial=0) < 2.0**62:
        return (d * d).sum(1).tolist()
    exact = [sum(v * v for v in row) for row in d.tolist()]
    return [x if x < 1 << 63 else None for x in exact]


def _rows(n: int, total: np.ndarray, axes: np.ndarray, components: int, names: list[str]):
    """Each row for each component; ``axes`` holds those with variance."""
    k = axes.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                x = _matrix(batch.column("x"), np.int64)
                if x.shape[1] != len(total):
                    raise ValueError("vectors differ in length")
                w = np.full((len(x), components), np.nan)
                w[:, :k] = centred(x, n, total) @ axes
                each = np.repeat(np.arange(len(x)), components)
                deviation = pa.array(_deviations(n * x - total), pa.int64()).take(pa.array(each))
                flat = pa.array(w.ravel(), mask=np.tile(np.arange(components) >= k, len(x)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, components + 1), len(x)), pa.int32()), deviation, flat], names=names)

    return of


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that are kept."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * UNIT) + SHIFT)
    return df.where(finite(F.col(vector))).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``integers`` rows."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    fit = cut(rows.select("x").distinct(), "whiten-fit")
    shape = fit.agg(F.min(F.size("x")), F.max(F.size("x")), F.count("*"), F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
    names = ["vec_id", "component", "deviation", "whitened"]
    schema = f"vec_id {kind}, component int, deviation long, whitened double"
    if not shape[2]:
        none = fit.sparkSession.createDataFrame([], schema)
        return none.select("vec_id", "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    if shape[0] != shape[1]:
        raise ValueError("vectors differ in length")
    d, n = shape[0], shape[2]
    if max(shape[3], -shape[4]) * n >= 1 << 62:
        raise ValueError("entries times rows don't fit in 64 bits")
    total = np.array(fit.agg(*[F.sum(F.get("x", F.lit(i))) for i in range(d)]).first(), np.int64)
    sizes, axes = jacobi(triangle(fit, n, total))
    sizes, axes = np.append(sizes, np.zeros(d - len(sizes))), axes
    many = min(components, d)
    real = int((sizes[:many] > sizes[0] * d * np.finfo(float).eps).sum()) if sizes[0] > 0 else 0
    scaled = axes[:, :real] / (sizes[:real] / np.sqrt(n))
    share = [float(s * s / (sizes * sizes).sum()) if c < real else 0.0 for c, s in enumerate(sizes[:many])]
    error = 0.0
    if real:
        sums = fit.mapInArrow(_products(n, total, scaled), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        mean, square = np.zeros(real), np.zeros((real, real))
        for r in sums:
            if r.i < 0:
                mean[r.j] = r.s / n
            else:
                square[r.i, r.j] = r.s / n
        error = float(np.abs(square - np.outer(mean, mean) - np.eye(real)).max())
    out = rows.mapInArrow(_rows(n, total, scaled, many, names), schema)
    explained = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("component"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op12(embeddings: DataFrame) -> DataFrame:
    """A row for each kept vector and component up to 16: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(integers(embeddings))
