"""Vector codes: each vector is cut into equal parts, each part is the number of an entry of its own codebook.

Codebooks are fitted by Lloyd rounds with Elkan's bounds. A row keeps, for each part, an upper bound of the distance to its
entry and one lower bound for each entry, from round to round in a table in the shared folder (a byte a lower bound, rounded
down, with one scale a part). When entries move, bounds are shifted by their movement. An entry is skipped only where the
triangle inequality shows that it is strictly farther: below half the distance between the two entries, or above the upper
bound. What is left is compared in integers, ties to the lower number, so codes and codebooks equal those of plain rounds
whatever the partitions. Where the bounds leave most entries of a block of rows, the block's distances come from one product
of matrices, exact too.

Entries' sums are kept by task (codebook-sized, whatever the rows) and summed by Spark; only codebooks reach the driver.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped; a null id is coded
and comes last among ids; of rows that repeat an id all are coded, and the first codebook takes them in the order of id and
vector; fewer rows than entries make a smaller codebook; an empty table gives no rows. Vectors of several lengths, of a
length that the parts don't divide, or with components of 2^27 / 1024 or more raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.sources.scratch import cut, drop_cut

PARTS = 4
ENTRIES = 256
ROUNDS = 4
UNIT = 1024
#: Integer components are below this, so that all squared distances fit in 64 bits.
MOST = 1 << 27
#: Relative slack of the floating-point bounds, far above their rounding.
SLACK = 1e-9
ROWS = 2048


def finite(vector: Column) -> Column:
    """Whether a vector is one of finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, as integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def reassign(x: np.ndarray, entries: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Nearest entries of the integer rows ``x``; ``code`` and both bounds are brought up to date. Returns how many
    distances the bounds left to compare."""
    apart = 0.5 * (1 - SLACK) * np.sqrt(_squares(entries, entries))
    np.fill_diagonal(apart, np.inf)
    rows = np.flatnonzero(upper >= apart.min(1)[code])
    if not len(rows):
        return 0
    own = ((x[rows] - entries[code[rows]]) ** 2).sum(1)
    up = np.sqrt(own) * (1 + SLACK)
    left = (up[:, None] >= lower[rows]) & (up[:, None] >= apart[code[rows]])
    n = int(left.sum())
    if 8 * n >= left.size:
        square = _squares(x[rows], entries)
        lower[rows] = np.sqrt(square) * (1 - SLACK)
    else:
        r, c = np.nonzero(left)
        square = np.full(left.shape, np.iinfo(np.int64).max)
        square[r, c] = ((x[rows[r]] - entries[c]) ** 2).sum(1)
        lower[rows[r], c] = np.sqrt(square[r, c]) * (1 - SLACK)
        square[np.arange(len(rows)), code[rows]] = own
        lower[rows, code[rows]] = np.sqrt(own) * (1 - SLACK)
    code[rows] = square.argmin(1)
    upper[rows] = np.sqrt(square.min(1)) * (1 + SLACK)
    return n


def to_bytes(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as one byte each, rounded down, and the scale of each row."""
    scale = (lower.max(1) / 255).astype(np.float32)
    scale[scale == 0] = 1
    return np.clip(np.floor(lower / scale[:, None].astype(float) * (1 - 1e-6)), 0, 255).astype(np.uint8), scale


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(column) and (len(flat) % len(column) or len(set(np.diff(column.offsets.to_numpy()))) > 1):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


_STATE = "code binary, upper array<double>, scale array<float>, lower binary, error long"


def _round(books: list[np.ndarray], moved: list[np.ndarray] | None, names: list[str]):
    """One assignment of all parts; ``moved``: how far each entry has moved since, None if there are no bounds yet."""
    parts, k = len(books), len(books[0])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x, n = _matrix(batch.column("x"), np.int64), batch.num_rows
                if x.shape[1] != parts * books[0].shape[1]:
                    raise ValueError("vectors differ in length")
                if np.abs(x).max(initial=0) >= MOST:
                    raise ValueError(f"components of {MOST // UNIT} or more")
                if moved is None:
                    code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.zeros((n, parts, k))
                else:
                    code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                    upper, scale = _matrix(batch.column("upper"), float), _matrix(batch.column("scale"), float)
                    lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), np.uint8).reshape(n, parts, k) * scale[:, :, None]
                error, low, scales = np.zeros(n, np.int64), [], []
                for p, (own, entries) in enumerate(zip(np.split(x, parts, axis=1), books, strict=True)):
                    c, u, b = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    if moved is not None:
                        u += moved[p][c]
                        b = np.maximum(b - moved[p], 0)
                    reassign(own, entries, c, u, b)
                    code[:, p], upper[:, p] = c, u
                    error += ((own - entries[c]) ** 2).sum(1)
                    q, s = to_bytes(b)
                    low.append(q)
                    scales.append(s)
                made = {
                    "code": pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary()),
                    "upper": pa.array(list(upper), pa.list_(pa.float64())),
                    "scale": pa.array(list(np.stack(scales, 1)), pa.list_(pa.float32())),
                    "lower": pa.array([r.tobytes() for r in np.concatenate(low, 1)], pa.binary()),
                    "error": pa.array(error),
                }
                yield pa.RecordBatch.from_arrays([made.get(c, None) if c in made else batch.column(c) for c in names], names=names)

    return of


def _sums(parts: int, k: int, width: int):
    """Of each task the number and the sum of the parts of each entry."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
            for p, own in enumerate(np.split(x, parts, axis=1)):
                count[p] += np.bincount(code[:, p], minlength=k)
                np.add.at(total[p], code[:, p], own)
        p, e = np.nonzero(count)
        cols = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), *[pa.array(total[p, e, i]) for i in range(width)]]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    return of


def integers(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, x) of the rows that are kept."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * UNIT).cast("int"))
    return df.where(finite(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), x.alias("x"))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, list[np.ndarray]]:
    """(vec_id, label, code, error) of ``integers`` rows, and the codebooks."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    if not first:
        return None, []
    if len({len(r.x) for r in first}) > 1 or len(first[0].x) % parts:
        raise ValueError("vectors of one length that the parts divide are asked for")
    books = np.split(np.array([r.x for r in first], np.int64), parts, axis=1)
    k, width = books[0].shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<int>, {_STATE}"
    names = ["vec_id", "label", "x", "code", "upper", "scale", "lower", "error"]
    state, moved = rows, None
    for n in range(rounds + 1):
        after = cut(state.mapInArrow(_round(books, moved, names), schema), "codes-state")
        drop_cut(state)
        state = after
        if n == rounds:
            break
        sums = state.select("x", "code").mapInArrow(_sums(parts, k, width), "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width)))
        was = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect():
            books[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
        moved = [np.sqrt(((b - a) ** 2).sum(1)) * (1 + SLACK) for a, b in zip(was, books, strict=True)]
    return state.select("vec_id", "label", "code", "error"), books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def op11(embeddings: DataFrame) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    rows = integers(embeddings, "vec_id", "embedding", "label")
    coded, books = fit(rows)
    if coded is None:
        coded = rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    by_label = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    by_label = by_label.select(F.col("label").alias("_label"), "label_error")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _lloyd_sql() -> str:
    """Plain Lloyd rounds: every part meets every entry. Fixed sizes: vectors of 64."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS (SELECT vec_id, row_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT k.vec_id, k.row_id, k.p, b.e, k.vv + b.ww - 2 * list_inner_product(k.v, b.w) AS d FROM parts k JOIN b{n} b USING (p)) GROUP BY 1, 2, 3)")
        if n < ROUNDS:
            steps.append(
                f"m{n} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS w FROM (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, a.e, unnest(k.v) AS x, generate_subscripts(k.v, 1) AS i FROM parts k JOIN a{n} a USING (row_id, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2),"
                f"b{n + 1} AS (SELECT p, e, w, list_inner_product(w, w) AS ww FROM (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{n} b LEFT JOIN m{n} m USING (p, e)))"
            )
    last = ROUNDS
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS row_id, list_transform(embedding, lambda c: floor({UNIT} * c::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS vv FROM (SELECT vec_id, row_id, p, x[p * 16 + 1 : p * 16 + 16] AS v FROM kept, range(0, {PARTS}) g(p))),
b0 AS (SELECT p, row_id AS e, v AS w, vv AS ww FROM parts WHERE row_id < {ENTRIES}),
{", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
c AS (SELECT row_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY 1),
h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM b{last}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN c USING (row_id), h"""


OP11_SQL = _lloyd_sql()
