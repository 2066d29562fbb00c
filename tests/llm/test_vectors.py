"""Vector codes against SQL and plain rounds, whitened vectors against a dense eigendecomposition."""

import math
import os

import duckdb
import numpy as np
import pytest

from talkloom.llm import vectorcodes as v
from talkloom.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, d=64, spread=6):
    """Rows round a few centres, with ties, repeats and rows to be dropped."""
    r = np.random.default_rng(seed)
    x = (r.normal(size=(spread, d))[r.integers(0, spread, n)] + r.normal(size=(n, d)) * 0.2).astype(np.float32)
    x[n // 2 : n // 2 + 20] = x[0]
    rows = [(int(i), [float(c) for c in row], int(i) % 3 if i % 7 else None) for i, row in zip(r.permutation(n), x, strict=True)]
    bad = [(n + 1, None, 1), (n + 2, [], 1), (n + 3, [math.nan] * d, 1), (n + 4, [None, *[0.0] * (d - 1)], 1), (n + 5, [math.inf, *[0.0] * (d - 1)], 1)]
    return rows, rows + bad


def plain_codes(rows, parts=4, entries=256, rounds=4):
    rows = sorted(rows, key=lambda r: r[0])
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 1024).astype(np.int64)
    code, error, books = [], np.zeros(len(rows), np.int64), []
    for own in np.split(x, parts, axis=1):
        book = own[:entries].copy()
        for n in range(rounds + 1):
            d = ((own[:, None] - book[None]) ** 2).sum(2)
            a = d.argmin(1)
            for e in range(len(book)) if n < rounds else ():
                if (a == e).any():
                    book[e] = own[a == e].sum(0) // (a == e).sum()
        code.append(a)
        error += d.min(1)
        books.append(book)
    return {r[0]: (bytes(int(c[i]) for c in code).hex(), int(error[i])) for i, r in enumerate(rows)}, v.books_digest(books)


@pytest.mark.parametrize("parts", [1, 7])
def test_codes_equal_plain_rounds(spark, parts):
    good, rows = vectors(3, 700)
    got = v.op11(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    want, digest = plain_codes(good)
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    assert {r.codebooks_sha256 for r in got} == {digest}
    label = {r[0]: r[2] for r in good}
    sums = {}
    for k, (_, e) in want.items():
        sums[label[k]] = sums.get(label[k], 0) + e
    assert {r.vec_id: r.label_error for r in got} == {k: sums[label[k]] for k in want}


def test_codes_equal_sql(spark, tmp_path):
    _, rows = vectors(5, 400)
    path = os.path.join(tmp_path, "e.parquet")
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, v.op11(df).collect())) == sorted(db.sql(v.OP11_SQL).fetchall())


def test_bounds_prune_and_stay_bounds():
    r = np.random.default_rng(1)
    book = r.integers(-800, 800, (256, 16))
    x = book[r.integers(0, 256, 3000)] + r.integers(-40, 40, (3000, 16))
    code, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, 256))
    assert v.reassign(x, book, code, upper, lower) > 0.9 * lower.size
    quantised, scale = v.to_bytes(lower)
    lower = quantised * scale[:, None].astype(float)
    after = book + r.integers(-3, 4, book.shape)
    moved = np.sqrt(((after - book) ** 2).sum(1)) * (1 + v.SLACK)
    upper, lower = upper + moved[code], np.maximum(lower - moved, 0)
    left = v.reassign(x, after, code, upper, lower)
    exact = ((x[:, None] - after[None]) ** 2).sum(2)
    assert left < 0.05 * exact.size
    assert (code == exact.argmin(1)).all()
    assert (lower**2 <= exact).all() and (upper**2 >= exact.min(1)).all()


def test_codes_of_large_components_ties_and_small_tables(spark):
    big = [(i, [float(c) for c in row], 0) for i, row in enumerate(np.random.default_rng(2).choice([-130000.0, 130000.0, 0.0], (50, 8)))]
    got = v.op11(spark.createDataFrame(big, SCHEMA)).collect()
    want, digest = plain_codes(big)
    assert {r.vec_id: (r.code, r.error) for r in got} == want and got[0].codebooks_sha256 == digest
    assert v.op11(spark.createDataFrame([], SCHEMA)).collect() == []
    one = v.op11(spark.createDataFrame([(None, [1.0] * 4, None), (None, [2.0] * 4, None), (5, [2.0] * 4, None)], SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.code, r.error, r.label_error) for r in one) == [(False, "00000000", 0, 0), (True, "00000000", 0, 0), (True, "01010101", 0, 0)]
    with pytest.raises(Exception, match="length"):
        v.op11(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], SCHEMA)).collect()


def dense(rows):
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    f = np.unique(x, axis=0)
    n, s = len(f), f.sum(0)
    c = (n * f - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s).astype(object) ** 2).sum(1), (n * x - s) / n, e[::-1], u[:, ::-1]


@pytest.mark.parametrize("parts", [1, 40])
def test_whitened_equals_dense(spark, parts):
    good, rows = vectors(8, 900, spread=80)
    got = w.op12(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    n, deviation, c, e, u = dense(good)
    at = {r[0]: i for i, r in enumerate(good)}
    assert len(got) == 16 * len(good) and {r.n for r in got} == {n}
    assert all(r.deviation == deviation[at[r.vec_id]] for r in got)
    z = c @ u[:, :16] / np.sqrt(e[:16])
    mine = np.zeros_like(z)
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
    for k in range(16):
        sign = np.sign(mine[:, k] @ z[:, k])
        assert np.abs(mine[:, k] - sign * z[:, k]).max() < 1e-8
    share = {r.component: r.explained for r in got}
    assert max(abs(share[k + 1] / (e[k] / e.sum()) - 1) for k in range(16)) < 1e-10
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_rotations_keep_small_values():
    r = np.random.default_rng(4)
    q1, q2 = (np.linalg.qr(r.normal(size=(9, 9)))[0] for _ in range(2))
    sizes = 10.0 ** -np.arange(9)
    got, axes = w.jacobi((q1 * sizes) @ q2.T)
    assert np.abs(got / sizes - 1).max() < 1e-7
    assert np.abs(np.abs(axes.T @ q2) - np.eye(9)).max() < 1e-6
    assert np.abs(axes.T @ axes - np.eye(9)).max() < 1e-13
    assert w.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_whitened_defined_cases(spark):
    assert w.op12(spark.createDataFrame([], SCHEMA)).collect() == []
    one = w.op12(spark.createDataFrame([(1, [0.5] * 3, 1), (None, [0.5] * 3, 1)], SCHEMA)).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, 0.0) for r in one)
    line = w.op12(spark.createDataFrame([(i, [float(i), 2.0 * i], 1) for i in (1, 2, 4)], SCHEMA).withColumn("x", w.F.lit(1))).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    first = sorted((r.vec_id, r.whitened) for r in line if r.component == 1)
    assert np.allclose(np.abs([z for _, z in first]), np.abs(np.array([-4, -1, 5]) / np.sqrt(14)))
    for size, fits in ((1e7, True), (3e7, False)):
        far = w.op12(spark.createDataFrame([(1, [size], 1), (2, [-size], 1)], SCHEMA)).collect()
        assert [r.deviation for r in far] == [(2 * 64 * int(size)) ** 2 if fits else None] * 2
