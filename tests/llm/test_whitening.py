from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.llm import whitening


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumns({c: F.lit("x") for c in ("x", "n", "d", "i", "j", "value", "col", "pos", "whitened")})


def vectors(rng, n, d=6):
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return (rng.normal(size=(n, d)) * np.geomspace(3, 0.3, d) @ turn + 5).astype(np.float32)


def brute_force(rows):
    xs = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[k] for x in xs) for k in range(d)]
    dev = [sum((n * x[k] - sums[k]) ** 2 for k in range(d)) for x in xs]
    centred = np.array([[float(Fraction(n * x[k] - sums[k], n)) for k in range(d)] for x in xs])
    return xs, sums, dev, centred


def test_equals_brute_force(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(np.random.default_rng(1), 700))]
    bad = [(1, None), (2, [None, *rows[0][1][1:]]), (3, [math.nan, *rows[0][1][1:]]), (4, [math.inf, *rows[0][1][1:]]), (5, []), (6, [1.0, 2.0])]
    more = [(None, rows[3][1]), (7000, rows[3][1]), (7000, rows[3][1])]
    good = rows + more
    got = whitening.whitened_components(table(spark, rows + bad + more)).collect()
    _, _, dev, centred = brute_force(good)
    cov = centred.T @ centred / len(good)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(got) == len(good) * 6 and {r.n for r in got} == {len(good)}
    sign, by_id = {}, {i: k for k, (i, _) in enumerate(good)}
    for r in got:
        k, c = by_id[r.vec_id], r.component - 1
        assert r.deviation == dev[k] and abs(r.explained - values[c] / values.sum()) < 1e-9 and 0 <= r.identity_error < 1e-9
        want = centred[k] @ basis[:, c] / math.sqrt(values[c])
        if abs(want) > 1e-3:
            sign.setdefault(c, math.copysign(1, want * r.whitened))
        assert abs(r.whitened - sign.get(c, 1) * want) < 1e-9 or abs(want) <= 1e-3
    assert len({r.identity_error for r in got}) == 1


def test_limits_components_and_takes_empty_tables_and_flat_vectors(spark):
    rng = np.random.default_rng(2)
    wide = [(i, rng.normal(size=40).tolist()) for i in range(300)]
    got = whitening.whiten(table(spark, wide), 32).collect()
    assert {len(r.whitened) for r in got} == {32} and got[0].identity_error < 1e-9 and np.all(np.diff(got[0].explained) <= 0)
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened_components(table(spark, rows)).collect() == []
    flat = [(i, [1.0, float(i), 2.0 * i]) for i in range(50)]  # one direction only
    assert {len(r.whitened) for r in whitening.whiten(table(spark, flat)).collect()} == {1}
    assert whitening.whitened_components(table(spark, [(1, [1.0, 2.0])] * 5)).collect() == []


def test_moments_are_exact_for_large_entries(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1.5, -7e4, 1e12, 3e15]) * rng.random() for _ in range(3)]) for i in range(60)]
    frame = table(spark, rows, "double")
    xs, sums, dev, _ = brute_force(rows)
    basis = whitening.fit(frame.select("vec_id", whitening.integers(F.col("embedding")).alias("x")))
    n = len(xs)
    exact = [[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs), n**3)) for j in range(3)] for i in range(3)]
    values = np.linalg.eigvalsh(np.array(exact))[::-1]
    assert basis.sums == sums and np.allclose(basis.values, values, rtol=1e-12, atol=1e-14 * values[0])
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame).collect()}
    assert got == {i: (v if v < 1 << 63 else None) for (i, _), v in zip(rows, dev)}


@pytest.mark.parametrize("gap", [0.0, 1e-13, 1e-9, 1e-5])
def test_clustered_eigenvalues(gap):
    rng = np.random.default_rng(5)
    d = 12
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(4):  # orthogonal to extended precision
        q = q + q @ (np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    values = np.array([5, 3, 1 + 2 * np.longdouble(gap), 1 + np.longdouble(gap), 1, 0.5, 0.5, 0.2, 0.1, 1e-3, 1e-6, 1e-9], dtype=np.longdouble)
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    rough = np.linalg.eigh(v.astype(np.float32))[1][:, ::-1]
    x, found = whitening.refined(v, rough)
    assert float(np.abs(found - values).max()) < 1e-17
    assert float(np.abs(x.T @ x - np.eye(d)).max()) < 1e-16
    assert float(np.abs(v @ x - x * found).max()) < 1e-17
    told = [0, 1, 7, 8, 9, 10, 11] + ([2, 3, 4] if gap >= 1e-9 else [])
    same = np.abs((x * q).sum(axis=0))[told]
    assert float(np.abs(same - 1).max()) < 1e-15
