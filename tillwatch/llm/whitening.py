"""Whitened embeddings: coordinates on the principal components, each divided by its standard deviation.

Entries become integers, so sums and second moments are exact, whatever the order in which tasks finish. Second moments are taken
around the rounded mean, where they are small; the rest of the centring is exact integer arithmetic on the driver, on one
matrix of d x d numbers.

Eigenvectors are found in float32 and corrected by the iterations of Ogita and Aishima: with R = I - X'X and S = X'VX, X moves by
X E, where E is (S + lambda R) / (lambda_j - lambda_i), or R / 2 where two eigenvalues are too close to be told apart. These are matrix
products in extended precision, and the error is squared each time. Eigenvalues that stay close form a cluster: its few
columns are solved anew within their own subspace, after a shift by the cluster's mean which leaves only the gaps, and the iterations go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 4096  # of a block; with limbs of LIMB bits each product sum of a block is exact in doubles
LIMB = 20
HALF = 60  # bits; sums of products travel in two halves, each far from what a decimal can hold
MOMENT = "i int, j int, high decimal(38,0), low decimal(38,0)"
OFFSET, SCALE = 1_000_000, 64


@dataclass
class Basis:
    """Of the rows that were fitted: their number, sums per dimension, mean (rounded, and the rest), eigenvectors (columns) and eigenvalues, largest first."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def integers(vector: Column) -> Column:
    """floor(SCALE * c) + OFFSET of each entry; null if the vector is null, empty, or holds entries that are null, not finite or beyond 2^62."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < 2.0**62))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, F.transform(wide, lambda c: F.floor(c * SCALE) + OFFSET))


def block_moments(y: np.ndarray) -> np.ndarray:
    """Y'Y of integers, exact, as Python integers: numbers are cut into limbs whose products doubles can add up exactly."""
    sign, left, limbs = np.sign(y), np.abs(y), []
    while True:
        limbs.append((sign * (left & ((1 << LIMB) - 1))).astype(float))
        left = left >> LIMB
        if not left.any():
            break
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for a, low in enumerate(limbs):
        for b, high in enumerate(limbs):
            out = out + ((low.T @ high).astype(np.int64).astype(object) << (LIMB * (a + b)))
    return out


def moments_of(centre: list[int]):
    """For each partition: the upper triangle of the sums of products around ``centre``, and in row -1 the sums."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(centre)
        at, gram, sums = np.array(centre, dtype=np.int64), np.zeros((d, d), dtype=object), np.zeros(d, dtype=object)
        seen = False
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                y = np.stack(batch["x"].iloc[start : start + ROWS].to_list()).astype(np.int64) - at
                gram, seen = gram + block_moments(y), True
                sums = sums + (y.sum(axis=0).astype(object) if np.abs(y).max() < 1 << 50 else y.astype(object).sum(axis=0))
        if seen:
            i, j = np.triu_indices(d)
            halves = [divmod(int(v), 1 << HALF) for v in [*gram[i, j], *sums]]
            yield pd.DataFrame({"i": [*i, *[-1] * d], "j": [*j, *range(d)], "high": [Decimal(h) for h, _ in halves], "low": [Decimal(v) for _, v in halves]})

    return task


def long_matrix(numerators: np.ndarray, divisor: int) -> np.ndarray:
    """Exact fractions rounded to extended precision."""

    def one(v: int) -> np.longdouble:
        size = abs(int(v))
        up = 70 - size.bit_length() + divisor.bit_length()
        whole = (size << up) // divisor if up >= 0 else size // (divisor << -up)  # 70 or 71 bits
        near = np.ldexp(np.longdouble(whole >> 40), 40) + np.longdouble(whole & ((1 << 40) - 1))
        return np.ldexp(near if v >= 0 else -near, -up)

    return np.array([[one(v) for v in row] for row in numerators], dtype=np.longdouble)


def refined(v: np.ndarray, x: np.ndarray, most: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and eigenvalues of the symmetric ``v`` (extended precision), from rough eigenvectors ``x``; largest first."""
    d = len(v)
    x = x.astype(np.longdouble)
    scale = np.abs(v).max() or np.longdouble(1)
    a, unit = v / scale, np.eye(d, dtype=np.longdouble)
    norm = np.sqrt((a * a).sum())
    last = np.inf
    for _ in range(most):
        r = unit - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        off = s - np.diag(np.diag(s))
        close = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        told = np.abs(gap) > close
        e = np.where(told, (s + values[None, :] * r) / np.where(told, gap, 1), r / 2)
        x = x + x @ e
        for start, end in clusters(values, close):
            x[:, start:end] = within_cluster(a, x[:, start:end])
        moved = float(np.abs(e).max())
        if moved < 1e-18 or (moved < 1e-15 and moved >= last / 2):
            break
        last = moved
    x = x + x @ (unit - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return x[:, order], values[order] * scale


def clusters(values: np.ndarray, close: float) -> list[tuple[int, int]]:
    """Ranges of two or more neighbours, in falling order, none further than ``close`` from the one before."""
    cuts = [0, *[i for i in range(1, len(values)) if values[i - 1] - values[i] > close], len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]


def within_cluster(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Columns that span an invariant subspace, turned to eigenvectors within it."""
    x = x + x @ (np.eye(x.shape[1], dtype=np.longdouble) - x.T @ x) / 2
    t = x.T @ (a @ x)
    mean = np.trace(t) / len(t)
    t = (t - mean * np.eye(len(t), dtype=np.longdouble)).astype(np.longdouble)
    size = np.abs(t).max()
    if not size:
        return x
    _, q = np.linalg.eigh(((t + t.T) / 2 / size).astype(float))
    return x @ q[:, ::-1].astype(np.longdouble)


def exact_moments(rows: DataFrame, centre: list[int]) -> tuple[np.ndarray, np.ndarray]:
    d = len(centre)
    gram, sums = np.zeros((d, d), dtype=object), np.zeros(d, dtype=object)
    for r in rows.select("x").mapInPandas(moments_of(centre), MOMENT).groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        value = (int(r.high) << HALF) + int(r.low)
        if r.i < 0:
            sums[r.j] = value
        else:
            gram[r.i, r.j] = gram[r.j, r.i] = value
    return gram, sums


def fit(rows: DataFrame) -> Basis | None:
    """The basis of rows with integer vectors ``x`` of one length; None of no rows."""
    per = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("pos").collect()
    if not per:
        return None
    n, sums = per[0].n, [int(r.s) for r in per]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    gram, rest = exact_moments(rows, centre)
    v = long_matrix(n * gram - np.outer(rest, rest), n * n)
    _, rough = np.linalg.eigh((v / (np.abs(v).max() or 1)).astype(np.float32))
    vectors, values = refined(v, rough[:, ::-1])
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(sums))] < 0, -1, 1)
    return Basis(n, sums, np.array(centre, dtype=np.int64), np.array([int(r) / n for r in rest]), vectors.astype(float), values.astype(float), float(np.trace(v)))


def kept_components(basis: Basis, most: int) -> int:
    """Components to return: those with variance, at most ``most``. Variance under d * eps of the largest is none."""
    least = len(basis.values) * np.finfo(float).eps * max(basis.values[0], 0)
    return int(min(most, (basis.values > least).sum()))


def coordinates(x: np.ndarray, basis: Basis, k: int) -> np.ndarray:
    return ((x - basis.centre) - basis.rest) @ basis.vectors[:, :k] / np.sqrt(basis.values[:k])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
    d, low, high = x.shape[1], int(x.min()), int(x.max())
    most = max(max(abs(n * low - s), abs(n * high - s)) for s in sums)
    if d * most * most < 1 << 63 and n * max(abs(low), abs(high)) < 1 << 63:
        y = n * x - np.array(sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def whiten(embeddings: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector: id, n, deviation (exact), whitened (array), explained (array) and identity_error.

    Left out are vectors that are null, empty, or hold null or non-finite entries, and those of another length than most have (of
    equally many the longer). Null and repeated ids stay as they are. Components without variance are not returned. ``identity_error``
    is the largest entry of the covariance of what is returned minus the identity, measured over all rows.
    """
    rows = embeddings.select(F.col(key).alias("vec_id"), integers(F.col(vector)).alias("x")).filter("x is not null")
    schema = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType)]).add("n", "long").add("deviation", "long").add("whitened", T.ArrayType(T.DoubleType())).add("explained", T.ArrayType(T.DoubleType())).add("identity_error", "double")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("x") == (lengths[0].d if lengths else 0))
    basis = fit(rows)
    if basis is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    k = kept_components(basis, components)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((k + 1, k)), False
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                z = coordinates(np.stack(batch["x"].iloc[start : start + ROWS].to_list()), basis, k)
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
                seen = True
        if seen:
            yield pd.DataFrame({"i": np.repeat(np.arange(k + 1), k), "j": np.tile(np.arange(k), k + 1), "value": total.ravel()})

    cov = np.zeros((k + 1, k))
    for r in rows.select("x").mapInPandas(spread, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        cov[r.i, r.j] = r.value / basis.n
    error = float(np.abs(cov[:k] - np.outer(cov[k], cov[k]) - np.eye(k)).max(initial=0.0))
    explained = (basis.values[:k] / basis.trace).tolist()

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.iloc[start : start + ROWS]
                x = np.stack(part["x"].to_list())
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].to_numpy(),
                        "n": basis.n,
                        "deviation": pd.array(deviations(x, basis.n, basis.sums), dtype="Int64"),
                        "whitened": list(coordinates(x, basis, k)),
                        "explained": [explained] * len(x),
                        "identity_error": error,
                    }
                )

    return rows.mapInPandas(apply, schema)


def whitened_components(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """The same with a row for each vector and component."""
    rows = whiten(embeddings, components)
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "of")
    rows = rows.select("vec_id", "n", "deviation", "identity_error", pairs)
    return rows.select("vec_id", (F.col("component") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")
