from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.llm import topk


def brute(rows, k=5, every=50):
    whole = [(u, i, [math.floor(256 * x) for x in v]) for u, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for u, i, q in whole:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j, w) for w, j, c in whole if w != u and len(c) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, workspace, seed):
    rng = random.Random(seed)
    vector = lambda n: [rng.choice([-1.5, -0.25, 0.0, 0.1, 0.5, rng.random()]) for _ in range(n)]
    common = vector(6)
    rows = [(i, common if rng.random() < 0.3 else vector(6)) for i in range(400)]
    rows += [(100, common), (100, common), (None, common), (50, None), (150, [None] + common[1:]), (200, [float("nan")] * 6), (250, [float("inf")] * 6), (300, []), (350, vector(3)), (351, vector(3))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).withColumn("uid", F.lit("x")).withColumn("dim", F.lit(1))
    exact = [(r.vec_id, r.embedding) for r in table.collect()]
    got = topk.top_k(table, workspace, rows_per_shard=64, query_block=4).collect()
    assert sorted(map(tuple, got)) == brute(exact)


def test_few_rows_and_none(spark, workspace):
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<double>")
    assert topk.top_k(one, workspace).collect() == []
    assert topk.top_k(one.limit(0), workspace).collect() == []


def test_large_components_stay_exact(spark, workspace):
    rows = [(i, [float(3_000_000 + i), -2.0e6 * (i % 3)]) for i in range(60)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), workspace, rows_per_shard=16).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_trees_hold_all_rows_in_tight_boxes():
    rng = np.random.default_rng(0)
    rows = rng.integers(-9, 9, (500, 4))
    tree = topk.build_tree(rows, np.arange(500), np.arange(500), leaf=16)
    assert sorted(tree["ids"].tolist()) == list(range(500))
    for (start, end, left), low, high, least in zip(tree["nodes"].tolist(), tree["low"], tree["high"], tree["smallest"], strict=True):
        part = tree["rows"][start:end]
        assert (part.min(0) == low).all() and (part.max(0) == high).all() and tree["ids"][start:end].min() == least
        assert left >= 0 or end - start <= 16
