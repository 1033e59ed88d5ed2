from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tillwatch import TrackingConfig
from tillwatch.operators.percentiles import percentiles
from tillwatch.operators.scan import running_total
from tillwatch.operators.spread import spread_join


def test_running_total(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(1, 5)}", t, rng.randint(0, 9)) for t in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, x long")
    found = running_total(df, ["k"], F.floor(F.col("t") / 10), ["t"], F.col("x"), "upto", total="total").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.upto == sum(x for k, t, x in rows if k == r.k and t <= r.t)
        assert r.total == sum(x for k, t, x in rows if k == r.k)


def test_spread_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("k"), "id")
    small = big.filter("k <> 'k1'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    for config in (TrackingConfig(), TrackingConfig(rows_per_task=10), TrackingConfig(rows_per_task=10, broadcast_groups=1)):
        for how in ("inner", "left"):
            ours = spread_join(big, small, ["k"], ["id"], "n", config, how)
            plain = big.join(small.drop("n"), ["k"], how)
            assert sorted(ours.select("k", "id", "top").collect(), key=str) == sorted(plain.select("k", "id", "top").collect(), key=str)


def test_percentiles(spark):
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 300)) for _ in range(400)] + [("b", v) for v in (5, 5, 9)] + [("b", None), ("c", 1)]
    df = spark.createDataFrame(rows, "g string, v long")
    shares = {"p50": 0.5, "p95": 0.95, "p100": 1.0}
    for width in (1, 50, 10_000):
        found = {r.g: r for r in percentiles(df, ["g"], "v", shares, width).collect()}
        for g in "abc":
            values = [v for k, v in rows if k == g and v is not None]
            for name, share in shares.items():
                assert abs(found[g][name] - np.quantile(values, share)) < 1e-9
