"""Ordered scans over keys that may hold any share of the rows.

A window partitioned by a key alone puts all rows of the key into one task. A heavy key is therefore cut
into slices: one small row per slice carries what the slices before it add up to, and the window over
the full rows is partitioned by key *and* slice. Slices of a key are few (time span / slice length), so
the window over them is small however many rows the key has. Other keys have the one slice 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.config import TrackingConfig
from tillwatch.functions import scalar as fn


def with_slice(df: DataFrame, keys: Sequence[str], time: str, heavy: DataFrame | None, config: TrackingConfig) -> DataFrame:
    """Add ``_slice``: the time slice for rows of a heavy key, 0 for others. ``heavy`` lists the heavy keys."""
    if heavy is None:
        return df.withColumn("_slice", F.lit(0).cast("long"))
    marked = df.join(heavy.select(*keys, F.lit(True).alias("_heavy")), list(keys), "left")
    number = F.when(F.col("_heavy"), fn.segment_of(time, config.segment_seconds)).otherwise(F.lit(0).cast("long"))
    return marked.withColumn("_slice", number).drop("_heavy")


def only_heavy(df: DataFrame, keys: Sequence[str], heavy: DataFrame) -> DataFrame:
    """The rows of heavy keys."""
    return df.join(heavy.select(*keys), list(keys), "left_semi")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    slice_no: Column,
    order: Sequence[str],
    amount: Column,
    running: str,
    total: str | None = None,
) -> DataFrame:
    """Add the sum of ``amount`` up to and including each row of its key, and the key's total if asked.

    ``slice_no`` must not decrease along ``order``, and ``order`` must be unique within a key.
    """
    rows = df.withColumn("_slice", slice_no).withColumn("_amount", amount)
    per_key = W.partitionBy(*keys)
    earlier = per_key.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    heads = (
        rows.groupBy(*keys, "_slice")
        .agg(F.sum("_amount").alias("_sum"))
        .select(
            *keys,
            "_slice",
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_amount"),
            F.sum("_sum").over(per_key).alias("_total"),
            F.lit(0).alias("_row"),
        )
    )
    upto = W.partitionBy(*keys, "_slice").orderBy("_row", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    out = out.withColumn(running, F.sum("_amount").over(upto))
    if total:
        out = out.withColumn(total, F.first("_total").over(upto))
    return out.filter("_row = 1").drop("_row", "_slice", "_amount", "_total")
