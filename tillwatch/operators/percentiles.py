"""Exact percentiles per group, where one group may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.operators.scan import running_total


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], slice_width: int, mean: str | None = None) -> DataFrame:
    """Per group one column per wanted share, interpolated between neighbouring values, and the ``mean`` if named.

    Nulls are ignored; a group of nulls alone has nulls.

    Values are counted first, then ranked by a running total over slices of ``slice_width``, so no task
    holds all values of a group.
    """
    counted = df.groupBy(*keys, value).agg(F.count(value).alias("n"))
    slice_no = F.floor(F.col(value) / F.lit(slice_width))
    ranked = running_total(counted, keys, slice_no, [value], F.col("n"), "_upto", total="_all")

    def value_at(rank):  # the smallest value with more than `rank` values up to it
        return F.min(F.when(F.col("_upto") > rank, F.col(value)))

    out = []
    for name, share in wanted.items():
        position = (F.col("_all") - 1) * F.lit(share)
        low, part = F.floor(position), position - F.floor(position)
        below, above = value_at(low), value_at(F.least(low + 1, F.col("_all") - 1))
        out.append((below + (above - below) * F.max(part)).alias(name))
    if mean:
        out.append(F.try_divide(F.sum(F.col(value) * F.col("n")), F.sum("n")).alias(mean))
    return ranked.groupBy(*keys).agg(*out)
