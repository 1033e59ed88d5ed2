"""Equi-join of many rows to at most one row per key, where one key may hold any share of the many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.config import TrackingConfig


def part_count(weight: str, config: TrackingConfig) -> Column:
    """Number of tasks the rows of a key should be spread over."""
    return F.greatest(F.ceil(F.col(weight) / F.lit(config.rows_per_task)), F.lit(1)).cast("int")


def heaviest(weights: DataFrame, keys: Sequence[str], weight: str, config: TrackingConfig) -> DataFrame | None:
    """All heavy keys with their part count; None if no key is heavy.

    ``weights`` should be a staged table: it is asked once, here, how many keys are heavy. A list of at most
    ``broadcast_groups`` is marked for broadcast; a longer one takes part in shuffled joins.
    """
    heavy = weights.filter(F.col(weight) > config.rows_per_task).select(*keys, part_count(weight, config).alias("_parts"))
    found = heavy.limit(config.broadcast_groups + 1).count()
    if not found:
        return None
    return F.broadcast(heavy) if found <= config.broadcast_groups else heavy


def assign_part(df: DataFrame, heavy: DataFrame, keys: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Add ``_part``: a hash of ``spread_by`` within the parts of a heavy key, 0 for other keys."""
    part = F.pmod(F.xxhash64(*spread_by), F.coalesce(F.col("_parts"), F.lit(1))).cast("int")
    return df.join(heavy, list(keys), "left").withColumn("_part", part).drop("_parts")


def repeat_parts(df: DataFrame, heavy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeat the rows of a heavy key for each of its parts, as ``_part``."""
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    return df.join(heavy, list(keys), "left").withColumn("_part", F.explode(parts)).drop("_parts")


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    weight: str,
    config: TrackingConfig,
    how: str = "inner",
) -> DataFrame:
    """Join ``big`` to ``small`` (staged, unique on ``keys``), spreading heavy keys over several tasks.

    ``small[weight]`` says how many rows of ``big`` a key has. The rows of a heavy key get a part number
    from a hash of ``spread_by``, and the one row of ``small`` is repeated for each part. Only a list of
    heavy keys that was counted and is short is broadcast. ``weight`` is dropped.
    """
    heavy = heaviest(small, keys, weight, config)
    if heavy is None:
        return big.join(small.drop(weight), list(keys), how)
    many = assign_part(big, heavy, keys, spread_by)
    one = repeat_parts(small.drop(weight), heavy, keys)
    return many.join(one, [*keys, "_part"], how).drop("_part")
