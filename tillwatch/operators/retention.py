"""Day partitions by deadline: which exist or should, and which may go."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.config import TrackingConfig
from tillwatch.functions import scalar as fn


def with_day(df: DataFrame) -> DataFrame:
    """Add expire_date, the partition column of state tables."""
    return df.withColumn("expire_date", F.to_date("expire_at"))


def by_day(df: DataFrame) -> DataFrame:
    """Rows with expire_date, each day in one task and a crowded one in several, so that a table partitioned by it gets few files."""
    return with_day(df).hint("rebalance", "expire_date")


def retained(df: DataFrame, today: date, config: TrackingConfig) -> DataFrame:
    """Rows of days that are kept; on a table partitioned by expire_date this prunes whole days."""
    return df.filter(F.col("expire_date") >= F.date_sub(F.lit(today), config.days_to_retain))


def partition_days(df: DataFrame, today: date, config: TrackingConfig) -> DataFrame:
    """One row per day that holds rows or is prepared ahead: suffix, bounds, rows, whether it may be dropped."""
    held = df.groupBy("expire_date").agg(F.count("*").alias("n_rows"))
    ahead = (
        df.sparkSession.range(1)
        .select(F.explode(fn.day_series(F.lit(today), config.days_ahead)).alias("expire_date"))
        .withColumn("n_rows", F.lit(0).cast("long"))
    )
    return (
        held.unionByName(ahead)
        .groupBy("expire_date")
        .agg(F.sum("n_rows").alias("n_rows"))
        .select(
            fn.day_suffix("expire_date").alias("suffix"),
            F.col("expire_date").cast("timestamp").alias("lower_bound"),
            F.date_add("expire_date", 1).cast("timestamp").alias("upper_bound"),
            "n_rows",
            (F.col("expire_date") < F.date_sub(F.lit(today), config.days_to_retain)).alias("droppable"),
        )
    )
