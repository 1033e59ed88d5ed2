"""Time windows over event streams: tumbling for time series, sliding for trailing periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.session import Workspace
from tillwatch.sources import tables

DELAY = "10 minutes"


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Events and their value per window and type; a window is emitted once it is complete."""
    return _windowed(events, F.window("ts", width), delay)


def sliding(events: DataFrame, size: str = "4 hours", step: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """The same over the trailing period, at every step."""
    return _windowed(events, F.window("ts", size, step), delay)


def _windowed(events: DataFrame, window: Column, delay: str) -> DataFrame:
    return (
        events.withWatermark("ts", delay)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select(F.col("w.start").alias("slot_start"), F.col("w.end").alias("slot_end"), "event_type", "n", F.col("total").cast("double"))
    )


def _replay(spark: SparkSession, folder: str, plan) -> DataFrame:
    """Stream the events table through a plan into a table, and read that.

    The table ends, so windows that no later event completes count too: each batch writes the windows it
    changed, and the newest state of a window is read.
    """
    workspace = Workspace(spark)
    stream = spark.readStream.schema(tables.COLUMNS["events"]).parquet(f"{folder}/events*.parquet")
    result = plan(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    out = f"{workspace.folder}/windows"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:09d}")

    query = (
        result.writeStream.outputMode("update")
        .option("checkpointLocation", f"{workspace.folder}/offsets")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    keys = ["slot_start", "slot_end", "event_type"]
    changed = spark.read.schema(T.StructType([*result.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{out}/*")
    newest = changed.groupBy(*keys).agg(F.max_by(F.struct("n", "total"), "batch").alias("w"))
    return newest.select(*keys, "w.n", "w.total")


def replay_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return _replay(spark, folder, tumbling)


def replay_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _replay(spark, folder, sliding)
