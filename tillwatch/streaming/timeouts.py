"""Machines that never answer, found by the clock: a left outer join of two streams with a bound on time.

A machine waits from its publish to its cutoff. Spark keeps it, and the answers that may be its own, until the watermark of both streams has passed
the cutoff; a machine without an answer then comes out with a null side. Nothing else has to happen for that: time passes with other events, or with
the ticks of a clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch import schemas
from tillwatch.config import TrackingConfig
from tillwatch.operators.attribution import cutoff
from tillwatch.plans.tracking import bucket_count
from tillwatch.session import Workspace
from tillwatch.sources import tables

TICK = ""  # key, store and machine of a tick: no event has blank ones, and rows with null ones are filtered out before they move the watermark
KEYS = ["message_key", "store_number", "pos_hostname"]
WAITING = "message_key string, msg_offset bigint, published_at timestamp, cutoff timestamp, store_number string, pos_hostname string"
ANSWERS = "message_key string, store_number string, pos_hostname string, received_at timestamp, seq bigint"


def waiting_machines(expected: DataFrame, publishes: DataFrame, config: TrackingConfig) -> DataFrame:
    """The named machines of publishes, with the time until which each may answer."""
    until = publishes.select(*schemas.EPISODE, cutoff(config).alias("cutoff"))
    rows = expected.filter("pos_hostname is not null").join(until, schemas.EPISODE)
    return rows.select("message_key", "msg_offset", "published_at", "cutoff", "store_number", "pos_hostname")


def missing_machines(waiting: DataFrame, answers: DataFrame, longest: str = "400 days", delay: str = "0 seconds") -> DataFrame:
    """The machines of the stream ``waiting`` that give no answer in the stream ``answers`` from their publish to their cutoff.

    No machine waits longer than ``longest``: answers are forgotten after that. Rows with TICK as each of the KEYS are ticks of a clock.
    """
    left = waiting.withWatermark("cutoff", delay).alias("w")
    right = answers.select(*[F.col(c).alias(f"_{c}") for c in (*KEYS, "received_at")]).withWatermark("_received_at", delay)
    same = [F.col(f"w.{k}") == F.col(f"_{k}") for k in KEYS]
    in_time = (F.col("_received_at") >= F.col("w.published_at")) & (F.col("_received_at") < F.col("w.cutoff"))
    remembered = F.col("_received_at") >= F.col("w.cutoff") - F.expr(f"interval '{longest}'")
    condition = in_time & remembered
    for match in same:
        condition = condition & match
    joined = left.join(right, condition, "left_outer")
    # a condition on both sides, so that it is not moved below the watermark of one, which ticks must reach
    no_answer = F.col("_message_key").isNull() & (F.coalesce("_message_key", "w.message_key") != TICK)
    return joined.filter(no_answer).select(F.col("w.cutoff").alias("missing_since"), *[F.col(f"w.{c}") for c in ("message_key", "msg_offset", "store_number", "pos_hostname")])


@contextmanager
def state_of(spark: SparkSession, rows: int, config: TrackingConfig) -> Iterator[None]:
    """Settings for streams that are started meanwhile: state on disk, one store per partition, and as many partitions as ``rows`` need.

    A store costs some files per micro-batch, however few rows it holds, and a stream keeps the number of partitions that it began with.
    """
    new = {
        "spark.sql.shuffle.partitions": str(bucket_count(spark, rows, config)),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.join.stateFormatVersion": "3",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    usual = {name: spark.conf.get(name, None) for name in new}
    try:
        for name, value in new.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in usual.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def replay_missing(spark: SparkSession, folder: str, end, split) -> DataFrame:
    """Play the machines and answers of an order database as two streams, in two parts and two ticks at ``end``; what has come out."""
    workspace = Workspace(spark)
    inputs = tables.inputs(spark, folder, workspace)
    waiting = workspace.stage(waiting_machines(inputs.expected, inputs.publishes, TrackingConfig()), "waiting")
    answers = inputs.responses.select(*[c.split()[0] for c in ANSWERS.split(", ")])
    at = F.lit(split).cast("timestamp")
    tick = spark.range(1).select(F.lit(end).cast("timestamp").alias("cutoff"), F.lit(end).cast("timestamp").alias("received_at"), *[F.lit(TICK).alias(k) for k in KEYS])
    parts = [
        (waiting.filter(F.col("published_at") <= at), answers.filter(F.col("received_at") <= at)),
        (waiting.filter(F.col("published_at") > at), answers.filter(F.col("received_at") > at)),
        (tick, tick),
        (tick, tick),  # what a tick lets expire comes out with the next micro-batch
    ]
    left, right, out = (f"{workspace.folder}/{name}" for name in ("waiting-in", "answers-in", "missing"))
    with state_of(spark, waiting.count() + answers.count(), TrackingConfig()):
        _play(spark, parts, left, right, out, f"{workspace.folder}/offsets")
    return spark.read.parquet(out)


def _play(spark: SparkSession, parts: list[tuple[DataFrame, DataFrame]], left: str, right: str, out: str, offsets: str) -> None:
    for machines, heard in parts:
        for rows, schema, path in ((machines, WAITING, left), (heard, ANSWERS, right)):
            names = [c.split() for c in schema.split(", ")]
            rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in names]).write.mode("append").parquet(path)
        found = missing_machines(spark.readStream.schema(WAITING).parquet(left), spark.readStream.schema(ANSWERS).parquet(right))
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).trigger(availableNow=True).start()
        query.awaitTermination()
