"""Result and state tables on disk, and events in wire form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.functions import scalar as fn
from tillwatch.operators.retention import by_day

# Attribute names of the three event types, in order.
MESSAGE_EVENT = "MessageTrackingResult"
STORE_EVENT = "StoreTrackingResult"
POS_EVENT = "PosTrackingResult"
ATTRIBUTES = {
    MESSAGE_EVENT: {
        "messageKey": "message_key",
        "clusterId": "cluster_id",
        "msgOffset": "msg_offset",
        "state": "state",
        "totalStores": "total_stores",
        "storesDone": "stores_done",
        "storesPartial": "stores_partial",
        "storesTimedOut": "stores_timed_out",
        "publishCount": "publish_count",
        "inconsistencyCount": "inconsistency_count",
        "inconsistencies": "inconsistencies",
        "firstPublishedAt": "first_published_at",
        "lastPublishedAt": "last_published_at",
        "expireAt": "expire_at",
        "trackingDurationMs": "tracking_duration_ms",
    },
    STORE_EVENT: {
        "messageKey": "message_key",
        "clusterId": "cluster_id",
        "storeNumber": "store_number",
        "locationId": "location_id",
        "state": "state",
        "checkpointPct": "checkpoint_pct",
        "expectedPosCount": "expected_pos_count",
        "respondedPosCount": "responded_pos_count",
        "missingPosCount": "missing_pos_count",
        "inconsistencyCount": "inconsistency_count",
        "inconsistencies": "inconsistencies",
        "expireAt": "expire_at",
    },
    POS_EVENT: {
        "messageKey": "message_key",
        "clusterId": "cluster_id",
        "storeNumber": "store_number",
        "locationId": "location_id",
        "posHostname": "pos_hostname",
        "status": "status",
        "expireAt": "expire_at",
        "firstPublishedAt": "first_published_at",
        "responselagMs": "response_lag_ms",
    },
}


def wire_events(results: DataFrame, event_type: str) -> DataFrame:
    """Events as JSON objects of their attributes; null attributes are left out."""
    attributes = F.struct(*[F.col(column).alias(name) for name, column in ATTRIBUTES[event_type].items()])
    return results.select(
        F.lit(event_type).alias("event_type"),
        fn.epoch_millis("event_ts").alias("timestamp_ms"),
        F.to_json(attributes, {"ignoreNullFields": "true"}).alias("attributes"),
    )


def write_results(results: DataFrame, path: str, mode: str = "append", kind: str = "parquet") -> None:
    """Result events, one folder per event day, so that recent windows read few days. Overwriting replaces the days that have events, no others.

    Events move to the task of their day first, and a crowded day is split over several; else each task would write a file for each day.
    """
    by_day = results.withColumn("event_date", F.to_date("event_ts")).hint("rebalance", "event_date")
    by_day.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("event_date").format(kind).save(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_state(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """State rows, one folder per day of the deadline, so that whole days can be dropped."""
    by_day(rows).write.mode(mode).partitionBy("expire_date").parquet(path)


def settled_removed(state: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """State rows without the settled or replaced ones."""
    return state.join(settled.select(*keys), keys, "left_anti")


def replaced_by(state: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """State after a publish: rows of the same key go, the new rows come, in one table."""
    return settled_removed(state, fresh.select(*keys).distinct(), keys).unionByName(fresh)
