"""What is open at a point in time: status documents, point reads, worklists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch import vocabulary as v
from tillwatch.config import TrackingConfig
from tillwatch.functions import scalar as fn
from tillwatch.operators import progress, settle
from tillwatch.schemas import EPISODE, STORE

EXPIRED_STORE = "EXPIRED_STORE"
STALLED_STORE = "STALLED_STORE"
STALLED_MESSAGE = "STALLED_MESSAGE"
READING_ORDER = ["message_key", "published_at", "msg_offset"]


def open_messages(messages: DataFrame) -> DataFrame:
    """Messages still tracked: neither settled nor replaced."""
    return messages.filter(F.col("state") == v.PENDING)


def open_stores(stores: DataFrame) -> DataFrame:
    """Stores still tracked."""
    return stores.filter("finalized_at is null and next_published_at is null")


def message_of(messages: DataFrame, message_key: str) -> DataFrame:
    """The open message of a key: one row or none."""
    return open_messages(messages).filter(F.col("message_key") == message_key)


def store_of(stores: DataFrame, message_key: str, store_number: str) -> DataFrame:
    """One open store of a key."""
    return open_stores(stores).filter((F.col("message_key") == message_key) & (F.col("store_number") == store_number))


def stores_of(stores: DataFrame, message_key: str) -> DataFrame:
    """The open stores of a key in order."""
    return open_stores(stores).filter(F.col("message_key") == message_key).orderBy("store_number")


def _missing_hosts(hosts: DataFrame) -> DataFrame:
    """Missing machines per store, sorted. The list is part of the list one publish record brought."""
    owing = hosts.filter(progress.missing_units() > 0)
    names = F.array_repeat("pos_hostname", progress.missing_units().cast("int"))
    return owing.groupBy(*STORE).agg(F.sort_array(F.flatten(F.collect_list(names))).alias("missing_pos"))


def store_details(hosts: DataFrame, stores: DataFrame, messages: DataFrame, config: TrackingConfig) -> DataFrame:
    """One row per open store, with the names of its missing machines."""
    still_open = settle.with_chain_start(open_stores(stores), messages, config)
    return still_open.join(_missing_hosts(hosts), STORE, "left").select(
        *EPISODE,
        "store_number",
        "state",
        fn.percent_2("responded", "expected", if_none=100.0).alias("pos_completion_pct"),
        F.col("responded").alias("responded_pos_count"),
        F.col("expected").alias("expected_pos_count"),
        F.col("missing").alias("missing_pos_count"),
        fn.or_empty("missing_pos").alias("missing_pos"),
        settle.store_flags(config).alias("inconsistencies"),
    )


def _message_columns() -> list[Column]:
    settled = F.col("stores_done") + F.col("stores_partial") + F.col("stores_timed_out")
    return [
        F.col("cluster_id"),
        F.col("state"),
        fn.percent_2(settled, "total_stores", if_none=0.0).alias("cluster_completion_pct"),
        F.col("total_stores").cast("long").alias("total_stores"),
        F.col("stores_done"),
        F.col("stores_partial"),
        (F.col("total_stores") - settled).cast("long").alias("stores_pending"),
        F.col("stores_timed_out"),
        F.col("first_published_at"),
        F.col("expire_at"),
        F.col("flags").alias("inconsistencies"),
    ]


def status_documents(hosts: DataFrame, stores: DataFrame, messages: DataFrame, config: TrackingConfig) -> DataFrame:
    """One nested document per open message. Its stores came in one publish record, so they fit in one."""
    details = store_details(hosts, stores, messages, config)
    fields = [c for c in details.columns if c not in EPISODE]
    nested = details.groupBy(*EPISODE).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("stores"))
    return open_messages(messages).select(*EPISODE, *_message_columns()).join(nested, EPISODE, "left").drop("published_at", "msg_offset")


# The names of a status document's fields, in their order.
MESSAGE_FIELDS = {
    "messageKey": "message_key",
    "clusterId": "cluster_id",
    "state": "state",
    "clusterCompletionPct": "cluster_completion_pct",
    "totalStores": "total_stores",
    "storesDone": "stores_done",
    "storesPartial": "stores_partial",
    "storesPending": "stores_pending",
    "storesTimedOut": "stores_timed_out",
    "firstPublishedAt": "first_published_at",
    "expireAt": "expire_at",
    "inconsistencies": "inconsistencies",
}
STORE_FIELDS = {
    "storeNumber": "store_number",
    "state": "state",
    "posCompletionPct": "pos_completion_pct",
    "respondedPosCount": "responded_pos_count",
    "expectedPosCount": "expected_pos_count",
    "missingPosCount": "missing_pos_count",
    "missingPos": "missing_pos",
    "inconsistencies": "inconsistencies",
}


def status_json(hosts: DataFrame, stores: DataFrame, messages: DataFrame, config: TrackingConfig) -> DataFrame:
    """The documents as they are sent: the key and a JSON text; a message without open stores has an empty list."""
    inner = F.transform(F.coalesce("stores", F.array()), lambda s: F.struct(*[s[c].alias(name) for name, c in STORE_FIELDS.items()]))
    document = F.struct(*[F.col(c).alias(name) for name, c in MESSAGE_FIELDS.items()], inner.alias("stores"))
    return status_documents(hosts, stores, messages, config).select("message_key", F.to_json(document).alias("document"))


def status_json_of(hosts: DataFrame, stores: DataFrame, messages: DataFrame, config: TrackingConfig, message_key: str) -> DataFrame:
    """The document of one key: one row, or none if nothing of it is open. Only the key's rows are joined and grouped."""
    return status_json(*(df.filter(F.col("message_key") == message_key) for df in (hosts, stores, messages)), config)


def status_rows(hosts: DataFrame, stores: DataFrame, messages: DataFrame, config: TrackingConfig) -> DataFrame:
    """The same as flat rows, one per open message and open store."""
    details = store_details(hosts, stores, messages, config).select(
        *EPISODE,
        "store_number",
        F.col("state").alias("store_state"),
        "pos_completion_pct",
        "responded_pos_count",
        "expected_pos_count",
        "missing_pos_count",
        fn.join_flags("missing_pos").alias("missing_pos"),
        fn.join_flags("inconsistencies").alias("store_inconsistencies"),
    )
    heads = open_messages(messages).select(*EPISODE, *_message_columns())
    return (
        heads.withColumn("inconsistencies", fn.join_flags("inconsistencies"))
        .withColumn("first_published_at", fn.epoch_millis("first_published_at"))
        .withColumn("expire_at", fn.epoch_millis("expire_at"))
        .join(details, EPISODE, "left")
        .drop("published_at", "msg_offset")
    )


# --- worklists -----------------------------------------------------------------------------------


def _first(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows in an order; without a limit all rows, in no order."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def expired_open(stores: DataFrame, as_of: datetime, limit: int | None = None) -> DataFrame:
    """Open stores past their deadline; with a limit the oldest."""
    at = F.lit(as_of).cast("timestamp")
    expired = open_stores(stores).filter((F.col("expire_at") < at) & F.col("state").isin(v.PENDING, v.PARTIAL))
    first = _first(expired, ["expire_at", *READING_ORDER, "store_number"], limit)
    return first.select("message_key", "msg_offset", "store_number", "state", "expire_at")


def _last_activity() -> Column:
    return F.greatest("published_at", "last_received_at")


def stalled_stores(stores: DataFrame, as_of: datetime, config: TrackingConfig, limit: int | None = None) -> DataFrame:
    """Open stores without a publish or response for some minutes; with a limit the longest."""
    before = fn.minutes_before(F.lit(as_of).cast("timestamp"), config.stalled_minutes)
    stalled = open_stores(stores).withColumn("last_activity", _last_activity()).filter(F.col("last_activity") < before)
    first = _first(stalled, ["last_activity", *READING_ORDER, "store_number"], limit)
    return first.select("message_key", "msg_offset", "store_number", "state", "last_activity")


def stalled_messages(messages: DataFrame, as_of: datetime, config: TrackingConfig, limit: int | None = None) -> DataFrame:
    """Open messages without a publish or response for some minutes; with a limit the longest."""
    before = fn.minutes_before(F.lit(as_of).cast("timestamp"), config.stalled_minutes)
    stalled = open_messages(messages).withColumn("last_activity", _last_activity()).filter(F.col("last_activity") < before)
    return _first(stalled, ["last_activity", *READING_ORDER], limit).select("message_key", "msg_offset", "state", "last_activity")


def attention_list(stores: DataFrame, messages: DataFrame, as_of: datetime, config: TrackingConfig) -> DataFrame:
    """The three worklists whole, as one report: stalled messages, stalled stores, expired open stores."""
    expired = expired_open(stores, as_of).withColumnRenamed("expire_at", "since")
    slow_stores = stalled_stores(stores, as_of, config).withColumnRenamed("last_activity", "since")
    slow_messages = stalled_messages(messages, as_of, config).withColumnRenamed("last_activity", "since")
    return (
        slow_messages.withColumn("reason", F.lit(STALLED_MESSAGE))
        .unionByName(slow_stores.withColumn("reason", F.lit(STALLED_STORE)), allowMissingColumns=True)
        .unionByName(expired.withColumn("reason", F.lit(EXPIRED_STORE)))
    )
