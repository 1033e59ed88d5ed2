"""Dashboard queries over the result tables.

``since`` keeps events from that time on, such as ``ago(as_of, days=1)``; folders of days before and files whose
times are all older are skipped. Shares of nothing are null.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch import vocabulary as v
from tillwatch.functions import scalar as fn
from tillwatch.operators import status as st
from tillwatch.operators.percentiles import percentiles


def ago(as_of: datetime, **span: float) -> datetime:
    """Start of a trailing period, as in ``ago(as_of, minutes=30)``."""
    return as_of - timedelta(**span)


def recent(events: DataFrame, since: datetime | None) -> DataFrame:
    """Events from a time on. Tables with a folder per day (``event_date``) are read from that day on."""
    if since is None:
        return events
    if "event_date" in events.columns:
        events = events.filter(F.col("event_date") >= F.lit(since.date()))
    return events.filter(F.col("event_ts") >= F.lit(since).cast("timestamp"))


def _slot(width: str) -> Column:
    return F.window("event_ts", width).getField("start").alias("slot")


def _share(condition: Column) -> Column:
    return F.try_divide(F.lit(100.0) * F.count_if(condition), F.count("*"))


def _newest(value: str, order: Column) -> Column:
    return F.max_by(value, order).alias(value)


STORE_EVENT_ORDER = ("event_ts", "checkpoint_pct", "store_number", "msg_offset")


def _order() -> Column:
    return F.struct(*STORE_EVENT_ORDER)


# --- complete state ------------------------------------------------------------------------------


def messages_by_state(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    return recent(messages, since).groupBy(_slot("1 hour"), "state").agg(F.count("*").alias("n"))


def inconsistency_rate(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    return recent(messages, since).agg(_share(F.col("has_inconsistency")).alias("pct_inconsistent"))


def inconsistency_breakdown(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    def having(flag: str, name: str) -> Column:
        return F.count_if(fn.has_flag("all_inconsistencies", flag)).alias(name)

    return recent(messages, since).agg(
        having(v.MISSING_POS, "missing_pos"),
        having(v.CONSUMER_ACK_MISSING, "unacknowledged"),
        having(v.MISSING_STORE, "missing_store"),
        having(v.DUPLICATE_KEY, "duplicate_keys"),
        having(v.LATE_POS_RESPONSE, "late_responses"),
    )


def replaced_per_hour(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    replaced = recent(messages, since).filter(F.col("state") == v.REPLACED)
    return replaced.groupBy(_slot("1 hour")).agg(F.count("*").alias("n"))


# --- by cluster ----------------------------------------------------------------------------------


def cluster_completion(stores: DataFrame, since: datetime | None = None) -> DataFrame:
    return recent(stores, since).groupBy("cluster_id", "message_key").agg(_newest("pos_completion_pct", _order()))


def degraded_by_cluster(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    degraded = recent(messages, since).filter(F.col("state") == v.DEGRADED)
    return degraded.groupBy("cluster_id").agg(F.count("*").alias("n"))


def unacknowledged_by_cluster(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    share = _share(fn.has_flag("all_inconsistencies", v.CONSUMER_ACK_MISSING)).alias("pct_unacknowledged")
    return recent(messages, since).groupBy("cluster_id").agg(share)


# --- by store ------------------------------------------------------------------------------------


def store_completion(stores: DataFrame, since: datetime | None = None) -> DataFrame:
    grouped = recent(stores, since).groupBy("message_key", "store_number")
    return grouped.agg(_newest("pos_completion_pct", _order()), _newest("state", _order()))


def missing_by_store(stores: DataFrame, since: datetime | None = None, limit: int | None = 20) -> DataFrame:
    finished = recent(stores, since).filter(F.col("state").isin(v.DONE, v.TIMED_OUT))
    totals = finished.groupBy("store_number").agg(F.sum("missing_pos_count").alias("missing_pos"))
    return totals if limit is None else totals.orderBy(F.desc("missing_pos"), "store_number").limit(limit)


def missing_machines_by_store(
    machines: DataFrame, since: datetime | None = None, limit: int = 20, approx: bool = False
) -> DataFrame:
    """Top stores by different missing machines; ``approx`` counts them with bounded-size sketches."""
    missing = recent(machines, since).filter(F.col("status") == v.MISSING)
    count = F.approx_count_distinct if approx else F.countDistinct
    distinct = missing.groupBy("store_number").agg(count("pos_hostname").alias("machines"))
    return distinct.orderBy(F.desc("machines"), "store_number").limit(limit)


def store_lookup(stores: DataFrame, message_key: str, store_number: str, since: datetime | None = None) -> DataFrame:
    wanted = (F.col("message_key") == message_key) & (F.col("store_number") == store_number)
    newest = [_newest(c, _order()) for c in ("state", "pos_completion_pct", "missing_pos_count")]
    return recent(stores, since).filter(wanted).agg(*newest)


# --- latency -------------------------------------------------------------------------------------

SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
LATENCY_SLICE_MS = 60_000


def latency(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    """Average and percentiles of publish to last consumer acknowledgement per half hour, in seconds."""
    rows = recent(messages, since).select(_slot("30 minutes"), "last_consumer_ack_ms")
    ranked = percentiles(rows, ["slot"], "last_consumer_ack_ms", SHARES, LATENCY_SLICE_MS, mean="mean")
    return ranked.select("slot", (F.col("mean") / 1000).alias("avg_sec"), *[F.round(F.col(p) / 1000, 6).alias(f"{p}_sec") for p in SHARES])


def latency_approx(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    """The same with bounded-size sketches instead of exact ranks."""
    ms = F.col("last_consumer_ack_ms")
    approx = [(F.percentile_approx(ms, share, 10_000) / 1000).alias(f"{p}_sec") for p, share in SHARES.items()]
    return recent(messages, since).groupBy(_slot("30 minutes")).agg((F.avg(ms) / 1000).alias("avg_sec"), *approx)


def delivery_window(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    mean = (F.avg("publish_to_last_pos_ack_ms") / 1000).alias("delivery_window_sec")
    return recent(messages, since).groupBy(_slot("30 minutes")).agg(mean)


def problem_trend(messages: DataFrame, since: datetime | None = None) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("unacked_pos_count", "missing_pos_count")]
    return recent(messages, since).groupBy(_slot("1 hour")).agg(*sums)


def slowest_clusters(messages: DataFrame, since: datetime | None = None, limit: int = 10) -> DataFrame:
    mean = recent(messages, since).groupBy("cluster_id").agg((F.avg("last_consumer_ack_ms") / 1000).alias("avg_sec"))
    return mean.orderBy(F.desc_nulls_last("avg_sec"), "cluster_id").limit(limit)


# --- questions -----------------------------------------------------------------------------------


def reached_all(messages: DataFrame) -> DataFrame:
    """For every key, whether its newest publish reached all machines, with the number still missing."""
    newest = F.struct("publish_no", "msg_offset", "missing", "state")
    return (
        messages.groupBy("message_key")
        .agg(F.max(newest).alias("newest"))
        .select(
            "message_key",
            "newest.msg_offset",
            F.col("newest.missing").alias("missing_pos_count"),
            (F.col("newest.missing") == 0).alias("reached_all"),
        )
    )


def missing_machines(machines: DataFrame) -> DataFrame:
    """Machines that never answered."""
    return machines.filter(F.col("status") == v.MISSING).select(
        "message_key", "msg_offset", "cluster_id", "store_number", "pos_hostname", "event_ts"
    )


def pending_by_store(stores: DataFrame) -> DataFrame:
    """Machines each open store still waits for."""
    return st.open_stores(stores).select("message_key", "msg_offset", "store_number", "state", F.col("missing").alias("pending_pos"))


def republished(messages: DataFrame) -> DataFrame:
    """Keys whose tracking was replaced: how often, and when last."""
    replaced = messages.filter(F.col("state") == v.REPLACED)
    return replaced.groupBy("message_key").agg(F.count("*").alias("times"), F.max("event_ts").alias("last_replaced_at"))


def chronic_missing(stores: DataFrame) -> DataFrame:
    """Missing machines of every store over all time."""
    return missing_by_store(stores, limit=None)


def event_volume(messages: DataFrame, stores: DataFrame, machines: DataFrame) -> DataFrame:
    """Events per type and day, and the largest number in one minute of the day."""
    kinds = {"message": messages, "store": stores, "pos": machines}
    rows = None
    for kind, df in kinds.items():
        part = df.select(F.lit(kind).alias("event_type"), F.date_trunc("minute", "event_ts").alias("minute"))
        rows = part if rows is None else rows.unionByName(part)
    per_minute = rows.groupBy("event_type", "minute").agg(F.count("*").alias("n"))
    return per_minute.groupBy("event_type", F.to_date("minute").alias("day")).agg(
        F.sum("n").alias("events"), F.max("n").alias("peak_per_minute")
    )


def in_flight(stores: DataFrame, messages: DataFrame) -> DataFrame:
    """Tracked messages and stores at the end of each day on which the number changed."""

    def changes(df: DataFrame, name: str) -> DataFrame:
        closed_at = F.coalesce("finalized_at", "next_published_at")
        steps = F.array(
            F.struct(F.col("published_at").alias("at"), F.lit(1).alias("step")),
            F.struct(closed_at.alias("at"), F.lit(-1).alias("step")),
        )
        return df.select(F.lit(name).alias("level"), F.explode(steps).alias("c")).select("level", "c.*").filter("at is not null")

    per_day = (
        changes(messages, "message")
        .unionByName(changes(stores, "store"))
        .groupBy("level", F.to_date("at").alias("day"))
        .agg(F.sum("step").alias("change"))
    )
    # At most one row per level and day is left.
    upto = W.partitionBy("level").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per_day.select("level", "day", F.sum("change").over(upto).alias("open_rows"))
