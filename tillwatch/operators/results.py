"""The three result tables: message, store and machine events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch import vocabulary as v
from tillwatch.config import TrackingConfig
from tillwatch.functions import scalar as fn
from tillwatch.operators import progress, settle
from tillwatch.operators.spread import spread_join
from tillwatch.schemas import EPISODE, HOST, STORE


def message_results(messages: DataFrame) -> DataFrame:
    """One event per settled episode and one per replaced episode."""
    first = "first_published_at"
    ended_at = F.when(F.col("replaced"), F.greatest("published_at", "last_settled_at")).otherwise(F.col("finalized_at"))
    return messages.filter("replaced or finalized_at is not null").select(
        "message_key",
        "cluster_id",
        F.col("msg_offset").cast("long").alias("msg_offset"),
        "state",
        *[F.col(c).cast("long").alias(c) for c in ("total_stores", "stores_done", "stores_partial", "stores_timed_out", "publish_count")],
        F.size("flags").cast("long").alias("inconsistency_count"),
        fn.join_flags("flags").alias("inconsistencies"),
        fn.epoch_millis(first).alias("first_published_at"),
        fn.epoch_millis("published_at").alias("last_published_at"),
        fn.epoch_millis("expire_at").alias("expire_at"),
        F.coalesce(fn.millis_between(first, ended_at), F.lit(0).cast("long")).alias("tracking_duration_ms"),
        F.when(F.col("replaced"), F.col("next_published_at")).otherwise(F.col("finalized_at")).alias("event_ts"),
        (F.size("all_flags") > 0).alias("has_inconsistency"),
        fn.join_flags("all_flags").alias("all_inconsistencies"),
        fn.millis_between(first, "last_ack_at").alias("last_consumer_ack_ms"),
        fn.millis_between(first, "last_received_at").alias("publish_to_last_pos_ack_ms"),
        F.col("unacked").alias("unacked_pos_count"),
        F.col("missing").alias("missing_pos_count"),
    )


def _store_event(rows: DataFrame) -> DataFrame:
    """Rows with state, checkpoint_pct, expected, responded, flags, event_ts to store events."""
    return rows.select(
        *EPISODE,
        "cluster_id",
        "store_number",
        "location_id",
        "state",
        F.col("checkpoint_pct").cast("long").alias("checkpoint_pct"),
        F.col("expected").alias("expected_pos_count"),
        F.col("responded").alias("responded_pos_count"),
        (F.col("expected") - F.col("responded")).alias("missing_pos_count"),
        F.size("flags").cast("long").alias("inconsistency_count"),
        fn.join_flags("flags").alias("inconsistencies"),
        fn.epoch_millis("expire_at").alias("expire_at"),
        "event_ts",
        fn.percent_2("responded", "expected", if_none=100.0).alias("pos_completion_pct"),
    )


def checkpoint_events(
    hosts: DataFrame, completion: DataFrame, stores: DataFrame, messages: DataFrame, config: TrackingConfig
) -> DataFrame:
    """Store events at checkpoints. At that moment a store is not examined yet, so only LATE can be known."""
    crossed = (
        progress.crossings(progress.steps(hosts, completion, config), config)
        .select(*STORE, "checkpoint_pct", "expected", F.col("nth").alias("responded"), F.col("received_at").alias("event_ts"))
        .join(stores.select(*STORE, "location_id", "cluster_id", "expire_at"), STORE)
    )
    # Without expected machines the first response completes the store.
    reached = fn.highest_checkpoint(F.lit(100), config.checkpoints)
    at_once = stores.filter("expected = 0 and done is not null").select(
        *STORE,
        reached.alias("checkpoint_pct"),
        "expected",
        "responded",
        F.col("done.received_at").alias("event_ts"),
        "location_id",
        "cluster_id",
        "expire_at",
    )
    # One join each: rows of a union are not known to lie in the buckets of their key, and would all move.
    events = settle.with_chain_start(crossed, messages, config).unionByName(
        settle.with_chain_start(at_once.filter("checkpoint_pct > 0"), messages, config)
    )
    return _store_event(
        events.withColumn("state", F.when(F.col("responded") >= F.col("expected"), v.DONE).otherwise(v.PARTIAL)).withColumn(
            "flags", fn.flags(**{v.LATE_POS_RESPONSE: settle.late(config, "event_ts")})
        )
    )


def final_events(stores: DataFrame, messages: DataFrame, config: TrackingConfig) -> DataFrame:
    """Store events at settlement, for stores that have not passed checkpoint 100."""
    finished = stores.filter(F.col("finalized_at").isNotNull() & (progress.last_checkpoint(config) < 100))
    return _store_event(
        settle.with_chain_start(finished, messages, config)
        .withColumn("flags", settle.store_flags(config))
        .withColumn("checkpoint_pct", F.lit(100))
        .withColumn("event_ts", F.col("finalized_at"))
    )


def store_results(
    hosts: DataFrame, completion: DataFrame, stores: DataFrame, messages: DataFrame, config: TrackingConfig
) -> DataFrame:
    """Checkpoint and settlement events of all stores."""
    return checkpoint_events(hosts, completion, stores, messages, config).unionByName(final_events(stores, messages, config))


def pos_results(hosts: DataFrame, stores: DataFrame, messages: DataFrame, config: TrackingConfig) -> DataFrame:
    """Events of problem machines at settlement of their store: one per missing answer, one per bad status."""
    bad = F.col("latest.status").isin(v.FAILED, v.DELIVERED_NO_ACK)
    per_store = stores.filter("finalized_at is not null").select(
        *STORE, "cluster_id", "location_id", "expire_at", F.col("finalized_at").alias("event_ts"), "n_hosts"
    )
    per_store = settle.with_chain_start(per_store, messages, config)
    missing = (
        hosts.filter(progress.missing_units() > 0)
        .select(*HOST, F.explode(F.sequence(F.lit(1), progress.missing_units().cast("int"))).alias("_"))
        .select(*HOST, F.lit(v.MISSING).alias("status"), F.lit(None).cast("timestamp").alias("received_at"))
    )
    answered = hosts.filter(bad).select(*HOST, "latest.status", "latest.received_at")
    problems = missing.unionByName(answered)
    return spread_join(problems, per_store, STORE, ["pos_hostname"], "n_hosts", config).select(
        *EPISODE,
        "cluster_id",
        "store_number",
        "location_id",
        "pos_hostname",
        "status",
        fn.epoch_millis("expire_at").alias("expire_at"),
        fn.epoch_millis("first_published_at").alias("first_published_at"),
        fn.millis_between("first_published_at", "received_at").alias("response_lag_ms"),
        "event_ts",
    )
