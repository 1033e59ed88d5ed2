"""Settling: when stores and messages become final, in which state, with which faults."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch import vocabulary as v
from tillwatch.config import TrackingConfig
from tillwatch.functions import scalar as fn
from tillwatch.operators.attribution import cutoff
from tillwatch.operators.episodes import publish_flags
from tillwatch.operators.spread import spread_join
from tillwatch.schemas import EPISODE


def settle_stores(stores: DataFrame, episodes: DataFrame, config: TrackingConfig, as_of: datetime | None) -> DataFrame:
    """Add the episode's columns, finalized_at and state to each store.

    A store is final when complete, else at its cutoff unless its message is replaced before that. A null
    finalized_at means open at ``as_of``, or dropped when the message was replaced.
    """
    joined = spread_join(stores, episodes.withColumn("_n", F.col("total_stores")), EPISODE, ["store_number"], "_n", config)
    next_at = F.col("next_published_at")
    by_clock = next_at.isNull() | (cutoff(config) <= next_at)
    if as_of is not None:
        by_clock = by_clock & (cutoff(config) <= F.lit(as_of).cast("timestamp"))
    finalized_at = F.when(F.col("done").isNotNull(), F.col("done.received_at")).when(by_clock, cutoff(config))
    state = (
        F.when(F.col("finalized_at").isNotNull() & (F.col("missing") > 0), v.TIMED_OUT)
        .when(F.col("finalized_at").isNotNull(), v.DONE)
        .when(F.col("responded") > 0, v.PARTIAL)
        .otherwise(v.PENDING)
    )
    return joined.withColumn("finalized_at", finalized_at).withColumn("state", state)


def settle_messages(stores: DataFrame) -> DataFrame:
    """One row per episode from settled stores: counters, roll-ups, and finalized_at once all stores are final."""
    final = F.col("finalized_at").isNotNull()
    of_episode = [
        *EPISODE,
        "cluster_id",
        "expire_at",
        "total_stores",
        "publish_no",
        "prev_published_at",
        "prev_msg_offset",
        "prev_expire_at",
        "next_published_at",
    ]
    settled = F.col("stores_done") + F.col("stores_partial") + F.col("stores_timed_out")
    return (
        stores.groupBy(*of_episode)
        .agg(
            F.count_if(final & (F.col("state") == v.DONE)).alias("stores_done"),
            F.count_if(final & ~F.col("state").isin(v.DONE, v.TIMED_OUT)).alias("stores_partial"),
            F.count_if(final & (F.col("state") == v.TIMED_OUT)).alias("stores_timed_out"),
            F.max("finalized_at").alias("last_settled_at"),
            F.sum("n_responses").alias("n_responses"),
            F.sum("missing").alias("missing"),
            F.sum("unacked").alias("unacked"),
            F.max("last_received_at").alias("last_received_at"),
            F.max("last_ack_at").alias("last_ack_at"),
            F.bool_or(final & F.col("conflicting")).alias("any_conflicting"),
            F.bool_or(final & F.col("ack_missing")).alias("any_ack_missing"),
            F.bool_or(final & (F.col("missing") > 0)).alias("any_missing"),
        )
        .withColumn("finalized_at", F.when(settled >= F.col("total_stores"), F.col("last_settled_at")))
    )


def with_chain_start(
    rows: DataFrame, messages: DataFrame, config: TrackingConfig, weight: str = "total_stores", spread_by: str = "store_number"
) -> DataFrame:
    """Add the first publish of the chain to rows of episodes: to stores, or with other weights to responses."""
    start = messages.select(*EPISODE, "first_published_at", F.col(weight).alias("_n"))
    return spread_join(rows, start, EPISODE, [spread_by], "_n", config)


def late(config: TrackingConfig, received_at: str = "last_received_at") -> Column:
    """An accepted response came more than the allowed whole minutes after the first publish of the chain."""
    lag = fn.whole_minutes("first_published_at", received_at)
    return F.coalesce(lag > config.late_minutes, F.lit(False))


def finish_messages(chained: DataFrame, config: TrackingConfig) -> DataFrame:
    """Add state, flags and the flag roll-up to episodes that know their chain."""
    final = F.col("finalized_at").isNotNull()
    missing_store = final & (F.col("stores_timed_out") > 0)
    flagged = (
        chained.withColumn("replaced", ~final & F.col("next_published_at").isNotNull())
        .withColumn("publish_flags", publish_flags())
        .withColumn("flags", fn.add_flags(F.col("publish_flags"), fn.flags(**{v.MISSING_STORE: missing_store})))
    )
    degraded = (F.size("flags") > 0) | (F.col("stores_timed_out") > 0) | (F.col("stores_partial") > 0)
    state = F.when(F.col("replaced"), v.REPLACED).when(~final, v.PENDING).when(degraded, v.DEGRADED).otherwise(v.DONE)
    from_stores = fn.flags(
        **{
            v.CONFLICTING_STATUS: F.col("any_conflicting"),
            v.CONSUMER_ACK_MISSING: F.col("any_ack_missing"),
            v.LATE_POS_RESPONSE: late(config),
            v.MISSING_POS: F.col("any_missing"),
        }
    )
    return flagged.withColumn("state", state).withColumn("all_flags", F.sort_array(F.array_union("flags", from_stores)))


def store_flags(config: TrackingConfig) -> Column:
    """Faults of a store in order of detection; an open or dropped store can only be late."""
    final = F.col("finalized_at").isNotNull()
    return fn.flags(
        **{
            v.LATE_POS_RESPONSE: late(config),
            v.CONFLICTING_STATUS: final & F.col("conflicting"),
            v.MISSING_POS: final & (F.col("missing") > 0),
            v.CONSUMER_ACK_MISSING: final & F.col("ack_missing"),
        }
    )
