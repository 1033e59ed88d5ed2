"""Give each response to the publish it answers: the latest of its key at or before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.config import TrackingConfig
from tillwatch.functions import scalar as fn
from tillwatch.operators.episodes import KEY
from tillwatch.operators.scan import only_heavy, with_slice
from tillwatch.operators.spread import assign_part, heaviest, repeat_parts, spread_join
from tillwatch.schemas import HOST, STORE

UNKNOWN_KEY = "UNKNOWN_KEY"
AFTER_CUTOFF = "AFTER_CUTOFF"
UNKNOWN_STORE = "UNKNOWN_STORE"
STORE_DONE = "STORE_DONE"


def _starts(publishes: DataFrame) -> DataFrame:
    return publishes.select("message_key", F.col("published_at").alias("_at"), _publish().alias("_publish"))


def _publish() -> Column:
    return F.struct("published_at", "msg_offset", "expire_at")


def time_slices(responses: DataFrame, publishes: DataFrame, heavy: DataFrame, config: TrackingConfig) -> DataFrame:
    """One row per heavy key and time slice with responses: their number, and the newest publish before it."""
    sent = with_slice(only_heavy(_starts(publishes), KEY, heavy), KEY, "_at", heavy, config)
    asked = with_slice(only_heavy(responses, KEY, heavy), KEY, "received_at", heavy, config)
    keys = [*KEY, "_slice"]
    earlier = W.partitionBy(*KEY).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return (
        sent.groupBy(*keys)
        .agg(F.max("_publish").alias("newest"))
        .unionByName(asked.groupBy(*keys).agg(F.count("*").alias("n")), allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.max("newest").alias("newest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        .select(*keys, F.max("newest").over(earlier).alias("_publish"), "n")
        .filter("n > 0")
    )


def attribute(
    responses: DataFrame, publishes: DataFrame, heavy: DataFrame | None, slices: DataFrame | None, config: TrackingConfig
) -> DataFrame:
    """As-of join: add published_at, msg_offset, expire_at of the publish, null where there is none.

    One scan per key over publishes and responses in order. A heavy key is scanned in time slices, which
    the staged result of ``time_slices`` describes; a slice with very many responses is spread further by
    a hash of ``seq``, with its publishes repeated, since responses need no order among themselves.
    """
    answers = with_slice(responses, KEY, "received_at", heavy, config).withColumn("_at", F.col("received_at"))
    starts = with_slice(_starts(publishes), KEY, "_at", heavy, config)
    answers, starts = answers.withColumn("_kind", F.lit(2)), starts.withColumn("_kind", F.lit(1))
    group = [*KEY, "_slice"]
    if slices is not None:
        heads = slices.filter("_publish is not null").drop("n").withColumn("_kind", F.lit(0))
        starts = starts.unionByName(heads, allowMissingColumns=True)
        crowded = heaviest(slices, group, "n", config)
        if crowded is not None:
            answers = assign_part(answers, crowded, group, ["seq"])
            starts = repeat_parts(starts, crowded, group)
            group = [*group, "_part"]
    # Heads have no time and sort first; at equal times a publish comes before a response.
    upto = W.partitionBy(*group).orderBy("_at", "_kind", "_publish").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        answers.unionByName(starts, allowMissingColumns=True)
        .withColumn("_publish", F.last("_publish", ignorenulls=True).over(upto))
        .filter("_kind = 2")
        .select(*responses.columns, "_publish.*")
    )


def cutoff(config: TrackingConfig) -> Column:
    """When a store that is still open settles by itself."""
    return fn.seconds_after("expire_at", config.cleanup_lag_seconds)


def in_window(config: TrackingConfig) -> Column:
    """The response has a publish and arrived before that publish's cutoff."""
    return F.coalesce(F.col("received_at") < cutoff(config), F.lit(False))


def with_outcome(attributed: DataFrame, completion: DataFrame, config: TrackingConfig) -> DataFrame:
    """Add ``reject_reason`` to each response: null if accepted, else why it is stale.

    ``completion`` is the staged ``store_progress``: one row per store that got a response in time or is
    known, with ``done``, the response that completed it. Only responses in time need it.
    """
    in_time = attributed.filter(in_window(config))
    stores = completion.select(*STORE, "known", "done", F.col("n_responses").alias("_n"))
    after_done = F.col("done").isNotNull() & ~at_or_before(F.struct("received_at", "seq"), F.col("done"))
    judged = spread_join(in_time, stores, STORE, ["seq"], "_n", config).withColumn(
        "reject_reason", F.when(~F.col("known"), F.lit(UNKNOWN_STORE)).when(after_done, F.lit(STORE_DONE))
    )
    too_late = attributed.filter(~in_window(config)).withColumn(
        "reject_reason", F.when(F.col("published_at").isNull(), F.lit(UNKNOWN_KEY)).otherwise(F.lit(AFTER_CUTOFF))
    )
    return judged.drop("known", "done").unionByName(too_late)


def stale(outcomes: DataFrame) -> DataFrame:
    """The responses that are ignored, with the reason."""
    return outcomes.filter("reject_reason is not null")


def at_or_before(a: Column, b: Column) -> Column:
    """Response a came no later than response b; ties go by seq."""
    a_at, b_at = a.getField("received_at"), b.getField("received_at")
    return (a_at < b_at) | ((a_at == b_at) & (a.getField("seq") <= b.getField("seq")))


def unexpected_hosts(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """Accepted responses of machines that the publish did not name for the store."""
    named = expected.filter("pos_hostname is not null").select(*HOST)
    accepted = outcomes.filter("reject_reason is null")
    # One row per machine first: a machine may answer any number of times.
    answered = accepted.groupBy(*HOST).agg(F.count("*").alias("n_responses"), F.min("received_at").alias("first_received_at"))
    return answered.join(named, HOST, "left_anti")

