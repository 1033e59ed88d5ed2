"""Responses per machine, progress and completion per store, checkpoints.

The rules are stated on the sequence of responses of a store, but need no window over that sequence:
a response advances its store when its machine still owes one, so the store is complete at the latest of
the responses its machines owed. That is a minimum per machine and a maximum per store, both combined
before the shuffle. Only responses around the completion of a store need a second look at the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch import vocabulary as v
from tillwatch.config import TrackingConfig
from tillwatch.functions import scalar as fn
from tillwatch.operators.attribution import at_or_before, in_window
from tillwatch.operators.scan import running_total
from tillwatch.operators.spread import spread_join
from tillwatch.schemas import HOST, STORE

NO_PROGRESS = "array<struct<received_at:timestamp,seq:bigint>>"


def _response() -> Column:
    return F.struct("received_at", "seq", "status", "ack_at")


def host_facts(attributed: DataFrame, expected: DataFrame, config: TrackingConfig) -> DataFrame:
    """One row per machine of a store: units it owes, how often it answered in time, first and last answer.

    A machine named twice owes two units; one that was not named owes none. A store without machines has
    one row with a null host.
    """
    named = expected.select(*HOST, "location_id", "units", F.lit(True).alias("known"))
    answered = attributed.filter(in_window(config)).select(*HOST, _response().alias("response"))
    return (
        named.unionByName(answered, allowMissingColumns=True)
        .groupBy(*HOST)
        .agg(
            F.max("location_id").alias("location_id"),
            F.coalesce(F.max("known"), F.lit(False)).alias("known"),
            F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
            F.count("response").alias("n_responses"),
            F.min("response").alias("first_response"),
            F.max("response").alias("last_response"),
        )
    )


def with_progress(hosts: DataFrame) -> DataFrame:
    """Add ``progress``: the answers of a machine that advance its store, oldest first, at most one per unit.

    For a machine named once that is its first answer; ``repeated_progress`` serves the others.
    """
    first = F.array(F.struct("first_response.received_at", "first_response.seq"))
    answered = (F.col("units") > 0) & (F.col("n_responses") > 0)
    return hosts.withColumn("progress", F.when(answered, first).otherwise(F.array().cast(NO_PROGRESS)))


def owes_several() -> Column:
    """The machine was named more than once and answered more than once."""
    return (F.col("units") > 1) & (F.col("n_responses") > 1)


def repeated_progress(hosts: DataFrame, attributed: DataFrame, config: TrackingConfig) -> DataFrame:
    """``progress`` for the machines of ``hosts``, staged rows that ``owes_several`` holds for, by ranking raw answers."""
    raw = attributed.filter(in_window(config)).select(*HOST, "received_at", "seq")
    wanted = hosts.select(*HOST, "units", F.col("n_responses").alias("_n"))
    ranked = running_total(
        spread_join(raw, wanted, HOST, ["seq"], "_n", config),
        HOST,
        fn.segment_of("received_at", config.segment_seconds),
        ["received_at", "seq"],
        F.lit(1),
        "_nth",
    )
    # At most one entry per unit, and the units came as one list in one publish.
    advancing = F.sort_array(F.collect_list(F.struct("received_at", "seq"))).alias("progress")
    return hosts.drop("progress").join(ranked.filter("_nth <= units").groupBy(*HOST).agg(advancing), HOST)


def store_progress(hosts: DataFrame) -> DataFrame:
    """One row per store: expected and responded units, and ``done``, the response that completed it.

    A store that only responses name is not ``known``.
    """
    totals = hosts.groupBy(*STORE).agg(*[total.alias(name) for name, total in _store_totals().items()])
    return totals.withColumn("done", _done()).drop("_all_owed", "_any")


def _store_totals() -> dict[str, Column]:
    """What the machines of a store add up to."""
    owed = F.when(F.size("progress") == F.col("units"), F.element_at("progress", -1))
    any_first = F.struct("first_response.received_at", "first_response.seq")
    return {
        "known": F.bool_or("known"),
        "location_id": F.max("location_id"),
        "expected": F.sum("units"),
        "responded": F.sum(F.size("progress")),
        "_all_owed": F.max(F.when(F.col("units") > 0, owed)),
        "_any": F.min(F.when(F.col("n_responses") > 0, any_first)),
        "n_responses": F.sum("n_responses"),
        "n_hosts": F.count(F.lit(1)),
    }


def _done(prefix: str = "") -> Column:
    expected, responded, all_owed, any_first = (F.col(f"{prefix}{c}") for c in ("expected", "responded", "_all_owed", "_any"))
    return F.when(expected == 0, any_first).when(responded == expected, all_owed)


STORE_COLUMNS = ("known", "location_id", "expected", "responded", "n_responses", "n_hosts", "done")


def with_store(hosts: DataFrame) -> DataFrame:
    """Add ``store`` to machines, the row of ``store_progress`` as a struct. A store's machines are one window, so none may be heavy."""
    per_store = W.partitionBy(*STORE)
    rows = hosts.withColumns({f"_s_{name}": total.over(per_store) for name, total in _store_totals().items()})
    store = F.struct(*[F.col(f"_s_{c}").alias(c) for c in STORE_COLUMNS])
    return rows.withColumn("_s_done", _done("_s_")).withColumn("store", store).select(*hosts.columns, "store")


def packed(hosts: DataFrame) -> DataFrame:
    """Machines named once without what their first answer tells: ``progress``, and the last answer where it is the first."""
    return hosts.withColumn("last_response", F.when(F.col("n_responses") > 1, F.col("last_response"))).drop("progress")


def unpacked(hosts: DataFrame) -> DataFrame:
    """What was ``packed``."""
    return with_progress(hosts.withColumn("last_response", F.coalesce("last_response", "first_response")))


def stores_of(hosts: DataFrame) -> DataFrame:
    """``store_progress`` from machines ``with_store``."""
    return hosts.select(*STORE, "store.*").distinct()


def with_own_store(hosts: DataFrame) -> DataFrame:
    """``with_done`` from machines ``with_store``; as in a join, stores without a name have no place in it."""
    of_store = [F.col(f"store.{c}") for c in ("location_id", "done", "expected", "responded", "n_hosts")]
    return hosts.filter("store.known").dropna(subset=STORE).select(*[c for c in hosts.columns if c not in ("known", "location_id", "store")], *of_store)


def with_done(hosts: DataFrame, stores: DataFrame, config: TrackingConfig) -> DataFrame:
    """Machines of known stores with the completion of their store. ``stores`` is the staged ``store_progress``."""
    done = stores.select(*STORE, F.col("known").alias("_known"), "location_id", "done", "expected", "responded", "n_hosts")
    joined = spread_join(hosts.drop("known", "location_id"), done, STORE, ["pos_hostname"], "n_hosts", config)
    return joined.filter("_known").drop("_known")


def straddles() -> Column:
    """The machine has answers on either side of its store's completion, and some in between."""
    return (F.col("n_responses") > 2) & _cut_off() & _starts_before()


def _cut_off() -> Column:
    return F.coalesce(F.col("done").isNotNull() & ~at_or_before(F.col("last_response"), F.col("done")), F.lit(False))


def _starts_before() -> Column:
    return F.coalesce(at_or_before(F.col("first_response"), F.col("done")), F.lit(False))


def latest_by_ends(hosts: DataFrame) -> DataFrame:
    """Add ``latest``, the last accepted answer, to machines whose first and last answer settle it."""
    latest = F.when(~_cut_off(), F.col("last_response")).when(_starts_before(), F.col("first_response"))
    return hosts.withColumn("latest", latest).drop("first_response", "last_response")


def latest_by_lookup(hosts: DataFrame, attributed: DataFrame, config: TrackingConfig) -> DataFrame:
    """Add ``latest`` to staged machines that straddle the completion of their store, from their raw answers."""
    raw = attributed.filter(in_window(config)).select(*HOST, _response().alias("response"), "seq")
    found = spread_join(raw, hosts.withColumn("_n", F.col("n_responses")), HOST, ["seq"], "_n", config)
    kept = [c for c in hosts.columns if c not in ("first_response", "last_response")]
    return found.filter(at_or_before(F.col("response"), F.col("done"))).groupBy(*kept).agg(F.max("response").alias("latest"))


def missing_units() -> Column:
    """Answers a machine still owes."""
    return F.col("units") - F.size("progress")


def store_facts(hosts: DataFrame) -> DataFrame:
    """One row per store from machines with ``latest``: counts, completion, and what its faults rest on."""
    status, ack = F.col("latest.status"), F.col("latest.ack_at")
    confirmed = status.isin(v.DONE, v.DELIVERED)

    def any_of(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    # What all machines of a store share is grouped by, so that only numbers and times are aggregated.
    return hosts.groupBy(*STORE, "location_id", "expected", "responded", "done").agg(
        F.sum(missing_units()).alias("missing"),
        F.sum("n_responses").alias("n_responses"),
        F.count("*").alias("n_hosts"),
        (any_of(confirmed) & any_of(status == v.DELIVERED_NO_ACK)).alias("conflicting"),
        any_of(confirmed & ack.isNull()).alias("ack_missing"),
        F.count_if(F.col("latest").isNotNull() & ack.isNull()).alias("unacked"),
        F.max("latest.received_at").alias("last_received_at"),
        F.max(ack).alias("last_ack_at"),
    )


def steps(hosts: DataFrame, completion: DataFrame, config: TrackingConfig) -> DataFrame:
    """Every response that advances a store, with ``nth``, its number within the store.

    ``completion`` is the staged ``store_progress``; if no store in it is heavy, one window does.
    """
    advancing = (
        hosts.filter(F.size("progress") > 0)
        .select(*STORE, "expected", F.explode("progress").alias("_at"))
        .select(*STORE, "expected", "_at.*")
    )
    if completion.filter(F.col("responded") > config.rows_per_task).isEmpty():
        return advancing.withColumn("nth", F.row_number().over(W.partitionBy(*STORE).orderBy("received_at", "seq")).cast("long"))
    return running_total(
        advancing,
        STORE,
        fn.segment_of("received_at", config.segment_seconds),
        ["received_at", "seq"],
        F.lit(1),
        "nth",
    )


def crossings(steps: DataFrame, config: TrackingConfig) -> DataFrame:
    """Steps at which a store passes a checkpoint; of several passed at once the highest counts."""
    now = fn.highest_checkpoint(fn.percent(F.col("nth"), F.col("expected")), config.checkpoints)
    before = fn.highest_checkpoint(fn.percent(F.col("nth") - 1, F.col("expected")), config.checkpoints)
    return steps.withColumn("checkpoint_pct", now).filter(now > before)


def last_checkpoint(config: TrackingConfig) -> Column:
    """Highest checkpoint a store has passed by responses."""
    reached = fn.highest_checkpoint(fn.percent(F.col("responded"), F.col("expected")), config.checkpoints)
    return F.when((F.col("expected") == 0) & F.col("done").isNull(), F.lit(0)).otherwise(reached)
