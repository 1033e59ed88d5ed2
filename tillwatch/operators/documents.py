"""Store rows in their stored form: host lists and the status map as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import scalar as fn
from tillwatch.operators import progress
from tillwatch.schemas import STORE


def _status() -> Column:
    return F.struct(
        F.col("latest.status").alias("status"),
        F.col("latest.ack_at").alias("consumerAckTimestamp"),
        F.col("latest.received_at").alias("patchReceivedAt"),
    )


def status_entries(hosts: DataFrame) -> DataFrame:
    """The status map of a store as rows, a machine each: the JSON it is stored with, and whether the publish named it.

    Machines that answered without being named are entries like the others. However many a store has, nothing is gathered.
    """
    answered = hosts.filter("latest is not null")
    return answered.select(*STORE, "pos_hostname", (F.col("units") > 0).alias("named"), F.to_json(_status()).alias("entry"))


def store_documents(hosts: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """One row per store with the machines its publish named; these came as one list in one record.

    With ``stores``, a store without machines has empty lists. Machines that were not named have no bound on their
    number, so their statuses are not in the map but rows of ``status_entries``.
    """
    status = _status()
    named = hosts.filter("units > 0").groupBy(*STORE)
    responded = F.array_repeat("pos_hostname", F.size("progress"))
    missing = F.array_repeat("pos_hostname", progress.missing_units().cast("int"))
    entries = F.collect_list(F.when(F.col("latest").isNotNull(), F.struct("pos_hostname", status.alias("status"))))
    lists = named.agg(
        F.sort_array(F.flatten(F.collect_list(F.array_repeat("pos_hostname", F.col("units").cast("int"))))).alias("expected_pos"),
        F.sort_array(F.flatten(F.collect_list(responded))).alias("responded_pos"),
        F.sort_array(F.flatten(F.collect_list(missing))).alias("missing_pos"),
        F.map_from_entries(F.sort_array(entries)).alias("pos_statuses"),
    )
    written = lists.select(
        *STORE,
        *[fn.strings_to_json(c).alias(c) for c in ("expected_pos", "responded_pos", "missing_pos")],
        fn.statuses_to_json("pos_statuses").alias("pos_statuses"),
    )
    if stores is None:
        return written
    empty = {"expected_pos": "[]", "responded_pos": "[]", "missing_pos": "[]", "pos_statuses": "{}"}
    return stores.select(*STORE).join(written, STORE, "left").fillna(empty)


def from_documents(documents: DataFrame) -> DataFrame:
    """Stored rows back to arrays and the status map."""
    lists = {c: fn.strings_from_json(c) for c in ("expected_pos", "responded_pos", "missing_pos")}
    return documents.withColumns({**lists, "pos_statuses": fn.statuses_from_json("pos_statuses")})
