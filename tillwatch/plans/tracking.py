"""A tracking run: from publishes and responses to states and events at one point in time."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.config import TrackingConfig
from tillwatch.operators import attribution, episodes, progress, results, settle
from tillwatch.operators.spread import heaviest
from tillwatch.session import Workspace

FEW_ROWS = 100_000  # fewer are not worth a bucket of their own


@dataclass(frozen=True)
class Inputs:
    """Validated input tables.

    publishes: message_key, published_at, msg_offset, cluster_id, expire_at, total_stores
    expected:  message_key, published_at, msg_offset, store_number, location_id, pos_hostname, units;
               one row per machine named, a null host with 0 units for a store without machines
    responses: message_key, store_number, pos_hostname, status, ack_at, received_at, seq
    repeated_hosts: whether a store may name a machine more than once
    buckets: number of buckets of the key that all three tables are read in already, where no key is heavy
    """

    publishes: DataFrame
    expected: DataFrame
    responses: DataFrame
    repeated_hosts: bool = True
    buckets: int | None = None

    def until(self, as_of: datetime | None) -> Inputs:
        """What was known at ``as_of``."""
        if as_of is None:
            return self
        at = F.lit(as_of).cast("timestamp")
        return Inputs(
            self.publishes.filter(F.col("published_at") <= at),
            self.expected.filter(F.col("published_at") <= at),
            self.responses.filter(F.col("received_at") <= at),
            self.repeated_hosts,
            self.buckets,
        )


def bucket_count(spark: SparkSession, rows: int, config: TrackingConfig) -> int:
    """Number of buckets of the key for this many rows of all inputs, so that each is small for a task."""
    usual = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / FEW_ROWS))
    return max(1, usual, math.ceil(rows / config.rows_per_bucket))


class TrackingRun:
    """Tables of one run, each computed when first asked for.

    Tables that feed several others, and the two large result tables, are written to the workspace once;
    message results are a projection of one of them.
    """

    def __init__(
        self,
        inputs: Inputs,
        workspace: Workspace,
        config: TrackingConfig | None = None,
        as_of: datetime | None = None,
    ):
        self.inputs = inputs.until(as_of)
        self.workspace = workspace
        self.config = config or TrackingConfig()
        self.as_of = as_of

    # --- tables written once ---------------------------------------------------------------

    @cached_property
    def key_sizes(self) -> DataFrame:
        """Rows of each key in all inputs."""
        return self.workspace.stage(episodes.key_sizes(self.inputs.publishes, self.inputs.expected, self.inputs.responses), "key_sizes")

    @cached_property
    def heavy_keys(self) -> DataFrame | None:
        """Keys with so many rows that no single task should scan one; None if there are none."""
        if self.inputs.buckets is not None:
            return None
        return heaviest(self.key_sizes, episodes.KEY, "n_rows", self.config)

    @cached_property
    def buckets(self) -> int | None:
        """Number of buckets of the key that tables are dealt into, so that each is small for a task; None where a key is heavy.

        Rows move to the bucket of their key once, when they come in: all tables of the run are of one key, one publish of it, one store or
        one machine, so what groups and joins them finds their rows together.
        """
        if self.inputs.buckets is not None or self.heavy_keys is not None:
            return self.inputs.buckets
        rows = self.key_sizes.agg(F.sum("n_rows")).first()[0] or 0
        return bucket_count(self.workspace.spark, rows, self.config)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows in the buckets of their key, as many as the staged tables have."""
        return rows if self.buckets is None or self.inputs.buckets is not None else rows.repartition(self.buckets, *episodes.KEY)

    def _stage(self, rows: DataFrame, name: str) -> DataFrame:
        return self.workspace.stage(rows, name, self.buckets, episodes.KEY)

    def _done_with(self, *names: str) -> None:
        """Remove tables that no other table or query is made from; asked for again, they are made again."""
        for name in names:
            self.__dict__.pop(name, None)
        self.workspace.drop(*names)

    @cached_property
    def episodes(self) -> DataFrame:
        """Publishes with their neighbours."""
        return self._stage(episodes.with_neighbours(self._dealt(self.inputs.publishes), self.heavy_keys, self.config), "episodes")

    @cached_property
    def attributed(self) -> DataFrame:
        """Responses with the publish they answer."""
        responses, heavy, config = self._dealt(self.inputs.responses), self.heavy_keys, self.config
        slices = None
        if heavy is not None:
            slices = self.workspace.stage(attribution.time_slices(responses, self.episodes, heavy, config), "slices")
        attributed = self._stage(attribution.attribute(responses, self.episodes, heavy, slices, config), "attributed")
        if slices is not None:
            self._done_with("slices")
        return attributed

    @cached_property
    def machines_of_stores(self) -> DataFrame | None:
        """Machines with their answers in time, their progress and what their store adds up to; None where that takes more than one scan.

        A bucket holds whole stores. If no machine is named twice either, machines and stores are known at once, and one table serves for both.
        """
        if self.buckets is None or self.inputs.repeated_hosts:
            return None
        facts = progress.host_facts(self.attributed, self._dealt(self.inputs.expected), self.config)
        return progress.unpacked(self._stage(progress.packed(progress.with_store(progress.with_progress(facts))), "machines"))

    @cached_property
    def machines(self) -> DataFrame:
        """Machines with their answers in time and the progress these make."""
        if self.machines_of_stores is not None:
            return self.machines_of_stores.drop("store")
        facts = progress.with_progress(progress.host_facts(self.attributed, self._dealt(self.inputs.expected), self.config))
        if not self.inputs.repeated_hosts:
            return self._stage(facts, "machines")
        facts = self._stage(facts, "machines_named_once")
        several = self._stage(facts.filter(progress.owes_several()), "machines_owing_several")
        if several.isEmpty():
            return facts
        ranked = progress.repeated_progress(several, self.attributed, self.config)
        return self._stage(facts.filter(~progress.owes_several()).unionByName(ranked), "machines")

    @cached_property
    def completion(self) -> DataFrame:
        """Stores with the response that completed them."""
        if self.machines_of_stores is not None:
            return progress.stores_of(self.machines_of_stores)
        return self._stage(progress.store_progress(self.machines), "completion")

    @cached_property
    def hosts(self) -> DataFrame:
        """Machines of known stores with their last accepted answer."""
        whole = self.machines_of_stores
        rows = progress.with_done(self.machines, self.completion, self.config) if whole is None else progress.with_own_store(whole)
        straddling = self._stage(rows.filter(progress.straddles()), "straddling")
        if straddling.isEmpty():
            latest = progress.latest_by_ends(rows)
        else:
            by_ends = progress.latest_by_ends(rows.filter(~progress.straddles()))
            latest = by_ends.unionByName(progress.latest_by_lookup(straddling, self.attributed, self.config))
        if whole is not None and straddling.isEmpty():
            return latest
        hosts = self._stage(latest, "hosts")
        if whole is None:
            self._done_with("straddling", "machines", "machines_named_once", "machines_owing_several")
        return hosts

    @cached_property
    def stores(self) -> DataFrame:
        """Stores with state and settlement."""
        facts = progress.store_facts(self.hosts)
        return self._stage(settle.settle_stores(facts, self.episodes, self.config, self.as_of), "stores")

    @cached_property
    def messages(self) -> DataFrame:
        """Episodes with counters, chain, state and flags."""
        settled = settle.settle_messages(self.stores)
        if self.heavy_keys is not None:
            settled = self._stage(settled, "settled")
        chained = episodes.with_chain(settled, self.heavy_keys, self.config)
        messages = self._stage(settle.finish_messages(chained, self.config), "messages")
        if self.heavy_keys is not None:
            self._done_with("settled")
        return messages

    # --- results ---------------------------------------------------------------------------

    @cached_property
    def outcomes(self) -> DataFrame:
        """Responses with the reason they are ignored, if they are."""
        return attribution.with_outcome(self.attributed, self.completion, self.config)

    @cached_property
    def message_results(self) -> DataFrame:
        return results.message_results(self.messages)

    @cached_property
    def store_results(self) -> DataFrame:
        events = results.store_results(self.hosts, self.completion, self.stores, self.messages, self.config)
        return self._stage(events, "store_results")

    @cached_property
    def pos_results(self) -> DataFrame:
        return self._stage(results.pos_results(self.hosts, self.stores, self.messages, self.config), "pos_results")
