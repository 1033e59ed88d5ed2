"""Roll-ups of result events per minute, added to by each run or batch, and the dashboards answered from them.

A row of a roll-up holds counts, sums and sketches, all of which merge: windows of whole minutes, hours and days are sums of rows, and no event is
read again. Each addition has a folder of its own, so a repeated one overwrites itself. Quantiles come from KLL sketches (rank error about 1.33 / k: 0.7 % at K) and
numbers of different machines from HyperLogLog sketches (relative error about 1.04 / sqrt(2^LG): 1.6 %); all else is exact.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch import vocabulary as v
from tillwatch.functions import scalar as fn
from tillwatch.plans.dashboards import SHARES

K = 200
LG = 12
MESSAGE, STORE, POS = "message", "store", "pos"
FLAGS = {
    "missing_pos": v.MISSING_POS,
    "unacknowledged": v.CONSUMER_ACK_MISSING,
    "missing_store": v.MISSING_STORE,
    "duplicate_keys": v.DUPLICATE_KEY,
    "late_responses": v.LATE_POS_RESPONSE,
}


def _minute() -> Column:
    return F.date_trunc("minute", "event_ts").alias("minute")


def message_rollup(messages: DataFrame) -> DataFrame:
    """Per minute, cluster and state: messages, faults, sums of latencies and machines, and a sketch of the latencies."""
    ack, last = F.col("last_consumer_ack_ms"), F.col("publish_to_last_pos_ack_ms")
    return messages.groupBy(_minute(), "cluster_id", "state").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("has_inconsistency").alias("inconsistent"),
        *[F.count_if(fn.has_flag("all_inconsistencies", flag)).alias(name) for name, flag in FLAGS.items()],
        F.sum(ack).alias("ack_ms"),
        F.count(ack).alias("ack_n"),
        F.sum(last).alias("last_ms"),
        F.count(last).alias("last_n"),
        F.sum("unacked_pos_count").alias("unacked_pos_count"),
        F.sum("missing_pos_count").alias("missing_pos_count"),
        F.kll_sketch_agg_bigint(ack, K).alias("ack_sketch"),
    )


def store_rollup(stores: DataFrame) -> DataFrame:
    """Per minute, store and state: events and missing machines."""
    return stores.groupBy(_minute(), "store_number", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("missing_pos_count").alias("missing_pos_count"))


def pos_rollup(machines: DataFrame) -> DataFrame:
    """Per minute, store and status: events, and a sketch of the different machines."""
    return machines.groupBy(_minute(), "store_number", "status").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("pos_hostname", LG).alias("machines"))


class Rollups:
    """Roll-ups below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, number: int, messages: DataFrame, stores: DataFrame, machines: DataFrame) -> None:
        """Add the events of run or batch ``number``; events may be of any time, but each must come in one addition only."""
        for name, rows in ((MESSAGE, message_rollup(messages)), (STORE, store_rollup(stores)), (POS, pos_rollup(machines))):
            months = rows.withColumn("month", F.to_date(F.date_trunc("month", "minute")))
            months.repartition("month").write.mode("overwrite").partitionBy("month").parquet(f"{self.folder}/{name}/addition={number}")

    def read(self, name: str, since: datetime | None = None) -> DataFrame:
        """Rows from a minute on; folders of months before are skipped."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        return rows if since is None else rows.filter((F.col("month") >= F.lit(since.date().replace(day=1))) & (F.col("minute") >= F.lit(since).cast("timestamp")))

    # --- dashboards, columns as in ``plans.dashboards`` ------------------------------------------

    def messages_by_state(self, since: datetime | None = None) -> DataFrame:
        return self.read(MESSAGE, since).groupBy(F.date_trunc("hour", "minute").alias("slot"), "state").agg(F.sum("n").alias("n"))

    def inconsistency_rate(self, since: datetime | None = None) -> DataFrame:
        return self.read(MESSAGE, since).agg(F.try_divide(F.lit(100.0) * F.sum("inconsistent"), F.sum("n")).alias("pct_inconsistent"))

    def inconsistency_breakdown(self, since: datetime | None = None) -> DataFrame:
        return self.read(MESSAGE, since).agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in FLAGS])

    def replaced_per_hour(self, since: datetime | None = None) -> DataFrame:
        return self.messages_by_state(since).filter(F.col("state") == v.REPLACED).drop("state")

    def degraded_by_cluster(self, since: datetime | None = None) -> DataFrame:
        return self.read(MESSAGE, since).filter(F.col("state") == v.DEGRADED).groupBy("cluster_id").agg(F.sum("n").alias("n"))

    def unacknowledged_by_cluster(self, since: datetime | None = None) -> DataFrame:
        share = F.try_divide(F.lit(100.0) * F.sum("unacknowledged"), F.sum("n")).alias("pct_unacknowledged")
        return self.read(MESSAGE, since).groupBy("cluster_id").agg(share)

    def missing_by_store(self, since: datetime | None = None, limit: int | None = 20) -> DataFrame:
        done = self.read(STORE, since).filter(F.col("state").isin(v.DONE, v.TIMED_OUT))
        totals = done.groupBy("store_number").agg(F.sum("missing_pos_count").alias("missing_pos"))
        return totals if limit is None else totals.orderBy(F.desc("missing_pos"), "store_number").limit(limit)

    def missing_machines_by_store(self, since: datetime | None = None, limit: int = 20) -> DataFrame:
        """Numbers of machines are estimates."""
        missing = self.read(POS, since).filter(F.col("status") == v.MISSING)
        counts = missing.groupBy("store_number").agg(F.hll_sketch_estimate(F.hll_union_agg("machines")).alias("machines"))
        return counts.orderBy(F.desc("machines"), "store_number").limit(limit)

    def latency(self, since: datetime | None = None) -> DataFrame:
        """Means are exact, percentiles estimates; null where no message of a slot was acknowledged."""
        merged = self.read(MESSAGE, since).groupBy(_half_hour()).agg(_mean("ack").alias("avg_sec"), F.sum("ack_n").alias("_n"), F.kll_merge_agg_bigint("ack_sketch", F.lit(K)).alias("_s"))
        of = lambda share: F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_bigint("_s", F.lit(share)) / 1000)
        return merged.select("slot", "avg_sec", *[of(share).alias(f"{p}_sec") for p, share in SHARES.items()])

    def delivery_window(self, since: datetime | None = None) -> DataFrame:
        return self.read(MESSAGE, since).groupBy(_half_hour()).agg(_mean("last").alias("delivery_window_sec"))

    def problem_trend(self, since: datetime | None = None) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("unacked_pos_count", "missing_pos_count")]
        return self.read(MESSAGE, since).groupBy(F.date_trunc("hour", "minute").alias("slot")).agg(*sums)

    def slowest_clusters(self, since: datetime | None = None, limit: int = 10) -> DataFrame:
        mean = self.read(MESSAGE, since).groupBy("cluster_id").agg(_mean("ack").alias("avg_sec"))
        return mean.orderBy(F.desc_nulls_last("avg_sec"), "cluster_id").limit(limit)

    def event_volume(self) -> DataFrame:
        parts = [self.read(name).select(F.lit(name).alias("event_type"), "minute", "n") for name in (MESSAGE, STORE, POS)]
        per_minute = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("event_type", "minute").agg(F.sum("n").alias("n"))
        return per_minute.groupBy("event_type", F.to_date("minute").alias("day")).agg(F.sum("n").alias("events"), F.max("n").alias("peak_per_minute"))


def _half_hour() -> Column:
    return F.window("minute", "30 minutes").getField("start").alias("slot")


def _mean(name: str) -> Column:
    return F.try_divide(F.sum(f"{name}_ms"), F.sum(f"{name}_n")) / 1000
