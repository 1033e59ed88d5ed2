"""Deliveries derived from order tables: an order is a publish, its customer the message, its lines machines.

An order's suppliers, modulo 3, are its stores; a (supplier, part) pair is a machine. Lines that are
returned or filled answer, those with a large quantity twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.config import TrackingConfig
from tillwatch.operators.episodes import KEY
from tillwatch.plans.tracking import Inputs, bucket_count
from tillwatch.session import Workspace

STORES_PER_ORDER = 3
PUBLISH = ["message_key", "published_at", "msg_offset"]

# The columns used here; reading with a schema needs no look at the files while planning.
COLUMNS = {
    "customer": "c_custkey bigint, c_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_returnflag string, l_linestatus string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def _store() -> Column:
    return F.concat(F.lit("S"), F.pmod("l_suppkey", F.lit(STORES_PER_ORDER)).cast("string")).alias("store_number")


def _host() -> Column:
    return F.concat_ws("-", F.lit("pos"), F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("pos_hostname")


def publishes(spark: SparkSession, folder: str) -> DataFrame:
    """One publish per order that has lines."""
    return _counted_publishes(spark, folder).drop("n_lines")


def _counted_publishes(spark: SparkSession, folder: str) -> DataFrame:
    """Publishes with the number of lines of their order."""
    lines = table(spark, folder, "lineitem")
    has_store = [F.max((F.pmod("l_suppkey", F.lit(STORES_PER_ORDER)) == s).cast("int")) for s in range(STORES_PER_ORDER)]
    stores = lines.groupBy("l_orderkey").agg(sum(has_store[1:], has_store[0]).alias("total_stores"), F.count("*").alias("n_lines"))
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    published = "(o_orderdate + (o_orderkey % 1440) * interval '1' minute)"
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(stores, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("message_key"),
            F.expr(f"cast({published} as timestamp)").alias("published_at"),
            F.col("o_orderkey").alias("msg_offset"),
            F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("cluster_id"),
            F.expr(f"cast({published} + (30 + (o_orderkey % 5) * 60) * interval '1' day as timestamp)").alias("expire_at"),
            F.col("total_stores").cast("int").alias("total_stores"),
            "n_lines",
        )
    )


def _machines(lines: DataFrame) -> DataFrame:
    return lines.select(
        *PUBLISH,
        _store(),
        F.lit(None).cast("string").alias("location_id"),
        _host(),
        F.lit(1).cast("long").alias("units"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by their order, with how often they answer and what, in columns that are short to move."""
    rows = table(spark, folder, "lineitem")
    answering = ~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"))
    filled = F.col("l_linestatus") == "F"
    returned = F.col("l_returnflag")
    status = (
        F.when(returned == "A", "DONE")
        .when((returned == "R") & filled, "DELIVERED")
        .when(returned == "R", "DELIVERED_NO_ACK")
        .otherwise("FAILED")
    )
    return rows.select(
        F.col("l_orderkey").alias("msg_offset"),
        "l_suppkey",
        "l_partkey",
        "l_linenumber",
        F.when(answering, F.when(F.col("l_quantity") > 45, 2).otherwise(1)).otherwise(0).alias("n_answers"),
        status.alias("status"),
        (returned.isin("A", "R") & filled).alias("acknowledged"),
    )


def _answers(lines: DataFrame, copies: Column) -> DataFrame:
    """Answers of lines with their publish, which there are ``copies`` of."""
    sent = F.when(F.col("n_answers") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    received = F.expr("published_at + ((l_partkey * 7 + l_linenumber * 11) % 90 + k * 5) * interval '1' minute")
    return lines.select("*", F.explode(F.flatten(F.array_repeat(sent, copies))).alias("k")).select(
        "message_key",
        _store(),
        _host(),
        "status",
        F.when(F.col("acknowledged"), received - F.expr("interval '2' second")).alias("ack_at"),
        received.alias("received_at"),
        F.expr("(((msg_offset * 20000 + l_partkey) * 1000 + l_suppkey) * 8 + l_linenumber) * 2 + k").alias("seq"),
    )


def _with_publish(spark: SparkSession, folder: str, sent: DataFrame) -> DataFrame:
    """Lines with their publish. Keys may repeat, so publishes that look alike to a line are counted, and what it says of them is repeated later."""
    alike = sent.select(*PUBLISH).repartition("msg_offset").groupBy(*PUBLISH).agg(F.count("*").cast("int").alias("copies"))
    return lines(spark, folder).join(alike, "msg_offset")


def _inputs(sent: DataFrame, staged: DataFrame, buckets: int | None = None) -> Inputs:
    """Publishes, and the machines and answers of staged lines with their publish, where the texts are made. A line names its machine once."""
    named = staged.select(*PUBLISH, "l_suppkey", "l_partkey", "copies").distinct()
    return Inputs(
        sent,
        _machines(named.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))),
        _answers(staged.filter("n_answers > 0"), F.col("copies")),
        repeated_hosts=False,
        buckets=buckets,
    )


def inputs(spark: SparkSession, folder: str, workspace: Workspace) -> Inputs:
    """Publishes, expected machines and responses of an order database; the last two are read from the lines, written once as numbers."""
    sent = workspace.stage(publishes(spark, folder), "publishes")
    return _inputs(sent, workspace.stage(_with_publish(spark, folder, sent), "lines"))


def dealt_inputs(spark: SparkSession, folder: str, workspace: Workspace, config: TrackingConfig) -> Inputs:
    """The same tables in buckets of the key for a batch run; as ``inputs`` where a key may be heavy.

    Lines move to their order once and from there to the bucket of their key once, as numbers.
    """
    counted = workspace.stage(_counted_publishes(spark, folder), "publishes")
    # A line names a machine and answers twice at most.
    per_key = counted.groupBy(*KEY).agg(F.sum(1 + 3 * F.col("n_lines")).alias("most"), F.sum(1 + 2 * F.col("n_lines")).alias("usual"))
    most, rows = per_key.agg(F.max("most"), F.sum("usual")).first()
    together = _with_publish(spark, folder, counted)
    if (most or 0) > config.rows_per_task:
        return _inputs(counted.drop("n_lines"), workspace.stage(together, "lines"))
    buckets = bucket_count(spark, rows or 0, config)
    staged = workspace.stage(together.repartition(buckets, *KEY).sortWithinPartitions("msg_offset"), "lines", buckets, KEY)
    return _inputs(counted.drop("n_lines").repartition(buckets, *KEY), staged, buckets)
