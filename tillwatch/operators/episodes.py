"""Publishes of a key in order: neighbours, chains of re-publishes, and the faults seen at publish time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch import vocabulary as v
from tillwatch.config import TrackingConfig
from tillwatch.functions import scalar as fn
from tillwatch.operators.scan import only_heavy, with_slice

KEY = ["message_key"]


def key_sizes(*tables: DataFrame) -> DataFrame:
    """Rows per key, counted before the shuffle."""
    whole = tables[0].select(*KEY)
    for table in tables[1:]:
        whole = whole.unionByName(table.select(*KEY))
    return whole.groupBy(*KEY).agg(F.count("*").alias("n_rows"))


def with_neighbours(publishes: DataFrame, heavy: DataFrame | None, config: TrackingConfig) -> DataFrame:
    """Add number, previous and next publish of the key to each publish.

    Adds publish_no (1 for the key's first), prev_published_at, prev_msg_offset, prev_expire_at and
    next_published_at. Order is by (published_at, msg_offset). ``heavy`` lists keys to scan in slices.
    """
    rows = with_slice(publishes, KEY, "published_at", heavy, config).withColumn("_step", F.lit(1)).withColumn("_row", F.lit(1))
    if heavy is not None:
        rows = rows.unionByName(_neighbour_rows(only_heavy(rows, KEY, heavy)), allowMissingColumns=True)
    w = W.partitionBy(*KEY, "_slice").orderBy("_row", "published_at", "msg_offset")
    numbered = rows.withColumns(
        {
            "publish_no": F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "prev_published_at": F.lag("published_at").over(w),
            "prev_msg_offset": F.lag("msg_offset").over(w),
            "prev_expire_at": F.lag("expire_at").over(w),
            "next_published_at": F.lead("published_at").over(w),
        }
    )
    return numbered.filter("_row = 1").drop("_row", "_step", "_slice")


def _neighbour_rows(rows: DataFrame) -> DataFrame:
    """The neighbours outside a slice as rows around it, so that lag and lead see them."""
    per_key = W.partitionBy(*KEY).orderBy("_slice")
    slices = (
        rows.groupBy(*KEY, "_slice")
        .agg(
            F.max(F.struct("published_at", "msg_offset", "expire_at")).alias("newest"),
            F.min("published_at").alias("oldest"),
            F.count("*").alias("n"),
        )
        .select(
            *KEY,
            "_slice",
            F.lag("newest").over(per_key).alias("before"),
            F.lead("oldest").over(per_key).alias("after"),
            F.coalesce(F.sum("n").over(per_key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_step"),
        )
    )
    heads = slices.filter("before is not null").select(*KEY, "_slice", "before.*", "_step", F.lit(0).alias("_row"))
    tails = slices.filter("after is not null").select(
        *KEY, "_slice", F.col("after").alias("published_at"), F.lit(0).alias("_step"), F.lit(2).alias("_row")
    )
    return heads.unionByName(tails, allowMissingColumns=True)


def with_chain(episodes: DataFrame, heavy: DataFrame | None, config: TrackingConfig) -> DataFrame:
    """Add first_published_at and publish_count of the chain of re-publishes an episode belongs to.

    Needs the columns of ``with_neighbours`` and ``finalized_at``. A chain ends with an episode that is
    finalized; its successor starts the next one, at the ended episode's next_published_at. The key's
    first publish starts a chain too.
    """
    here = F.struct(F.col("published_at").alias("at"), F.col("publish_no").alias("no"))
    successor = F.struct(F.col("next_published_at").alias("at"), (F.col("publish_no") + 1).alias("no"))
    rows = (
        with_slice(episodes, KEY, "published_at", heavy, config)
        .withColumn("_opens", F.when(F.col("finalized_at").isNotNull(), successor))
        .withColumn("_row", F.lit(1))
    )
    if heavy is not None:
        rows = rows.unionByName(_chain_heads(only_heavy(rows, KEY, heavy)), allowMissingColumns=True)
    w = W.partitionBy(*KEY, "_slice").orderBy("_row", "publish_no")
    opened = F.last("_opens", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    first = F.first(F.when(F.col("_row") == 1, here), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        rows.withColumn("_start", F.coalesce(opened, first))
        .filter("_row = 1")
        .withColumn("first_published_at", F.col("_start.at"))
        .withColumn("publish_count", F.col("publish_no") - F.col("_start.no") + 1)
        .drop("_row", "_slice", "_opens", "_start")
    )


def _chain_heads(rows: DataFrame) -> DataFrame:
    """Per slice a row with the chain that is under way when it begins."""
    per_key = W.partitionBy(*KEY).orderBy("_slice")
    ended = F.max("last_end").over(per_key.rowsBetween(W.unboundedPreceding, -1))
    return (
        rows.groupBy(*KEY, "_slice")
        .agg(
            F.max(F.when(F.col("_opens").isNotNull(), F.struct("publish_no", "_opens"))).alias("last_end"),
            F.min(F.struct(F.col("publish_no").alias("no"), F.col("published_at").alias("at"))).alias("first"),
        )
        .select(*KEY, "_slice", ended.alias("ended"), F.first("first").over(per_key).alias("first"))
        .select(
            *KEY,
            "_slice",
            F.coalesce("ended._opens", F.struct(F.col("first.at").alias("at"), F.col("first.no").alias("no"))).alias("_opens"),
            F.lit(0).alias("_row"),
        )
    )


def premature(prev_expire_at: Column, published_at: Column) -> Column:
    """The replaced publish was still within its deadline."""
    return F.coalesce(prev_expire_at > published_at, F.lit(False))


def offset_differs(prev_offset: Column, offset: Column) -> Column:
    """The replaced publish had an offset, and another one."""
    return prev_offset.isNotNull() & ~prev_offset.eqNullSafe(offset)


def publish_flags() -> Column:
    """Faults seen at publish time; only a publish that replaces an open one has any."""
    replaces = F.col("publish_count") > 1
    return fn.flags(
        **{
            v.DUPLICATE_KEY: replaces,
            v.PREMATURE_REPUBLISH: replaces & premature(F.col("prev_expire_at"), F.col("published_at")),
            v.OFFSET_MISMATCH: replaces & offset_differs(F.col("prev_msg_offset"), F.col("msg_offset")),
        }
    )
