"""Rendezvous hashing of record keys over weighted shards, and gapless slots within shards.

Each shard scores each key by ``weight / -ln(u)``, where ``u`` in (0, 1) comes from a hash of key and shard, and
the highest score wins. The score of a shard does not depend on the other shards, so a shard that is added only
takes keys for itself and a shard that is removed only gives its own keys away. All is DataFrame code.

Null keys are one key of their own. Rows with equal keys go to the same shard. Equal rows are counted before
they are numbered, so a key that holds any share of the rows is one row until it is written out in pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwatch.session import Workspace

HASH_DIGITS = 13  # hexadecimal digits taken from md5: 52 bits, exact in a double
HASH_RANGE = 16.0**HASH_DIGITS


def unit_hash(value: Column) -> Column:
    """A hash of a string as an integer from 0 to 2^52 - 1."""
    return F.conv(F.substring(F.md5(value), 1, HASH_DIGITS), 16, 10).cast("long")


def key_text(key: Column) -> Column:
    """The key as text; a null key gets a text that no other key has."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, that a key belongs to. Shards of weight 0 or less get no keys."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a weight over 0")
    ranks = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (unit_hash(F.concat(key_text(key), F.lit(f":{shard}"))) + 0.5) / F.lit(HASH_RANGE)
            ranks.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = ranks[0] if len(ranks) == 1 else F.greatest(*ranks)
    return (-best["shard"]).cast("int")


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], workspace: Workspace, rows_per_bucket: int = 50_000, chunk: int = 4096) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, as ``slot``.

    ``rows`` needs a column ``place``, a hash of the key from 0 to 2^52 - 1. The order is place, then ``order``; rows equal
    in all columns are interchangeable. A shard is cut along ``place`` into buckets of about ``rows_per_bucket``
    distinct rows. Only counts of buckets are summed over a shard; rows are ranked in their bucket.
    """
    names = [c for c in rows.columns if c != "_bucket"]
    counted = workspace.stage(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "counted")
    buckets = max(1, -(-counted.count() // rows_per_bucket))
    cut = counted.withColumn("_bucket", F.floor(F.col("place") * F.lit(float(buckets)) / F.lit(HASH_RANGE)).cast("int"))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = cut.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_rows")).select(shard, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(shard, "_bucket").orderBy("place", *order).rowsBetween(W.unboundedPreceding, -1)
    placed = cut.withColumn("_first", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(heads, [shard, "_bucket"])
    placed = placed.withColumn("_first", F.col("_first") + F.col("_base")).drop("_base", "_bucket", "place")
    few = placed.filter(F.col("_n") <= chunk).withColumn("_last", F.col("_first") + F.col("_n") - 1)
    pieces = placed.filter(F.col("_n") > chunk).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    many = (
        pieces.withColumn("_end", F.col("_first") + F.col("_n") - 1)
        .withColumn("_first", F.col("_first") + F.col("_piece") * chunk)
        .withColumn("_last", F.least("_end", F.col("_first") + chunk - 1))
        .repartition(shard, "_first")
        .drop("_end", "_piece")
    )
    return few.unionByName(many).withColumn("slot", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last", "_n")


def shard_documents(documents: DataFrame, workspace: Workspace, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every document, with its size (UTF-8 bytes of the text plus 16) and the CRC-32 of its text.

    ``grown_shard`` is the shard after one more of weight 1 is added: it equals ``shard`` or is the new one. A null text has
    no bytes; its CRC-32 is that of the empty text. Repeated rows each get a slot. An empty table gives no rows.
    """
    k, t = F.col(key), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(
        k.alias("doc_id"),
        (F.octet_length(t).cast("long") + 16).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        rendezvous(k, weights).alias("shard"),
        rendezvous(k, [*weights, 1.0]).alias("grown_shard"),
        unit_hash(key_text(k)).alias("place"),
    )
    out = with_slots(rows, "shard", ["doc_id", "size", "text_crc32"], workspace)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
