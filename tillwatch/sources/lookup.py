"""Tables to look single keys up in: clustered by key, sorted within files, with Bloom filters on the key.

A reader with a filter on the key skips files by their least and greatest key, and row groups by their Bloom filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwatch.operators import status


def write_lookup(rows: DataFrame, path: str, key: str = "message_key", then: tuple[str, ...] = (), files: int | None = None, distinct_per_file: int = 100_000) -> None:
    """Replace the table at ``path``. Spark's range partitioning puts neighbours into one file; a key with very many rows may span several."""
    ranged = rows.repartitionByRange(files, key, *then) if files else rows.repartitionByRange(key, *then)
    writer = ranged.sortWithinPartitions(key, *then).write.mode("overwrite")
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct_per_file)).parquet(path)


class StatusTables:
    """Messages and stores of a run, written for lookups; reads touch the files of the key alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, messages: DataFrame, stores: DataFrame, files: int | None = None) -> None:
        write_lookup(messages, f"{self.folder}/messages", then=("published_at",), files=files)
        write_lookup(stores, f"{self.folder}/stores", then=("store_number",), files=files)

    def message(self, key: str) -> DataFrame:
        return status.message_of(self._read("messages"), key)

    def store(self, key: str, number: str) -> DataFrame:
        return status.store_of(self._read("stores"), key, number)

    def stores(self, key: str) -> DataFrame:
        return status.stores_of(self._read("stores"), key)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

