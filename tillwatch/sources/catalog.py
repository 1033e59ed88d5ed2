"""State as a partitioned table of the catalog, a partition per day of the deadline; old days go without their rows being read."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from tillwatch.config import TrackingConfig
from tillwatch.operators.retention import by_day


class DayTable:
    """A managed table ``name`` with the partition column ``expire_date``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def replace(self, rows: DataFrame) -> None:
        """The table anew, with these rows. They move to the task of their day first; else each task would write a file for each day."""
        by_day(rows).write.mode("overwrite").partitionBy("expire_date").format("parquet").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def days(self) -> list[date]:
        """Days that have a partition; a few hundred names, no rows."""
        return sorted(date.fromisoformat(r.partition.split("=")[1]) for r in self.spark.sql(f"show partitions {self.name}").collect() if "__HIVE_DEFAULT" not in r.partition)

    def drop_old_days(self, today: date, config: TrackingConfig) -> list[date]:
        """Drop the days that are no longer kept, with their files; returns them."""
        oldest = today - timedelta(days=config.days_to_retain)
        gone = [d for d in self.days() if d < oldest]
        if gone:
            parts = ", ".join(f"partition (expire_date = date'{d}')" for d in gone)
            self.spark.sql(f"alter table {self.name} drop if exists {parts}")
        return gone

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
