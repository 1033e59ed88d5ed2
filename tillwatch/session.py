"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def tune(spark: SparkSession) -> SparkSession:
    """Set what results depend on (UTC) and what skewed joins, time filters on files and large staged tables need.

    Times stored as 64-bit numbers have statistics that filters can skip by, and are cheaper to write and
    read than the default. Files are packed by zstd, since what a run writes is a large share of what it moves. A task
    that writes a bucket or two keeps their files open instead of sorting its rows by bucket; tables in buckets are always
    read bucket by bucket, so that what is written from them stays dealt out. The number of shuffle partitions is the cluster's.
    """
    free_shuffles(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def free_shuffles(spark: SparkSession) -> None:
    """Let each query remove its shuffle files when it ends; else they fill the disks until the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only for a local master."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tillwatch-")


class Workspace:
    """A fresh folder below the shared one. ``stage`` writes a table there and reads it back.

    A staged table has no lineage: an executor lost later costs a re-read, not a recomputation, and
    each reader takes only its own columns. A table staged in buckets of columns is read as it was dealt out:
    groupings, windows and joins on these columns, alone or with others, move no rows between tasks.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str, buckets: int | None = None, by: Sequence[str] = ()) -> DataFrame:
        path = f"{self.folder}/{name}"
        if buckets is None:
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        # Only a table of the catalog can have buckets. Its name is not needed once it is resolved; dropping it leaves the files.
        table = f"tillwatch_{uuid.uuid4().hex}"
        # Spark keeps a union in buckets only where the first table's columns of the buckets bear no name of a table, as renamed ones do not.
        names = {c: f"_by_{c}" if c in by else c for c in df.columns}
        usual = self.spark.conf.get(ALL_KEYS)
        self.spark.conf.set(ALL_KEYS, "false")  # joins on more than the bucket's columns take buckets as they are; elsewhere a key's rows may be many
        try:
            df.withColumnsRenamed(names).write.mode("overwrite").bucketBy(buckets, *[names[c] for c in by]).option("path", path).format("parquet").saveAsTable(table)
        finally:
            self.spark.conf.set(ALL_KEYS, usual)
        staged = self.spark.table(table).withColumnsRenamed({new: c for c, new in names.items()})
        self.spark.sql(f"DROP TABLE {table}")
        return staged

    def drop(self, *names: str) -> None:
        """Remove staged tables that nothing reads any more; without names the whole folder."""
        for path in [f"{self.folder}/{name}" for name in names] or [self.folder]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
