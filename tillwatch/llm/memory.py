"""Memory of the Python workers, which executors keep from stage to stage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS = 500  # whole texts in a batch; Spark's default is 10,000 rows of any size


def small_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """Send texts to Python in batches of at most ``rows`` from now on."""
    if int(spark.conf.get(BATCH_ROWS)) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def trim() -> None:
    """Give what is freed back to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidied(batches: Iterable) -> Iterator:
    """The batches; memory of an earlier task is given back before them, and this task's after them."""
    trim()
    try:
        yield from batches
    finally:
        trim()
