from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillwatch.session import Workspace

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))


@pytest.fixture
def workspace(spark):
    return Workspace(spark)


@pytest.fixture
def documents(spark):
    """Documents from (id, text) pairs, with columns of clashing names beside them."""

    def make(rows):
        table = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)
        extra = {name: F.lit("x") for name in ("n", "cls", "h", "label", "shard", "slot", "size", "place", "start", "kind", "token", "score", "spans", "block")}
        return table.withColumns(extra)

    return make
