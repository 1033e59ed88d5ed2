"""Every registered query beside its SQL on the smallest tables, and the known sizes of these."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import oracles
from checks.compare import compare, connect

FOLDER = entry.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
SQL = oracles.all_sql()
# These tables are too small to have any.
MAY_BE_EMPTY = {"unexpected_hosts", "dash_d01_last_half_hour", "dash_d08_last_half_hour", "dash_d09_last_half_hour"}

# Answered from sketches; test_tables holds them against the exact queries.
ESTIMATES = {"rollup_d10_missing_machines_by_store", "rollup_d12_latency"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_each_query_has_sql():
    others = {*entry.llm.queries(), "pipeline"} if entry.llm else set()
    assert set(entry.queries()) - others - ESTIMATES == set(SQL)


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, con, name):
    problem, n = compare(spark, con, FOLDER, entry.queries()[name], SQL[name])
    assert problem == ""
    assert n > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() == 1473


def test_sizes(spark):
    run = entry._run(spark, FOLDER)
    assert run.episodes.count() == 1473 and run.episodes.select("message_key").distinct().count() == 150
    assert run.inputs.expected.count() == 5992
    outcomes = {r.stale: r["count"] for r in run.outcomes.groupBy(F.col("reject_reason").isNotNull().alias("stale")).count().collect()}
    assert outcomes == {False: 5222, True: 263}
    states = {r.s: r["count"] for r in run.stores.groupBy(F.when(F.col("finalized_at").isNotNull(), F.col("state")).alias("s")).count().collect()}
    assert states == {"DONE": 2409, "TIMED_OUT": 538, None: 363}
    assert {r.state: r["count"] for r in run.messages.groupBy("state").count().collect()} == {"DONE": 611, "DEGRADED": 571, "REPLACED": 291}


def test_dashboards_read_few_columns(spark):
    plan = entry.queries()["dash_d09_last_day"](spark, FOLDER)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "ReadSchema: struct<store_number:string,state:string,missing_pos_count:bigint,event_ts:timestamp>" in plan
    assert "GreaterThanOrEqual(event_ts" in plan


def test_messages_partition(spark):
    run = entry._run(spark, FOLDER, "mid")
    states = {r.state: r["count"] for r in run.messages.groupBy("state").count().collect()}
    assert set(states) == {"DONE", "DEGRADED", "REPLACED", "PENDING"} and sum(states.values()) == run.episodes.count()
