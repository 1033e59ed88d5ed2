"""Tables of a run are dealt out by key once; what groups, joins and scans them moves no rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests import cases
from tests.test_against_machine import LATER, check
from tillwatch import TrackingConfig
from tillwatch.operators import progress, results
from tillwatch.plans.tracking import TrackingRun
from tillwatch.schemas import STORE
from tillwatch.session import ALL_KEYS, Workspace
from tillwatch.sources import sinks, tables

SMALL = TrackingConfig(rows_per_bucket=20)


def plan_of(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_buckets_change_no_result(spark):
    check(spark, *cases.random_case(6), LATER, SMALL)


def test_rows_move_once(spark):
    run = cases.run_of(spark, *cases.random_case(1), LATER, SMALL)
    assert run.buckets > 2
    run.pos_results, run.store_results  # noqa: B018
    per_store = progress.store_progress(run.machines)
    ranked = run.hosts.withColumn("n", F.row_number().over(W.partitionBy(*STORE).orderBy("pos_hostname")))
    united = run.attributed.select("message_key").unionByName(run.episodes.select("message_key"))
    for rows in (per_store, ranked, united.groupBy("message_key").count()):
        assert "Exchange" not in plan_of(rows)


def test_a_heavy_key_is_not_put_into_one_bucket(spark):
    run = cases.run_of(spark, *cases.random_case(1), LATER, TrackingConfig(rows_per_task=1))
    assert run.buckets is None


def order_tables(spark, folder: str) -> str:
    """A small order database with keys that repeat or are null, and lines that come twice."""
    day = "timestamp_ntz'1995-01-01 00:00:00'"
    customers = spark.range(20).selectExpr("id as c_custkey", "cast(id % 3 as int) as c_nationkey")
    customers.unionByName(customers.filter("c_custkey = 3")).write.parquet(f"{folder}/customer.parquet")
    orders = spark.range(100).selectExpr("nullif(id, 7) as o_orderkey", "nullif(id % 25, 4) as o_custkey", f"{day} + make_dt_interval(cast(id as int)) as o_orderdate")
    orders.unionByName(orders.filter("o_orderkey in (8, 9)")).write.parquet(f"{folder}/orders.parquet")
    lines = spark.range(500).selectExpr(
        "nullif(id % 110, 11) as l_orderkey",
        "nullif(id % 13, 5) as l_partkey",
        "nullif(id % 4, 3) as l_suppkey",
        "nullif(cast(id % 7 as int), 6) as l_linenumber",
        "nullif(cast(40 + id % 11 as double), 44) as l_quantity",
        "nullif(substr('ANR', 1 + cast(id % 3 as int), 1), if(id % 17 = 0, 'A', null)) as l_returnflag",
        "nullif(substr('FO', 1 + cast(id % 2 as int), 1), if(id % 19 = 0, 'F', null)) as l_linestatus",
    )
    lines.unionByName(lines.filter("l_orderkey < 30")).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_inputs_in_buckets_have_the_same_rows_and_move_once(spark, tmp_path):
    folder, workspace = order_tables(spark, str(tmp_path / "orders")), Workspace(spark, str(tmp_path / "work"))
    plain = tables.inputs(spark, folder, Workspace(spark, str(tmp_path / "other")))
    dealt = tables.dealt_inputs(spark, folder, workspace, SMALL)
    assert dealt.buckets > 2 and not dealt.repeated_hosts
    for name in ("publishes", "expected", "responses"):
        one, other = getattr(plain, name), getattr(dealt, name)
        assert one.columns == other.columns and one.count() == other.count() > 50
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    run = TrackingRun(dealt, workspace, SMALL)
    assert run.heavy_keys is None and run.buckets == dealt.buckets
    keys = [t.select("message_key") for t in (dealt.responses, dealt.expected, run.episodes)]
    for rows in (keys[0].unionByName(keys[2]), keys[1].unionByName(keys[0])):
        assert "Exchange" not in plan_of(rows.groupBy("message_key").count())


def test_inputs_of_a_heavy_key_are_not_put_into_one_bucket(spark, tmp_path):
    folder = order_tables(spark, str(tmp_path / "orders"))
    assert tables.dealt_inputs(spark, folder, Workspace(spark, str(tmp_path / "work")), TrackingConfig(rows_per_task=10)).buckets is None


def test_machines_with_their_stores_change_no_result(spark, tmp_path):
    folder, workspace = order_tables(spark, str(tmp_path / "orders")), Workspace(spark, str(tmp_path / "work"))
    plain = TrackingRun(tables.inputs(spark, folder, Workspace(spark, str(tmp_path / "other"))), Workspace(spark, str(tmp_path / "plain")), TrackingConfig(rows_per_task=10))
    dealt = TrackingRun(tables.dealt_inputs(spark, folder, workspace, SMALL), Workspace(spark, str(tmp_path / "dealt")), SMALL)
    assert dealt.machines_of_stores is not None and plain.machines_of_stores is None
    for name in ("machines", "completion", "hosts", "stores", "outcomes", "message_results", "store_results", "pos_results"):
        one, other = getattr(plain, name), getattr(dealt, name)
        other = other.select(*one.columns)
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty() and not one.isEmpty(), name


def test_checkpoints_move_no_rows(spark):
    run = cases.run_of(spark, *cases.random_case(1), LATER, SMALL)
    usual = spark.conf.get(ALL_KEYS)
    parts = run.hosts, run.completion, run.stores, run.messages
    spark.conf.set(ALL_KEYS, "false")  # as where a staged table is written
    try:
        assert "Exchange hashpartitioning" not in plan_of(results.checkpoint_events(*parts, SMALL))
    finally:
        spark.conf.set(ALL_KEYS, usual)


def test_a_day_of_events_is_one_file(spark, tmp_path):
    path = str(tmp_path / "events")
    events = spark.range(0, 400, 1, 8).select("id", F.expr("timestamp'2026-02-01 12:00:00' + make_dt_interval(cast(id % 10 as int))").alias("event_ts"))
    sinks.write_results(events, path, mode="overwrite")
    assert len(list((tmp_path / "events").glob("event_date=*/*.parquet"))) == 10
    assert sinks.read_results(spark, path).drop("event_date").exceptAll(events).isEmpty()
