"""What runs leave on disk: few files for a table of days, and no table that nothing reads any more."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from tests import cases
from tillwatch.config import TrackingConfig
from tillwatch.session import Workspace
from tillwatch.sources import catalog, events, sinks, tables
from tillwatch.streaming.state import utc
from tillwatch.streaming.tracker import Tracker, clock, combined

AT = datetime(1998, 6, 1)


def order_tables(spark, folder: Path) -> None:
    rows = {
        "customer": ([(1, 3), (2, 4)], "c_custkey bigint, c_nationkey int"),
        "orders": ([(10, 1, AT), (11, 1, AT + timedelta(days=19)), (12, 2, AT)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"),
        "lineitem": ([(10, 5, 1, 1, 9.0, "A", "F"), (10, 5, 1, 2, 50.0, "R", "F"), (10, 6, 2, 2, 9.0, "N", "O"), (11, 7, 1, 1, 50.0, "R", "F"), (12, 8, 1, 2, 9.0, "N", "O")], tables.COLUMNS["lineitem"]),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(str(folder / f"{name}.parquet"))


def files_of(folder: Path) -> list[Path]:
    return [f for f in folder.rglob("part-*") if f.is_file()]


def test_a_day_of_a_state_table_is_one_file(spark, tmp_path):
    days = 5
    rows = spark.range(400).repartition(8).select("id", (F.lit(AT).cast("timestamp") + F.make_dt_interval(days=(F.col("id") % days).cast("int"))).alias("expire_at"))
    state = catalog.DayTable(spark, "tillwatch_test_days")
    state.replace(rows)
    try:
        assert state.rows().count() == 400 and state.rows().select(F.input_file_name()).distinct().count() == days
    finally:
        state.drop()
    sinks.write_state(rows, str(tmp_path / "state"))
    assert len(files_of(tmp_path / "state")) == days


def test_queries_remove_their_shuffles(spark):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_staged_tables_can_be_dropped(spark, tmp_path):
    workspace = Workspace(spark, str(tmp_path / "run"))
    workspace.stage(spark.range(3).toDF("a"), "one")
    workspace.stage(spark.range(3).toDF("a"), "two", 2, ["a"])
    workspace.drop("one", "never")
    assert [f.name for f in (tmp_path / "run").iterdir()] == ["two"]
    workspace.drop()
    assert not (tmp_path / "run").exists()


def test_inputs_of_orders_are_written_once_as_lines(spark, tmp_path):
    order_tables(spark, tmp_path)
    for inputs in (lambda w: tables.inputs(spark, str(tmp_path), w), lambda w: tables.dealt_inputs(spark, str(tmp_path), w, TrackingConfig(rows_per_task=1))):
        workspace = Workspace(spark, str(tmp_path / "run"))
        found = inputs(workspace)
        assert sorted(f.name for f in (tmp_path / "run").iterdir()) == ["lines", "publishes"]
        assert sorted((r.msg_offset, r.store_number, r.pos_hostname, r.units) for r in found.expected.collect()) == [(10, "S1", "pos-1-5", 1), (10, "S2", "pos-2-6", 1), (11, "S1", "pos-1-7", 1), (12, "S1", "pos-1-8", 1)]
        assert sorted((r.message_key, r.pos_hostname, r.status) for r in found.responses.collect()) == [*[("K1", "pos-1-5", "DELIVERED")] * 2, ("K1", "pos-1-5", "DONE"), *[("K1", "pos-1-7", "DELIVERED")] * 2]
        assert "n_lines" not in found.publishes.columns and found.publishes.count() == 3 and found.buckets is None


def test_a_run_drops_what_nothing_reads(spark):
    publishes, responses = cases.random_case(5, n_publishes=12, n_responses=120)
    run = cases.run_of(spark, publishes, responses, cases.at(60 * 48), TrackingConfig(rows_per_task=1, broadcast_groups=10))
    assert run.heavy_keys is not None
    plain = cases.run_of(spark, publishes, responses, cases.at(60 * 48))
    for name, columns in (("message_results", cases.MESSAGE), ("store_results", cases.STORE), ("pos_results", cases.POS)):
        assert cases.rows(getattr(run, name), *columns) == cases.rows(getattr(plain, name), *columns)
    left = {f.name for f in Path(run.workspace.folder).iterdir()}
    assert {"attributed", "hosts", "messages"} <= left and not {"slices", "machines", "machines_named_once", "straddling", "settled"} & left
    assert run.machines.count() == plain.machines.count()


def test_a_stream_keeps_no_tables_of_batches_that_are_whole(spark, tmp_path):
    publishes, responses = cases.random_case(6, n_publishes=6, n_responses=40)
    sent, heard = cases.frames(spark, publishes, responses)
    tracker = Tracker(spark, str(tmp_path / "stream"))
    rows = combined(events.staged_inputs(sent, heard, Workspace(spark)))
    tracker.process(rows, 0)
    tracker.process(clock(spark.range(1).select(F.lit(utc(cases.at(60 * 48))).cast("timestamp").alias("timestamp"))), 1)
    assert not list((tmp_path / "stream" / "work").iterdir())
    assert tracker.results("message_results").count() and tracker.open_rows().isEmpty()
