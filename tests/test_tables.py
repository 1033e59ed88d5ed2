"""Lookups by key, day partitions in the catalog, roll-ups, expiry by a stream join, and batch runs that carry on."""

from __future__ import annotations

import random
import uuid
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests import cases
from tests.machine import utc
from tillwatch import TrackingConfig, job
from tillwatch.operators import rollups
from tillwatch.plans import dashboards as dash
from tillwatch.session import Workspace
from tillwatch.sources import catalog, lookup, tables
from tillwatch.streaming import timeouts


def rows_scanned(df) -> int:
    """Rows that came out of the file scans of a plan that has run."""


    def walk(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        own = plan.metrics().apply("numOutputRows").value() if plan.nodeName().startswith("Scan") else 0
        children = plan.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_lookup_reads_the_files_of_its_key(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(0, 20_000, 1, 8).select(F.concat(F.lit("K"), F.col("id") % 5000).alias("message_key"), F.col("id").alias("n"))
    lookup.write_lookup(rows, path, then=("n",), files=100)
    table = spark.read.parquet(path)
    assert 90 <= table.select(F.input_file_name()).distinct().count() <= 100
    for key, found in (("K4711", 4), ("K47110", 0)):
        one = table.filter(F.col("message_key") == key)
        assert len(one.collect()) == found and rows_scanned(one) <= 500  # of two files at most
    assert "PushedFilters: [IsNotNull(message_key), EqualTo(message_key,K4711)]" in table.filter("message_key = 'K4711'")._jdf.queryExecution().toString()


def test_old_days_leave_with_their_files(spark):
    table = catalog.DayTable(spark, f"days_{uuid.uuid4().hex}")
    rows = spark.range(10).select("id", F.expr("timestamp'2026-02-01 12:00:00' + make_interval(0, 0, 0, cast(id as int))").alias("expire_at"))
    table.replace(rows)
    assert len(table.days()) == 10
    gone = table.drop_old_days(date(2026, 2, 8), TrackingConfig(days_to_retain=3))
    assert gone == [date(2026, 2, d) for d in (1, 2, 3, 4)] and table.days()[0] == date(2026, 2, 5)
    left = table.rows().select("id", F.input_file_name().alias("file"))
    assert sorted(r.id for r in left.collect()) == [4, 5, 6, 7, 8, 9] and not any("2026-02-04" in r.file for r in left.collect())
    assert table.drop_old_days(date(2026, 2, 8), TrackingConfig(days_to_retain=3)) == []
    table.drop()


@pytest.fixture(scope="module")
def results(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        at = utc(datetime(2026, 2, 17, rng.randint(8, 11), rng.randint(0, 59), rng.randint(0, 59)))
        ack = rng.choice([None, rng.randint(0, 500_000)])
        flags = rng.choice(["", "MISSING_POS", "CONSUMER_ACK_MISSING,MISSING_POS"])
        rows.append((f"k{i}", f"c{i % 3}", rng.choice(["DONE", "DEGRADED", "REPLACED"]), at, flags != "", flags, ack, rng.randint(0, 9) * 1000, i % 4, i % 5))
    messages = spark.createDataFrame(rows, "message_key string, cluster_id string, state string, event_ts timestamp, has_inconsistency boolean, all_inconsistencies string, last_consumer_ack_ms long, publish_to_last_pos_ack_ms long, unacked_pos_count long, missing_pos_count long").cache()
    stores = messages.select("message_key", "event_ts", "state", F.concat(F.lit("s"), F.col("missing_pos_count")).alias("store_number"), "missing_pos_count")
    machines = messages.select("message_key", "event_ts", F.lit("MISSING").alias("status"), F.concat(F.lit("s"), F.col("missing_pos_count")).alias("store_number"), F.concat(F.lit("h"), F.pmod(F.xxhash64("message_key"), F.lit(700))).alias("pos_hostname"))
    return messages, stores, machines


def test_rollups_answer_as_the_events_do(spark, tmp_path, results):
    messages, stores, machines = results
    made = rollups.Rollups(spark, str(tmp_path / "rollups"))
    halves = F.pmod(F.xxhash64("message_key"), F.lit(2))
    for number in (0, 1, 1):  # a repeated addition counts once
        made.add(number, *[df.filter(halves == number) for df in results])
    exact = lambda df: sorted(map(str, df.collect()))
    for since in (None, datetime(2026, 2, 17, 10)):
        same = [
            (dash.messages_by_state(messages, since), made.messages_by_state(since)),
            (dash.inconsistency_rate(messages, since), made.inconsistency_rate(since)),
            (dash.inconsistency_breakdown(messages, since), made.inconsistency_breakdown(since)),
            (dash.replaced_per_hour(messages, since), made.replaced_per_hour(since)),
            (dash.degraded_by_cluster(messages, since), made.degraded_by_cluster(since)),
            (dash.unacknowledged_by_cluster(messages, since), made.unacknowledged_by_cluster(since)),
            (dash.missing_by_store(stores, since), made.missing_by_store(since)),
            (dash.delivery_window(messages, since), made.delivery_window(since)),
            (dash.problem_trend(messages, since), made.problem_trend(since)),
            (dash.slowest_clusters(messages, since), made.slowest_clusters(since)),
        ]
        for ours, theirs in same:
            assert ours.columns == theirs.columns and exact(ours) == exact(theirs)
    assert exact(dash.event_volume(*results)) == exact(made.event_volume())
    assert "rollups" in made.latency()._jdf.queryExecution().toString() and made.read("message").count() < messages.count()


def test_sketches_are_close(spark, tmp_path, results):
    messages, _, machines = results
    made = rollups.Rollups(spark, str(tmp_path / "rollups"))
    made.add(0, *results)
    values = {}
    for r in messages.filter("last_consumer_ack_ms is not null").select(F.window("event_ts", "30 minutes").start.alias("slot"), "last_consumer_ack_ms").collect():
        values.setdefault(r.slot, []).append(r.last_consumer_ack_ms)
    for r in made.latency().collect():
        mine = sorted(values[r.slot])
        assert abs(r.avg_sec - sum(mine) / len(mine) / 1000) < 1e-9
        for name, share in dash.SHARES.items():
            rank = sum(v <= r[f"{name}_sec"] * 1000 for v in mine) / len(mine)
            assert abs(rank - share) < 0.02
    true = {r.store_number: r.machines for r in dash.missing_machines_by_store(machines).collect()}
    got = {r.store_number: r.machines for r in made.missing_machines_by_store().collect()}
    assert set(got) == set(true) and all(abs(got[s] / true[s] - 1) < 0.06 for s in true)


def test_machines_expire_by_the_clock(spark, tmp_path):
    at = lambda m: utc(cases.at(m))
    waiting = [("k", 1, at(0), at(60), "s", host) for host in ("a", "b", "c", "d")] + [("far", 2, at(0), at(6000), "s", "a"), ("later", 3, at(0), at(200), "s", "a")]
    answers = [("k", "s", "a", at(5), 1), ("k", "s", "a", at(6), 2), ("k", "s", "b", at(60), 3), ("k", "s", "c", at(-1), 4), ("x", "s", "d", at(5), 5)]
    tick = lambda m: ([(timeouts.TICK, None, None, at(m), timeouts.TICK, timeouts.TICK)], [(timeouts.TICK, timeouts.TICK, timeouts.TICK, at(m), None)])
    left, right, out = (str(tmp_path / n) for n in ("left", "right", "out"))
    for machines, heard in ((waiting, answers), tick(300), tick(301)):
        spark.createDataFrame(machines, timeouts.WAITING).write.mode("append").parquet(left)
        spark.createDataFrame(heard, timeouts.ANSWERS).write.mode("append").parquet(right)
        found = timeouts.missing_machines(spark.readStream.schema(timeouts.WAITING).parquet(left), spark.readStream.schema(timeouts.ANSWERS).parquet(right))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.message_key, r.pos_hostname) for r in spark.read.parquet(out).collect()) == [("k", "b"), ("k", "c"), ("k", "d"), ("later", "a")]


def test_few_rows_keep_their_state_in_one_store(spark, tmp_path, monkeypatch):
    day = lambda n: datetime(1998, 6, n)
    tables_of = {
        "customer": ([(1, 3)], "c_custkey bigint, c_nationkey int"),
        "orders": ([(10, 1, day(1)), (11, 1, day(20))], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"),
        "lineitem": ([(10, 5, 1, 1, 9.0, "A", "F"), (10, 6, 2, 2, 9.0, "N", "O"), (11, 7, 1, 1, 50.0, "R", "F"), (11, 8, 1, 2, 9.0, "N", "O")], tables.COLUMNS["lineitem"]),
    }
    for name, (rows, schema) in tables_of.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(timeouts, "Workspace", lambda spark: Workspace(spark, str(tmp_path / "run")))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    found = timeouts.replay_missing(spark, str(tmp_path), datetime(2003, 1, 1), datetime(1998, 6, 10))
    assert sorted((r.msg_offset, r.pos_hostname) for r in found.collect()) == [(10, "pos-2-6"), (11, "pos-1-8")]
    stores = [f for f in (tmp_path / "run" / "offsets" / "state" / "0").iterdir() if f.name.isdigit()]
    assert [f.name for f in stores] == ["0"] and not [f for f in stores[0].iterdir() if f.name.startswith(("left", "right"))]
    assert spark.conf.get("spark.sql.shuffle.partitions") == usual


def test_batch_runs_carry_on(spark, tmp_path):
    publishes, responses = cases.random_case(5, n_publishes=12, n_responses=120)
    sent, heard = cases.frames(spark, publishes, responses)
    until, middle = cases.at(60 * 48), utc(cases.at(300))
    out = str(tmp_path / "out")
    parts = [(sent.filter(F.col("published_at") <= middle), heard.filter(F.col("received_at") <= middle), middle), (sent.filter(F.col("published_at") > middle), heard.filter(F.col("received_at") > middle), utc(until))]
    for number, (p, r, upto) in enumerate(parts):
        p.write.parquet(str(tmp_path / f"p{number}"))
        r.write.parquet(str(tmp_path / f"r{number}"))
        tracker = job.resume(spark, str(tmp_path / f"p{number}"), str(tmp_path / f"r{number}"), out, "parquet", upto, TrackingConfig())
        assert tracker.state.newest() == number
    whole = cases.run_of(spark, publishes, responses, until)
    for name, columns in (("message_results", cases.MESSAGE), ("store_results", cases.STORE), ("pos_results", cases.POS)):
        assert cases.rows(tracker.results(name), *columns) == cases.rows(getattr(whole, name), *columns)
    assert tracker.open_rows().isEmpty()
