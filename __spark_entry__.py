"""

A tracking run writes its tables once; queries are plans over these and over the result tables. Runs are kept per session, folder and point in time, as a dashboard reads what a job has written.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import oracles  # noqa: E402
from tillwatch import TrackingConfig  # noqa: E402
from tillwatch.config import CLEANUP_BATCH  # noqa: E402
from tillwatch.functions import scalar as fn  # noqa: E402
from tillwatch.operators import attribution, documents, progress, results, retention, rollups, settle, status  # noqa: E402
from tillwatch.plans import dashboards as dash  # noqa: E402
from tillwatch.plans.tracking import TrackingRun  # noqa: E402
from tillwatch.schemas import EPISODE  # noqa: E402
from tillwatch.session import Workspace, tune  # noqa: E402
from tillwatch.sources import catalog, lookup, samples, sinks, tables  # noqa: E402
from tillwatch.streaming import replay, timeouts, windows  # noqa: E402
from tillwatch.streaming.tracker import Tracker  # noqa: E402

try:  # the subpackage for training data and its pipeline can be left out
    import corpus_pipeline
    from tillwatch.llm import queries as llm
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "tillwatch.llm"):
        raise
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"
# All is settled at END. At MID deliveries are in flight, and the cleanup is thirty days behind.
END = datetime(2003, 1, 1)
MID = datetime(1998, 7, 1)
MID_CONFIG = TrackingConfig(cleanup_lag_seconds=30 * 86400)
HALF_HOUR = dash.ago(MID, minutes=30)
TODAY = date(1998, 7, 1)
# Every group counts as heavy, and there are too many of them to broadcast.
SPREAD_CONFIG = TrackingConfig(rows_per_task=1, broadcast_groups=10)

_runs: dict[tuple[str, str, str], TrackingRun] = {}
_written: set[tuple[str, str]] = set()
_streams: dict[tuple[str, str, str], Tracker] = {}


def reset() -> None:
    """Forget all runs: the next query starts from the given tables again."""
    _runs.clear()
    _written.clear()
    _streams.clear()


def _run(spark: SparkSession, folder: str, kind: str = "end") -> TrackingRun:
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _runs:
        tune(spark)
        workspace = Workspace(spark)
        config, as_of = {"end": (TrackingConfig(), END), "mid": (MID_CONFIG, MID), "spread": (SPREAD_CONFIG, END)}[kind]
        sources = tables.dealt_inputs(spark, folder, workspace, config)
        _runs[key] = TrackingRun(sources, workspace, config, as_of)
    return _runs[key]


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, so that any client shows the same UTC values."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def _end(plan: Callable[[TrackingRun], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _plain(plan(_run(spark, folder)))


def _mid(plan: Callable[[TrackingRun], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _plain(plan(_run(spark, folder, "mid")))


def _spread(plan: Callable[[TrackingRun], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _plain(plan(_run(spark, folder, "spread")))


def _stream(kind: str, plan: Callable[[Tracker], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the outputs of a stream, or of batch runs that carry on from each other; played once."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder, kind)
        if key not in _streams:
            tune(spark)
            play = {"stream": lambda: replay.run(spark, folder, END), "events": lambda: replay.run_events(spark, folder), "resumed": lambda: replay.resumed(spark, folder, END)}[kind]
            _streams[key] = play()
        return _plain(plan(_streams[key]))

    return query


def _rolled(plan: Callable[[rollups.Rollups], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A dashboard answered from roll-ups to which the run's events were added in two parts."""

    def query(run: TrackingRun) -> DataFrame:
        path = f"{run.workspace.folder}/rollups"
        made = rollups.Rollups(run.workspace.spark, path)
        if (path, "") not in _written:
            for half in (0, 1):
                part = F.pmod(F.xxhash64("message_key"), F.lit(2)) == half
                made.add(half, run.message_results.filter(part), run.store_results.filter(part), run.pos_results.filter(part))
            _written.add((path, ""))
        return plan(made)

    return _end(query)


def _looked_up(run: TrackingRun) -> lookup.StatusTables:
    path = f"{run.workspace.folder}/lookup"
    made = lookup.StatusTables(run.workspace.spark, path)
    if (path, "") not in _written:
        made.write(run.messages, run.stores)
        _written.add((path, ""))
    return made


def _days_left(run: TrackingRun) -> DataFrame:
    """Stores in a catalog table, a partition per day; old days are dropped, what is left is read."""
    state = catalog.DayTable(run.workspace.spark, f"tillwatch_state_{run.workspace.folder[-12:].replace('-', '_')}")
    state.replace(run.stores.select("message_key", "msg_offset", "store_number", "expire_at"))
    state.drop_old_days(TODAY, run.config)
    return state.rows().select("message_key", "msg_offset", "store_number", fn.day_suffix("expire_date").alias("suffix"))


def _events(run: TrackingRun, name: str) -> DataFrame:
    """A result table as the job writes it, a folder per day."""
    path = f"{run.workspace.folder}/events/{name}"
    if (run.workspace.folder, name) not in _written:
        sinks.write_results(getattr(run, name), path, mode="overwrite")
        _written.add((run.workspace.folder, name))
    return sinks.read_results(run.workspace.spark, path)


# --- queries over a run --------------------------------------------------------------------------


def _publish_flags(run: TrackingRun) -> DataFrame:
    return run.messages.select(
        "message_key", "msg_offset", "publish_count", "first_published_at", fn.join_flags("publish_flags").alias("flags")
    )


def _response_attribution(run: TrackingRun) -> DataFrame:
    return run.attributed.select("seq", "message_key", "msg_offset", attribution.in_window(run.config).alias("in_window"))


def _stale_responses(run: TrackingRun) -> DataFrame:
    return attribution.stale(run.outcomes).select("seq", "message_key", "store_number", "reject_reason")


def _unexpected_hosts(run: TrackingRun) -> DataFrame:
    return attribution.unexpected_hosts(run.outcomes, run.inputs.expected).drop("published_at")


def _missing_pos(run: TrackingRun) -> DataFrame:
    return run.hosts.filter(progress.missing_units() > 0).select(
        "message_key", "msg_offset", "store_number", "pos_hostname", progress.missing_units().alias("missing")
    )


def _store_progress(run: TrackingRun) -> DataFrame:
    return run.stores.select(
        "message_key",
        "msg_offset",
        "store_number",
        "state",
        "expected",
        "responded",
        "missing",
        fn.percent_2("responded", "expected", if_none=100.0).alias("pos_completion_pct"),
        F.col("done.received_at").alias("done_at"),
        "finalized_at",
    )


def _checkpoint_events(run: TrackingRun) -> DataFrame:
    return results.checkpoint_events(run.hosts, run.completion, run.stores, run.messages, run.config).drop("published_at")


def _late_responses(run: TrackingRun) -> DataFrame:
    accepted = settle.with_chain_start(run.outcomes.filter("reject_reason is null"), run.messages, run.config, "n_responses", "seq")
    return accepted.filter(settle.late(run.config, "received_at")).select(
        "seq", "message_key", "msg_offset", fn.whole_minutes("first_published_at", "received_at").alias("lag_minutes")
    )


def _pos_latest_status(run: TrackingRun) -> DataFrame:
    return run.hosts.filter("latest is not null").select(
        "message_key", "msg_offset", "store_number", "pos_hostname", "latest.status", "latest.received_at", "latest.ack_at"
    )


def _store_faults(run: TrackingRun) -> DataFrame:
    rows = settle.with_chain_start(run.stores, run.messages, run.config)
    return rows.select("message_key", "msg_offset", "store_number", fn.join_flags(settle.store_flags(run.config)).alias("flags"))


def _store_documents(run: TrackingRun) -> DataFrame:
    return documents.store_documents(run.hosts, run.stores).drop("published_at")


def _event_json(run: TrackingRun) -> DataFrame:
    return (
        sinks.wire_events(run.message_results, sinks.MESSAGE_EVENT)
        .unionByName(sinks.wire_events(run.store_results, sinks.STORE_EVENT))
        .unionByName(sinks.wire_events(run.pos_results, sinks.POS_EVENT))
    )


def _open_state(run: TrackingRun) -> DataFrame:
    """Store rows without those that settled or whose message was replaced."""
    gone = run.stores.filter("finalized_at is not null or next_published_at is not null")
    left = sinks.settled_removed(run.stores, gone, [*EPISODE, "store_number"])
    return left.select("message_key", "msg_offset", "store_number", "state", "expire_at")


def _retention_keep(run: TrackingRun) -> DataFrame:
    kept = retention.retained(retention.with_day(run.stores), TODAY, run.config)
    return kept.select("message_key", "msg_offset", "store_number", fn.day_suffix("expire_date").alias("suffix"))


def _message(df: DataFrame) -> DataFrame:
    return df.select("message_key", "msg_offset", "cluster_id", F.col("total_stores").cast("long").alias("total_stores"), "stores_done")


def _found(df: DataFrame) -> DataFrame:
    return df.select("message_key", "msg_offset", "store_number", "state", "expected", "responded")


def entry(spark: SparkSession) -> DataFrame:
    """Message results: state, counters, faults and latencies of every publish."""
    return _end(lambda run: run.message_results)(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator or query; each takes the session and a folder of tables."""
    more = {**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {}
    return {
        "message_results": _end(lambda r: r.message_results),
        "store_results": _end(lambda r: r.store_results.drop("published_at")),
        "pos_results": _end(lambda r: r.pos_results.drop("published_at")),
        "publish_flags": _end(_publish_flags),
        "response_attribution": _end(_response_attribution),
        "stale_responses": _end(_stale_responses),
        "unexpected_hosts": _end(_unexpected_hosts),
        "missing_pos": _end(_missing_pos),
        "store_progress": _end(_store_progress),
        "checkpoint_events": _end(_checkpoint_events),
        "late_responses": _end(_late_responses),
        "pos_latest_status": _end(_pos_latest_status),
        "store_faults": _end(_store_faults),
        "store_documents": _end(_store_documents),
        "store_status_entries": _end(lambda r: documents.status_entries(r.hosts).drop("published_at")),
        "status_documents": _mid(lambda r: status.status_json(r.hosts, r.stores, r.messages, r.config)),
        "status_document_of_key": _mid(lambda r: status.status_json_of(r.hosts, r.stores, r.messages, r.config, "K84")),
        "event_json": _end(_event_json),
        "message_results_mid": _mid(lambda r: r.message_results),
        "store_progress_mid": _mid(_store_progress),
        "status_snapshot": _mid(lambda r: status.status_rows(r.hosts, r.stores, r.messages, r.config)),
        "find_message": _mid(lambda r: _message(status.message_of(r.messages, "K84"))),
        "lookup_message": _mid(lambda r: _message(_looked_up(r).message("K84"))),
        "lookup_store": _mid(lambda r: _found(_looked_up(r).store("K84", "S2"))),
        "lookup_stores": _mid(lambda r: _found(_looked_up(r).stores("K84"))),
        "retention_table": _end(_days_left),
        "find_store": _mid(lambda r: _found(status.store_of(r.stores, "K84", "S2"))),
        "find_stores": _mid(lambda r: _found(status.stores_of(r.stores, "K84"))),
        "open_state": _mid(_open_state),
        "expired_open_topk": _mid(lambda r: status.expired_open(r.stores, MID, CLEANUP_BATCH)),
        "stalled_stores_topk": _mid(lambda r: status.stalled_stores(r.stores, MID, r.config, CLEANUP_BATCH)),
        "stalled_messages_topk": _mid(lambda r: status.stalled_messages(r.messages, MID, r.config, CLEANUP_BATCH)),
        "attention_list": _mid(lambda r: status.attention_list(r.stores, r.messages, MID, r.config)),
        "retention_keep": _end(_retention_keep),
        "partition_days": _end(lambda r: retention.partition_days(retention.with_day(r.stores), TODAY, r.config)),
        "publish_store_rows": lambda spark, folder: _plain(samples.expected_machines(tune(spark), folder)),
        "publish_summary_rows": lambda spark, folder: _plain(samples.summaries(tune(spark), folder)),
        "validation_rejects": lambda spark, folder: _plain(samples.rejects(tune(spark), folder)),
        "ack_parsing": lambda spark, folder: _plain(samples.acknowledgements(tune(spark), folder)),
        "dash_d01_messages_by_state": _end(lambda r: dash.messages_by_state(r.message_results)),
        "dash_d01_last_day": _mid(lambda r: dash.messages_by_state(r.message_results, dash.ago(MID, days=1))),
        "dash_d08_last_day": _mid(lambda r: dash.store_completion(r.store_results, dash.ago(MID, days=1))),
        "dash_d09_last_day": _mid(lambda r: dash.missing_by_store(r.store_results, dash.ago(MID, days=1))),
        "message_results_spread": _spread(lambda r: r.message_results),
        "store_results_spread": _spread(lambda r: r.store_results.drop("published_at")),
        "pos_results_spread": _spread(lambda r: r.pos_results.drop("published_at")),
        "dash_d01_last_half_hour": _mid(lambda r: dash.messages_by_state(_events(r, "message_results"), HALF_HOUR)),
        "dash_d02_last_half_hour": _mid(lambda r: dash.inconsistency_rate(_events(r, "message_results"), HALF_HOUR)),
        "dash_d02_empty_window": _mid(lambda r: dash.inconsistency_rate(_events(r, "message_results"), END)),
        "dash_d08_last_half_hour": _mid(lambda r: dash.store_completion(_events(r, "store_results"), HALF_HOUR)),
        "dash_d09_last_half_hour": _mid(lambda r: dash.missing_by_store(_events(r, "store_results"), HALF_HOUR)),
        "dash_d11_last_four_hours": _mid(lambda r: dash.store_lookup(_events(r, "store_results"), "K84", "S2", dash.ago(MID, hours=4))),
        "dash_d12_last_day": _mid(lambda r: dash.latency(_events(r, "message_results"), dash.ago(MID, days=1))),
        "dash_d02_inconsistency_rate": _end(lambda r: dash.inconsistency_rate(r.message_results)),
        "dash_d03_inconsistency_breakdown": _end(lambda r: dash.inconsistency_breakdown(r.message_results)),
        "dash_d04_replaced_per_hour": _end(lambda r: dash.replaced_per_hour(r.message_results)),
        "dash_d05_cluster_completion": _end(lambda r: dash.cluster_completion(r.store_results)),
        "dash_d06_degraded_by_cluster": _end(lambda r: dash.degraded_by_cluster(r.message_results)),
        "dash_d07_unacknowledged_by_cluster": _end(lambda r: dash.unacknowledged_by_cluster(r.message_results)),
        "dash_d08_store_completion": _end(lambda r: dash.store_completion(r.store_results)),
        "dash_d09_missing_by_store": _end(lambda r: dash.missing_by_store(r.store_results)),
        "dash_d10_missing_machines_by_store": _end(lambda r: dash.missing_machines_by_store(r.pos_results)),
        "dash_d11_store_lookup": _end(lambda r: dash.store_lookup(r.store_results, "K84", "S2")),
        "dash_d12_latency": _end(lambda r: dash.latency(r.message_results)),
        "dash_d13_delivery_window": _end(lambda r: dash.delivery_window(r.message_results)),
        "dash_d14_problem_trend": _end(lambda r: dash.problem_trend(r.message_results)),
        "dash_d15_slowest_clusters": _end(lambda r: dash.slowest_clusters(r.message_results)),
        "dash_d16_reached_all": _end(lambda r: dash.reached_all(r.messages)),
        "dash_d17_missing_machines": _end(lambda r: dash.missing_machines(r.pos_results)),
        "dash_d18_pending_by_store": _mid(lambda r: dash.pending_by_store(r.stores)),
        "dash_d19_republished": _end(lambda r: dash.republished(r.message_results)),
        "dash_d20_chronic_missing": _end(lambda r: dash.chronic_missing(r.store_results)),
        "dash_d21_event_volume": _end(lambda r: dash.event_volume(r.message_results, r.store_results, r.pos_results)),
        "dash_d22_in_flight": _end(lambda r: dash.in_flight(r.stores, r.messages)),
        "rollup_d01_messages_by_state": _rolled(lambda u: u.messages_by_state()),
        "rollup_d02_inconsistency_rate": _rolled(lambda u: u.inconsistency_rate()),
        "rollup_d03_inconsistency_breakdown": _rolled(lambda u: u.inconsistency_breakdown()),
        "rollup_d04_replaced_per_hour": _rolled(lambda u: u.replaced_per_hour()),
        "rollup_d06_degraded_by_cluster": _rolled(lambda u: u.degraded_by_cluster()),
        "rollup_d07_unacknowledged_by_cluster": _rolled(lambda u: u.unacknowledged_by_cluster()),
        "rollup_d09_missing_by_store": _rolled(lambda u: u.missing_by_store()),
        "rollup_d10_missing_machines_by_store": _rolled(lambda u: u.missing_machines_by_store()),
        "rollup_d12_latency": _rolled(lambda u: u.latency()),
        "rollup_d13_delivery_window": _rolled(lambda u: u.delivery_window()),
        "rollup_d14_problem_trend": _rolled(lambda u: u.problem_trend()),
        "rollup_d15_slowest_clusters": _rolled(lambda u: u.slowest_clusters()),
        "rollup_d21_event_volume": _rolled(lambda u: u.event_volume()),
        "stream_message_results": _stream("stream", lambda t: t.results("message_results")),
        "stream_store_results": _stream("stream", lambda t: t.results("store_results").drop("published_at")),
        "stream_pos_results": _stream("stream", lambda t: t.results("pos_results").drop("published_at")),
        "stream_stale_responses": _stream("stream", lambda t: t.results("stale_responses")),
        "stream_rejects": _stream("events", lambda t: t.results("invalid").groupBy("source", "reasons").agg(F.count("*").alias("n"))),
        "stream_missing_pos": lambda spark, folder: _plain(timeouts.replay_missing(tune(spark), folder, END, MID)),
        "resumed_message_results": _stream("resumed", lambda t: t.results("message_results")),
        "resumed_store_results": _stream("resumed", lambda t: t.results("store_results").drop("published_at")),
        "stream_event_windows": lambda spark, folder: _plain(windows.replay_tumbling(tune(spark), folder)),
        "stream_trailing_windows": lambda spark, folder: _plain(windows.replay_sliding(tune(spark), folder)),
        **more,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries, over the plain tables."""
    more = {**llm.oracle_sql(), "pipeline": corpus_pipeline.ORACLE_SQL} if llm else {}
    return {**oracles.all_sql(), **{name: sql for name, sql in more.items() if sql}}
