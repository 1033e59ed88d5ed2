"""Batch job: events in, result tables, open state and status out.

    spark-submit -m tillwatch.job --publishes in/publish --responses in/response --out out [--as-of 2026-02-17T12:00:00]

With ``--resume`` a run reads new files only and carries on from the open deliveries that the last one left below ``out``.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillwatch.config import CHECKPOINTS, LATE_MINUTES, TrackingConfig, parse_checkpoints
from tillwatch.operators import status
from tillwatch.plans.tracking import TrackingRun
from tillwatch.session import Workspace, tune
from tillwatch.sources import events, sinks
from tillwatch.streaming.tracker import Tracker, raw_events


def track(spark: SparkSession, publishes: str, responses: str, out: str, kind: str, as_of: datetime | None, config: TrackingConfig) -> TrackingRun:
    """Run over event files and write message_results, store_results, pos_results, quarantine, open stores and status."""
    tune(spark)
    workspace = Workspace(spark)
    sent = events.read_publishes(spark, publishes, kind)
    answers = events.read_responses(spark, responses, kind)
    events.rejected(events.check_publishes(sent)).write.mode("overwrite").parquet(f"{out}/rejected_publishes")
    events.rejected(events.check_responses(answers)).write.mode("overwrite").parquet(f"{out}/rejected_responses")
    run = TrackingRun(events.staged_inputs(sent, answers, workspace), workspace, config, as_of)
    for name in ("message_results", "store_results", "pos_results"):
        sinks.write_results(getattr(run, name), f"{out}/{name}", mode="overwrite")
    sinks.write_state(status.open_stores(run.stores), f"{out}/open_stores")
    status.status_documents(run.hosts, run.stores, run.messages, config).write.mode("overwrite").json(f"{out}/status")
    return run


def resume(spark: SparkSession, publishes: str, responses: str, out: str, kind: str, as_of: datetime, config: TrackingConfig) -> Tracker:
    """Carry on from the last whole run below ``out`` with new event files; each run adds a folder to each output.

    A run that was cut off left no pointer, so the next one repeats its number and overwrites what it wrote.
    """
    tune(spark)
    tracker = Tracker(spark, out, config, deduplicate=True)
    last = tracker.state.newest()
    tick = spark.range(1).select(F.lit(as_of).cast("timestamp").alias("timestamp"))
    raw = raw_events(events.read_publishes(spark, publishes, kind), events.read_responses(spark, responses, kind), tick)
    tracker.process_events(raw, 0 if last is None else last + 1)
    return tracker


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("publishes", "responses", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--kind", choices=["parquet", "json"], default="parquet")
    parser.add_argument("--as-of", type=datetime.fromisoformat, help="UTC; without it all deliveries settle")
    parser.add_argument("--resume", action="store_true", help="carry on from the last run; needs --as-of")
    parser.add_argument("--late-minutes", type=int, default=LATE_MINUTES)
    parser.add_argument("--checkpoints", type=parse_checkpoints, default=parse_checkpoints(CHECKPOINTS))
    args = parser.parse_args(argv)
    as_of = args.as_of and args.as_of.replace(tzinfo=args.as_of.tzinfo or timezone.utc)
    config = TrackingConfig(late_minutes=args.late_minutes, checkpoints=args.checkpoints)
    spark = SparkSession.builder.appName("tillwatch").getOrCreate()
    if args.resume:
        if as_of is None:
            parser.error("--resume needs --as-of")
        resume(spark, args.publishes, args.responses, args.out, args.kind, as_of, config)
        return
    track(spark, args.publishes, args.responses, args.out, args.kind, as_of, config)


if __name__ == "__main__":
    main()
