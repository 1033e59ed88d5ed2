"""Runs against the sequential machine on random event lists, and with heavy groups spread."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests import cases
from tests.machine import Tracker
from tillwatch import TrackingConfig
from tillwatch.operators import status
from tillwatch.operators.attribution import stale

LATER = cases.at(60 * 48)


def check(spark, publishes, responses, until, config=None):
    config = config or TrackingConfig()
    truth = Tracker(config.late_minutes, config.checkpoints, config.cleanup_lag_seconds).run(publishes, responses, until)
    run = cases.run_of(spark, publishes, responses, until, config)
    assert cases.rows(run.message_results, *cases.MESSAGE) == sorted(truth.messages, key=repr)
    assert cases.rows(run.store_results, *cases.STORE) == sorted(truth.store_events, key=repr)
    assert cases.rows(run.pos_results, *cases.POS) == sorted(truth.pos_events, key=repr)
    assert sorted(r.seq for r in stale(run.outcomes).select("seq").collect()) == sorted(truth.stale)
    details = status.store_details(run.hosts, run.stores, run.messages, config)
    flat = details.withColumns({c: F.concat_ws(",", c) for c in ("missing_pos", "inconsistencies")})
    assert cases.rows(
        flat, "message_key", "msg_offset", "store_number", "state", "responded_pos_count", "missing_pos", "inconsistencies"
    ) == sorted(truth.status(), key=repr)
    return truth


@pytest.mark.parametrize("seed", [1, 2])
def test_random_events(spark, seed):
    truth = check(spark, *cases.random_case(seed), LATER)
    assert {m[3] for m in truth.messages} == {"DONE", "DEGRADED", "REPLACED"}


def test_in_flight(spark):
    truth = check(spark, *cases.random_case(3), cases.at(300))
    assert truth.status()


def test_other_settings_and_spread_groups(spark):
    # A task should see one row of a group, so every join and scan spreads.
    config = TrackingConfig(late_minutes=10, checkpoints=(20, 40, 70), cleanup_lag_seconds=1800, segment_seconds=60, rows_per_task=1)
    check(spark, *cases.random_case(4), LATER, config)


def test_few_spread_groups(spark):
    config = TrackingConfig(segment_seconds=86400, rows_per_task=3, broadcast_groups=2)
    check(spark, *cases.random_case(5), LATER, config)


def test_one_key_holds_most_rows(spark):
    hosts = [f"h{i}" for i in range(200)]
    publishes = [cases.publish("hot", 0, cases.store("s", *hosts), cases.store("t", "a")), cases.publish("cold", 0, cases.store("s", "a"), offset=2)]
    answers = [cases.respond("hot", "s", h, 1 + i % 50, i) for i, h in enumerate(hosts)]
    chatty = [cases.respond("hot", "t", "x", i % 100, 1000 + i, "FAILED") for i in range(500)]
    check(spark, publishes, answers + chatty + [cases.respond("cold", "s", "a", 1, 5000)], LATER, TrackingConfig(rows_per_task=10))
