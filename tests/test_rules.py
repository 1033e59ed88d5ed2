"""One scenario per key, all in one run; expectations are stated by hand and by the sequential machine."""

from __future__ import annotations

from datetime import timedelta

import pytest

from tests import cases
from tests.cases import publish, respond, store
from tests.machine import Tracker

HOUR = timedelta(hours=1)


def scenario():
    publishes, responses = [], []
    seq = iter(range(10_000))

    def answer(key, number, host, minutes, status="DONE", ack=0.0):
        responses.append(respond(key, number, host, minutes, next(seq), status, ack))

    def sent(key, minutes, *stores, **kw):
        publishes.append(publish(key, minutes, *stores, **kw))

    sent("jump", 0, store("s", "a", "b"))
    answer("jump", "s", "a", 1)
    answer("jump", "s", "b", 2)

    many = [f"h{i:03}" for i in range(200)]
    sent("steps", 0, store("s", *many))
    for i, host in enumerate(many):
        answer("steps", "s", host, 1 + i / 10)
    sent("rounding", 0, store("s", *many))
    for i, host in enumerate(many[:-1]):
        answer("rounding", "s", host, 1 + i / 10)

    sent("empty", 0, store("s"), store("t", null=True))
    answer("empty", "s", "stranger", 1)

    sent("twice", 0, store("s", "a", "a", "b"))
    for minute in (1, 2, 3):
        answer("twice", "s", "a", minute)
    answer("twice", "s", "b", 4)
    sent("twice-open", 0, store("s", "a", "a", "b"))
    answer("twice-open", "s", "a", 1)

    sent("stranger", 0, store("s", "a"))
    answer("stranger", "s", "x", 1, "FAILED")
    answer("stranger", "s", "a", 2)
    answer("stranger", "s", "x", 3, "DONE")

    sent("grace", 0, store("s", "a"), store("t", "a"), expire=10)
    answer("grace", "s", "a", 10.5)
    answer("grace", "t", "a", 11)

    sent("instants", 0, store("s", "a"), offset=1)
    sent("instants", 5, store("s", "a"), offset=2)
    answer("instants", "s", "a", 5)

    sent("overdue", 0, store("s", "a"), offset=1, expire=10)
    sent("overdue", 10.5, store("s", "a"), offset=2)
    sent("same-offset", 0, store("s", "a"), offset=7)
    sent("same-offset", 1, store("s", "a"), offset=7)

    sent("fresh", 0, store("s", "a"), offset=1)
    answer("fresh", "s", "a", 1)
    sent("fresh", 2, store("s", "a"), offset=2)

    sent("lag", 0, store("s", "a"), store("t", "a"))
    answer("lag", "s", "a", 60 + 59 / 60)
    answer("lag", "t", "a", 61)

    sent("acks", 0, store("s", "a", "b"), store("t", "a", "b"), store("u", "a"))
    answer("acks", "s", "a", 1, "DELIVERED", None)
    answer("acks", "s", "b", 1, "DELIVERED_NO_ACK", None)
    answer("acks", "t", "a", 1, "DELIVERED_NO_ACK", None)
    answer("acks", "t", "b", 1, "FAILED", None)
    answer("acks", "u", "a", 1, "FAILED")

    sent("overwrite", 0, store("s", "a", "b"))
    answer("overwrite", "s", "a", 1, "FAILED")
    answer("overwrite", "s", "a", 2, "DONE")
    answer("overwrite", "s", "a", 3, "DELIVERED")
    answer("overwrite", "s", "b", 4)
    answer("overwrite", "s", "a", 5, "FAILED")

    answer("nobody", "s", "a", 1)
    sent("known", 0, store("s", "a"))
    answer("known", "t", "a", 1)
    answer("known", "s", "a", -1)

    sent("tie", 0, store("s", "a", "b"))
    answer("tie", "s", "a", 1, "FAILED")
    answer("tie", "s", "a", 1, "DONE")
    answer("tie", "s", "b", 1)
    answer("tie", "s", "a", 1, "FAILED")
    return publishes, responses


@pytest.fixture(scope="module")
def outcome(spark):
    publishes, responses = scenario()
    until = cases.at(60 * 24)
    truth = Tracker().run(publishes, responses, until)
    return truth, cases.run_of(spark, publishes, responses, until)


def messages(truth):
    return {(m[0], m[2]): m for m in truth.messages}


def test_run_equals_machine(outcome):
    truth, run = outcome
    assert cases.rows(run.message_results, *cases.MESSAGE) == sorted(truth.messages, key=repr)
    assert cases.rows(run.store_results, *cases.STORE) == sorted(truth.store_events, key=repr)
    assert cases.rows(run.pos_results, *cases.POS) == sorted(truth.pos_events, key=repr)


@pytest.mark.parametrize(
    ("key", "checkpoints"),
    [("jump", [50, 100]), ("steps", [1, 50, 100]), ("rounding", [1, 50, 100]), ("stranger", [100]), ("overdue", [100])],
)
def test_checkpoints(outcome, key, checkpoints):
    _, run = outcome
    found = run.store_results.filter(run.store_results.message_key == key).orderBy("event_ts").collect()
    assert [r.checkpoint_pct for r in found] == checkpoints


@pytest.mark.parametrize(
    ("key", "offset", "state", "flags"),
    [
        ("empty", 1, "DONE", ""),
        ("rounding", 1, "DEGRADED", "MISSING_STORE"),
        ("instants", 1, "REPLACED", ""),
        ("instants", 2, "DEGRADED", "DUPLICATE_KEY,PREMATURE_REPUBLISH,OFFSET_MISMATCH"),
        ("overdue", 2, "DEGRADED", "DUPLICATE_KEY,OFFSET_MISMATCH,MISSING_STORE"),
        ("fresh", 2, "DEGRADED", "MISSING_STORE"),
        ("grace", 1, "DEGRADED", "MISSING_STORE"),
        ("twice", 1, "DONE", ""),
        ("tie", 1, "DONE", ""),
    ],
)
def test_message_state(outcome, key, offset, state, flags):
    _, run = outcome
    found = {(r.message_key, r.msg_offset): r for r in run.message_results.collect()}
    assert (found[key, offset].state, found[key, offset].inconsistencies) == (state, flags)


def test_machine_events(outcome):
    _, run = outcome
    found = sorted((r.message_key, r.store_number, r.pos_hostname, r.status) for r in run.pos_results.collect())
    of = {k: [f[1:] for f in found if f[0] == k] for k in ("twice-open", "stranger", "overwrite", "tie", "acks")}
    assert of["twice-open"] == [("s", "a", "MISSING"), ("s", "b", "MISSING")]
    assert of["stranger"] == [("s", "x", "FAILED")]
    assert of["overwrite"] == of["tie"] == []
    assert of["acks"] == [("s", "b", "DELIVERED_NO_ACK"), ("t", "a", "DELIVERED_NO_ACK"), ("t", "b", "FAILED"), ("u", "a", "FAILED")]


def test_rejected_responses(outcome):
    truth, run = outcome
    stale = {r.seq: r.reject_reason for r in run.outcomes.filter("reject_reason is not null").collect()}
    assert set(stale) == set(truth.stale)
    assert set(stale.values()) == {"UNKNOWN_KEY", "AFTER_CUTOFF", "UNKNOWN_STORE", "STORE_DONE"}


def test_invariants(outcome):
    _, run = outcome
    assert run.stores.filter("responded + missing <> expected").isEmpty()
    assert run.messages.filter("stores_done + stores_partial + stores_timed_out > total_stores").isEmpty()
    assert run.stores.groupBy("message_key", "published_at", "msg_offset", "store_number").count().filter("count > 1").isEmpty()
