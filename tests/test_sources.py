from __future__ import annotations

import json
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests import cases
from tillwatch import TrackingConfig, job
from tillwatch.operators import documents, retention, status
from tillwatch.plans import dashboards
from tillwatch.plans.tracking import TrackingRun
from tillwatch.session import Workspace, shared_folder
from tillwatch.sources import events, sinks

PUBLISH = {
    "messageKey": "623506cf_en_GB",
    "clusterId": "cluster-uk-north",
    "msgOffset": 1144353810,
    "publishedAt": "2026-02-17T10:00:00Z",
    "expireAt": "2026-02-17T11:00:00Z",
    "stores": [
        {"storeNumber": "9750", "locationId": "25ea26e3", "expectedPosHosts": ["uk-9750-1", "uk-9750-2"]},
        {"storeNumber": "9751", "expectedPosHosts": None},
    ],
}
RESPONSE = {
    "messageKey": "623506cf_en_GB",
    "posHostname": "uk-9750-1",
    "storeNumber": "9750",
    "delivered": True,
    "consumerAckTimestamp": "2026-02-17T10:05:23Z",
    "status": "DONE",
    "receivedAt": "2026-02-17T10:05:24Z",
    "seq": 1,
}
RECORD = "key string, value string, partition int, offset bigint, timestamp timestamp"


def lines(path, *objects):
    path.mkdir()
    (path / "part.json").write_text("\n".join(json.dumps(o) for o in objects))
    return str(path)


def test_requests_as_they_are_sent(spark):
    """Requests without times, and responses without key and number, in records of a log; each delivered twice."""
    publish = {k: v for k, v in PUBLISH.items() if k != "publishedAt"}
    response = {k: v for k, v in RESPONSE.items() if k not in ("messageKey", "receivedAt", "seq")}
    sent = [(PUBLISH["messageKey"], json.dumps(publish), 0, 5, datetime(2026, 2, 17, 10, 0))] * 2
    answered = [(PUBLISH["messageKey"], json.dumps(response), 1, 7, datetime(2026, 2, 17, 10, 5, 24))] * 2
    publishes = events.publishes_from_records(spark.createDataFrame(sent, RECORD))
    answers = events.responses_from_records(spark.createDataFrame(answered, RECORD))
    assert events.rejected(events.check_publishes(publishes)).isEmpty() and events.rejected(events.check_responses(answers)).isEmpty()
    run = TrackingRun(events.inputs(publishes, answers), Workspace(spark), TrackingConfig(), datetime(2026, 2, 17, 10, 30))
    document = status.status_documents(run.hosts, run.stores, run.messages, run.config).first()
    assert document.state == "PENDING" and document.inconsistencies == []
    assert [(s.store_number, s.pos_completion_pct) for s in document.stores] == [("9750", 50.0), ("9751", 100.0)]
    stored = {r.store_number: r for r in documents.store_documents(run.hosts, run.stores).collect()}
    assert stored["9751"].expected_pos == "[]" and stored["9751"].pos_statuses == "{}"
    sent_document = json.loads(status.status_json_of(run.hosts, run.stores, run.messages, run.config, PUBLISH["messageKey"]).first().document)
    assert list(sent_document) == [*status.MESSAGE_FIELDS, "stores"] and [list(s) for s in sent_document["stores"]] == [list(status.STORE_FIELDS)] * 2
    assert sent_document["inconsistencies"] == [] and sent_document["stores"][1]["missingPos"] == []
    assert status.status_json_of(run.hosts, run.stores, run.messages, run.config, "none").isEmpty()


def test_statuses_of_machines_that_were_not_named(spark):
    """They are entries like the others, and no list of the stored rows holds them."""
    publishes = events.publishes_from_records(spark.createDataFrame([(PUBLISH["messageKey"], json.dumps({k: v for k, v in PUBLISH.items() if k != "publishedAt"}), 0, 5, datetime(2026, 2, 17, 10, 0))], RECORD))
    response = {k: v for k, v in RESPONSE.items() if k not in ("messageKey", "receivedAt", "seq")}
    hosts = [response["posHostname"], *(f"stray-{k}" for k in range(300))]
    sent = [(PUBLISH["messageKey"], json.dumps({**response, "posHostname": h}), 1, k, datetime(2026, 2, 17, 10, 5, 24)) for k, h in enumerate(hosts)]
    run = TrackingRun(events.inputs(publishes, events.responses_from_records(spark.createDataFrame(sent, RECORD))), Workspace(spark), TrackingConfig(), datetime(2026, 2, 17, 10, 30))
    entries = {r.pos_hostname: r for r in documents.status_entries(run.hosts).collect()}
    assert {h: r.named for h, r in entries.items()} == {h: k == 0 for k, h in enumerate(hosts)}
    assert all(json.loads(r.entry)["status"] == response["status"] for r in entries.values())
    stored = {r.store_number: r for r in documents.store_documents(run.hosts, run.stores).collect()}
    assert list(json.loads(stored[response["storeNumber"]].pos_statuses)) == hosts[:1]


def test_a_response_without_number_is_rejected(spark):
    answers = spark.createDataFrame([("K", "S", "P", True, None, "DONE", datetime(2026, 1, 1), None)], events.schemas.RESPONSE)
    assert events.check_responses(answers).first().reasons == ["SEQ_NULL"]


def test_recent_windows_read_few_days(spark, tmp_path, capsys):
    rows = spark.createDataFrame([(datetime(2026, 1, d), "DONE") for d in range(1, 20)], "event_ts timestamp, state string")
    sinks.write_results(rows, f"{tmp_path}/results")
    newest = dashboards.messages_by_state(sinks.read_results(spark, f"{tmp_path}/results"), datetime(2026, 1, 18))
    newest.explain("formatted")
    assert "PartitionFilters: [isnotnull(event_date" in capsys.readouterr().out
    assert newest.count() == 2


def test_json_to_results(spark, tmp_path):
    publishes = events.read_publishes(spark, lines(tmp_path / "publish", PUBLISH), "json")
    answers = events.read_responses(spark, lines(tmp_path / "response", RESPONSE, {**RESPONSE, "seq": 2, "status": " "}), "json")
    run = TrackingRun(events.inputs(publishes, answers), Workspace(spark), TrackingConfig(), datetime(2026, 2, 17, 10, 30))
    document = status.status_documents(run.hosts, run.stores, run.messages, run.config).first().asDict(recursive=True)
    assert document["state"] == "PENDING" and document["total_stores"] == 2 and document["stores_pending"] == 2
    assert [s["store_number"] for s in document["stores"]] == ["9750", "9751"]
    assert document["stores"][0]["missing_pos"] == ["uk-9750-2"] and document["stores"][0]["pos_completion_pct"] == 50.0
    assert document["stores"][1]["pos_completion_pct"] == 100.0 and document["stores"][1]["missing_pos"] == []

    stored = documents.store_documents(run.hosts)
    row = documents.from_documents(stored).first()
    assert (row.expected_pos, row.responded_pos, row.missing_pos) == (["uk-9750-1", "uk-9750-2"], ["uk-9750-1"], ["uk-9750-2"])
    assert row.pos_statuses["uk-9750-1"]["status"] == "DONE"

    settled = TrackingRun(events.inputs(publishes, answers), Workspace(spark))
    message = json.loads(sinks.wire_events(settled.message_results, sinks.MESSAGE_EVENT).first().attributes)
    assert list(message) == list(sinks.ATTRIBUTES[sinks.MESSAGE_EVENT])
    assert message["state"] == "DEGRADED" and message["storesDone"] == 1 and message["storesTimedOut"] == 1
    machine = json.loads(sinks.wire_events(settled.pos_results, sinks.POS_EVENT).first().attributes)
    assert "responselagMs" not in machine and machine["status"] == "MISSING" and machine["locationId"] == "25ea26e3"

    sinks.write_results(settled.store_results, str(tmp_path / "stores"))
    back = sinks.read_results(spark, str(tmp_path / "stores"))
    assert back.count() == settled.store_results.count() and (tmp_path / "stores" / "event_date=2026-02-17").exists()
    recent = dashboards.recent(back, datetime(2026, 2, 17, 10, 30))
    assert {r.checkpoint_pct for r in recent.collect()} == {100}


def test_validation(spark):
    good = cases.publish("k", 0, cases.store("s", "a"))
    bad = {
        "MESSAGE_KEY_BLANK": {"message_key": " "},
        "CLUSTER_ID_BLANK": {"cluster_id": None},
        "MSG_OFFSET_NULL": {"msg_offset": None},
        "EXPIRE_AT_NULL": {"expire_at": None},
        "STORES_EMPTY": {"stores": []},
        "STORE_NUMBER_NULL": {"stores": [cases.store(None, "a")]},
        "STORE_REPEATED": {"stores": [cases.store("s"), cases.store("s")]},
    }
    rows = [good] + [{**good, **change} for change in bad.values()]
    frame = spark.createDataFrame([{**r} for r in rows], events.schemas.PUBLISH)
    checked = events.check_publishes(frame)
    assert events.accepted(checked).count() == 1
    assert sorted(r.reasons[0] for r in events.rejected(checked).collect()) == sorted(bad)

    answer = {k: v for k, v in cases.respond("k", "s", "a", 1, 1).items() if k != "ack_at"} | {"consumer_ack_timestamp": None}
    wrong = {"POS_HOSTNAME_BLANK": {"pos_hostname": ""}, "STORE_NUMBER_BLANK": {"store_number": None}, "STATUS_BLANK": {"status": "\t"}, "DELIVERED_NULL": {"delivered": None}}
    frame = spark.createDataFrame([answer] + [{**answer, **change} for change in wrong.values()], events.schemas.RESPONSE)
    checked = events.check_responses(frame)
    assert sorted(r.reasons[0] for r in events.rejected(checked).collect()) == sorted(wrong)


def test_distinct_publishes(spark):
    sent = [cases.publish("k", 0, cases.store("s", "a")), cases.publish("k", 0, cases.store("s", "a")), cases.publish("k", 0, offset=2)]
    frame, _ = cases.frames(spark, sent, [cases.respond("k", "s", "a", 1, 1)])
    assert events.distinct_publishes(frame).count() == 2


def test_distinct_responses(spark, tmp_path):
    _, answers = cases.frames(spark, [cases.publish("k", 0)], [cases.respond("k", "s", "a", m, s) for m, s in ((1, 1), (1, 1), (2, 2))])
    assert events.distinct_responses(answers).count() == 2
    answers.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schemas.RESPONSE).parquet(str(tmp_path / "in"))
    writer = events.distinct_responses(stream).writeStream.option("checkpointLocation", str(tmp_path / "offsets"))
    writer.trigger(availableNow=True).start(str(tmp_path / "out"), "parquet").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_shared_folder():
    def session(master, **conf):
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("yarn", **{"spark.checkpoint.dir": "hdfs:/c/"})) == "hdfs:/c"
    assert shared_folder(session("local[2]")) == shared_folder(session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))


def test_state_tables(spark, tmp_path):
    state = spark.createDataFrame([("a", "s", 1), ("a", "t", 1), ("b", "s", 1)], "message_key string, store_number string, v int")
    settled = state.filter("store_number = 't'")
    assert sinks.settled_removed(state, settled, ["message_key", "store_number"]).count() == 2
    fresh = spark.createDataFrame([("a", "s", 2)], state.schema)
    assert sorted(map(tuple, sinks.replaced_by(state, fresh, ["message_key"]).collect())) == [("a", "s", 2), ("b", "s", 1)]

    rows = state.withColumn("expire_at", F.expr("timestamp'2026-02-17 23:00:00' + make_interval(0, 0, 0, if(message_key = 'a', 0, 5))"))
    sinks.write_state(rows, str(tmp_path / "state"))
    kept = retention.retained(spark.read.parquet(str(tmp_path / "state")), date(2026, 2, 22), TrackingConfig())
    assert [r.message_key for r in kept.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(expire_date" in kept._jdf.queryExecution().toString()


def test_job(spark, tmp_path):
    publishes = lines(tmp_path / "publish", PUBLISH, {**PUBLISH, "messageKey": " "}, PUBLISH)
    answers = lines(tmp_path / "response", RESPONSE)
    out = str(tmp_path / "out")
    job.track(spark, publishes, answers, out, "json", None, TrackingConfig())
    assert spark.read.parquet(f"{out}/message_results").first().state == "DEGRADED"
    assert spark.read.parquet(f"{out}/rejected_publishes").count() == 1
    job.track(spark, publishes, answers, out, "json", cases.utc(datetime(2026, 2, 17, 10, 30)), TrackingConfig())
    assert spark.read.parquet(f"{out}/open_stores").count() == 2
    assert spark.read.json(f"{out}/status").first().state == "PENDING"
