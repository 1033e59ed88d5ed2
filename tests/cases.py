"""Small event lists: random ones, and the way from them to a run."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import SparkSession

from tests.machine import utc
from tillwatch import TrackingConfig, schemas
from tillwatch.plans.tracking import TrackingRun
from tillwatch.session import Workspace
from tillwatch.sources import events

START = datetime(2026, 2, 17, 10)
STATUSES = ["DONE", "DELIVERED", "DELIVERED_NO_ACK", "FAILED"]


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def store(number: str, *hosts: str, location: str | None = None, null: bool = False) -> dict:
    return {"store_number": number, "location_id": location, "expected_pos": None if null else list(hosts)}


def publish(key: str, minutes: float, *stores: dict, offset: int = 1, expire: float = 120, cluster: str = "c") -> dict:
    return {
        "message_key": key,
        "cluster_id": cluster,
        "msg_offset": offset,
        "published_at": at(minutes),
        "expire_at": at(minutes + expire),
        "stores": list(stores),
    }


def respond(key: str, number: str, host: str, minutes: float, seq: int, status: str = "DONE", ack: float | None = 0) -> dict:
    return {
        "message_key": key,
        "store_number": number,
        "pos_hostname": host,
        "delivered": True,
        "ack_at": None if ack is None else at(minutes + ack),
        "status": status,
        "received_at": at(minutes),
        "seq": seq,
    }


def random_case(seed: int, n_publishes: int = 40, n_responses: int = 700) -> tuple[list, list]:
    """Few keys, stores and machines and coarse times, so that ties, replays and re-publishes are common."""
    rng = random.Random(seed)
    publishes = []
    for i in range(n_publishes):
        stores = []
        for number in rng.sample(["s1", "s2", "s3"], rng.randint(1, 3)):
            hosts = [f"h{rng.randint(1, 5)}" for _ in range(rng.choice([0, 1, 2, 3, 4, 8]))]
            stores.append(store(number, *hosts, location=rng.choice([None, "l"]), null=not hosts and rng.random() < 0.5))
        publishes.append(
            publish(f"k{rng.randint(1, 6)}", rng.randint(0, 120) * 5, *stores, offset=1000 + i, expire=rng.choice([5, 20, 60, 120, 200]))
        )
    responses = []
    for seq in range(n_responses):
        responses.append(
            respond(
                f"k{rng.randint(1, 7)}", rng.choice(["s1", "s2", "s3"]), f"h{rng.randint(1, 6)}", rng.randint(0, 720), seq,
                rng.choice(STATUSES), rng.choice([None, 0, -1]),
            )
        )
    return publishes, responses


def frames(spark: SparkSession, publishes: list, responses: list):
    """Event tables of the lists."""
    sent = [
        {**p, "published_at": utc(p["published_at"]), "expire_at": utc(p["expire_at"])} for p in publishes
    ]
    answers = [
        {
            **{k: v for k, v in r.items() if k != "ack_at"},
            "received_at": utc(r["received_at"]),
            "consumer_ack_timestamp": r["ack_at"] and r["ack_at"].strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
        }
        for r in responses
    ]
    return spark.createDataFrame(sent, schemas.PUBLISH), spark.createDataFrame(answers, schemas.RESPONSE)


def run_of(spark: SparkSession, publishes: list, responses: list, until: datetime | None, config: TrackingConfig | None = None) -> TrackingRun:
    workspace = Workspace(spark)
    inputs = events.staged_inputs(*frames(spark, publishes, responses), workspace)
    return TrackingRun(inputs, workspace, config or TrackingConfig(), utc(until))


def rows(df, *columns: str) -> list[tuple]:
    """Sorted rows of some columns, times without zone."""
    times = [c for c in columns if dict(df.dtypes)[c] == "timestamp"]
    return sorted((tuple(r) for r in df.withColumns({c: df[c].cast("timestamp_ntz") for c in times}).select(*columns).collect()), key=repr)


MESSAGE = (
    "message_key cluster_id msg_offset state total_stores stores_done stores_timed_out publish_count inconsistencies "
    "first_published_at last_published_at expire_at tracking_duration_ms event_ts"
).split()
STORE = (
    "message_key msg_offset store_number location_id state checkpoint_pct expected_pos_count responded_pos_count missing_pos_count "
    "inconsistencies expire_at event_ts"
).split()
POS = "message_key msg_offset store_number location_id pos_hostname status response_lag_ms event_ts".split()
