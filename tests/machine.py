"""The tracked rules one event at a time, for small lists of events. Tests compare runs with it."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone


def millis(t: datetime) -> int:
    return round((t - datetime(1970, 1, 1)) / timedelta(milliseconds=1))


def half_up(x: float) -> int:
    return int(x + 0.5)


@dataclass
class Store:
    number: str
    location: str | None
    expected: list
    missing: list
    responded: list = field(default_factory=list)
    statuses: dict = field(default_factory=dict)
    state: str = "PENDING"
    flags: list = field(default_factory=list)
    checkpoint: int = 0
    last_received: datetime | None = None


@dataclass
class Message:
    key: str
    cluster: str
    offset: int
    first: datetime
    last: datetime
    expire: datetime
    total: int
    count: int
    flags: list
    stores: dict
    done: int = 0
    timed_out: int = 0
    touched: datetime | None = None


class Tracker:
    """Feed events in time order; cleanup settles a store ``lag`` after its deadline."""

    def __init__(self, late=60, checkpoints=(1, 50, 100), lag=60):
        self.late, self.checkpoints, self.lag = late, checkpoints, timedelta(seconds=lag)
        self.open: dict[str, Message] = {}
        self.messages, self.store_events, self.pos_events, self.stale = [], [], [], []

    def run(self, publishes, responses, until):
        inputs = [(p["published_at"], 1, p["msg_offset"], p) for p in publishes] + [(r["received_at"], 2, r["seq"], r) for r in responses]
        for at, kind, _, event in sorted(inputs, key=lambda e: e[:3]):
            if at > until:
                break
            self.cleanup(at)
            (self.publish if kind == 1 else self.respond)(event)
        self.cleanup(until)
        return self

    def cleanup(self, now):
        due = sorted((m.expire + self.lag, m.key) for m in self.open.values() if m.expire + self.lag <= now)
        for at, key in due:
            m = self.open[key]
            for s in list(m.stores.values()):
                self.settle_store(m, s, at)

    def publish(self, e):
        now, old, flags = e["published_at"], self.open.pop(e["message_key"], None), []
        if old:
            flags.append("DUPLICATE_KEY")
            if old.expire > now:
                flags.append("PREMATURE_REPUBLISH")
            if old.offset != e["msg_offset"]:
                flags.append("OFFSET_MISMATCH")
            self.emit_message(old, "REPLACED", now, old.touched)
        stores = {
            s["store_number"]: Store(s["store_number"], s["location_id"], list(s["expected_pos"] or []), list(s["expected_pos"] or []))
            for s in e["stores"]
        }
        self.open[e["message_key"]] = Message(
            e["message_key"], e["cluster_id"], e["msg_offset"], old.first if old else now, now, e["expire_at"],
            len(stores), old.count + 1 if old else 1, flags, stores, touched=now,
        )

    def respond(self, e):
        m = self.open.get(e["message_key"])
        s = m.stores.get(e["store_number"]) if m else None
        if s is None:
            self.stale.append(e["seq"])
            return
        now, host = e["received_at"], e["pos_hostname"]
        s.statuses[host] = (e["status"], e["ack_at"], now)
        s.last_received = now
        if host in s.missing:
            s.missing.remove(host)
            s.responded.append(host)
        if (now - m.first) // timedelta(minutes=1) > self.late and "LATE_POS_RESPONSE" not in s.flags:
            s.flags.append("LATE_POS_RESPONSE")
        pct = half_up(len(s.responded) * 100.0 / len(s.expected)) if s.expected else 100
        if len(s.responded) >= len(s.expected):
            s.state = "DONE"
        elif s.responded:
            s.state = "PARTIAL"
        reached = max([t for t in self.checkpoints if t <= pct], default=0)
        if reached > s.checkpoint:
            s.checkpoint = reached
            self.emit_store(m, s, reached, now)
        if s.state == "DONE":
            self.settle_store(m, s, now)

    def settle_store(self, m, s, at):
        status = [(st, ack) for st, ack, _ in s.statuses.values()]
        good = [ack for st, ack in status if st in ("DONE", "DELIVERED")]
        if good and any(st == "DELIVERED_NO_ACK" for st, _ in status):
            s.flags.append("CONFLICTING_STATUS")
        if s.missing:
            s.flags.append("MISSING_POS")
        if any(ack is None for ack in good):
            s.flags.append("CONSUMER_ACK_MISSING")
        s.state = "TIMED_OUT" if s.missing else "DONE"
        if s.missing:
            m.timed_out += 1
        else:
            m.done += 1
        m.touched = at
        if s.checkpoint < 100:
            self.emit_store(m, s, 100, at)
        for host in s.missing:
            self.pos_events.append((m.key, m.offset, s.number, s.location, host, "MISSING", None, at))
        for host, (st, _, received) in s.statuses.items():
            if st in ("FAILED", "DELIVERED_NO_ACK"):
                self.pos_events.append((m.key, m.offset, s.number, s.location, host, st, millis(received) - millis(m.first), at))
        del m.stores[s.number]
        if m.done + m.timed_out >= m.total:
            if m.timed_out:
                m.flags.append("MISSING_STORE")
            self.emit_message(m, "DEGRADED" if m.flags else "DONE", at, at)
            del self.open[m.key]

    def emit_message(self, m, state, at, until):
        self.messages.append(
            (m.key, m.cluster, m.offset, state, m.total, m.done, m.timed_out, m.count, ",".join(m.flags),
             millis(m.first), millis(m.last), millis(m.expire), millis(until) - millis(m.first), at)
        )

    def emit_store(self, m, s, checkpoint, at):
        self.store_events.append(
            (m.key, m.offset, s.number, s.location, s.state, checkpoint, len(s.expected), len(s.responded), len(s.missing),
             ",".join(s.flags), millis(m.expire), at)
        )

    def status(self):
        """Open stores: key, offset, store, state, responded, missing machines, flags."""
        return [
            (m.key, m.offset, s.number, s.state, len(s.responded), ",".join(sorted(s.missing)), ",".join(s.flags))
            for m in self.open.values()
            for s in m.stores.values()
        ]


def utc(t: datetime | None) -> datetime | None:
    return None if t is None else t.replace(tzinfo=timezone.utc)
