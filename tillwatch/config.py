"""Settings of a tracking run."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults of the tracked service.
LATE_MINUTES = 60
CHECKPOINTS = "1,50,100"
CLEANUP_PERIOD_SECONDS = 60
CLEANUP_BATCH = 500
STALLED_MINUTES = 5
DAYS_AHEAD = 14
DAYS_TO_RETAIN = 3


def parse_checkpoints(text: str) -> tuple[int, ...]:
    """Turn a comma list such as ``"50, 1,100"`` into sorted percentages."""
    return tuple(sorted(int(part) for part in text.split(",")))


@dataclass(frozen=True)
class TrackingConfig:
    """Business thresholds, and four numbers that shape the shuffles.

    ``segment_seconds`` cuts ordered scans of a key into time slices, ``rows_per_task`` is the number
    of rows of one group a task should see before the group is spread over several tasks. The list of
    such groups is broadcast up to ``broadcast_groups`` of them, and joined by a shuffle beyond. Where no
    key has that many rows, a bucket of keys has about ``rows_per_bucket``. None changes a result.
    """

    late_minutes: int = LATE_MINUTES
    checkpoints: tuple[int, ...] = parse_checkpoints(CHECKPOINTS)
    cleanup_lag_seconds: int = CLEANUP_PERIOD_SECONDS
    stalled_minutes: int = STALLED_MINUTES
    days_ahead: int = DAYS_AHEAD
    days_to_retain: int = DAYS_TO_RETAIN
    segment_seconds: int = 300
    rows_per_task: int = 2_000_000
    broadcast_groups: int = 1000
    rows_per_bucket: int = 1_000_000
