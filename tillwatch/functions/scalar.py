"""Small column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwatch import schemas


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- strings -----------------------------------------------------------------------------------


def not_blank(c: Column | str) -> Column:
    """True for text with at least one non-space character; false for null."""
    return F.coalesce(_col(c).rlike(r"\S"), F.lit(False))


def join_flags(c: Column | str) -> Column:
    """Flags as one comma-separated string, empty for none."""
    return F.concat_ws(",", _col(c))


def has_flag(c: Column | str, flag: str) -> Column:
    """The flag name occurs in the joined flag string, as ``LIKE '%flag%'``."""
    return _col(c).contains(flag)


# --- time --------------------------------------------------------------------------------------


def parse_instant(c: Column | str) -> Column:
    """ISO-8601 instant (seconds and zone required) to a timestamp; blank or anything else to null."""
    text = F.upper(_col(c))
    instant = r"^[+-]?\d{4,}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{0,9})?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"
    return F.when(text.rlike(instant), F.try_to_timestamp(text))


def whole_minutes(start: Column | str, end: Column | str) -> Column:
    """Whole minutes from start to end, cut toward zero."""
    return F.timestamp_diff("MINUTE", _col(start), _col(end))


def millis_between(start: Column | str, end: Column | str) -> Column:
    """Whole milliseconds from start to end, cut toward zero."""
    return F.timestamp_diff("MILLISECOND", _col(start), _col(end))


def epoch_millis(c: Column | str) -> Column:
    """Milliseconds since 1970; 0 for null."""
    return F.coalesce(F.unix_millis(_col(c)), F.lit(0).cast("long"))


def minutes_before(c: Column | str, minutes: int) -> Column:
    return _col(c) - F.make_dt_interval(mins=F.lit(minutes))


def seconds_after(c: Column | str, seconds: int) -> Column:
    return _col(c) + F.make_dt_interval(secs=F.lit(seconds))


def segment_of(c: Column | str, seconds: int) -> Column:
    """Number of the time slice a timestamp lies in."""
    return F.floor(F.unix_seconds(_col(c)) / F.lit(seconds))


def day_suffix(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy_MM_dd")


def day_series(first: Column | str, days: int) -> Column:
    """The dates first .. first + days, as an array."""
    return F.sequence(_col(first), F.date_add(_col(first), days))


# --- numbers -----------------------------------------------------------------------------------


def percent(part: Column | str, whole: Column | str) -> Column:
    """Whole percent, half up; 100 of nothing."""
    part, whole = _col(part), _col(whole)
    return F.when(whole == 0, F.lit(100)).otherwise(F.floor(part * F.lit(100.0) / whole + F.lit(0.5))).cast("int")


def percent_2(part: Column | str, whole: Column | str, if_none: float) -> Column:
    """Percent with two decimals, half up; ``if_none`` where the whole is 0."""
    part, whole = _col(part), _col(whole)
    rounded = F.floor(part * F.lit(100.0) / whole * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)
    return F.when(whole == 0, F.lit(if_none)).otherwise(rounded)


def highest_checkpoint(pct: Column, checkpoints: Sequence[int]) -> Column:
    """The highest threshold that pct has reached; 0 for none."""
    reached = F.lit(0)
    for threshold in sorted(t for t in checkpoints if t > 0):
        reached = F.when(pct >= threshold, F.lit(threshold)).otherwise(reached)
    return reached


# --- arrays, maps and JSON ---------------------------------------------------------------------


def or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.array().cast("array<string>"))


def length_of(c: Column | str) -> Column:
    return F.size(or_empty(c))


def flags(**raised: Column) -> Column:
    """Names of the raised flags, in the order given."""
    return F.array_remove(F.array(*[F.when(on, F.lit(name)).otherwise(F.lit("")) for name, on in raised.items()]), "")


def add_flags(c: Column, more: Column) -> Column:
    """Append the flags that are not there yet, keeping the order."""
    return F.array_union(or_empty(c), more)


def strings_from_json(c: Column | str) -> Column:
    """JSON list to strings; null, blank or junk to an empty list."""
    return or_empty(F.from_json(_col(c), "array<string>"))


def strings_to_json(c: Column | str) -> Column:
    return F.to_json(or_empty(c))


def statuses_from_json(c: Column | str) -> Column:
    """JSON object of machine statuses by host to a map; unknown fields are ignored, null gives an empty map."""
    kind = f"map<string,{schemas.POS_STATUS.simpleString()}>"
    return F.coalesce(F.from_json(_col(c), kind), F.map_from_arrays(F.array(), F.array()).cast(kind))


def statuses_to_json(c: Column | str) -> Column:
    return F.to_json(_col(c))
