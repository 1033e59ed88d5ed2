from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tillwatch.config import parse_checkpoints
from tillwatch.functions import scalar as fn
from tillwatch.operators import episodes, retention
from tillwatch import TrackingConfig


def values(spark, dtype, given, column):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], f"i int, c {dtype}")
    return [r[0] for r in df.select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_not_blank(spark):
    assert values(spark, "string", ["a", " a ", "", "  ", "\t\n", None], fn.not_blank("c")) == [True, True, False, False, False, False]


def test_parse_instant(spark):
    given = {
        "2026-02-17T10:05:23Z": datetime(2026, 2, 17, 10, 5, 23),
        "2026-02-17t10:05:23.5z": datetime(2026, 2, 17, 10, 5, 23, 500_000),
        "2026-02-17T10:05:23+02:00": datetime(2026, 2, 17, 8, 5, 23),
        "2026-02-17T10:05:23": None,
        "2026-02-17T10:05Z": None,
        "2026-02-17": None,
        "2026-02-31T10:05:23Z": None,
        "12": None,
        "junk": None,
        " ": None,
        None: None,
    }
    assert values(spark, "string", list(given), fn.parse_instant("c").cast("timestamp_ntz")) == list(given.values())


def test_minutes_are_cut(spark):
    start = datetime(2026, 1, 1)
    ends = [datetime(2026, 1, 1, 1, 0, 59), datetime(2026, 1, 1, 1, 1), datetime(2025, 12, 31, 23, 58, 30)]
    assert values(spark, "timestamp_ntz", ends, fn.whole_minutes(F.lit(start), F.col("c"))) == [60, 61, -1]


def test_epoch_millis(spark):
    column = fn.epoch_millis(F.col("c").cast("timestamp"))
    assert values(spark, "timestamp_ntz", [datetime(1970, 1, 1, 0, 0, 1, 500_000), None], column) == [1500, 0]


def test_percents(spark):
    df = spark.createDataFrame([(199, 200), (1, 200), (1, 3), (0, 0), (0, 7)], "part int, whole int")
    found = df.select(fn.percent("part", "whole"), fn.percent_2("part", "whole", 100.0), fn.percent_2("part", "whole", 0.0)).collect()
    assert [tuple(r) for r in found] == [(100, 99.5, 99.5), (1, 0.5, 0.5), (33, 33.33, 33.33), (100, 100.0, 0.0), (0, 0.0, 0.0)]


def test_checkpoints(spark):
    assert parse_checkpoints(" 50, 1,100") == (1, 50, 100)
    assert values(spark, "int", [0, 1, 49, 50, 99, 100], fn.highest_checkpoint(F.col("c"), (1, 50, 100))) == [0, 1, 1, 50, 50, 100]


def test_flags(spark):
    raised = fn.flags(B=F.col("c") > 0, A=F.col("c") > 1)
    assert values(spark, "int", [0, 1, 2], fn.join_flags(raised)) == ["", "B", "B,A"]
    assert values(spark, "int", [2], fn.add_flags(raised, F.array(F.lit("A"), F.lit("C")))) == [["B", "A", "C"]]
    assert values(spark, "string", ["MISSING_POS,X", "X", ""], fn.has_flag("c", "MISSING_POS")) == [True, False, False]


def test_json_lists(spark):
    assert values(spark, "string", ['["a","b"]', "[]", "", None, "junk"], fn.strings_from_json("c")) == [["a", "b"], [], [], [], []]
    assert values(spark, "array<string>", [["a"], [], None], fn.strings_to_json("c")) == ['["a"]', "[]", "[]"]


def test_json_statuses(spark):
    text = '{"h":{"status":"DONE","consumerAckTimestamp":"2026-02-17T10:05:23Z","extra":1}}'
    found = values(spark, "string", [text, None], fn.statuses_from_json("c"))
    assert found[0]["h"]["status"] == "DONE" and found[0]["h"]["patchReceivedAt"] is None
    assert found[1] == {}
    again = values(spark, "string", [text], fn.statuses_to_json(fn.statuses_from_json("c")))
    assert again == ['{"h":{"status":"DONE","consumerAckTimestamp":"2026-02-17T10:05:23.000Z"}}']


def test_arrays(spark):
    assert values(spark, "array<string>", [["a", "b"], None], fn.length_of("c")) == [2, 0]


def test_days(spark):
    day = F.lit(date(2026, 2, 27))
    found = spark.range(1).select(fn.day_series(day, 2), fn.day_suffix(day)).first()
    assert list(found) == [[date(2026, 2, 27), date(2026, 2, 28), date(2026, 3, 1)], "2026_02_27"]


@pytest.mark.parametrize(("old", "new", "differs"), [(None, 1, False), (1, 1, False), (1, 2, True), (1, None, True)])
def test_offset_differs(spark, old, new, differs):
    column = episodes.offset_differs(F.lit(old).cast("long"), F.lit(new).cast("long"))
    assert spark.range(1).select(column).first()[0] is differs


def test_premature_needs_a_deadline(spark):
    at = F.lit(datetime(2026, 1, 1)).cast("timestamp")
    assert spark.range(1).select(episodes.premature(F.lit(None).cast("timestamp"), at)).first()[0] is False


def test_partition_days(spark):
    rows = [(datetime(2026, 2, 10, 5),), (datetime(2026, 2, 14),), (datetime(2026, 2, 17, 23, 59),), (datetime(2026, 2, 17),)]
    df = retention.with_day(spark.createDataFrame(rows, "t timestamp_ntz").select(F.col("t").cast("timestamp").alias("expire_at")))
    config, today = TrackingConfig(days_ahead=1), date(2026, 2, 17)
    found = {r.suffix: (r.n_rows, r.droppable) for r in retention.partition_days(df, today, config).collect()}
    assert found == {"2026_02_10": (1, True), "2026_02_14": (1, False), "2026_02_17": (2, False), "2026_02_18": (0, False)}
    assert retention.retained(df, today, config).count() == 3
