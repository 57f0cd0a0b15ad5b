"""Received times against the standard library."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from loomlake.functions.instants import ALL
from loomlake.operators.instants import fit_mixtures, normalise_times

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def us(y, m, d, h=0, mi=0, s=0, f=0, off=None, zone=None):
    local = datetime(y, m, d, h, mi, s, f)
    at = local.replace(tzinfo=timezone(timedelta(minutes=off))) if zone is None else local.replace(tzinfo=ZoneInfo(zone))
    return (at - EPOCH) // timedelta(microseconds=1)


NY, SEOUL = "America/New_York", "Asia/Seoul"
CASES = [
    ("2023-05-01T10:20:30+09:00", NY, us(2023, 5, 1, 10, 20, 30, off=540)),
    ("2023-05-01T10:20:30Z", SEOUL, us(2023, 5, 1, 10, 20, 30, off=0)),
    ("2023-05-01 10:20", SEOUL, us(2023, 5, 1, 10, 20, zone=SEOUL)),
    ("2023-07-01 10:20:30 EST", SEOUL, us(2023, 7, 1, 10, 20, 30, off=-300)),
    ("2023-11-05 01:30:00", NY, us(2023, 11, 5, 1, 30, off=-240)),  # twice: the first
    ("2023-03-12 02:30:00", NY, None),  # never
    ("20230501102030", NY, us(2023, 5, 1, 10, 20, 30, zone=NY)),
    (" ２０２３０５０１ ", SEOUL, us(2023, 5, 1, zone=SEOUL)),
    ("1672532848", NY, 1672532848_000000),
    ("1672532848831", NY, 1672532848831_000),
    ("1672532848831432", NY, 1672532848831432),
    ("2023-05-01T10:20:30.123456789Z", NY, us(2023, 5, 1, 10, 20, 30, 123456, off=0)),
    ("Mon, 1 May 2023 10:20:30 -0400", NY, us(2023, 5, 1, 10, 20, 30, off=-240)),
    ("May 1, 2023 12:20 AM KST", NY, us(2023, 5, 1, 0, 20, off=540)),
    ("2023년 5월 1일 오후 12시 4분", SEOUL, us(2023, 5, 1, 12, 4, zone=SEOUL)),
    ("2023. 5. 1. 오전 12:04", SEOUL, us(2023, 5, 1, 0, 4, zone=SEOUL)),
    ("05/13/2023 10:20", NY, us(2023, 5, 13, 10, 20, zone=NY)),
    ("13/05/2023 10:20", NY, None),
    ("2023-05-01 10:20:30 America/New_York", SEOUL, us(2023, 5, 1, 10, 20, 30, zone=NY)),
    ("2023-05-01T10:20:30+09:00[Asia/Seoul]", NY, us(2023, 5, 1, 10, 20, 30, off=540)),
    ("2024-02-30 10:15:00", NY, None),
    ("2023-05-01 24:00:00", NY, None),
    ("2023-05-01 10:20:30 Mars/Base", NY, None),
    ("1 May 2023", SEOUL, us(2023, 5, 1, zone=SEOUL)),
    ("N/A", NY, None),
    ("", NY, None),
    (None, NY, None),
    ("9" * 5000, NY, None),
]


def test_each_form(spark):
    rows = spark.createDataFrame([(k, v, z, "s", "mine") for k, (v, z, _) in enumerate(CASES)], "k int, v string, z string, s string, reading string")
    got = {r.k: r.utc_us for r in normalise_times(rows, "v", "z", "s").collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)}


def test_open_order_is_settled_by_the_source_or_marked(spark):
    days = [("a", f"{m:02d}/{d:02d}/2023 10:00") for m, d in [(1, 13), (2, 25), (3, 30), (4, 22)] * 20]
    rows = [*days, ("a", "03/04/2023 10:00"), ("b", "03/04/2023 10:00"), *[("c", f"{d:02d}/01/2023") for d in range(13, 29)] * 5, ("c", "03/04/2023"), ("d", "05/05/2023")]
    df = spark.createDataFrame([(s, v, SEOUL) for s, v in rows], "s string, v string, z string")
    out = {(r.s, r.v): r for r in normalise_times(df, "v", "z", "s", ALL).collect()}
    assert out[("a", "03/04/2023 10:00")].reading == "month_first"
    assert out[("c", "03/04/2023")].reading == "day_first" and out[("c", "03/04/2023")].utc_us == us(2023, 4, 3, zone=SEOUL)
    assert out[("b", "03/04/2023 10:00")].ambiguous and out[("b", "03/04/2023 10:00")].utc_us is None
    assert not out[("d", "05/05/2023")].ambiguous  # both readings mean the same day


def test_empty(spark):
    assert normalise_times(spark.createDataFrame([], "v string, z string, s string"), "v", "z", "s").count() == 0


def test_mixture_weights():
    w = fit_mixtures([("x", "month_first", None, 90), ("x", "month_first", "day_first", 10)])["x"]
    assert w["month_first"] > 0.95 and sum(w.values()) == pytest.approx(1)


def test_every_source_has_its_own_mixture_however_many(spark):
    """The same text is read by what its own source writes; none are merged, whatever their number."""
    rows = []
    for k in range(300):
        day = k % 2
        rows += [(f"s{k}", f"{d:02d}/01/2023" if day else f"01/{d:02d}/2023") for d in range(13, 29)]
        rows.append((f"s{k}", "03/04/2023"))
    df = spark.createDataFrame([(s, v, SEOUL) for s, v in rows], "s string, v string, z string")
    got = {(r.s): r.reading for r in normalise_times(df, "v", "z", "s", ALL).filter("v = '03/04/2023'").collect()}
    assert got == {f"s{k}": "day_first" if k % 2 else "month_first" for k in range(300)}


def test_without_a_second_reading_nothing_is_fitted(spark):
    df = spark.createDataFrame([("03/04/2023", "UTC", "s"), ("13/04/2023", "UTC", "s"), ("2023-04-03", "UTC", "s"), (None, "UTC", None)], "v string, z string, s string")
    plain, fitted = normalise_times(df, "v", "z", "s"), normalise_times(df, "v", "z", "s", ALL)
    assert "FlatMapGroups" not in plain._jdf.queryExecution().toString() and "FlatMapGroups" in fitted._jdf.queryExecution().toString()
    assert plain.columns == fitted.columns and plain.schema["ambiguous"].dataType == fitted.schema["ambiguous"].dataType
    assert sorted((r.v or "", r.reading, r.utc_us is None, r.ambiguous) for r in plain.collect()) == [("", None, True, False), ("03/04/2023", "month_first", False, False), ("13/04/2023", None, True, False), ("2023-04-03", "year_first", False, False)]
