"""Received times: every reading of a text as a native expression, and the instant each reading denotes.

A reading is one way to understand a text (year first, month first, digits since 1970 ...). A text may be valid under two
readings; ``loomlake.operators.instants`` weighs them. Everything here runs in the JVM: one regexp_replace turns a text
into fields, arithmetic on whole numbers does the rest, so no session time zone matters. The steps are projections of
their own, so that no expression is written out twice in the generated code.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.spelling import tidy

_SEP = "\u0001"
#: Groups: half of the day, hour, minute, second, fraction, half of the day, zone or offset, zone in brackets.
_TIME = (
    r"(?:(?:t|,? )(?:(오전|오후|am|pm) ?)?(\d{1,2})(?::|시 ?)(\d{1,2})(?:분)?(?:(?::| )(\d{1,2})(?:초)?(?:[.,](\d+))?)?(?: ?(am|pm)(?![a-z]))?"
    r"(?: ?(z|utc|gmt|ut|kst|est|edt|[+\-]\d{2}(?::?\d{2})?|[a-z_]+/[a-z_/]+)?(?: ?\[([a-z_]+(?:/[a-z_]+)*)\])?)?)?"
)
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
#: Minutes east of UTC of the marks that hold in any season (fixed values).
_MARKS = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "kst": 540, "est": -300, "edt": -240}

_REST = _SEP.join(f"${k}" for k in range(4, 12))
#: Reading, shape of the text, pattern, and the groups that hold year, month and day; shapes exclude each other but for the last two rows.
_SHAPES = (
    ("year_first", rf"^(\d{{4}})(?:-|/|\. ?|년 ?)(\d{{1,2}})(?:-|/|\. ?|월 ?)(\d{{1,2}})(?:\.|일)?{_TIME}$", (1, 2, 3), True),
    ("digits_calendar", r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2}))?$", (1, 2, 3), False),
    ("month_first", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_TIME}$", (3, 1, 2), True),
    ("name_day", rf"^(?:[a-z]{{3,9}},? )?{_NAME} (\d{{1,2}}),? (\d{{4}}){_TIME}$", (3, 1, 2), True),
    ("day_name", rf"^(?:[a-z]{{3,9}},? )?(\d{{1,2}}) {_NAME} (\d{{4}}){_TIME}$", (3, 2, 1), True),
)
EPOCH = "since_1970"
#: The readings that the project's conventions allow: with slashes and the year last the month comes first, eight digits begin with the year.
DECLARED = ("year_first", "digits_calendar", "month_first", "name_day", "day_name", EPOCH)
#: The second reading of a shape, where no convention settles the order.
OTHER = {"month_first": "day_first", "digits_calendar": "digits_day_first"}
ALL = (*DECLARED, *OTHER.values())


def zone_ids(spark: SparkSession) -> list[str]:
    """Region names that this JVM knows, so that no text can name a zone that fails the query."""
    return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar, null if there is no such date."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    most = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = y.between(1, 9999) & m.between(1, 12) & d.between(1, most)
    return F.when(ok, F.unix_date(F.make_date(F.when(ok, y).otherwise(2000), F.when(ok, m).otherwise(1), F.when(ok, d).otherwise(1))))


def _int(c: Column) -> Column:
    return F.when(F.length(c) > 0, c).cast("int")


def _to_utc(local_us: Column, zone: Column) -> Column:
    """The first instant with this local time; null if the zone's clock never shows it."""
    at = F.timestamp_micros(local_us)
    utc = F.to_utc_timestamp(at, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == at, F.unix_micros(utc))


def with_readings(df: DataFrame, value: str, zone: str, names: tuple[str, ...] = DECLARED, zones: list[str] | None = None) -> DataFrame:
    """Adds ``_reading`` and ``_us`` (the first reading that fits and its µs since 1970) and, where ``names`` holds a second
    reading of the shape, ``_reading2`` and ``_us2``. All are null if the text denotes no instant in that reading.

    value, zone: names of the columns with the text and the region of its local times. Columns of the same names are replaced.
    """
    zones = zone_ids(df.sparkSession) if zones is None else zones
    own = df.columns
    known = F.from_json(F.lit(json.dumps({z.lower(): z for z in zones})), "map<string,string>")  # folded into one literal
    t = df.withColumn("_t", F.lower(tidy(F.col(value).cast("string"))))
    c = F.col("_t")
    shape, fields = F.when(c.rlike(r"^(\d{10}|\d{13}|\d{16})$"), EPOCH), F.lit(None).cast("string")
    for name, pattern, (y, m, d), timed in reversed(_SHAPES):
        template = _SEP.join([f"${y}", f"${m}", f"${d}", _REST if timed else _SEP.join(["", "$4", "$5", "$6", "", "", "", ""])])
        fields = F.when(F.col("_shape") == name, F.regexp_replace(c, pattern, template)).otherwise(fields)
    for name, pattern, _, _ in _SHAPES:
        shape = shape.when(c.rlike(pattern), name)
    t = t.withColumn("_shape", shape).withColumn("_p", F.split(fields, _SEP))
    g = {n: F.element_at("_p", k + 1) for k, n in enumerate(("y", "m", "d", "ap", "h", "mi", "s", "f", "ap2", "z", "zr"))}
    known_zone = F.element_at(known, F.col("_zn"))
    numeric = F.col("_z").rlike(r"^[+\-]\d")
    off = F.when(F.substring("_z", 1, 1) == "-", -1).otherwise(1) * (F.substring("_z", 2, 2).cast("int") * 60 + F.col("_zm"))
    marks = F.lit(None).cast("int")
    for k, v in _MARKS.items():
        marks = F.when(F.col("_z") == k, F.lit(v)).otherwise(marks)
    twelve = F.when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_ap").isin("오후", "pm"), 12).otherwise(0))
    t = (
        t.withColumns(
            {
                "_y": _int(g["y"]),
                "_m": F.when(g["m"].rlike("^[a-z]"), F.array_position(F.array(*map(F.lit, _MONTHS)), g["m"]).cast("int")).otherwise(F.regexp_extract(g["m"], r"^\d+$", 0).try_cast("int")),
                "_d": _int(g["d"]),
                "_h": F.coalesce(_int(g["h"]), F.lit(0)),
                "_mi": F.coalesce(_int(g["mi"]), F.lit(0)),
                "_s": F.coalesce(_int(g["s"]), F.lit(0)),
                "_f": F.rpad(F.substring(g["f"], 1, 6), 6, "0").cast("long"),
                "_ap": F.concat(g["ap"], g["ap2"]),
                "_z": g["z"],
                "_zr": g["zr"],
            }
        )
        .withColumns(
            {
                "_h": F.when(F.col("_ap") != "", twelve).otherwise(F.col("_h")),
                "_zm": F.when(numeric, F.rpad(F.regexp_replace(F.substring("_z", 4, 3), ":", ""), 2, "0").cast("int")),
                "_zn": F.when(F.col("_z").contains("/"), F.col("_z")).when(F.col("_z") == "", F.when(F.col("_zr") != "", F.col("_zr"))),
            }
        )
        .withColumns(
            {
                "_clock": F.when(
                    F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59),
                    ((F.col("_h").cast("long") * 60 + F.col("_mi")) * 60 + F.col("_s")) * 1_000_000 + F.col("_f"),
                ),
                "_off": F.when(numeric, F.when((F.abs(off) <= 1080) & (F.col("_zm") < 60), off)).otherwise(marks),
                "_zone": F.when((F.col("_z") == "") & (F.col("_zr") == ""), F.col(zone)).otherwise(known_zone),
            }
        )
    )

    def instant(days: Column, local: str) -> tuple[Column, Column]:
        day_us = days.cast("long") * 86_400_000_000 + F.col("_clock")
        at = F.when(F.col("_off").isNotNull(), F.col(local) - F.col("_off").cast("long") * 60_000_000)
        return day_us, at.when(F.col("_zone").isNotNull(), _to_utc(F.col(local), F.col("_zone")))

    unit = F.when(F.length(c) == 10, 1_000_000).when(F.length(c) == 13, 1_000).otherwise(1)
    day_us, at = instant(_days(F.col("_y"), F.col("_m"), F.col("_d")), "_local")
    t = t.withColumn("_local", day_us).withColumn("_us", F.when(F.col("_shape") == EPOCH, c.try_cast("long") * unit).otherwise(at))
    t = t.withColumn("_reading", F.when(F.col("_us").isNotNull() & F.col("_shape").isin(*names), F.col("_shape")))
    out = [F.col(x) for x in own if x not in ("_reading", "_us", "_reading2", "_us2")] + [F.col("_reading"), F.when(F.col("_reading").isNotNull(), F.col("_us")).alias("_us")]
    second = {k: v for k, v in OTHER.items() if v in names}
    if second:
        swapped = F.col("_shape") == "month_first"
        eight = (F.col("_shape") == "digits_calendar") & (F.length(c) == 8)
        y = F.when(swapped, F.col("_y")).when(eight, F.substring(c, 5, 4).try_cast("int"))
        m = F.when(swapped, F.col("_d")).when(eight, F.substring(c, 3, 2).try_cast("int"))
        d = F.when(swapped, F.col("_m")).when(eight, F.substring(c, 1, 2).try_cast("int"))
        t = t.withColumns({"_y": y, "_m": m, "_d": d})
        day_us, at = instant(_days(F.col("_y"), F.col("_m"), F.col("_d")), "_local2")
        other = F.lit(None).cast("string")
        for k, v in second.items():
            other = F.when(F.col("_shape") == k, F.lit(v)).otherwise(other)
        t = t.withColumn("_local2", day_us).withColumn("_us2", at)
        t = t.withColumn("_reading2", F.when(F.col("_us2").isNotNull(), other))
        out += [F.col("_reading2"), F.when(F.col("_reading2").isNotNull(), F.col("_us2")).alias("_us2")]
    else:
        out += [F.lit(None).cast("string").alias("_reading2"), F.lit(None).cast("long").alias("_us2")]
    return t.select(*out)
