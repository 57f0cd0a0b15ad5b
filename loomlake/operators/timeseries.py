"""Series on a trading calendar: every "n-th trading day" is arithmetic on the calendar's index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_trading_day(events: DataFrame, at: str, calendar: DataFrame, close_minute: int = 15 * 60 + 30, zone: str = "Asia/Seoul") -> DataFrame:
    """J-13: events with ``idx``, the first trading day on or after their local day, strictly after it from the minute the market closes on.

    The calendar (trading_date, idx) becomes a map of every local day of the events to its trading day: an equi-join, not a range join.
    """
    local = F.from_utc_timestamp(F.col(at).cast("timestamp"), zone)
    shift = (F.hour(local) * 60 + F.minute(local) >= close_minute).cast("int")
    rows = events.withColumn("_day", F.date_add(F.to_date(local), shift))
    days = rows.select("_day").distinct()
    marks = days.select(F.col("_day").alias("day"), F.lit(None).cast("long").alias("idx")).unionByName(calendar.select(F.col("trading_date").alias("day"), "idx"))
    mark = marks.groupBy("day").agg(F.max("idx").alias("idx"))  # one row a calendar day: the window below has a few thousand rows
    w = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    lookup = mark.select(F.col("day").alias("_day"), F.first("idx", ignorenulls=True).over(w).alias("idx"))
    return rows.join(lookup, "_day", "left").drop("_day")


def after_close(events: DataFrame, at: str, calendar: DataFrame, close_minute: int = 15 * 60 + 30, zone: str = "Asia/Seoul", name: str = "after_close") -> DataFrame:
    """F-36: events with a flag: the market cannot react on their local day. True from the closing minute on and on days that the calendar
    (trading_date) up to its last day leaves out; beyond it only weekends are closed. Null for a null time."""
    local = F.from_utc_timestamp(F.col(at).cast("timestamp"), zone)
    days = calendar.select(F.col("trading_date").alias("_day"), F.lit(True).alias("_open")).distinct()
    last = F.broadcast(calendar.agg(F.max("trading_date").alias("_last")))  # one row
    rows = events.withColumns({"_day": F.to_date(local), "_late": F.hour(local) * 60 + F.minute(local) >= close_minute}).join(days, "_day", "left").crossJoin(last)
    shut = F.when(F.col("_last").isNotNull() & (F.col("_day") <= F.col("_last")), F.col("_open").isNull()).otherwise(F.dayofweek("_day").isin(1, 7))
    return rows.withColumn(name, F.col("_late") | shut).drop("_day", "_late", "_open", "_last")


def on_calendar(series: DataFrame, key: str, calendar: DataFrame) -> DataFrame:
    """(key, idx, close, base): the series and its index level by calendar position."""
    return series.join(calendar.select("trading_date", "idx", F.col("close_price").cast("double").alias("base")), "trading_date").select(key, "idx", "trading_date", F.col("close_price").cast("double").alias("close"), "base")


def lookback_close(series: DataFrame, key: str, days: tuple[int, ...]) -> DataFrame:
    """J-12: per key the last close at or before its latest day minus each number of days; one shuffle, no range join."""
    w = Window.partitionBy(key)
    rows = series.withColumn("_last", F.max("trading_date").over(w))
    cols = [F.max_by("close_price", F.when(F.col("trading_date") <= F.date_sub("_last", n), F.col("trading_date"))).alias(f"close_{n}d") for n in days]
    return rows.groupBy(key).agg(F.max_by("close_price", "trading_date").alias("close"), *cols)


def abnormal_returns(cases: DataFrame, key: str, series: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """X-25: for a case on calendar day t0 the return of key from t0 - 1 to t0 + n - 1, less the index's over the same days.

    cases: (key, idx, ...); series: from ``on_calendar``. Null if either day has no bar.
    """
    base = series.select(key, (F.col("idx") + 1).alias("idx"), F.col("close").alias("_c0"), F.col("base").alias("_b0"))
    out = cases.join(base, [key, "idx"], "left")
    for n in windows:
        end = series.select(key, (F.col("idx") - n + 1).alias("idx"), F.col("close").alias("_c"), F.col("base").alias("_b"))
        ar = F.try_divide("_c", "_c0") - F.try_divide("_b", "_b0")
        out = out.join(end, [key, "idx"], "left").withColumn(f"ar_{n}", F.round(ar, 8)).drop("_c", "_b")
    return out.drop("_c0", "_b0")


def daily_abnormal(series: DataFrame, key: str) -> DataFrame:
    """W-12: return of a bar over the bar of the calendar day before, less the index's; null after a gap."""
    w = Window.partitionBy(key).orderBy("idx")
    gap = F.col("idx") - F.lag("idx").over(w) == 1
    return series.withColumn("ar", F.when(gap, F.col("close") / F.lag("close").over(w) - F.col("base") / F.lag("base").over(w)))


def rolling_sigma(daily: DataFrame, key: str, window: int = 60, least: int = 50) -> DataFrame:
    """W-10: sample deviation of the ``window`` calendar positions before each day, with ``least`` observations and above zero."""
    w = Window.partitionBy(key).orderBy("idx").rangeBetween(-window, -1)
    s = F.stddev_samp("ar").over(w)
    return daily.withColumn("sigma", F.when((F.count("ar").over(w) >= least) & (s > 0), s))


def z_label(z: Column, half: float = 0.5) -> Column:
    """X-26: beyond ``half`` deviations; exactly there is neutral."""
    return F.when(z.isNull(), None).when(z < -half, "NEGATIVE").when(z > half, "POSITIVE").otherwise("NEUTRAL")


def pair_correlation(pairs: DataFrame, series: DataFrame, key: str, least: int = 20, before: str | None = None) -> DataFrame:
    """(a, b, corr) of the pairs asked for: correlation of daily returns on the days both have one, from ``least`` such days on. ``before`` keeps later
    prices out of a score of that day. Joins follow the pairs, so the work is pairs times days, never all companies with all."""
    rows = series if before is None else series.filter(F.col("trading_date") < F.lit(before).cast("date"))
    w = Window.partitionBy(key).orderBy("idx")
    r = rows.select(key, "idx", F.when(F.col("idx") - F.lag("idx").over(w) == 1, F.try_divide("close", F.lag("close").over(w)) - 1).alias("r")).filter("r is not null")
    j = pairs.select("a", "b").distinct().join(r.select(F.col(key).alias("a"), "idx", F.col("r").alias("ra")), "a").join(r.select(F.col(key).alias("b"), "idx", F.col("r").alias("rb")), ["b", "idx"])
    g = j.groupBy("a", "b").agg(F.corr("ra", "rb").alias("c"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return g.filter("c is not null and not isnan(c)").select("a", "b", F.round("c", 6).alias("corr"))


def reaction_stats(cases: DataFrame, windows: tuple[int, ...], key: str = "company_id") -> DataFrame:
    """A-13: (event_type, position, key, win, n, mean, med, down, up) of the columns ar_<window>, for each company and for all (key null)."""
    u = cases.select("event_type", "position", key, F.inline(F.array(*[F.struct(F.lit(n).alias("win"), F.col(f"ar_{n}").alias("v")) for n in windows]))).filter("v is not null")
    g = u.groupingSets([["event_type", "position", "win"], ["event_type", "position", "win", key]], "event_type", "position", "win", key)
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("med"), F.count_if(F.col("v") < 0).alias("down"), F.count_if(F.col("v") > 0).alias("up"))


def signals(asked: DataFrame, stats: DataFrame, win: int, least_mean: float, least: int = 10, share: float = 0.65, key: str = "company_id", none: str = "OTHER") -> DataFrame:
    """X-28: asked (event_type, position, key, status, ...) with label, hold_reason, scope, cases, same_share and mean_ar.

    The company's own statistics count from ``least`` cases on, else its position's. UP or DOWN if the greater side has ``share`` of the
    cases, the mean is ``least_mean`` away from 0 and both agree; otherwise HOLD: WEAK_LINK (status is not OK), NO_TYPE, FEW, SPLIT or SMALL.
    """
    s = stats.filter(F.col("win") == win)
    cols = ["n", "mean", "down", "up"]
    own = s.filter(F.col(key).isNotNull()).select("event_type", "position", key, F.struct(*cols).alias("own")).filter(F.col("own.n") >= least)
    all_ = s.filter(F.col(key).isNull()).select("event_type", "position", F.struct(*cols).alias("all"))
    j = asked.join(own, ["event_type", "position", key], "left").join(all_, ["event_type", "position"], "left").withColumn("_s", F.coalesce("own", "all"))
    n, down, up, mean = F.coalesce("_s.n", F.lit(0)), F.col("_s.down"), F.col("_s.up"), F.col("_s.mean")
    same = F.greatest(down, up) / F.col("_s.n")
    reason = (
        F.when(F.col("status") != "OK", "WEAK_LINK").when(F.col("event_type") == none, "NO_TYPE").when(n < least, "FEW").when(same < share, "SPLIT").when(F.abs(mean) < least_mean, "SMALL")
        .when(~(((down > up) & (mean < 0)) | ((up > down) & (mean > 0))), "SPLIT")
    )
    asked_for = (F.col("status") == "OK") & (F.col("event_type") != none)
    j = j.withColumns({"hold_reason": reason, "scope": F.when(asked_for, F.when(F.col("own").isNotNull(), "COMPANY").otherwise("POSITION")), "cases": F.when(asked_for, n).otherwise(0), "same_share": F.when(asked_for, F.round(same, 6)), "mean_ar": F.when(asked_for, mean)})
    return j.withColumn("label", F.when(F.col("hold_reason").isNotNull(), "HOLD").when(down > up, "DOWN").otherwise("UP")).drop("_s", "own", "all")


def chart(events: DataFrame, key: str, series: DataFrame, calendar: DataFrame, before: int = 5, after: int = 20) -> DataFrame:
    """X-37, W-19: cumulative return around the event's day, offset 0 = that day, base = the close before it."""
    slots = events.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("at", F.col("idx") + F.col("offset"))
    slots = slots.join(calendar.select(F.col("idx").alias("at"), F.col("trading_date").alias("day")), "at")
    base = series.select(key, (F.col("idx") + 1).alias("idx"), F.col("close").alias("_c0"))
    bar = series.select(key, F.col("idx").alias("at"), "close")
    return slots.join(base, [key, "idx"], "left").join(bar, [key, "at"], "left").withColumn("cumulative", F.round(F.try_divide("close", "_c0") - 1, 8)).drop("_c0")
