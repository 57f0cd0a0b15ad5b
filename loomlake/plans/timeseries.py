"""Time series, case statistics and backtests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlake.operators import timeseries as T
from loomlake.operators.serving import ranked_by
from loomlake.plans.fixtures import fixture, with_views

_F: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _F[name] = (f, sql)
        return f

    return add


def _series(spark, d):
    return T.on_calendar(fixture(spark, d, "fx_price"), "company_id", fixture(spark, d, "fx_index"))


def _cases(spark, d):
    """Orders as cases: company, its trading day's index, type and position."""
    cal = fixture(spark, d, "fx_index").select("trading_date", "idx")
    from loomlake.sources.tables import table

    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("company_id"), F.to_date("o_orderdate").alias("trading_date"), F.col("o_orderpriority").alias("event_type"), F.col("o_orderkey").alias("news_id"), F.when(F.col("o_orderkey") % 3 == 0, "SUPPLIER").otherwise("CUSTOMER").alias("position"))
    return o.join(cal, "trading_date")


_CAL = "ix AS (SELECT trading_date, idx, CAST(close_price AS DOUBLE) AS base FROM fx_index), sr AS (SELECT p.company_id, ix.idx, p.trading_date, CAST(p.close_price AS DOUBLE) AS close, ix.base FROM fx_price p JOIN ix USING (trading_date))"
_CASES = "cs AS (SELECT o_custkey % 20 AS company_id, ix.idx, ix.trading_date, o_orderpriority AS event_type, o_orderkey AS news_id, CASE WHEN o_orderkey % 3 = 0 THEN 'SUPPLIER' ELSE 'CUSTOMER' END AS position FROM orders JOIN ix ON ix.trading_date = CAST(o_orderdate AS DATE))"
_AR = "ar AS (SELECT c.*, " + ", ".join(f"round(e{n}.close / NULLIF(b.close, 0) - e{n}.base / NULLIF(b.base, 0), 8) AS ar_{n}" for n in (1, 3, 5)) + " FROM cs c LEFT JOIN sr b ON b.company_id = c.company_id AND b.idx = c.idx - 1 " + " ".join(f"LEFT JOIN sr e{n} ON e{n}.company_id = c.company_id AND e{n}.idx = c.idx + {n - 1}" for n in (1, 3, 5)) + ")"


@query("T_01_calendar", "SELECT trading_date, idx FROM fx_index")
def t01(spark, d):
    return fixture(spark, d, "fx_index").select("trading_date", "idx")


@query("J_12_asof_close", "WITH l AS (SELECT company_id, MAX(trading_date) AS l FROM fx_price GROUP BY 1) SELECT l.company_id, (SELECT close_price FROM fx_price p WHERE p.company_id = l.company_id AND p.trading_date = l.l) AS close, " + ", ".join(f"(SELECT max_by(close_price, trading_date) FROM fx_price p WHERE p.company_id = l.company_id AND p.trading_date <= l.l - {n}) AS close_{n}d" for n in (7, 30, 90)) + " FROM l")
def j12(spark, d):
    return T.lookback_close(fixture(spark, d, "fx_price"), "company_id", (7, 30, 90))


_J13 = """WITH e AS (SELECT document_id, CAST(published_at + INTERVAL 9 HOUR AS DATE) + CASE WHEN hour(published_at + INTERVAL 9 HOUR) * 60 + minute(published_at + INTERVAL 9 HOUR) >= 930 THEN 1 ELSE 0 END AS day FROM (SELECT DISTINCT document_id, published_at + to_minutes(CAST(document_id % 1440 AS BIGINT)) AS published_at FROM fx_evidence))
SELECT document_id, (SELECT MIN(idx) FROM fx_index i WHERE i.trading_date >= e.day) AS idx FROM e"""


@query("J_13_event_trading_day", _J13)
def j13(spark, d):
    e = fixture(spark, d, "fx_evidence").select("document_id", "published_at").distinct()
    e = e.withColumn("published_at", F.timestamp_micros(F.unix_micros(F.col("published_at").cast("timestamp")) + (F.col("document_id") % 1440) * 60_000_000))
    return T.next_trading_day(e, "published_at", fixture(spark, d, "fx_index")).select("document_id", "idx")


@query("W_10_rolling_sigma", f"WITH {_CAL}, dl AS (SELECT company_id, idx, CASE WHEN idx - lag(idx) OVER w = 1 THEN close / lag(close) OVER w - base / lag(base) OVER w END AS ar FROM sr WINDOW w AS (PARTITION BY company_id ORDER BY idx)) SELECT company_id, idx, CASE WHEN COUNT(ar) OVER v >= 20 AND stddev_samp(ar) OVER v > 0 THEN round(stddev_samp(ar) OVER v, 6) END AS sigma FROM dl WINDOW v AS (PARTITION BY company_id ORDER BY idx RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def w10(spark, d):
    return T.rolling_sigma(T.daily_abnormal(_series(spark, d), "company_id"), "company_id", 60, 20).select("company_id", "idx", F.round("sigma", 6).alias("sigma"))


@query("W_12_daily_abnormal", f"WITH {_CAL} SELECT company_id, idx, round(CASE WHEN idx - lag(idx) OVER w = 1 THEN close / lag(close) OVER w - base / lag(base) OVER w END, 8) AS ar FROM sr WINDOW w AS (PARTITION BY company_id ORDER BY idx)")
def w12(spark, d):
    return T.daily_abnormal(_series(spark, d), "company_id").select("company_id", "idx", F.round("ar", 8).alias("ar"))


@query("W_13_five_day_return", f"WITH {_CAL} SELECT company_id, idx, round(lag(close, 1) OVER w / lag(close, 6) OVER w - 1, 8) AS ret_5d FROM sr WINDOW w AS (PARTITION BY company_id ORDER BY idx)")
def w13(spark, d):
    w = Window.partitionBy("company_id").orderBy("idx")
    return _series(spark, d).select("company_id", "idx", F.round(F.lag("close", 1).over(w) / F.lag("close", 6).over(w) - 1, 8).alias("ret_5d"))


@query("W_19_calendar_slice", "SELECT e.k AS center, i.idx - e.k AS offset_days, i.trading_date FROM (SELECT unnest([100, 500, 900]) AS k) e JOIN fx_index i ON i.idx BETWEEN e.k - 5 AND e.k + 20")
def w19(spark, d):
    k = spark.createDataFrame([(100,), (500,), (900,)], "center int").withColumn("offset_days", F.explode(F.sequence(F.lit(-5), F.lit(20)))).withColumn("idx", (F.col("center") + F.col("offset_days")).cast("long"))
    return k.join(fixture(spark, d, "fx_index"), "idx").select("center", F.col("offset_days").cast("long").alias("offset_days"), "trading_date")


@query("X_25_abnormal_returns", f"WITH {_CAL}, {_CASES}, {_AR} SELECT news_id, company_id, ar_1, ar_3, ar_5 FROM ar")
def x25(spark, d):
    return T.abnormal_returns(_cases(spark, d), "company_id", _series(spark, d), (1, 3, 5)).select("news_id", "company_id", "ar_1", "ar_3", "ar_5")


_X26 = f"""WITH {_CAL}, dl AS (SELECT company_id, idx, CASE WHEN idx - lag(idx) OVER w = 1 THEN close / lag(close) OVER w - base / lag(base) OVER w END AS ar FROM sr WINDOW w AS (PARTITION BY company_id ORDER BY idx)),
sg AS (SELECT *, CASE WHEN COUNT(ar) OVER v >= 20 THEN stddev_samp(ar) OVER v END AS s FROM dl WINDOW v AS (PARTITION BY company_id ORDER BY idx RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT company_id, idx, CASE WHEN ar IS NULL OR s IS NULL OR s <= 0 THEN NULL WHEN round(ar / s, 6) < -0.5 THEN 'NEGATIVE' WHEN round(ar / s, 6) > 0.5 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS label FROM sg"""


@query("X_26_z_label", _X26)
def x26(spark, d):
    s = T.rolling_sigma(T.daily_abnormal(_series(spark, d), "company_id"), "company_id", 60, 20)
    return s.select("company_id", "idx", T.z_label(F.round(F.col("ar") / F.col("sigma"), 6)).alias("label"))


@query("X_27_unique_cases", f"WITH {_CAL}, {_CASES} SELECT company_id, idx, event_type, position, news_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id, idx, event_type, position ORDER BY news_id) AS rn FROM cs) WHERE rn = 1")
def x27(spark, d):
    return unique_cases(spark, d).select("company_id", "idx", "event_type", "position", "news_id")


def unique_cases(spark, d):
    w = Window.partitionBy("company_id", "idx", "event_type", "position").orderBy("news_id")
    return _cases(spark, d).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def _reactions(spark, d):
    return T.abnormal_returns(_cases(spark, d), "company_id", _series(spark, d), (1, 3, 5))


_STATS = f"""WITH {_CAL}, {_CASES}, {_AR}, u AS (SELECT event_type, position, company_id, trading_date, unnest([1, 3, 5]) AS win, unnest([ar_1, ar_3, ar_5]) AS v FROM ar)
SELECT event_type, position, company_id, win, COUNT(*) AS n, round(AVG(v), 6) AS mean, round(median(v), 6) AS med, COUNT(*) FILTER (v < 0) AS down, COUNT(*) FILTER (v > 0) AS up FROM u WHERE v IS NOT NULL AND trading_date <= DATE '2000-12-31' GROUP BY GROUPING SETS ((event_type, position, win), (event_type, position, win, company_id))"""


@query("A_13_reaction_stats", _STATS)
def a13(spark, d):
    """Statistics per type, position and window, for each company and for all (company null)."""
    return T.reaction_stats(_reactions(spark, d).filter(F.col("trading_date") <= F.lit("2000-12-31").cast("date")), (1, 3, 5))


_AR2 = "a2 AS (SELECT c.*, " + ", ".join(f"round(e{n}.close / NULLIF(b.close, 0) - e{n}.base / NULLIF(b.base, 0), 8) AS ar_{n}" for n in (3, 20)) + " FROM cs c LEFT JOIN sr b ON b.company_id = c.company_id AND b.idx = c.idx - 1 " + " ".join(f"LEFT JOIN sr e{n} ON e{n}.company_id = c.company_id AND e{n}.idx = c.idx + {n - 1}" for n in (3, 20)) + ")"


def _signal_sql(share: float, means: tuple[float, float]) -> str:
    """Signals of both horizons for every (company, type, position); urgent cases stand for those without a type, a seventh of the companies for weak links."""
    return f"""WITH {_CAL}, {_CASES}, {_AR2}, u AS (SELECT event_type, position, company_id, unnest([3, 20]) AS win, unnest([ar_3, ar_20]) AS v FROM a2 WHERE trading_date <= DATE '2000-12-31'),
st AS (SELECT event_type, position, company_id, win, COUNT(*) AS n, round(AVG(v), 6) AS m, COUNT(*) FILTER (v < 0) AS dn, COUNT(*) FILTER (v > 0) AS up FROM u WHERE v IS NOT NULL GROUP BY GROUPING SETS ((event_type, position, win), (event_type, position, win, company_id))),
k AS (SELECT DISTINCT company_id, event_type, position, CASE WHEN company_id % 7 = 0 THEN 'HOLD' ELSE 'OK' END AS status, h.horizon, h.win, h.lm FROM cs, (VALUES ('SHORT', 3, {means[0]}), ('LONG', 20, {means[1]})) h(horizon, win, lm)),
j AS (SELECT k.*, o.n IS NOT NULL AS own, COALESCE(o.n, p.n, 0) AS n, CASE WHEN o.n IS NOT NULL THEN o.m ELSE p.m END AS m, CASE WHEN o.n IS NOT NULL THEN o.dn ELSE p.dn END AS dn, CASE WHEN o.n IS NOT NULL THEN o.up ELSE p.up END AS up
 FROM k LEFT JOIN st o ON o.company_id = k.company_id AND o.event_type = k.event_type AND o.position = k.position AND o.win = k.win AND o.n >= 10 LEFT JOIN st p ON p.company_id IS NULL AND p.event_type = k.event_type AND p.position = k.position AND p.win = k.win),
r AS (SELECT *, status = 'OK' AND event_type <> '1-URGENT' AS asked, CASE WHEN status <> 'OK' THEN 'WEAK_LINK' WHEN event_type = '1-URGENT' THEN 'NO_TYPE' WHEN n < 10 THEN 'FEW' WHEN GREATEST(dn, up) / CAST(n AS DOUBLE) < {share} THEN 'SPLIT' WHEN abs(m) < lm THEN 'SMALL' WHEN NOT ((dn > up AND m < 0) OR (up > dn AND m > 0)) THEN 'SPLIT' END AS why FROM j),
sg AS (SELECT company_id, event_type, position, horizon, CASE WHEN why IS NOT NULL THEN 'HOLD' WHEN dn > up THEN 'DOWN' ELSE 'UP' END AS label, why AS hold_reason, CASE WHEN asked THEN CASE WHEN own THEN 'COMPANY' ELSE 'POSITION' END END AS scope, CASE WHEN asked THEN n ELSE 0 END AS cases,
 CASE WHEN asked THEN round(GREATEST(dn, up) / CAST(n AS DOUBLE), 6) END AS same_share, CASE WHEN asked THEN m END AS mean_ar FROM r)"""


def signals(spark, d, share: float = 0.65, means: tuple[float, float] = (0.01, 0.02)):
    """X-28 at both horizons, from cases up to the end of training."""
    r = T.abnormal_returns(_cases(spark, d), "company_id", _series(spark, d), (3, 20)).filter(F.col("trading_date") <= F.lit("2000-12-31").cast("date"))
    stats = T.reaction_stats(r, (3, 20))
    k = _cases(spark, d).select("company_id", "event_type", "position").distinct().withColumn("status", F.when(F.col("company_id") % 7 == 0, "HOLD").otherwise("OK"))
    out = [T.signals(k, stats, win, least_mean, share=share, none="1-URGENT").withColumn("horizon", F.lit(h)) for h, win, least_mean in (("SHORT", 3, means[0]), ("LONG", 20, means[1]))]
    return out[0].unionByName(out[1]).select("company_id", "event_type", "position", "horizon", "label", "hold_reason", "scope", "cases", "same_share", "mean_ar")


@query("X_28_signals", _signal_sql(0.65, (0.01, 0.02)) + " SELECT * FROM sg")
def x28(spark, d):
    return signals(spark, d)


_MOVE = f"""WITH {_CAL}, {_CASES}, {_AR}, m AS (SELECT company_id, AVG(abs(ar_5)) AS s FROM ar WHERE ar_5 IS NOT NULL GROUP BY 1) SELECT company_id, round(s, 6) AS expected, CAST((ROW_NUMBER() OVER (ORDER BY round(s, 6), company_id) - 1) * 3 // COUNT(*) OVER () AS BIGINT) AS grade FROM m"""


@query("X_29_expected_move", _MOVE)
def x29(spark, d):
    """Grades are thirds of the companies by expected move; ranks come from ranges, not from one task."""
    m = _reactions(spark, d).filter("ar_5 is not null").groupBy("company_id").agg(F.round(F.avg(F.abs("ar_5")), 6).alias("expected"))
    n = F.broadcast(m.agg(F.count(F.lit(1)).alias("companies")))  # one row
    return ranked_by(m, ["expected", "company_id"]).crossJoin(n).select("company_id", "expected", F.floor(F.col("rank") * 3 / F.col("companies")).alias("grade"))


_BACK = _signal_sql(0.5, (0.0, 0.0)) + """, te AS (SELECT a2.*, sg.label FROM a2 JOIN sg USING (company_id, event_type, position) WHERE horizon = 'SHORT' AND trading_date > DATE '2000-12-31' AND ar_3 IS NOT NULL AND label <> 'HOLD')
SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER ((label = 'UP' AND ar_3 > 0) OR (label = 'DOWN' AND ar_3 < 0)) AS hits FROM te GROUP BY GROUPING SETS ((), (event_type)) HAVING COUNT(*) > 0"""


@query("A_20_backtest", _BACK)
def a20(spark, d):
    """Signals of the training period against what came after; without a minimum share or mean, so that there is something to test."""
    r = _reactions(spark, d).filter((F.col("trading_date") > F.lit("2000-12-31").cast("date")) & F.col("ar_3").isNotNull())
    t = r.join(signals(spark, d, 0.5, (0.0, 0.0)).filter("label <> 'HOLD' and horizon = 'SHORT'"), ["company_id", "event_type", "position"])
    hit = ((F.col("label") == "UP") & (F.col("ar_3") > 0)) | ((F.col("label") == "DOWN") & (F.col("ar_3") < 0))
    return t.groupingSets([[], ["event_type"]], "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))


@query("A_21_move_backtest", _MOVE.replace("SELECT company_id, round(s, 6) AS expected", ", g AS (SELECT company_id, round(s, 6) AS expected", 1).replace(" FROM m", " FROM m)", 1) + " SELECT grade, COUNT(*) AS n, round(AVG(expected), 6) AS predicted, round(AVG(abs(ar_5)), 6) AS realised FROM ar JOIN g USING (company_id) WHERE ar_5 IS NOT NULL GROUP BY 1")
def a21(spark, d):
    r = _reactions(spark, d).filter("ar_5 is not null")
    return r.join(x29(spark, d), "company_id").groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("expected"), 6).alias("predicted"), F.round(F.avg(F.abs("ar_5")), 6).alias("realised"))


_PRED = "pr AS (SELECT event_id, event_type AS y, CASE WHEN value < 30 THEN 'click' WHEN value < 60 THEN 'view' ELSE 'purchase' END AS pred, GREATEST(0.3, LEAST(0.999, value / 100)) AS conf, 1.0 AS w FROM fx_event)"


def _predictions(spark, d):
    e = fixture(spark, d, "fx_event")
    return e.select("event_id", F.col("event_type").alias("y"), F.when(F.col("value") < 30, "click").when(F.col("value") < 60, "view").otherwise("purchase").alias("pred"), F.greatest(F.lit(0.3), F.least(F.lit(0.999), F.col("value") / 100)).alias("conf"))


@query("A_22_scores", f"WITH {_PRED}, c AS (SELECT k, COUNT(*) FILTER (y = k AND pred = k) AS tp, COUNT(*) FILTER (y <> k AND pred = k) AS fp, COUNT(*) FILTER (y = k AND pred <> k) AS fn FROM pr, (SELECT DISTINCT y AS k FROM pr) GROUP BY 1) SELECT (SELECT round(AVG(CASE WHEN y = pred THEN 1 ELSE 0 END), 6) FROM pr) AS accuracy, round(AVG(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM c")
def a22(spark, d):
    """Accuracy and macro-F1 from one confusion table."""
    m = _predictions(spark, d).groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    ks = m.select(F.col("y").alias("k")).distinct()
    c = m.crossJoin(F.broadcast(ks)).groupBy("k").agg(*[F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(a) for a, cond in (("tp", (F.col("y") == F.col("k")) & (F.col("pred") == F.col("k"))), ("fp", (F.col("y") != F.col("k")) & (F.col("pred") == F.col("k"))), ("fn", (F.col("y") == F.col("k")) & (F.col("pred") != F.col("k"))), ("all", F.lit(True)))])  # label x label cells
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return c.agg(F.round(F.sum("tp") / F.max("all"), 6).alias("accuracy"), F.round(F.avg(f1), 6).alias("macro_f1"))


@query("A_23_calibration", f"WITH {_PRED} SELECT CAST(floor(conf * 10) AS BIGINT) AS bin, COUNT(*) AS n, round(AVG(conf), 6) AS confidence, round(AVG(CASE WHEN y = pred THEN 1 ELSE 0 END), 6) AS accuracy FROM pr GROUP BY 1")
def a23(spark, d):
    p = _predictions(spark, d)
    return p.groupBy(F.floor(F.col("conf") * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("conf"), 6).alias("confidence"), F.round(F.avg((F.col("y") == F.col("pred")).cast("int")), 6).alias("accuracy"))


@query("X_32_choose_tau", f"WITH {_PRED}, g AS (SELECT unnest([40, 50, 60, 70, 80, 90]) AS tau) SELECT tau, COUNT(*) FILTER (conf >= tau / 100.0) AS covered, COUNT(*) FILTER (conf >= tau / 100.0 AND y = pred) AS correct FROM pr, g GROUP BY 1")
def x32(spark, d):
    """Coverage and hits on a grid of thresholds; the choice reads these six rows."""
    p = _predictions(spark, d)
    cells = F.array(*[F.struct(F.lit(t).alias("tau"), (F.col("conf") >= t / 100).alias("on")) for t in (40, 50, 60, 70, 80, 90)])
    return p.select("y", "pred", F.inline(cells)).groupBy("tau").agg(F.count_if("on").alias("covered"), F.count_if(F.col("on") & (F.col("y") == F.col("pred"))).alias("correct"))


@query("X_37_chart", f"WITH {_CAL} SELECT e.company_id, e.idx, o.offset_days AS \"offset\", r.close, round(r.close / NULLIF(b.close, 0) - 1, 8) AS cumulative FROM (SELECT company_id, MAX(idx) - 60 AS idx FROM sr GROUP BY 1) e CROSS JOIN (SELECT CAST(unnest(range(-5, 21)) AS INTEGER) AS offset_days) o JOIN ix ON ix.idx = e.idx + o.offset_days LEFT JOIN sr b ON b.company_id = e.company_id AND b.idx = e.idx - 1 LEFT JOIN sr r ON r.company_id = e.company_id AND r.idx = e.idx + o.offset_days")
def x37(spark, d):
    s = _series(spark, d)
    e = s.groupBy("company_id").agg((F.max("idx") - 60).alias("idx"))
    return T.chart(e, "company_id", s, fixture(spark, d, "fx_index")).select("company_id", "idx", "offset", "close", "cumulative")


QUERIES = {k: f for k, (f, _) in _F.items()}
SQL = {k: with_views(s) for k, (_, s) in _F.items() if s}
