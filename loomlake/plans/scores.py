"""Queries A-01 ... A-36, P-05, Q-01 ... Q-08 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.operators import graph as G
from loomlake.operators import scores as S
from loomlake.operators import timeseries as T
from loomlake.plans.fixtures import fixture, with_views

AS_OF = "2001-01-01"


def _windows(spark: SparkSession, windows=S.LONG_WINDOWS) -> DataFrame:
    return S.window_table(spark, AS_OF, windows)


_W = f"""w AS (SELECT * FROM (VALUES ('30D', TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY), ('1Y', TIMESTAMP '{AS_OF}' - INTERVAL 1 YEAR), ('10Y', TIMESTAMP '{AS_OF}' - INTERVAL 10 YEAR)) v(window_type, start_at))"""
_K = "source_company_id, target_company_id, relationship_type"
_CANON = """c AS (SELECT CASE WHEN relationship_type IN ('PARTNER','COMPETE') THEN LEAST(source_company_id, target_company_id) ELSE source_company_id END AS source_company_id,
 CASE WHEN relationship_type IN ('PARTNER','COMPETE') THEN GREATEST(source_company_id, target_company_id) ELSE target_company_id END AS target_company_id,
 relationship_type, document_id, document_type, published_at, score, confidence, impact_direction FROM fx_evidence WHERE source_company_id <> target_company_id)"""


def a01(spark, d):
    return S.evidence_mean(fixture(spark, d, "fx_evidence"), _windows(spark))


_A01 = f"""WITH {_W}, {_CANON}, r AS (SELECT {_K}, document_id, CAST(score * 1000000 AS BIGINT) AS micro, MIN(document_type) AS document_type, MIN(published_at) AS published_at, MIN(impact_direction) AS impact_direction FROM c GROUP BY {_K}, document_id, micro),
g AS (SELECT DISTINCT {_K}, window_type FROM r, w),
s AS (SELECT {_K}, window_type, SUM(CAST(micro AS HUGEINT)) FILTER (document_type = 'NEWS') AS ns, COUNT(*) FILTER (document_type = 'NEWS') AS nn, SUM(CAST(micro AS HUGEINT)) FILTER (document_type = 'DISCLOSURE') AS ds,
 COUNT(*) FILTER (document_type = 'DISCLOSURE') AS dn, COUNT(DISTINCT impact_direction) AS k, MIN(impact_direction) AS dir FROM r JOIN w ON published_at >= start_at AND published_at < TIMESTAMP '{AS_OF}' GROUP BY ALL),
m AS (SELECT g.*, CASE WHEN nn > 0 THEN (ns * 2 + nn) // (nn * 2) END AS news_micro, CASE WHEN dn > 0 THEN (ds * 2 + dn) // (dn * 2) END AS disclosure_micro, COALESCE(nn, 0) AS news_n, COALESCE(dn, 0) AS disclosure_n, CASE WHEN k = 1 THEN dir END AS direction FROM g LEFT JOIN s USING ({_K}, window_type))
SELECT {_K}, window_type, CAST(news_micro AS BIGINT) AS news_micro, CAST(disclosure_micro AS BIGINT) AS disclosure_micro,
 CAST(CASE WHEN news_micro IS NOT NULL AND disclosure_micro IS NOT NULL THEN ((news_micro + disclosure_micro) * 2 + 2) // 4 ELSE COALESCE(news_micro, disclosure_micro) END AS BIGINT) AS score_micro, news_n, disclosure_n, direction FROM m"""


def _correlations(spark, d, pairs):
    series = T.on_calendar(fixture(spark, d, "fx_price"), "company_id", fixture(spark, d, "fx_index"))
    return T.pair_correlation(pairs, series, "company_id", 5, AS_OF)


def a02(spark, d):
    """With the bonus for prices that moved together before the as-of time."""
    ev = fixture(spark, d, "fx_evidence")
    pairs = ev.select(F.least("source_company_id", "target_company_id").alias("a"), F.greatest("source_company_id", "target_company_id").alias("b"))
    return S.saturating_support(ev, _windows(spark), correlation=_correlations(spark, d, pairs))


#: Correlation of daily returns of all pairs, from five common days on.
CORR = f"""ret AS (SELECT company_id, idx, r FROM (SELECT company_id, i.idx, CASE WHEN i.idx - lag(i.idx) OVER v = 1 THEN CAST(p.close_price AS DOUBLE) / lag(CAST(p.close_price AS DOUBLE)) OVER v - 1 END AS r FROM fx_price p JOIN fx_index i USING (trading_date) WHERE p.trading_date < DATE '{AS_OF}' WINDOW v AS (PARTITION BY company_id ORDER BY i.idx)) WHERE r IS NOT NULL),
cor AS (SELECT x.company_id AS a, y.company_id AS b, round(corr(x.r, y.r), 6) AS corr FROM ret x JOIN ret y ON x.idx = y.idx AND x.company_id < y.company_id GROUP BY 1, 2 HAVING COUNT(*) >= 5)"""

_A02 = f"""WITH {_W}, {_CANON}, {CORR}, dd AS (SELECT {_K}, window_type, document_type, document_id, CAST(MAX(confidence) AS DOUBLE) AS c FROM c JOIN w ON published_at >= start_at AND published_at < TIMESTAMP '{AS_OF}' GROUP BY ALL),
p AS (SELECT {_K}, window_type, 100 * (1 - exp(-SUM(c) FILTER (document_type = 'NEWS') / 5)) AS n, 100 * (1 - exp(-SUM(c) FILTER (document_type = 'DISCLOSURE') / 5)) AS f FROM dd GROUP BY ALL)
SELECT {_K}, window_type, round(n, 6) AS news_score, round(f, 6) AS disclosure_score, round(LEAST(100, CASE WHEN n IS NOT NULL AND f IS NOT NULL THEN (n + f) / 2 ELSE COALESCE(n, f) END + 3 * LEAST(1, abs(COALESCE(corr, 0)))), 6) AS score
FROM p LEFT JOIN cor ON cor.a = LEAST(source_company_id, target_company_id) AND cor.b = GREATEST(source_company_id, target_company_id)"""


def a03(spark, d):
    """Re-score only the relations that new evidence (the last 60 days) touches."""
    ev = fixture(spark, d, "fx_evidence")
    key = ["source_company_id", "target_company_id", "relationship_type"]
    touched = ev.filter(F.col("published_at").between(F.lit("2000-11-02").cast("timestamp_ntz"), F.lit(AS_OF).cast("timestamp_ntz"))).select(*key).distinct()
    rows = ev.join(touched, key, "left_semi").join(F.broadcast(_windows(spark)), S.in_window("published_at"))
    return rows.groupBy(*key, "window_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.least(F.lit(1.0), 0.5 - 0.35 * F.expm1(-F.count(F.lit(1)) / 8)), 6).alias("confidence"))


_A03 = f"""WITH {_W}, t AS (SELECT DISTINCT {_K} FROM fx_evidence WHERE published_at BETWEEN TIMESTAMP '2000-11-02' AND TIMESTAMP '{AS_OF}')
SELECT {_K}, window_type, COUNT(*) AS n, round(LEAST(1, 0.5 + 0.35 * (1 - exp(-COUNT(*) / 8))), 6) AS confidence FROM fx_evidence JOIN t USING ({_K}) JOIN w ON published_at >= start_at AND published_at < TIMESTAMP '{AS_OF}' GROUP BY ALL"""


def a04(spark, d):
    """Company metrics per window: events, positive and negative share, mean value, relations on either side."""
    ev, rel = fixture(spark, d, "fx_event"), fixture(spark, d, "fx_edge")
    w = S.window_table(spark, "2024-01-31", S.SHORT_WINDOWS)
    m = ev.join(F.broadcast(w), S.in_window("dateline")).groupBy("company_id", "window_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.round(F.avg("value"), 6).alias("mean_value")
    )
    sides = rel.select(F.col("src").alias("company_id"), "src", "dst", "rel").unionByName(rel.select(F.col("dst").alias("company_id"), "src", "dst", "rel"))
    return m.join(sides.groupBy("company_id").agg(F.count(F.lit(1)).alias("relations")), "company_id", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))


_A04 = """WITH w AS (SELECT * FROM (VALUES ('7D', 7), ('30D', 30), ('90D', 90)) v(window_type, k)), m AS (SELECT company_id, window_type, COUNT(*) AS n, COUNT(*) FILTER (status = 'ACTIVE') AS active, COUNT(*) FILTER (event_type = 'purchase') AS purchases, round(AVG(value), 6) AS mean_value
 FROM fx_event JOIN w ON dateline >= TIMESTAMP '2024-01-31' - to_days(CAST(k AS INTEGER)) AND dateline < TIMESTAMP '2024-01-31' GROUP BY ALL),
r AS (SELECT company_id, COUNT(*) AS relations FROM (SELECT src AS company_id FROM fx_edge UNION ALL SELECT dst FROM fx_edge) GROUP BY 1) SELECT m.*, COALESCE(relations, 0) AS relations FROM m LEFT JOIN r USING (company_id)"""


def a05(spark, d):
    c = fixture(spark, d, "fx_price").select("company_id", "trading_date", (F.col("close_price").cast("double") / 1_000_000).alias("pct"))
    return c.select("company_id", "trading_date", S.invest_score(F.col("pct")).alias("invest_score"))


_A05 = """SELECT company_id, trading_date, CASE WHEN pct < 0.05 THEN 0 ELSE round(LEAST(100, 100 * (1 - exp(-pct / 0.28))), 6) END AS invest_score FROM (SELECT company_id, trading_date, CAST(close_price AS DOUBLE) / 1000000 AS pct FROM fx_price)"""


def a06(spark, d):
    ev = fixture(spark, d, "fx_evidence").filter("confidence between 0.01 and 1")
    return S.noisy_or(S.canonical(ev), ["source_company_id", "target_company_id", "relationship_type"], "confidence")


_A06 = f"""SELECT * FROM (SELECT {_K}, round(CASE WHEN MAX(confidence) >= 1 THEN 1 ELSE 1 - exp(SUM(ln(1 - CAST(confidence AS DOUBLE))) FILTER (confidence < 1)) END, 6) AS strength, COUNT(*) AS pieces FROM
 (SELECT CASE WHEN relationship_type IN ('PARTNER', 'COMPETE') THEN LEAST(source_company_id, target_company_id) ELSE source_company_id END AS source_company_id, CASE WHEN relationship_type IN ('PARTNER', 'COMPETE') THEN GREATEST(source_company_id, target_company_id) ELSE target_company_id END AS target_company_id, relationship_type, confidence FROM fx_evidence WHERE source_company_id <> target_company_id) c WHERE confidence BETWEEN 0.01 AND 1 GROUP BY ALL) WHERE strength >= 0.5"""


def a07(spark, d):
    """Co-mention NPMI of company pairs that share a segment in three documents or more."""
    return G.comention_stats(fixture(spark, d, "fx_segment"), "document_id", "segment", "company_id").select("a", "b", "n_ab", "npmi")


_A07 = """WITH m AS (SELECT DISTINCT document_id, segment, company_id FROM fx_segment), n AS (SELECT COUNT(DISTINCT document_id) AS docs FROM m), s AS (SELECT company_id, COUNT(DISTINCT document_id) AS k FROM m GROUP BY 1),
p AS (SELECT a, b, COUNT(*) AS n_ab FROM (SELECT DISTINCT x.document_id, x.company_id AS a, y.company_id AS b FROM m x JOIN m y ON x.document_id = y.document_id AND x.segment = y.segment AND x.company_id < y.company_id) GROUP BY ALL HAVING COUNT(*) >= 3)
SELECT a, b, n_ab, round(CASE WHEN n_ab = docs THEN 1 ELSE ln(CAST(n_ab AS DOUBLE) * docs / (CAST(s1.k AS DOUBLE) * s2.k)) / -ln(n_ab / CAST(docs AS DOUBLE)) END, 6) AS npmi FROM p JOIN s s1 ON s1.company_id = a JOIN s s2 ON s2.company_id = b, n"""


def a08(spark, d):
    return fixture(spark, d, "fx_mention").groupBy("company_id").agg(F.count_distinct("document_id").alias("docs")).orderBy(F.desc("docs"), "company_id").limit(30)


_A08 = "SELECT company_id, COUNT(DISTINCT document_id) AS docs FROM fx_mention GROUP BY 1 ORDER BY docs DESC, company_id LIMIT 30"


def a09(spark, d):
    return fixture(spark, d, "fx_evidence").agg(F.count_distinct("document_id").alias("docs"), F.count_distinct("source_company_id", "target_company_id").alias("pairs"))


_A09 = "SELECT COUNT(DISTINCT document_id) AS docs, COUNT(DISTINCT (source_company_id, target_company_id)) AS pairs FROM fx_evidence"


def a10(spark, d):
    """Spans of a document as one sorted list, carried as text."""
    m = fixture(spark, d, "fx_mention")
    return m.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("company_id")), lambda x: x.cast("string")), ",").alias("companies"))


_A10 = "SELECT document_id, string_agg(CAST(company_id AS VARCHAR), ',' ORDER BY company_id) AS companies FROM fx_mention GROUP BY 1"


def a11(spark, d):
    """Mention roll-up: count, position of the first (title, lead, body), greatest confidence, methods in order."""
    e = fixture(spark, d, "fx_event")
    pos = F.when(F.min("value") < 1, "title").when(F.min("value") < 10, "lead").otherwise("body")
    return e.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), pos.alias("first_pos"), F.round(F.max("value"), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("methods"))


_A11 = """SELECT company_id, COUNT(*) AS n, CASE WHEN MIN(value) < 1 THEN 'title' WHEN MIN(value) < 10 THEN 'lead' ELSE 'body' END AS first_pos, round(MAX(value), 6) AS confidence, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS methods FROM fx_event GROUP BY 1"""


def a12(spark, d):
    c, m = fixture(spark, d, "fx_company"), fixture(spark, d, "fx_mention")
    return m.join(c, "company_id").groupBy("industry").agg(F.count_distinct("company_id").alias("companies"), F.count_distinct("document_id").alias("documents"))


_A12 = "SELECT industry, COUNT(DISTINCT company_id) AS companies, COUNT(DISTINCT document_id) AS documents FROM fx_mention JOIN fx_company USING (company_id) GROUP BY 1"


def a14(spark, d):
    i = fixture(spark, d, "fx_impact").filter("status = 'OK'")
    return i.groupBy("company_id").pivot("hop", [0, 1, 2, 3]).count().select("company_id", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"hop{h}") for h in range(4)])


_A14 = "SELECT company_id, " + ", ".join(f"COUNT(*) FILTER (hop = {h}) AS hop{h}" for h in range(4)) + " FROM fx_impact WHERE status = 'OK' GROUP BY 1"


def a15(spark, d):
    """Recent and usual event counts by Seoul's calendar day, from the newest day there is."""
    e = fixture(spark, d, "fx_event").withColumn("day", F.to_date(F.from_utc_timestamp(F.col("dateline").cast("timestamp"), "Asia/Seoul")))
    newest = e.agg(F.max("day").alias("newest"))
    age = F.datediff("newest", "day")
    return e.crossJoin(F.broadcast(newest)).groupBy("company_id").agg(F.count_if(age < 7).alias("recent"), F.count_if(age.between(7, 66)).alias("usual"))  # one row


_A15 = """WITH e AS (SELECT company_id, CAST(dateline + INTERVAL 9 HOUR AS DATE) AS day FROM fx_event), n AS (SELECT MAX(day) AS newest FROM e)
SELECT company_id, COUNT(*) FILTER (newest - day < 7) AS recent, COUNT(*) FILTER (newest - day BETWEEN 7 AND 66) AS usual FROM e, n GROUP BY 1"""


def a16(spark, d):
    p = fixture(spark, d, "fx_price")
    w = Window.partitionBy("company_id").orderBy(F.desc("trading_date"))
    return p.withColumn("rn", F.row_number().over(w)).filter("rn <= 250").groupBy("company_id").agg(F.max("close_price").alias("high"), F.min("low_price").alias("low"))


_A16 = "SELECT company_id, MAX(close_price) AS high, MIN(low_price) AS low FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY trading_date DESC) AS rn FROM fx_price) WHERE rn <= 250 GROUP BY 1"


def a17(spark, d):
    e = fixture(spark, d, "fx_edge")
    both = e.select(F.col("src").alias("company_id"), F.col("dst").alias("other")).union(e.select("dst", "src"))
    return both.groupBy("company_id").agg(F.count_distinct("other").alias("counterparts"))


_A17 = "SELECT company_id, COUNT(DISTINCT other) AS counterparts FROM (SELECT src AS company_id, dst AS other FROM fx_edge UNION ALL SELECT dst, src FROM fx_edge) GROUP BY 1"


def a18(spark, d):
    c = fixture(spark, d, "fx_company")
    active = c.filter("status = 'ACTIVE'").select("company_id", "industry")
    return c.select("industry").distinct().join(active, "industry", "left").groupBy("industry").agg(F.count_distinct("company_id").alias("companies"))


_A18 = "SELECT i.industry, COUNT(DISTINCT c.company_id) AS companies FROM (SELECT DISTINCT industry FROM fx_company) i LEFT JOIN (SELECT * FROM fx_company WHERE status = 'ACTIVE') c USING (industry) GROUP BY 1"


def a19(spark, d):
    """The probe stops at 2,000 rows: its result is the feature, not a short cut."""
    e = fixture(spark, d, "fx_event")
    return e.filter("status = 'ACTIVE'").select("event_id").limit(2000).agg(F.count(F.lit(1)).alias("probed"))


_A19 = "SELECT COUNT(*) AS probed FROM (SELECT event_id FROM fx_event WHERE status = 'ACTIVE' LIMIT 2000)"


def a24(spark, d):
    e = fixture(spark, d, "fx_event")
    w = Window.partitionBy("company_id", F.to_date("dateline"))
    return e.select("event_id", F.round(1 / F.count(F.lit(1)).over(w), 8).alias("weight"))


_A24 = "SELECT event_id, round(1.0 / COUNT(*) OVER (PARTITION BY company_id, CAST(dateline AS DATE)), 8) AS weight FROM fx_event"


def a25(spark, d):
    e = fixture(spark, d, "fx_event")
    n = e.agg(F.count_distinct("event_id").alias("n"))
    return e.groupBy("event_type").agg(F.count_distinct("event_id").alias("k")).crossJoin(F.broadcast(n)).filter(F.col("k") >= 0.01 * F.col("n")).select("event_type", F.round(F.col("k") / F.col("n"), 6).alias("share"))


_A25 = "WITH n AS (SELECT COUNT(DISTINCT event_id) AS n FROM fx_event) SELECT event_type, round(COUNT(DISTINCT event_id) / MAX(n), 6) AS share FROM fx_event, n GROUP BY 1 HAVING COUNT(DISTINCT event_id) >= 0.01 * MAX(n)"


def a26(spark, d):
    a = fixture(spark, d, "fx_alias").groupBy("company_id", "alias").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("company_id").orderBy(F.desc("k"), "alias")
    return a.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("company_id", F.col("alias").alias("main_alias"), "k")


_A26 = "SELECT company_id, alias AS main_alias, k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY k DESC, alias) AS rn FROM (SELECT company_id, alias, COUNT(*) AS k FROM fx_alias GROUP BY ALL)) WHERE rn = 1"


def a27(spark, d):
    """Verdict per company and document: both signs conflict, neutral abstains, else the sign that is there."""
    e = fixture(spark, d, "fx_evidence").groupBy("source_company_id", "document_id").agg(F.bool_or(F.col("impact_direction") == "POSITIVE").alias("p"), F.bool_or(F.col("impact_direction") == "NEGATIVE").alias("n"))
    p, n = F.coalesce("p", F.lit(False)), F.coalesce("n", F.lit(False))
    return e.select("source_company_id", "document_id", F.when(p & n, "CONFLICT").when(p, "POSITIVE").when(n, "NEGATIVE").alias("verdict"))


_A27 = """SELECT source_company_id, document_id, CASE WHEN p > 0 AND n > 0 THEN 'CONFLICT' WHEN p > 0 THEN 'POSITIVE' WHEN n > 0 THEN 'NEGATIVE' END AS verdict FROM
(SELECT source_company_id, document_id, COUNT(*) FILTER (impact_direction = 'POSITIVE') AS p, COUNT(*) FILTER (impact_direction = 'NEGATIVE') AS n FROM fx_evidence GROUP BY ALL)"""


def a28(spark, d):
    e = fixture(spark, d, "fx_evidence").groupBy("document_id").agg(F.count_distinct("impact_direction").alias("k"), F.min("impact_direction").alias("m"))
    return e.select("document_id", F.when(F.col("k") == 1, F.col("m")).alias("label"))


_A28 = "SELECT document_id, CASE WHEN COUNT(DISTINCT impact_direction) = 1 THEN MIN(impact_direction) END AS label FROM fx_evidence GROUP BY 1"


def a29(spark, d):
    return a01(spark, d).groupBy("window_type").agg(F.count(F.lit(1)).alias("rows"))


_A29 = "SELECT window_type, COUNT(*) AS rows FROM (" + _A01.replace("WITH ", "WITH ", 1) + ") GROUP BY 1"


def a30(spark, d):
    """A seeded fraction: the sample is the feature, so there is no SQL to hold it against."""
    return fixture(spark, d, "fx_document").select("document_id").sample(False, 0.1, 42)


def a31(spark, d):
    e = fixture(spark, d, "fx_event")
    return e.filter("status = 'ACTIVE'").groupBy("company_id").agg(F.max_by("event_id", F.struct("dateline", "event_id")).alias("latest"), F.max("dateline").alias("at"))


_A31 = "SELECT company_id, event_id AS latest, dateline AS at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY dateline DESC, event_id DESC) AS rn FROM fx_event WHERE status = 'ACTIVE') WHERE rn = 1"


def a32(spark, d):
    """Publishers are the documents' residues here, as the fixture has none."""
    return S.evidence_confidence(fixture(spark, d, "fx_evidence").withColumn("publisher", F.col("document_id") % 7))


_A32 = f"""WITH {_CANON} SELECT {_K}, COUNT(DISTINCT document_id) AS n, round(LEAST(1, 0.5 + 0.35 * (1 - exp(-COUNT(DISTINCT document_id) / 8)) + CASE WHEN COUNT(*) FILTER (document_type = 'DISCLOSURE') > 0 THEN 0.05 ELSE 0 END
 + CASE WHEN COUNT(DISTINCT document_type) = 2 THEN 0.05 ELSE 0 END + CASE WHEN COUNT(DISTINCT document_id % 7) >= 2 THEN 0.03 ELSE 0 END + CASE WHEN CAST(MAX(published_at) AS DATE) - CAST(MIN(published_at) AS DATE) >= 180 THEN 0.02 ELSE 0 END), 6) AS confidence FROM c GROUP BY ALL"""


def a33(spark, d):
    """Direction by unordered pair: the first stated one, else POSITIVE."""
    ev = fixture(spark, d, "fx_evidence")
    pair = {"lo": F.least("source_company_id", "target_company_id"), "hi": F.greatest("source_company_id", "target_company_id")}
    stated = ev.withColumns(pair).groupBy("lo", "hi").agg(F.min("impact_direction").alias("stated"))
    rel = ev.select("source_company_id", "target_company_id").distinct().withColumns(pair)
    return rel.join(stated, ["lo", "hi"], "left").select("source_company_id", "target_company_id", F.coalesce("stated", F.lit("POSITIVE")).alias("direction"))


_A33 = """WITH s AS (SELECT LEAST(source_company_id, target_company_id) AS lo, GREATEST(source_company_id, target_company_id) AS hi, MIN(impact_direction) AS stated FROM fx_evidence GROUP BY ALL)
SELECT r.source_company_id, r.target_company_id, COALESCE(stated, 'POSITIVE') AS direction FROM (SELECT DISTINCT source_company_id, target_company_id FROM fx_evidence) r LEFT JOIN s ON lo = LEAST(r.source_company_id, r.target_company_id) AND hi = GREATEST(r.source_company_id, r.target_company_id)"""


def a34(spark, d):
    e = fixture(spark, d, "fx_evidence")
    return e.groupBy("relationship_type").agg(*[F.count_if(F.col("impact_direction") == x).alias(x.lower()) for x in ("POSITIVE", "NEGATIVE", "NEUTRAL")], F.count_if(F.col("impact_direction").isNull()).alias("unstated"))


_A34 = "SELECT relationship_type, COUNT(*) FILTER (impact_direction = 'POSITIVE') AS positive, COUNT(*) FILTER (impact_direction = 'NEGATIVE') AS negative, COUNT(*) FILTER (impact_direction = 'NEUTRAL') AS neutral, COUNT(*) FILTER (impact_direction IS NULL) AS unstated FROM fx_evidence GROUP BY 1"


def a35(spark, d):
    """Set precision, recall and F1 of predicted pairs against gold pairs."""
    e = fixture(spark, d, "fx_evidence")
    pairs = ["source_company_id", "target_company_id"]
    pred, gold = e.filter("document_type = 'NEWS'").select(*pairs).distinct(), e.filter("document_type = 'DISCLOSURE'").select(*pairs).distinct()
    both = pred.withColumn("p", F.lit(1)).join(gold.withColumn("g", F.lit(1)), pairs, "outer").agg(F.count("p").alias("np"), F.count("g").alias("ng"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"))
    return both.select(F.round(F.try_divide("tp", "np"), 6).alias("precision"), F.round(F.try_divide("tp", "ng"), 6).alias("recall"), F.round(F.try_divide(2 * F.col("tp"), F.col("np") + F.col("ng")), 6).alias("f1"))


_A35 = """WITH p AS (SELECT DISTINCT source_company_id, target_company_id FROM fx_evidence WHERE document_type = 'NEWS'), g AS (SELECT DISTINCT source_company_id, target_company_id FROM fx_evidence WHERE document_type = 'DISCLOSURE'),
c AS (SELECT (SELECT COUNT(*) FROM p) AS np, (SELECT COUNT(*) FROM g) AS ng, (SELECT COUNT(*) FROM p JOIN g USING (source_company_id, target_company_id)) AS tp) SELECT round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * tp / (np + ng), 6) AS f1 FROM c"""


def a36(spark, d):
    return fixture(spark, d, "fx_price").groupBy("company_id").agg(F.round(F.median(F.col("close_price").cast("double")), 6).alias("median_close"))


_A36 = "SELECT company_id, round(median(CAST(close_price AS DOUBLE)), 6) AS median_close FROM fx_price GROUP BY 1"


def p05(spark, d):
    return S.violations(fixture(spark, d, "fx_evidence")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


_P05 = """SELECT rule, COUNT(*) AS rows FROM (SELECT CASE WHEN source_company_id = target_company_id THEN 'self_relation' WHEN score NOT BETWEEN 0 AND 100 THEN 'score_range' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_range' END AS rule FROM fx_evidence) WHERE rule IS NOT NULL GROUP BY 1"""


def j05(spark, d):
    rel = fixture(spark, d, "fx_evidence").select("source_company_id", "target_company_id", "relationship_type").distinct()
    return rel.crossJoin(F.broadcast(_windows(spark).select("window_type")))  # three rows


_J05 = f"WITH {_W} SELECT DISTINCT {_K}, window_type FROM fx_evidence, w"


def j06(spark, d):
    return fixture(spark, d, "fx_evidence").join(F.broadcast(_windows(spark)), S.in_window("published_at")).groupBy("window_type", "document_type").agg(F.count(F.lit(1)).alias("rows"))


_J06 = f"WITH {_W} SELECT window_type, document_type, COUNT(*) AS rows FROM fx_evidence JOIN w ON published_at >= start_at AND published_at < TIMESTAMP '{AS_OF}' GROUP BY ALL"

_FUNCTIONS = {
    "A_01_evidence_mean": (a01, _A01), "A_02_saturating_support": (a02, _A02), "A_03_incremental_rescore": (a03, _A03), "A_04_company_metrics": (a04, _A04), "A_05_invest_score": (a05, _A05),
    "A_06_noisy_or": (a06, _A06), "A_07_npmi": (a07, _A07), "A_08_top_docs": (a08, _A08), "A_09_distinct_counts": (a09, _A09), "A_10_collect_spans": (a10, _A10), "A_11_mention_rollup": (a11, _A11),
    "A_12_industry_rollup": (a12, _A12), "A_14_signal_counts": (a14, _A14), "A_15_news_recency": (a15, _A15), "A_16_year_range": (a16, _A16), "A_17_counterparts": (a17, _A17), "A_18_industry_companies": (a18, _A18),
    "A_19_capped_count": (a19, _A19), "A_24_sample_weight": (a24, _A24), "A_25_category_vocab": (a25, _A25), "A_26_main_alias": (a26, _A26), "A_27_verdict": (a27, _A27), "A_28_unanimous": (a28, _A28),
    "A_29_group_counts": (a29, _A29), "A_30_sample": (a30, None), "A_31_latest": (a31, _A31), "A_32_confidence": (a32, _A32), "A_33_direction_overwrite": (a33, _A33), "A_34_direction_report": (a34, _A34),
    "A_35_prf": (a35, _A35), "A_36_median": (a36, _A36), "P_05_violations": (p05, _P05), "J_05_window_grid": (j05, _J05), "J_06_window_theta": (j06, _J06),
}
QUERIES = {k: f for k, (f, _) in _FUNCTIONS.items()}
SQL = {k: with_views(s) for k, (_, s) in _FUNCTIONS.items() if s}
