"""Whole pages of the service (section 2.14 of the inventory): each composes its blocks from the page's first table to its last row."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import graph as G
from loomlake.operators import scores
from loomlake.operators import serving as S
from loomlake.operators import timeseries as T
from loomlake.plans.fixtures import fixture, with_views
from loomlake.plans.timeseries import _CAL, _series
from loomlake.session import written
from loomlake.sources.tables import table

_F: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _F[name] = (f, sql)
        return f

    return add


def _active(spark, d):
    return fixture(spark, d, "fx_company").filter("status = 'ACTIVE'")


_LAST = "l AS (SELECT company_id, MAX(trading_date) AS l, max_by(CAST(close_price AS DOUBLE), trading_date) AS c FROM fx_price GROUP BY 1)"


@query("E_03_graph_latest", f"""WITH {_LAST}, k AS (SELECT l.company_id, {", ".join(f"max_by(CAST(p.close_price AS DOUBLE), p.trading_date) FILTER (p.trading_date <= l - {n}) AS c{n}" for n in (7, 30, 90))}, any_value(c) AS c FROM l JOIN fx_price p USING (company_id) GROUP BY 1)
SELECT 'node' AS kind, m.company_id AS a, NULL AS b, NULL AS rel, round(c / c7 - 1, 6) AS x, round(c / c30 - 1, 6) AS y, round(c / c90 - 1, 6) AS z FROM fx_company m LEFT JOIN k USING (company_id) WHERE status = 'ACTIVE'
UNION ALL SELECT 'edge', src, dst, rel, round(strength, 6), NULL, NULL FROM fx_edge e WHERE EXISTS (SELECT 1 FROM fx_company WHERE company_id = src AND status = 'ACTIVE') AND EXISTS (SELECT 1 FROM fx_company WHERE company_id = dst AND status = 'ACTIVE')""")
def e03(spark, d):
    """The latest graph: active companies with their change over 7, 30 and 90 days, and the relations between them."""
    c = T.lookback_close(fixture(spark, d, "fx_price").withColumn("close_price", F.col("close_price").cast("double")), "company_id", (7, 30, 90))
    change = [F.round(F.try_divide("close", f"close_{n}d") - 1, 6).alias(x) for n, x in ((7, "x"), (30, "y"), (90, "z"))]
    a = _active(spark, d).select("company_id")
    nodes = a.join(c, "company_id", "left").select(F.lit("node").alias("kind"), F.col("company_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("string").alias("rel"), *change)
    e = fixture(spark, d, "fx_edge").join(a.toDF("src"), "src", "left_semi").join(a.toDF("dst"), "dst", "left_semi")
    none = F.lit(None).cast("double")
    return nodes.unionByName(e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "rel", F.round("strength", 6).alias("x"), none.alias("y"), none.alias("z")))


_NEAR = "aj AS (SELECT src AS me, dst AS other FROM fx_relation UNION ALL SELECT dst, src FROM fx_relation), b AS (SELECT '052143' AS node, 0 AS depth UNION SELECT other, depth + 1 FROM b JOIN aj ON me = node WHERE depth < 2), n AS (SELECT node, MIN(depth) AS depth FROM b GROUP BY 1)"


@query("E_04_company_graph", f"WITH RECURSIVE {_NEAR} SELECT n.node, n.depth, c.name_official AS name, c.sector, COUNT(r.src) AS links FROM n LEFT JOIN companies c ON c.ticker = n.node LEFT JOIN fx_relation r ON (r.src = n.node AND r.dst IN (SELECT node FROM n)) OR (r.dst = n.node AND r.src IN (SELECT node FROM n)) GROUP BY ALL")
def e04(spark, d):
    """The graph around one company: everyone within two hops, with name, sector and the links to others of them."""
    r = written(fixture(spark, d, "fx_relation"), "relations")
    near = G.frontier(r, spark.createDataFrame([("052143",)], "center string"), 2).select("node", "depth")
    inner = S.both_ways(r, "src", "dst").join(near.select(F.col("node").alias("me")), "me", "left_semi").join(near.select(F.col("node").alias("other")), "other", "left_semi")
    links = inner.groupBy(F.col("me").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    c = table(spark, d, "companies").select(F.col("ticker").alias("node"), F.col("name_official").alias("name"), "sector")
    return near.join(c, "node", "left").join(links, "node", "left").select("node", "depth", "name", "sector", F.coalesce("links", F.lit(0)).alias("links"))


@query("E_05_relationship_detail", "WITH b AS (SELECT l_suppkey AS src, l_partkey % 100 AS dst, MAX(CAST(round(l_discount * 100) AS BIGINT)) AS pct FROM lineitem WHERE l_suppkey <> l_partkey % 100 AND round(l_discount * 100) BETWEEN 1 AND 100 GROUP BY 1, 2) SELECT e.src, e.dst, e.rel, x.name AS src_name, y.name AS dst_name, round(e.strength, 6) AS strength, e.n, b.pct FROM fx_edge e JOIN fx_company x ON x.company_id = e.src JOIN fx_company y ON y.company_id = e.dst LEFT JOIN b ON b.src = e.src AND b.dst = e.dst")
def e05(spark, d):
    """Relations with both names, strength, evidence and the stake that the source holds of the target."""
    h = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.round(F.col("l_discount") * 100).cast("bigint").alias("pct"))
    best = G.best_stakes(h, "src", "dst", "pct", []).select("src", "dst", "pct")
    e, c = fixture(spark, d, "fx_edge"), fixture(spark, d, "fx_company").select("company_id", "name")
    return e.join(c.toDF("src", "src_name"), "src").join(c.toDF("dst", "dst_name"), "dst").join(best, ["src", "dst"], "left").select("src", "dst", "rel", "src_name", "dst_name", F.round("strength", 6).alias("strength"), "n", "pct")


@query("E_06_evidence_page", "WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY score DESC NULLS LAST, relationship_type) AS rn FROM fx_evidence WHERE source_company_id = 3 OR target_company_id = 3) SELECT document_id, published_at, relationship_type, score FROM r WHERE rn = 1 AND (published_at, document_id) < (TIMESTAMP '2000-06-01', 1000000000) ORDER BY published_at DESC, document_id DESC LIMIT 21")
def e06(spark, d):
    """Evidence of one company's relations: the best row of each document, behind a cursor, a page of twenty and one more."""
    e = fixture(spark, d, "fx_evidence").filter("source_company_id = 3 or target_company_id = 3")
    one = S.top_per(e, ["document_id"], [F.desc_nulls_last("score"), F.col("relationship_type")])
    cursor = S.after([("published_at", F.lit("2000-06-01").cast("timestamp_ntz"), True), ("document_id", F.lit(1_000_000_000), True)])
    return S.page(one.filter(cursor), [F.desc("published_at"), F.desc("document_id")], 20).select("document_id", "published_at", "relationship_type", "score")


@query("E_07_event_feed", "WITH p AS (SELECT * FROM fx_event WHERE status = 'ACTIVE' AND event_type = 'purchase' ORDER BY dateline DESC, event_id DESC LIMIT 31), i AS (SELECT event_id, COUNT(*) FILTER (status = 'OK') AS sure, COUNT(*) FILTER (status = 'HOLD') AS held FROM fx_impact GROUP BY 1) SELECT p.event_id, p.dateline, c.name, COALESCE(sure, 0) AS sure, COALESCE(held, 0) AS held FROM p LEFT JOIN i USING (event_id) LEFT JOIN fx_company c USING (company_id)")
def e07(spark, d):
    """A page of the feed by type, with company and the number of sure and held impacts; only the page's own events are counted."""
    p = S.page(S.optional(fixture(spark, d, "fx_event").filter("status = 'ACTIVE'"), event_type="purchase", company_id=None), [F.desc("dateline"), F.desc("event_id")], 30)
    i = fixture(spark, d, "fx_impact").select("event_id", F.col("status").alias("state")).join(F.broadcast(p.select("event_id")), "event_id", "left_semi")  # a page
    n = i.groupBy("event_id").agg(F.count_if(F.col("state") == "OK").alias("sure"), F.count_if(F.col("state") == "HOLD").alias("held"))
    c = fixture(spark, d, "fx_company").select("company_id", "name")
    return p.join(n, "event_id", "left").join(c, "company_id", "left").select("event_id", "dateline", "name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("sure", "held")])


@query("E_08_company_history", "WITH h AS (SELECT * FROM fx_event WHERE company_id = 5 AND status = 'ACTIVE'), n AS (SELECT COUNT(*) AS n FROM (SELECT 1 FROM h LIMIT 100)) SELECT event_id, dateline, event_type, round(i.score, 6) AS impact, n.n AS known FROM (SELECT * FROM h ORDER BY dateline DESC, event_id LIMIT 25) LEFT JOIN (SELECT event_id, MAX(score) AS score FROM fx_impact WHERE company_id = 5 GROUP BY 1) i USING (event_id), n")
def e08(spark, d):
    """One company's events, newest first, with the impact on it and a count that stops at a hundred."""
    h = fixture(spark, d, "fx_event").filter("company_id = 5 and status = 'ACTIVE'")
    n = F.broadcast(h.limit(100).agg(F.count(F.lit(1)).alias("known")))  # one row
    i = fixture(spark, d, "fx_impact").filter("company_id = 5").groupBy("event_id").agg(F.round(F.max("score"), 6).alias("impact"))
    return h.orderBy(F.desc("dateline"), "event_id").limit(25).join(i, "event_id", "left").crossJoin(n).select("event_id", "dateline", "event_type", "impact", "known")


@query("E_09_news_search", "WITH m AS (SELECT document_id, COUNT(*) AS companies, MIN(company_id) AS primary_company FROM fx_mention GROUP BY 1) SELECT t.document_id, t.publisher, t.published_at, COALESCE(companies, 0) AS companies, primary_company FROM (SELECT * FROM fx_document WHERE contains(lower(title), 'stake') OR contains(lower(title), '맞손') ORDER BY published_at DESC NULLS LAST, document_id LIMIT 20) t LEFT JOIN m USING (document_id)")
def e09(spark, d):
    """Documents whose title holds either keyword, newest first, with the companies they name."""
    hit = S.contains_ignoring_case("title", "stake") | S.contains_ignoring_case("title", "맞손")
    p = fixture(spark, d, "fx_document").filter(hit).orderBy(F.desc_nulls_last("published_at"), "document_id").limit(20)
    m = fixture(spark, d, "fx_mention").groupBy("document_id").agg(F.count(F.lit(1)).alias("companies"), F.min("company_id").alias("primary_company"))
    return p.join(m, "document_id", "left").select("document_id", "publisher", "published_at", F.coalesce("companies", F.lit(0)).alias("companies"), "primary_company")


@query("E_10_company_search", "WITH a AS (SELECT ticker, list(lower(alias_name)) AS l FROM company_alias GROUP BY 1), r AS (SELECT c.ticker, name_official, CASE WHEN lower(c.ticker) = '백개' THEN 0 WHEN lower(name_official) = '백개' OR list_contains(COALESCE(l, []), '백개') THEN 1 WHEN starts_with(lower(name_official), '백개') OR len(list_filter(COALESCE(l, []), lambda x: starts_with(x, '백개'))) > 0 THEN 2 WHEN contains(lower(name_official), '백개') OR len(list_filter(COALESCE(l, []), lambda x: contains(x, '백개'))) > 0 THEN 3 END AS rank FROM companies c LEFT JOIN a USING (ticker)) SELECT ticker, name_official AS name, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, name, ticker LIMIT 20")
def e10(spark, d):
    """Companies by code, name or alias: exact, then prefix, then contained."""
    a = table(spark, d, "company_alias").groupBy("ticker").agg(F.collect_list("alias_name").alias("aliases"))  # curated, a few a company
    c = table(spark, d, "companies").join(a, "ticker", "left").withColumn("rank", S.search_rank("ticker", "name_official", "aliases", "백개"))
    return c.filter("rank is not null").orderBy("rank", "name_official", "ticker").limit(20).select("ticker", F.col("name_official").alias("name"), "rank")


@query("E_11_industries", "SELECT sector, COUNT(*) AS companies, COUNT(*) FILTER (delisted_at IS NULL) AS listed, COUNT(DISTINCT market) AS markets FROM companies WHERE sector IS NOT NULL GROUP BY 1")
def e11(spark, d):
    return table(spark, d, "companies").filter("sector is not null").groupBy("sector").agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("delisted_at").isNull()).alias("listed"), F.count_distinct("market").alias("markets"))


@query("E_12_backtest", "WITH o AS (SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (value > 50) AS hits FROM fx_event WHERE status = 'ACTIVE' GROUP BY GROUPING SETS ((), (event_type))) SELECT event_type, n, hits, round(hits / CAST(n AS DOUBLE), 6) AS rate, round(hits / CAST(n AS DOUBLE) - (SELECT MAX(hits / CAST(n AS DOUBLE)) FROM o WHERE event_type IS NULL), 6) AS over_all FROM o")
def e12(spark, d):
    """Hit rates by type and over all, with the distance to the rate over all."""
    e = fixture(spark, d, "fx_event").filter("status = 'ACTIVE'")
    o = e.groupingSets([[], ["event_type"]], "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("hits")).withColumn("r", F.col("hits") / F.col("n"))
    base = F.broadcast(o.filter("event_type is null").select(F.col("r").alias("base")))  # one row
    return o.crossJoin(base).select("event_type", "n", "hits", F.round("r", 6).alias("rate"), F.round(F.col("r") - F.col("base"), 6).alias("over_all"))


@query("E_13_related", "SELECT other, rel, round(strength, 6) AS strength, n, name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY other ORDER BY strength DESC, n DESC, rel) AS rn FROM (SELECT dst AS other, rel, strength, n FROM fx_edge WHERE src = 3 UNION ALL SELECT src, rel, strength, n FROM fx_edge WHERE dst = 3 AND rel <> 'SUPPLY')) JOIN fx_company ON company_id = other WHERE rn = 1")
def e13(spark, d):
    """Relations from one company's side, the best row of each counterpart; a directed relation only from its source."""
    e = S.both_ways(fixture(spark, d, "fx_edge"), "src", "dst", F.col("rel") == "SUPPLY").filter("me = 3")
    best = S.top_per(e, ["other"], [F.desc("strength"), F.desc("n"), F.col("rel")])
    return best.join(fixture(spark, d, "fx_company").select(F.col("company_id").alias("other"), "name"), "other").select("other", "rel", F.round("strength", 6).alias("strength"), "n", "name")


@query("E_14_metric_history", "WITH w AS (SELECT * FROM (VALUES ('30D', TIMESTAMP '2001-01-01' - INTERVAL 30 DAY), ('1Y', TIMESTAMP '2000-01-01'), ('10Y', TIMESTAMP '1991-01-01')) v(window_type, start_at)) SELECT window_type, source_company_id AS company_id, COUNT(*) AS evidence, MAX(published_at) AS latest, round(AVG(CAST(score AS DOUBLE)), 4) AS mean FROM fx_evidence JOIN w ON published_at >= start_at AND published_at < TIMESTAMP '2001-01-01' GROUP BY 1, 2")
def e14(spark, d):
    """Every company's figures for each window up to the as-of time."""
    w = F.broadcast(scores.window_table(spark, "2001-01-01"))  # three windows
    e = fixture(spark, d, "fx_evidence").join(w, scores.in_window("published_at"))
    return e.groupBy("window_type", F.col("source_company_id").alias("company_id")).agg(F.count(F.lit(1)).alias("evidence"), F.max("published_at").alias("latest"), F.round(F.avg(F.col("score").cast("double")), 4).alias("mean"))


@query("E_15_stock_prices", "WITH a AS (SELECT MAX(trading_date) AS a FROM fx_price WHERE company_id = 3) SELECT trading_date, close_price, low_price, volume FROM fx_price, a WHERE company_id = 3 AND trading_date BETWEEN a - 90 AND a")
def e15(spark, d):
    """One company's bars of the 90 days up to its own latest."""
    p = fixture(spark, d, "fx_price").filter("company_id = 3")
    a = F.broadcast(p.agg(F.max("trading_date").alias("a")))  # one row
    return p.crossJoin(a).filter(F.col("trading_date") >= F.date_sub("a", 90)).select("trading_date", "close_price", "low_price", "volume")


@query("E_16_event_chart", f"WITH {_CAL}, e AS (SELECT company_id, MAX(idx) - 40 AS idx FROM sr GROUP BY 1) SELECT e.company_id, r.idx - e.idx AS offset_days, r.trading_date, round(r.close / NULLIF(b.close, 0) - 1, 6) AS company, round(r.base / NULLIF(b.base, 0) - 1, 6) AS market FROM e JOIN sr b ON b.company_id = e.company_id AND b.idx = e.idx - 1 JOIN sr r ON r.company_id = e.company_id AND r.idx BETWEEN e.idx - 5 AND e.idx + 20")
def e16(spark, d):
    """A company and its market around an event's day, both against the close of the day before."""
    s = _series(spark, d)
    e = s.groupBy("company_id").agg((F.max("idx") - 40).alias("at"))
    b = s.select("company_id", (F.col("idx") + 1).alias("at"), F.col("close").alias("c0"), F.col("base").alias("b0"))
    rows = s.join(e, "company_id").filter((F.col("idx") >= F.col("at") - 5) & (F.col("idx") <= F.col("at") + 20)).join(b, ["company_id", "at"])
    return rows.select("company_id", (F.col("idx") - F.col("at")).alias("offset_days"), "trading_date", F.round(F.try_divide("close", "c0") - 1, 6).alias("company"), F.round(F.try_divide("base", "b0") - 1, 6).alias("market"))


@query("E_17_watch_page", "WITH w AS (SELECT user_id, company_id, MIN(dateline) AS since FROM fx_event GROUP BY 1, 2) SELECT w.user_id, w.company_id, c.name, w.since, p.close FROM w JOIN fx_company c USING (company_id) LEFT JOIN (SELECT company_id, max_by(close_price, trading_date) AS close FROM fx_price GROUP BY 1) p USING (company_id) WHERE (w.since, w.user_id) < (TIMESTAMP '2024-01-20', 1000000) ORDER BY w.since DESC, w.user_id DESC, w.company_id LIMIT 31")
def e17(spark, d):
    """Watched companies behind a cursor, with name and last close."""
    w = fixture(spark, d, "fx_event").groupBy("user_id", "company_id").agg(F.min("dateline").alias("since"))
    cursor = S.after([("since", F.lit("2024-01-20").cast("timestamp_ntz"), True), ("user_id", F.lit(1_000_000), True)])
    p = S.page(w.filter(cursor).join(fixture(spark, d, "fx_company").select("company_id", "name"), "company_id"), [F.desc("since"), F.desc("user_id"), F.col("company_id")], 30)
    close = fixture(spark, d, "fx_price").groupBy("company_id").agg(F.max_by("close_price", "trading_date").alias("close"))
    return p.join(close, "company_id", "left").select("user_id", "company_id", "name", "since", "close")


QUERIES = {k: f for k, (f, _) in _F.items()}
SQL = {k: with_views(s) for k, (_, s) in _F.items() if s}
SQL["E_04_company_graph"] = SQL["E_04_company_graph"].replace("WITH ", "WITH RECURSIVE ", 1)
