"""Scalar functions (F-..) and text operators (X-01 ...) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.functions import text as T
from loomlake.operators import mentions as M
from loomlake.plans.fixtures import fixture, with_views
from loomlake.sources.tables import table

_F: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _F[name] = (f, sql)
        return f

    return add


def _docs(spark, d):
    return fixture(spark, d, "fx_document").filter("body is not null")


@query("F_04_feed_sentences", None)
def f04(spark, d):
    return _docs(spark, d).select("document_id", T.cut_sentences(F.col("body"), 200).alias("sentences"))


@query("F_05_fragments")
def f05(spark, d):
    """All fragments of all whole texts."""
    f = _docs(spark, d).select("document_id", T.fragments(F.col("body")).alias("fragments"))
    return f.select("document_id", F.size("fragments").cast("long").alias("n"), "fragments")


@query("F_06_boilerplate")
def f06(spark, d):
    """All texts, cut before their boilerplate."""
    x = _docs(spark, d).select("document_id", F.length("body").alias("n"), T.trim_boilerplate(F.col("body")).alias("kept"))
    return x.select("document_id", F.length("kept").cast("long").alias("cut"), (F.length("kept") < F.col("n")).alias("trimmed"), "kept")


@query("F_07_canonical_url", "SELECT event_id, concat('https://ex.example/p/', event_id, '?a=', company_id) AS url FROM fx_event")
def f07(spark, d):
    raw = F.concat(F.lit(" HTTPS://EX.Example:443/p/"), F.col("event_id").cast("string"), F.lit("/?a="), F.col("company_id").cast("string"), F.lit("#top "))
    return fixture(spark, d, "fx_event").select("event_id", T.canonical_url(raw).alias("url"))


@query("F_08_identity", "SELECT event_id, sha256(concat_ws(chr(10), event_type, CAST(company_id AS VARCHAR))) AS id FROM fx_event")
def f08(spark, d):
    return fixture(spark, d, "fx_event").select("event_id", T.identity_hash(F.col("event_type"), F.col("company_id").cast("string")).alias("id"))


@query("F_11_normal_name", "SELECT company_id, regexp_replace(lower(name), '[#\\s]+', '', 'g') AS key FROM fx_company")
def f11(spark, d):
    return fixture(spark, d, "fx_company").select("company_id", T.normal_name(F.col("name")).alias("key"))


@query("F_17_end_of_day", "SELECT trading_date, company_id, CAST(trading_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS at FROM fx_price")
def f17(spark, d):
    return fixture(spark, d, "fx_price").select("trading_date", "company_id", (F.date_add("trading_date", 1).cast("timestamp_ntz") - F.expr("interval 1 microsecond")).alias("at"))


@query("F_18_format", "SELECT event_id, strftime(dateline, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM fx_event")
def f18(spark, d):
    return fixture(spark, d, "fx_event").select("event_id", F.date_format("dateline", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"))


@query("F_19_seoul_day", "SELECT event_id, CAST(dateline + INTERVAL 9 HOUR AS DATE) AS day FROM fx_event")
def f19(spark, d):
    return fixture(spark, d, "fx_event").select("event_id", F.to_date(F.from_utc_timestamp(F.col("dateline").cast("timestamp"), "Asia/Seoul")).alias("day"))


@query("F_20_half_up", "SELECT company_id, trading_date, CAST(round(close_price, 2) AS DECIMAL(20,2)) AS close FROM fx_price")
def f20(spark, d):
    return fixture(spark, d, "fx_price").select("company_id", "trading_date", F.round("close_price", 2).cast("decimal(20,2)").alias("close"))


@query("F_21_number", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN -CAST(event_id AS DOUBLE) ELSE CAST(event_id AS DOUBLE) END AS n FROM fx_event")
def f21(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, "-").when(e % 5 == 1, F.concat(F.lit("△"), e.cast("string"))).otherwise(F.format_number(e, 0))
    return fixture(spark, d, "fx_event").select("event_id", T.number(raw).alias("n"))


@query("F_22_return", "SELECT company_id, trading_date, round(CAST(close_price AS DOUBLE) / NULLIF(CAST(low_price AS DOUBLE), 0) - 1, 8) AS ret FROM fx_price")
def f22(spark, d):
    return fixture(spark, d, "fx_price").select("company_id", "trading_date", F.round(F.try_divide(F.col("close_price").cast("double"), F.col("low_price").cast("double")) - 1, 8).alias("ret"))


@query("F_25_multiples", "SELECT company_id, trading_date, CASE WHEN volume > 1 THEN round(CAST(close_price AS DOUBLE) / volume, 4) END AS per FROM fx_price")
def f25(spark, d):
    return fixture(spark, d, "fx_price").select("company_id", "trading_date", F.when(F.col("volume") > 1, F.round(F.col("close_price").cast("double") / F.col("volume"), 4)).alias("per"))


@query("F_26_trailing", "WITH y AS (SELECT o_custkey % 20 AS c, year(o_orderdate) AS y, round(SUM(o_totalprice), 2) AS full_year, round(SUM(o_totalprice) FILTER (month(o_orderdate) <= 6), 2) AS half FROM orders GROUP BY ALL) SELECT a.c, a.y, round(p.full_year + a.half - p.half, 2) AS trailing FROM y a JOIN y p ON p.c = a.c AND p.y = a.y - 1")
def f26(spark, d):
    """Last year, plus this year's first half, less last year's first half."""
    o = table(spark, d, "orders")
    y = o.groupBy((F.col("o_custkey") % 20).alias("c"), F.year("o_orderdate").cast("long").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("full_year"), F.round(F.sum(F.when(F.month("o_orderdate") <= 6, F.col("o_totalprice"))), 2).alias("half"))
    p = y.select("c", (F.col("y") + 1).alias("y"), F.col("full_year").alias("pf"), F.col("half").alias("ph"))
    return y.join(p, ["c", "y"]).select("c", "y", F.round(F.col("pf") + F.col("half") - F.col("ph"), 2).alias("trailing"))


@query("F_27_relevance", "WITH m AS (SELECT document_id, company_id, COUNT(DISTINCT segment) AS n FROM fx_segment GROUP BY ALL), c AS (SELECT document_id, COUNT(*) AS k FROM m GROUP BY 1) SELECT document_id, company_id, round(LEAST(1, 0.25 + 0.55 * (LEAST(4, n) - 1) / 3.0 + 0.2 / k), 6) AS relevance, round(LEAST(1, 0.4 + 0.15 * n), 6) AS confidence FROM m JOIN c USING (document_id)")
def f27(spark, d):
    """Sentences of a company in a document, companies of the document."""
    m = fixture(spark, d, "fx_segment").groupBy("document_id", "company_id").agg(F.count_distinct("segment").alias("n"))
    c = m.groupBy("document_id").agg(F.count(F.lit(1)).alias("k"))
    return m.join(c, "document_id").select("document_id", "company_id", T.relevance(F.col("n"), F.col("k")).alias("relevance"), T.sentence_confidence(F.col("n")).alias("confidence"))


@query("F_28_path_sign", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS sign FROM fx_event")
def f28(spark, d):
    e = F.col("event_id")
    path = F.array(F.when(e % 2 == 0, 1).otherwise(-1), F.when(e % 3 == 0, -1).otherwise(1))
    return fixture(spark, d, "fx_event").select("event_id", F.aggregate(path, F.lit(1), lambda a, s: a * s).alias("sign"))


@query("F_29_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f29(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("F_30_entity", "SELECT p_partkey, regexp_extract(concat(p_name, ':', p_brand), '^(.*):([^:]*)$', 1) AS name, regexp_extract(concat(p_name, ':', p_brand), '^(.*):([^:]*)$', 2) AS kind FROM part")
def f30(spark, d):
    t = F.concat_ws(":", "p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(t, "^(.*):([^:]*)$", 1).alias("name"), F.regexp_extract(t, "^(.*):([^:]*)$", 2).alias("kind"))


@query("F_31_blend", "WITH e AS (SELECT event_id, value / 3 AS s, CASE WHEN event_id % 4 IN (0, 1) THEN value END AS n, CASE WHEN event_id % 4 IN (0, 2) THEN value / 2 END AS f FROM fx_event) SELECT event_id, CASE WHEN n IS NULL AND f IS NULL THEN NULL WHEN n IS NULL THEN floor(0.8 * f * 10 + 0.5) / 10 WHEN f IS NULL THEN floor(n * 10 + 0.5) / 10 ELSE floor((0.6 * n + 0.4 * f) * 10 + 0.5) / 10 END AS shown, CASE WHEN n IS NULL AND f IS NULL THEN NULL WHEN n IS NULL THEN floor(f * 10 + 0.5) / 10 WHEN f IS NULL THEN floor(n * 10 + 0.5) / 10 ELSE s END AS usual FROM e")
def f31(spark, d):
    e, v = F.col("event_id"), F.col("value")
    news, filed = F.when(e % 4 < 2, v), F.when(e % 2 == 0, v / 2)
    return fixture(spark, d, "fx_event").select("event_id", T.blend(v / 3, news, filed, 0.6).alias("shown"), T.blend(v / 3, news, filed, 0.5).alias("usual"))


@query("F_32_position", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'SELF' WHEN 1 THEN 'SUPPLIER' ELSE 'CUSTOMER' END AS position FROM fx_event")
def f32(spark, d):
    e = F.col("event_id")
    path = F.when(e % 3 == 0, F.array().cast("array<string>")).when(e % 3 == 1, F.array(F.lit("PARTNER"), F.lit("SUPPLY_IN"))).otherwise(F.array(F.lit("SUPPLY_OUT")))
    last = F.when(F.size(path) > 0, F.element_at(path, -1))
    return fixture(spark, d, "fx_event").select("event_id", F.when(last.isNull(), "SELF").when(last == "SUPPLY_IN", "SUPPLIER").otherwise("CUSTOMER").alias("position"))


_NT = ", ".join(" + ".join(f"3 * COALESCE(CAST(regexp_matches(title, '{p}') AS INT), 0) + COALESCE(CAST(regexp_matches(body, '{p}') AS INT), 0)" for p in ps) + f" AS p{k}" for k, (_, ps) in enumerate(T.NEWS_TYPES))
_NP = [f"p{k}" for k in range(len(T.NEWS_TYPES))]
_NK = " ".join(f"WHEN p{k} = top THEN '{n}'" for k, (n, _) in enumerate(T.NEWS_TYPES))


@query("F_33_news_type", f"SELECT document_id, CASE WHEN top < 2 THEN 'OTHER' {_NK} END AS kind, CASE WHEN top < 2 THEN 0 ELSE round(top / CAST({' + '.join(_NP)} AS DOUBLE), 6) END AS confidence FROM (SELECT *, GREATEST({', '.join(_NP)}) AS top FROM (SELECT document_id, {_NT} FROM fx_document WHERE body IS NOT NULL))")
def f33(spark, d):
    return _docs(spark, d).select("document_id", T.news_type(F.col("title"), F.col("body")).alias("t")).select("document_id", "t.kind", "t.confidence")


@query("F_34_argmax", "SELECT event_id, CASE WHEN a = b AND a >= c THEN NULL WHEN a = c AND a >= b THEN NULL WHEN b = c AND b >= a THEN NULL WHEN a = GREATEST(a, b, c) THEN 'NEGATIVE' WHEN b = GREATEST(b, c) THEN 'NEUTRAL' ELSE 'POSITIVE' END AS label FROM (SELECT event_id, CAST(event_id % 3 AS DOUBLE) AS a, CAST(event_id % 5 AS DOUBLE) AS b, CAST(event_id % 7 AS DOUBLE) AS c FROM fx_event)")
def f34(spark, d):
    p = F.array(*[(F.col("event_id") % k).cast("double") for k in (3, 5, 7)])
    return fixture(spark, d, "fx_event").select("event_id", T.argmax_label(p, ("NEGATIVE", "NEUTRAL", "POSITIVE")).alias("label"))


_F36 = """WITH e AS (SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN dateline - INTERVAL 8766 DAY ELSE dateline END) + INTERVAL 9 HOUR AS t FROM fx_event), l AS (SELECT MAX(trading_date) AS last FROM fx_index WHERE idx % 3 <> 0)
SELECT event_id, hour(t) * 60 + minute(t) >= 930 OR CASE WHEN CAST(t AS DATE) <= last THEN NOT EXISTS (SELECT 1 FROM fx_index i WHERE i.trading_date = CAST(t AS DATE) AND i.idx % 3 <> 0) ELSE dayofweek(t) IN (0, 6) END AS after_close FROM e, l"""


@query("F_36_after_close", _F36)
def f36(spark, d):
    """Half of the events lie within the calendar, of which every third day is taken out."""
    from loomlake.operators.timeseries import after_close

    at = F.when(F.col("event_id") % 2 == 0, F.col("dateline") - F.expr("interval 8766 day")).otherwise(F.col("dateline"))
    return after_close(fixture(spark, d, "fx_event").withColumn("at", at), "at", fixture(spark, d, "fx_index").filter("idx % 3 <> 0")).select("event_id", "after_close")


def _dictionary(spark, d):
    """Names and curated aliases; first names that companies share as groups; sectors; preferred shares, which hide the company's name."""
    c = table(spark, d, "companies")
    kinds = [
        (c, F.col("name_official"), "name", F.col("ticker")), (c, F.col("name_en"), "name", F.col("ticker")), (table(spark, d, "company_alias"), F.col("alias_name"), "name", F.col("ticker")),
        (c, F.regexp_extract("name_en", r"^(\w{3,})", 1), "group", F.col("ticker")), (c, F.col("sector"), "industry", F.col("sector")), (c, F.concat("name_official", F.lit("우")), "block", F.col("ticker")),
    ]
    rows = [df.select(a.alias("alias"), F.lit(k).alias("kind"), key.alias("key"), F.lit(None).cast("string").alias("holder")) for df, a, k, key in kinds]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.filter("alias is not null and alias <> ''")


def _documents(spark, d):
    """A document's first line is its title."""
    x = _docs(spark, d)
    return x.select("document_id", F.regexp_extract("body", r"^([^\n]*)", 1).alias("title"), F.regexp_replace("body", r"^[^\n]*", "").alias("rest"), "body")


def _batch(spark, d):
    codes = table(spark, d, "companies").select(F.col("ticker").alias("code"), F.col("ticker").alias("key"))
    return M.match_documents(_documents(spark, d), "document_id", "title", "rest", _dictionary(spark, d), codes)


def _matched(spark, d):
    """Companies in documents by official and English name."""
    c = table(spark, d, "companies")
    names = c.select(F.col("name_official").alias("alias"), "ticker").union(c.select("name_en", "ticker"))
    return M.mentions(_docs(spark, d), "document_id", "body", names, "alias", "ticker")


@query("X_01_mentions", None)
def x01(spark, d):
    """Every mention with its place, how it was found and how sure it is."""
    return _batch(spark, d).select("id", F.inline("mentions"))


@query("X_01_batch", None)
def x01_batch(spark, d):
    """The tagged batch: one pass over the documents, four tables, counted from what was stored."""
    from loomlake.session import shared_path

    tables = M.mention_batch(_batch(spark, d), shared_path(spark, "mention-batch"))
    out = None
    for name, df in tables.items():
        n = df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("documents"))
        out = n if out is None else out.unionByName(n)
    return out


@query("X_04_salience", None)
def x04(spark, d):
    """Greatest salience of a company in a document: 1 in its title, .8 in its text; .6 for the company it is filed under, as an organisation named beside it."""
    s = _batch(spark, d).select("id", F.inline("mentions")).filter("confidence >= 0.7").select("id", "key", F.when(F.col("part") == "title", 1.0).otherwise(0.8).alias("s"), "part")
    filed = table(spark, d, "documents").filter("text is not null and stock_code is not null").select(F.col("doc_id").alias("id"), F.col("stock_code").alias("key"), F.lit(0.6).alias("s"), F.lit("orgs").alias("part"))
    return s.unionByName(filed).groupBy("id", "key").agg(F.max("s").alias("salience"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("part")), "+").alias("sources"))


@query("X_06_pair_candidates", None)
def x06(spark, d):
    return M.pair_candidates(_matched(spark, d)).select("id", "sentence_order", "a", "b", "companies")


@query("X_07_evidence_sentences", None)
def x07(spark, d):
    return M.evidence_sentences(_matched(spark, d))


@query("X_09_classified", None)
def x09(spark, d):
    return M.classified(M.pair_candidates(_matched(spark, d))).select("id", "sentence_order", "src", "dst", "relation", "confidence", "pattern", "reject")


QUERIES = {k: f for k, (f, _) in _F.items()}
SQL = {k: with_views(s) for k, (_, s) in _F.items() if s}
