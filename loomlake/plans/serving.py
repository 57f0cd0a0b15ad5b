"""Serving queries: projections, joins, order, sets, windows and quote analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlake.operators import serving as S
from loomlake.plans.fixtures import fixture, with_views

_F: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _F[name] = (f, sql)
        return f

    return add


def _ts(x: str):
    return F.lit(x).cast("timestamp_ntz")


@query("P_01_nested_fields", "SELECT event_id, event_type AS kind, round(value, 6) AS amount FROM fx_event")
def p01(spark, d):
    s = fixture(spark, d, "fx_event").select("event_id", F.struct("event_type", "value").alias("s"))
    return s.select("event_id", F.col("s.event_type").alias("kind"), F.round(F.col("s.value"), 6).alias("amount"))


@query("P_02_eligible", "SELECT company_id, name FROM fx_company WHERE status = 'ACTIVE' AND market_cap > 0")
def p02(spark, d):
    return fixture(spark, d, "fx_company").filter((F.col("status") == "ACTIVE") & (F.col("market_cap") > 0)).select("company_id", "name")


@query("P_03_threshold", "SELECT document_id, source_company_id, target_company_id, relationship_type FROM fx_evidence WHERE confidence >= 0.9")
def p03(spark, d):
    return fixture(spark, d, "fx_evidence").filter(F.col("confidence") >= 0.9).select("document_id", "source_company_id", "target_company_id", "relationship_type")


@query("P_04_missing_columns", "SELECT company_id, CAST(NULL AS VARCHAR) AS isin, name FROM fx_company")
def p04(spark, d):
    c = fixture(spark, d, "fx_company")
    wanted = {"company_id": "bigint", "isin": "string", "name": "string"}
    return c.select(*[F.col(k) if k in c.columns else F.lit(None).cast(t).alias(k) for k, t in wanted.items()])


@query("P_06_optional", "SELECT event_id FROM fx_event WHERE company_id = 3 AND status = 'ACTIVE'")
def p06(spark, d):
    return S.optional(fixture(spark, d, "fx_event"), company_id=3, status="ACTIVE", event_type=None).select("event_id")


@query("P_07_like", "SELECT company_id, name FROM fx_company WHERE contains(lower(name), '#00000001')")
def p07(spark, d):
    return fixture(spark, d, "fx_company").filter(S.contains_ignoring_case("name", "#00000001")).select("company_id", "name")


_RANK = """WITH a AS (SELECT company_id, list(lower(alias)) AS al FROM fx_alias GROUP BY 1) SELECT company_id, rank FROM (SELECT c.company_id, CASE WHEN CAST(c.company_id AS VARCHAR) = 'p' THEN 0 WHEN lower(name) = 'p' OR list_contains(al, 'p') THEN 1
 WHEN starts_with(lower(name), 'p') OR len(list_filter(al, lambda x: starts_with(x, 'p'))) > 0 THEN 2 WHEN contains(lower(name), 'p') OR len(list_filter(al, lambda x: contains(x, 'p'))) > 0 THEN 3 END AS rank FROM fx_company c LEFT JOIN a USING (company_id)) WHERE rank IS NOT NULL"""


@query("P_08_search_rank", _RANK)
def p08(spark, d):
    a = fixture(spark, d, "fx_alias").groupBy("company_id").agg(F.collect_list("alias").alias("al"))
    c = fixture(spark, d, "fx_company").join(a, "company_id", "left")
    return c.select("company_id", S.search_rank("company_id", "name", "al", "p").alias("rank")).filter("rank is not null")


@query("P_09_keyset", "SELECT event_id, dateline FROM fx_event WHERE (dateline, event_id) < (TIMESTAMP '2024-01-15', 5000) ORDER BY dateline DESC, event_id DESC LIMIT 21")
def p09(spark, d):
    e = fixture(spark, d, "fx_event").filter(S.after([("dateline", _ts("2024-01-15"), True), ("event_id", F.lit(5000), True)]))
    return S.page(e, [F.desc("dateline"), F.desc("event_id")], 20).select("event_id", "dateline")


@query("P_10_keyset_mixed", "SELECT market, name, company_id FROM fx_company WHERE market > 'ASIA' OR (market = 'ASIA' AND name < 'Supplier#000000050') OR (market = 'ASIA' AND name = 'Supplier#000000050' AND company_id > 10) ORDER BY market, name DESC, company_id LIMIT 11")
def p10(spark, d):
    c = fixture(spark, d, "fx_company").filter(S.after([("market", F.lit("ASIA"), False), ("name", F.lit("Supplier#000000050"), True), ("company_id", F.lit(10), False)]))
    return S.page(c, [F.asc("market"), F.desc("name"), F.asc("company_id")], 10).select("market", "name", "company_id")


@query("P_11_keyset_comments", "SELECT event_id, user_id, dateline FROM fx_event WHERE user_id = 7 AND status = 'ACTIVE' AND (dateline < TIMESTAMP '2024-01-20' OR (dateline = TIMESTAMP '2024-01-20' AND event_id < 9000)) ORDER BY dateline DESC, event_id DESC LIMIT 6")
def p11(spark, d):
    e = S.optional(fixture(spark, d, "fx_event"), user_id=7, status="ACTIVE").filter(S.after([("dateline", _ts("2024-01-20"), True), ("event_id", F.lit(9000), True)]))
    return S.page(e, [F.desc("dateline"), F.desc("event_id")], 5).select("event_id", "user_id", "dateline")


@query("P_12_half_open", "SELECT event_id FROM fx_event WHERE dateline >= TIMESTAMP '2024-01-10' AND dateline < TIMESTAMP '2024-01-11'")
def p12(spark, d):
    return fixture(spark, d, "fx_event").filter((F.col("dateline") >= _ts("2024-01-10")) & (F.col("dateline") < _ts("2024-01-11"))).select("event_id")


@query("P_13_sanitise", r"SELECT document_id, trim(regexp_replace(title, '\d+(\.\d+)?%', '', 'g')) AS title FROM fx_document WHERE title IS NOT NULL")
def p13(spark, d):
    return fixture(spark, d, "fx_document").filter("title is not null").select("document_id", F.trim(F.regexp_replace("title", r"\d+(\.\d+)?%", "")).alias("title"))


@query("P_14_expand_verdicts", "SELECT document_id, company_id, label FROM (SELECT document_id, unnest([source_company_id, target_company_id]) AS company_id, impact_direction AS label FROM fx_evidence) WHERE label IS NOT NULL")
def p14(spark, d):
    e = fixture(spark, d, "fx_evidence").select("document_id", F.array(*[F.struct(F.col(c).alias("company_id"), F.col("impact_direction").alias("label")) for c in ("source_company_id", "target_company_id")]).alias("v"))
    return e.select("document_id", F.inline("v")).filter("label is not null")


@query("P_15_category_prefix", "SELECT p_partkey, p_type FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda x: x = 'STEEL' OR starts_with(x, 'PRO'))) > 0")
def p15(spark, d):
    from loomlake.sources.tables import table

    return table(spark, d, "part").filter(F.exists(F.split("p_type", " "), lambda x: (x == "STEEL") | x.startswith("PRO"))).select("p_partkey", "p_type")


@query("P_16_prescreen", "SELECT document_id, company_id FROM fx_mention WHERE document_id IN (SELECT document_id FROM fx_mention GROUP BY 1 HAVING COUNT(*) BETWEEN 2 AND 9)")
def p16(spark, d):
    m = fixture(spark, d, "fx_mention")
    return m.join(m.groupBy("document_id").agg(F.count(F.lit(1)).alias("k")).filter("k between 2 and 9").select("document_id"), "document_id", "left_semi")


_OHLC = "CASE WHEN close_price IS NULL OR low_price IS NULL THEN 'MISSING' WHEN low_price < 0 THEN 'NEGATIVE' WHEN low_price > close_price THEN 'INVERTED' WHEN volume = 1 THEN 'SINGLE' ELSE 'VALID' END"


@query("P_17_bar_quality", f"SELECT quality, COUNT(*) AS bars FROM (SELECT {_OHLC} AS quality FROM fx_price) GROUP BY 1")
def p17(spark, d):
    return fixture(spark, d, "fx_price").select(F.expr(_OHLC).alias("quality")).groupBy("quality").agg(F.count(F.lit(1)).alias("bars"))


@query("P_18_valid_bar", "SELECT company_id, trading_date FROM fx_price WHERE close_price IS NOT NULL AND low_price >= 0 AND close_price >= low_price")
def p18(spark, d):
    return fixture(spark, d, "fx_price").filter("close_price is not null and low_price >= 0 and close_price >= low_price").select("company_id", "trading_date")


@query("P_19_in_window", "SELECT event_id FROM fx_event WHERE dateline > TIMESTAMP '2024-01-08' AND dateline <= TIMESTAMP '2024-01-15'")
def p19(spark, d):
    """The variant (t - d, t] of the look-back."""
    return fixture(spark, d, "fx_event").filter((F.col("dateline") > _ts("2024-01-08")) & (F.col("dateline") <= _ts("2024-01-15"))).select("event_id")


@query("P_20_release_time", "SELECT event_id, CASE WHEN abs(datediff('day', CAST(dateline AS DATE), DATE '2024-01-15')) <= 1 THEN dateline ELSE TIMESTAMP '2024-01-15' END AS released FROM fx_event")
def p20(spark, d):
    near = F.abs(F.datediff(F.to_date("dateline"), F.lit("2024-01-15").cast("date"))) <= 1
    return fixture(spark, d, "fx_event").select("event_id", F.coalesce(F.when(near, F.col("dateline")), _ts("2024-01-15")).alias("released"))


@query("P_21_visible_edges", "SELECT company_id FROM fx_company WHERE company_id NOT IN (SELECT src FROM fx_edge WHERE strength >= 1 UNION ALL SELECT dst FROM fx_edge WHERE strength >= 1)")
def p21(spark, d):
    """Companies without a shown edge."""
    e = fixture(spark, d, "fx_edge").filter("strength >= 1")
    shown = e.select(F.col("src").alias("company_id")).union(e.select("dst"))
    return fixture(spark, d, "fx_company").join(shown, "company_id", "left_anti").select("company_id")


@query("J_01_spans_news", "SELECT document_id, COUNT(*) AS k FROM fx_mention JOIN (SELECT DISTINCT document_id FROM fx_evidence) USING (document_id) GROUP BY 1")
def j01(spark, d):
    news = fixture(spark, d, "fx_evidence").select("document_id").distinct()
    return fixture(spark, d, "fx_mention").join(news, "document_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("k"))


@query("J_02_id_list", "SELECT document_id, title FROM fx_document WHERE document_id IN (3, 5, 8, 13)")
def j02(spark, d):
    ids = spark.createDataFrame([(3,), (5,), (8,), (13,)], "document_id bigint")
    return fixture(spark, d, "fx_document").join(F.broadcast(ids), "document_id").select("document_id", "title")  # the list is the request's own


@query("J_03_full_outer", "SELECT COALESCE(a.document_id, b.document_id) AS document_id, a.n AS news, b.n AS filed FROM (SELECT document_id, COUNT(*) AS n FROM fx_evidence WHERE impact_direction = 'POSITIVE' GROUP BY 1) a FULL JOIN (SELECT document_id, COUNT(*) AS n FROM fx_evidence WHERE impact_direction = 'NEGATIVE' GROUP BY 1) b ON a.document_id = b.document_id")
def j03(spark, d):
    e = fixture(spark, d, "fx_evidence")
    a, b = (e.filter(F.col("impact_direction") == x).groupBy("document_id").agg(F.count(F.lit(1)).alias(n)) for x, n in (("POSITIVE", "news"), ("NEGATIVE", "filed")))
    return a.join(b, "document_id", "outer")


@query("J_04_anti", "SELECT DISTINCT document_id FROM fx_mention WHERE document_id NOT IN (SELECT document_id FROM fx_evidence WHERE impact_direction IS NOT NULL)")
def j04(spark, d):
    return fixture(spark, d, "fx_mention").select("document_id").distinct().join(fixture(spark, d, "fx_evidence").filter("impact_direction is not null"), "document_id", "left_anti")


@query("J_08_exists", "SELECT event_id FROM fx_event e WHERE EXISTS (SELECT 1 FROM fx_impact i WHERE i.event_id = e.event_id AND i.hop = 0 AND i.status = 'OK')")
def j08(spark, d):
    return fixture(spark, d, "fx_event").join(fixture(spark, d, "fx_impact").filter("hop = 0 and status = 'OK'"), "event_id", "left_semi").select("event_id")


@query("J_09_not_exists", "SELECT event_id FROM fx_event e WHERE NOT EXISTS (SELECT 1 FROM fx_impact i WHERE i.event_id = e.event_id AND i.status = 'HOLD')")
def j09(spark, d):
    return fixture(spark, d, "fx_event").join(fixture(spark, d, "fx_impact").filter("status = 'HOLD'"), "event_id", "left_anti").select("event_id")


@query("J_10_mark", "SELECT document_id, document_id IN (SELECT event_id FROM fx_event WHERE user_id = 7) AS scrapped FROM fx_document")
def j10(spark, d):
    mine = fixture(spark, d, "fx_event").filter("user_id = 7").select(F.col("event_id").alias("document_id"), F.lit(True).alias("m")).distinct()
    return fixture(spark, d, "fx_document").join(mine, "document_id", "left").select("document_id", F.col("m").isNotNull().alias("scrapped"))


@query("J_11_lateral_top1", "SELECT company_id, name, event_type FROM fx_company c LEFT JOIN (SELECT company_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY value DESC, event_id) AS rn FROM fx_event) WHERE rn = 1) USING (company_id)")
def j11(spark, d):
    best = S.top_per(fixture(spark, d, "fx_event"), ["company_id"], [F.desc("value"), F.asc("event_id")]).select("company_id", "event_type")
    return fixture(spark, d, "fx_company").join(best, "company_id", "left").select("company_id", "name", "event_type")


@query("J_14_unordered", "SELECT COUNT(*) AS matches FROM (SELECT DISTINCT LEAST(source_company_id, target_company_id) AS lo, GREATEST(source_company_id, target_company_id) AS hi FROM fx_evidence) JOIN (SELECT DISTINCT LEAST(src, dst) AS lo, GREATEST(src, dst) AS hi FROM fx_edge) USING (lo, hi)")
def j14(spark, d):
    def pairs(df, a, b):
        return df.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()

    return pairs(fixture(spark, d, "fx_evidence"), "source_company_id", "target_company_id").join(pairs(fixture(spark, d, "fx_edge"), "src", "dst"), ["lo", "hi"]).agg(F.count(F.lit(1)).alias("matches"))


@query("J_15_symmetric", "SELECT src AS me, dst AS other, rel, n FROM fx_edge WHERE src = 3 UNION ALL SELECT dst, src, rel, n FROM fx_edge WHERE dst = 3 AND rel <> 'SUPPLY'")
def j15(spark, d):
    return S.both_ways(fixture(spark, d, "fx_edge"), "src", "dst", F.col("rel") == "SUPPLY").filter("me = 3").select("me", "other", "rel", "n")


@query("J_16_edges_active", "SELECT e.src, e.dst, e.rel, a.name AS src_name, b.name AS dst_name FROM fx_edge e JOIN fx_company a ON a.company_id = e.src AND a.status = 'ACTIVE' JOIN fx_company b ON b.company_id = e.dst AND b.status = 'ACTIVE'")
def j16(spark, d):
    c = fixture(spark, d, "fx_company").filter("status = 'ACTIVE'").select("company_id", "name")
    e = fixture(spark, d, "fx_edge")
    return e.join(c.toDF("src", "src_name"), "src").join(c.toDF("dst", "dst_name"), "dst").select("src", "dst", "rel", "src_name", "dst_name")


@query("J_17_relations_per_company", "SELECT company_id, COUNT(*) AS relations FROM (SELECT src AS company_id FROM fx_edge UNION ALL SELECT dst FROM fx_edge) GROUP BY 1")
def j17(spark, d):
    return S.both_ways(fixture(spark, d, "fx_edge"), "src", "dst").groupBy(F.col("me").alias("company_id")).agg(F.count(F.lit(1)).alias("relations"))


@query("J_18_resolve_guard", "SELECT COUNT(*) AS asked, COUNT(c.company_id) AS resolved FROM (SELECT DISTINCT src AS company_id FROM fx_edge) e LEFT JOIN fx_company c USING (company_id)")
def j18(spark, d):
    asked = fixture(spark, d, "fx_edge").select(F.col("src").alias("company_id")).distinct()
    c = fixture(spark, d, "fx_company").select("company_id", F.lit(1).alias("hit"))
    return asked.join(c, "company_id", "left").agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("resolved"))


@query("J_19_composite_key", "SELECT company_id, name FROM fx_company WHERE concat(market, ':', CAST(company_id AS VARCHAR)) IN ('ASIA:1', 'ASIA:2', 'EUROPE:3', 'AFRICA:4', 'AMERICA:5')")
def j19(spark, d):
    keys = spark.createDataFrame([(k,) for k in ("ASIA:1", "ASIA:2", "EUROPE:3", "AFRICA:4", "AMERICA:5")], "k string")
    return fixture(spark, d, "fx_company").withColumn("k", F.concat_ws(":", "market", F.col("company_id").cast("string"))).join(F.broadcast(keys), "k", "left_semi").select("company_id", "name")


@query("J_22_pairs", "SELECT x.company_id AS a, y.company_id AS b, COUNT(*) AS documents FROM fx_mention x JOIN fx_mention y ON x.document_id = y.document_id AND x.company_id < y.company_id GROUP BY ALL")
def j22(spark, d):
    """Pairs are made within a document's own row: nothing is joined to itself."""
    from loomlake.operators.graph import segment_pairs

    m = fixture(spark, d, "fx_mention").withColumn("segment", F.lit(0))
    return segment_pairs(m, "document_id", "segment", "company_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents"))


@query("J_23_update_ok_only", "SELECT i.event_id, CASE WHEN i.status = 'OK' THEN COALESCE(e.value, i.score) ELSE i.score END AS score FROM fx_impact i LEFT JOIN (SELECT event_id, value FROM fx_event WHERE status = 'ACTIVE') e USING (event_id)")
def j23(spark, d):
    e = fixture(spark, d, "fx_event").filter("status = 'ACTIVE'").select("event_id", "value")
    return fixture(spark, d, "fx_impact").join(e, "event_id", "left").select("event_id", F.when(F.col("status") == "OK", F.coalesce("value", "score")).otherwise(F.col("score")).alias("score"))


@query("J_24_fetch_join", "SELECT w.user_id, c.company_id, c.name FROM (SELECT DISTINCT user_id, company_id FROM fx_event) w JOIN fx_company c USING (company_id)")
def j24(spark, d):
    return fixture(spark, d, "fx_event").select("user_id", "company_id").distinct().join(fixture(spark, d, "fx_company"), "company_id").select("user_id", "company_id", "name")


@query("J_25_correlated_counts", "SELECT company_id, (SELECT COUNT(*) FROM fx_impact i WHERE i.company_id = c.company_id AND i.status = 'OK') AS ok, (SELECT COUNT(*) FROM fx_impact i WHERE i.company_id = c.company_id AND i.status = 'HOLD') AS held FROM fx_company c")
def j25(spark, d):
    k = fixture(spark, d, "fx_impact").groupBy("company_id").agg(F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "HOLD").alias("held"))
    return fixture(spark, d, "fx_company").join(k, "company_id", "left").select("company_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ok", "held")])


@query("O_01_nulls_last", "SELECT document_id, impact_direction, rn FROM (SELECT document_id, impact_direction, ROW_NUMBER() OVER (ORDER BY impact_direction DESC NULLS LAST, document_id, source_company_id, target_company_id, relationship_type) AS rn FROM fx_evidence) WHERE rn <= 50")
def o01(spark, d):
    top = fixture(spark, d, "fx_evidence").orderBy(F.desc_nulls_last("impact_direction"), "document_id", "source_company_id", "target_company_id", "relationship_type").limit(50)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc_nulls_last("impact_direction"), "document_id", "source_company_id", "target_company_id", "relationship_type")).cast("long")).select("document_id", "impact_direction", "rn")


@query("O_02_case_order", "SELECT company_id, market, ROW_NUMBER() OVER (ORDER BY CASE market WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 ELSE 2 END, company_id) AS rn FROM fx_company ORDER BY rn LIMIT 40")
def o02(spark, d):
    order = [F.when(F.col("market") == "ASIA", 0).when(F.col("market") == "EUROPE", 1).otherwise(2), F.col("company_id")]
    return fixture(spark, d, "fx_company").orderBy(*order).limit(40).withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long")).select("company_id", "market", "rn")


@query("O_03_nearest_first", "SELECT event_id FROM fx_event ORDER BY dateline > TIMESTAMP '2024-01-15', abs(epoch_us(dateline) - epoch_us(TIMESTAMP '2024-01-15')), event_id LIMIT 25")
def o03(spark, d):
    at = F.unix_micros(F.lit("2024-01-15").cast("timestamp"))
    e = fixture(spark, d, "fx_event").withColumn("us", F.unix_micros(F.col("dateline").cast("timestamp")))
    return e.orderBy(F.col("us") > at, F.abs(F.col("us") - at), "event_id").limit(25).select("event_id")


@query("O_04_page_plus_one", "SELECT document_id FROM fx_document ORDER BY published_at DESC NULLS LAST, document_id DESC LIMIT 11")
def o04(spark, d):
    return S.page(fixture(spark, d, "fx_document"), [F.desc_nulls_last("published_at"), F.desc("document_id")], 10).select("document_id")


@query("O_05_top_n", "SELECT company_id, volume FROM (SELECT company_id, SUM(volume) AS volume FROM fx_price GROUP BY 1) ORDER BY volume DESC, company_id LIMIT 5")
def o05(spark, d):
    return fixture(spark, d, "fx_price").groupBy("company_id").agg(F.sum("volume").alias("volume")).orderBy(F.desc("volume"), "company_id").limit(5)


@query("O_06_cap_order", "SELECT company_id, name, ROW_NUMBER() OVER (ORDER BY CASE WHEN market_cap > 0 THEN market_cap END DESC NULLS LAST, name) AS rn FROM fx_company")
def o06(spark, d):
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap"))
    return S.ranked_by(fixture(spark, d, "fx_company").select("company_id", "name", cap.alias("cap")), [F.desc_nulls_last("cap"), F.col("name")]).select("company_id", "name", (F.col("rank") + 1).alias("rn"))


@query("O_07_match_first", "SELECT event_id FROM fx_event WHERE company_id IN (3, 4) ORDER BY (company_id = 4) DESC NULLS LAST, dateline DESC, event_id LIMIT 30")
def o07(spark, d):
    return fixture(spark, d, "fx_event").filter("company_id in (3, 4)").orderBy((F.col("company_id") == 4).desc_nulls_last(), F.desc("dateline"), "event_id").limit(30).select("event_id")


_O08 = """WITH b AS (SELECT src AS me, dst AS other, rel, strength FROM fx_edge UNION ALL SELECT dst, src, rel, strength FROM fx_edge), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY me, other ORDER BY strength DESC, rel) AS rn FROM b)
SELECT me, other, MAX(rel) FILTER (rn = 1) AS best, COALESCE(string_agg(rel, ',' ORDER BY rel) FILTER (rn > 1), '') AS others FROM r GROUP BY ALL"""


@query("O_08_best_and_rest", _O08)
def o08(spark, d):
    b = S.both_ways(fixture(spark, d, "fx_edge"), "src", "dst")
    r = b.withColumn("rn", F.row_number().over(Window.partitionBy("me", "other").orderBy(F.desc("strength"), "rel")))
    return r.groupBy("me", "other").agg(F.max(F.when(F.col("rn") == 1, F.col("rel"))).alias("best"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") > 1, F.col("rel")))), ",").alias("others"))


@query("U_01_union_directions", "SELECT src AS me, dst AS other FROM fx_edge UNION ALL SELECT dst, src FROM fx_edge")
def u01(spark, d):
    return S.both_ways(fixture(spark, d, "fx_edge"), "src", "dst").select("me", "other")


@query("U_02_union_by_name", "SELECT company_id, name, CAST(NULL AS VARCHAR) AS alias FROM fx_company UNION ALL SELECT company_id, NULL, alias FROM fx_alias")
def u02(spark, d):
    return fixture(spark, d, "fx_company").select("company_id", "name").unionByName(fixture(spark, d, "fx_alias").select("company_id", "alias"), allowMissingColumns=True)


@query("U_03_run_over_live", "SELECT event_id, value FROM fx_event WHERE event_id % 3 = 0 UNION ALL SELECT event_id, -value FROM fx_event WHERE event_id % 3 <> 0")
def u03(spark, d):
    e = fixture(spark, d, "fx_event")
    run, live = e.filter("event_id % 3 = 0").select("event_id", "value"), e.select("event_id", (-F.col("value")).alias("value"))
    return run.unionByName(live.join(run, "event_id", "left_anti"))


@query("U_04_bag_difference", "SELECT 'left' AS side, COUNT(*) AS rows FROM (SELECT company_id, event_type FROM fx_event WHERE event_id % 2 = 0 EXCEPT ALL SELECT company_id, event_type FROM fx_event WHERE event_id % 2 = 1) UNION ALL SELECT 'right', COUNT(*) FROM (SELECT company_id, event_type FROM fx_event WHERE event_id % 2 = 1 EXCEPT ALL SELECT company_id, event_type FROM fx_event WHERE event_id % 2 = 0)")
def u04(spark, d):
    e = fixture(spark, d, "fx_event")
    a, b = (e.filter(F.col("event_id") % 2 == k).select("company_id", "event_type") for k in (0, 1))
    return a.exceptAll(b).agg(F.lit("left").alias("side"), F.count(F.lit(1)).alias("rows")).unionByName(b.exceptAll(a).agg(F.lit("right").alias("side"), F.count(F.lit(1)).alias("rows")))


@query("U_05_identity_difference", "SELECT COUNT(*) AS unmatched FROM (SELECT src, dst FROM fx_edge WHERE rel = 'SUPPLY' EXCEPT SELECT src, dst FROM fx_edge WHERE rel = 'PARTNER')")
def u05(spark, d):
    e = fixture(spark, d, "fx_edge")
    return e.filter("rel = 'SUPPLY'").select("src", "dst").subtract(e.filter("rel = 'PARTNER'").select("src", "dst")).agg(F.count(F.lit(1)).alias("unmatched"))


@query("U_06_intersection", "SELECT src, dst FROM fx_edge WHERE rel = 'SUPPLY' INTERSECT SELECT src, dst FROM fx_edge WHERE rel = 'PARTNER'")
def u06(spark, d):
    e = fixture(spark, d, "fx_edge")
    return e.filter("rel = 'SUPPLY'").select("src", "dst").intersect(e.filter("rel = 'PARTNER'").select("src", "dst"))


@query("U_07_keep_last", "SELECT company_id, event_type, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id, event_type ORDER BY dateline DESC, event_id DESC) AS rn FROM fx_event) WHERE rn = 1")
def u07(spark, d):
    return S.last_wins(fixture(spark, d, "fx_event"), ["company_id", "event_type"], [F.desc("dateline"), F.desc("event_id")]).select("company_id", "event_type", "event_id")


@query("U_08_merge_retract", "SELECT event_id, value * 2 AS value FROM fx_event WHERE event_id % 4 = 0 AND status = 'ACTIVE' UNION ALL SELECT event_id, value FROM fx_event WHERE event_id % 4 <> 0")
def u08(spark, d):
    """New rows replace old ones by id; cancelled ones go."""
    e = fixture(spark, d, "fx_event")
    new = e.filter("event_id % 4 = 0").select("event_id", (F.col("value") * 2).alias("value"), "status")
    return S.replace_keys(e.select("event_id", "value"), new, ["event_id"]).filter("status is null or status = 'ACTIVE'").select("event_id", "value")


@query("W_01_recent_closes", "SELECT company_id, trading_date, close_price FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY trading_date DESC) AS rn FROM fx_price) WHERE rn <= 30")
def w01(spark, d):
    return S.top_per(fixture(spark, d, "fx_price"), ["company_id"], [F.desc("trading_date")], 30).select("company_id", "trading_date", "close_price")


@query("W_03_change", "SELECT company_id, trading_date, round(CAST(close_price AS DOUBLE) / NULLIF(CAST(lag(close_price, 5) OVER (PARTITION BY company_id ORDER BY trading_date) AS DOUBLE), 0) - 1, 8) AS change5 FROM fx_price")
def w03(spark, d):
    w = Window.partitionBy("company_id").orderBy("trading_date")
    return fixture(spark, d, "fx_price").select("company_id", "trading_date", F.round(F.try_divide(F.col("close_price").cast("double"), F.lag("close_price", 5).over(w).cast("double")) - 1, 8).alias("change5"))


@query("W_04_thirds", "SELECT event_id, CASE WHEN p <= 1.0/3 THEN 'NEGATIVE' WHEN p <= 2.0/3 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS label FROM (SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY CAST(dateline AS DATE) ORDER BY value, event_id) AS DOUBLE) / COUNT(*) OVER (PARTITION BY CAST(dateline AS DATE)) AS p FROM fx_event)")
def w04(spark, d):
    day = Window.partitionBy(F.to_date("dateline"))
    e = fixture(spark, d, "fx_event").withColumn("p", F.row_number().over(day.orderBy("value", "event_id")) / F.count(F.lit(1)).over(day))
    return e.select("event_id", F.when(F.col("p") <= 1 / 3, "NEGATIVE").when(F.col("p") <= 2 / 3, "NEUTRAL").otherwise("POSITIVE").alias("label"))


@query("W_05_grades", "SELECT company_id, CAST((ROW_NUMBER() OVER (ORDER BY m, company_id) - 1) * 3 // COUNT(*) OVER () AS BIGINT) AS grade FROM (SELECT company_id, AVG(value) AS m FROM fx_event GROUP BY 1)")
def w05(spark, d):
    m = fixture(spark, d, "fx_event").groupBy("company_id").agg(F.avg("value").alias("m"))
    n = F.broadcast(m.agg(F.count(F.lit(1)).alias("n")))  # one row
    return S.ranked_by(m, ["m", "company_id"]).crossJoin(n).select("company_id", F.floor(F.col("rank") * 3 / F.col("n")).alias("grade"))


@query("W_06_size_class", "SELECT company_id, CAST(rn AS BIGINT) AS rn, CASE WHEN rn <= 5 THEN 'LARGE' WHEN rn <= 12 THEN 'MID' ELSE 'SMALL' END AS size FROM (SELECT company_id, ROW_NUMBER() OVER (PARTITION BY market ORDER BY market_cap DESC, company_id) AS rn FROM fx_company)")
def w06(spark, d):
    c = fixture(spark, d, "fx_company").withColumn("rn", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("market_cap"), "company_id")).cast("long"))
    return c.select("company_id", "rn", F.when(F.col("rn") <= 5, "LARGE").when(F.col("rn") <= 12, "MID").otherwise("SMALL").alias("size"))


@query("W_07_hold_by_rank", "SELECT event_id, CASE WHEN status = 'OK' AND rn <= 6 THEN 'OK' ELSE 'HOLD' END AS final FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id, status ORDER BY score DESC, event_id) AS rn FROM fx_impact WHERE hop > 0) WHERE rn <= 12")
def w07(spark, d):
    i = fixture(spark, d, "fx_impact").filter("hop > 0").withColumn("rn", F.row_number().over(Window.partitionBy("company_id", "status").orderBy(F.desc("score"), "event_id")))
    return i.filter("rn <= 12").select("event_id", F.when((F.col("status") == "OK") & (F.col("rn") <= 6), "OK").otherwise("HOLD").alias("final"))


@query("W_08_top_pairs", "SELECT DISTINCT src, dst, rel FROM (SELECT src, dst, rel, ROW_NUMBER() OVER (PARTITION BY me ORDER BY strength DESC, n DESC, src, dst, rel) AS rn FROM (SELECT *, src AS me FROM fx_edge UNION ALL SELECT *, dst FROM fx_edge)) WHERE rn <= 5")
def w08(spark, d):
    return S.top_per(S.both_ways(fixture(spark, d, "fx_edge"), "src", "dst"), ["me"], [F.desc("strength"), F.desc("n"), "src", "dst", "rel"], 5).select("src", "dst", "rel").distinct()


@query("W_09_newest_docs", "SELECT source_company_id, document_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_company_id ORDER BY published_at DESC, document_id DESC) AS rn FROM (SELECT DISTINCT source_company_id, document_id, published_at FROM fx_evidence)) WHERE rn <= 20")
def w09(spark, d):
    e = fixture(spark, d, "fx_evidence").select("source_company_id", "document_id", "published_at").distinct()
    return S.top_per(e, ["source_company_id"], [F.desc("published_at"), F.desc("document_id")], 20).select("source_company_id", "document_id")


@query("W_11_buzz", "SELECT event_id, round(COUNT(*) OVER (PARTITION BY company_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) / (COUNT(*) OVER (PARTITION BY company_id ORDER BY us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING) / 30.0 + 1), 8) AS buzz FROM (SELECT *, epoch_us(dateline) AS us FROM fx_event)")
def w11(spark, d):
    e = fixture(spark, d, "fx_event").select("event_id", "company_id", F.unix_micros(F.col("dateline").cast("timestamp")).alias("us"))
    return S.counts_before(e, "company_id", "us", (1, 30)).select("event_id", F.round(F.col("n1") / (F.col("n30") / 30 + 1), 8).alias("buzz"))


@query("W_14_feed_order", "SELECT event_id, CAST(rn AS BIGINT) AS rn, CAST(dateline AS DATE) AS day FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY CAST(dateline AS DATE), company_id ORDER BY dateline DESC, event_id) AS rn FROM fx_event)")
def w14(spark, d):
    """The n-th newest event of each company within a day: round-robin place of the feed."""
    w = Window.partitionBy(F.to_date("dateline"), "company_id").orderBy(F.desc("dateline"), "event_id")
    return fixture(spark, d, "fx_event").select("event_id", F.row_number().over(w).cast("long").alias("rn"), F.to_date("dateline").alias("day"))


@query("W_15_main_company", "WITH k AS (SELECT company_id, COUNT(*) AS k FROM fx_mention GROUP BY 1) SELECT document_id, company_id FROM (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY k, company_id) AS rn FROM fx_mention m JOIN k USING (company_id)) WHERE rn = 1")
def w15(spark, d):
    m = fixture(spark, d, "fx_mention")
    return S.top_per(m.join(m.groupBy("company_id").agg(F.count(F.lit(1)).alias("k")), "company_id"), ["document_id"], ["k", "company_id"]).select("document_id", "company_id")


@query("W_16_degree_percentile", "SELECT me, round((ROW_NUMBER() OVER (ORDER BY k, me) - 1) / NULLIF(COUNT(*) OVER () - 1, 0), 8) AS pct FROM (SELECT me, COUNT(*) AS k FROM (SELECT src AS me FROM fx_edge UNION ALL SELECT dst FROM fx_edge) GROUP BY 1)")
def w16(spark, d):
    k = S.both_ways(fixture(spark, d, "fx_edge"), "src", "dst").groupBy("me").agg(F.count(F.lit(1)).alias("k"))
    n = F.broadcast(k.agg(F.count(F.lit(1)).alias("n")))  # one row
    return S.ranked_by(k, ["k", "me"]).crossJoin(n).select("me", F.round(F.try_divide(F.col("rank"), F.col("n") - 1), 8).alias("pct"))


@query("W_17_distinct_on", "SELECT document_id, source_company_id, target_company_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY score DESC NULLS LAST, source_company_id, target_company_id, relationship_type) AS rn FROM fx_evidence) WHERE rn = 1")
def w17(spark, d):
    return S.top_per(fixture(spark, d, "fx_evidence"), ["document_id"], [F.desc_nulls_last("score"), "source_company_id", "target_company_id", "relationship_type"]).select("document_id", "source_company_id", "target_company_id")


@query("W_18_distinct_evidence", "SELECT DISTINCT document_id, relationship_type FROM fx_evidence")
def w18(spark, d):
    return fixture(spark, d, "fx_evidence").select("document_id", "relationship_type").dropDuplicates(["document_id", "relationship_type"])


@query("W_20_fair_select", "SELECT event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY dateline, event_id) AS rn FROM fx_event) ORDER BY rn, (company_id + 20 - 7) % 20 LIMIT 50")
def w20(spark, d):
    """Round-robin over partitions, beginning with the seventh."""
    e = fixture(spark, d, "fx_event").withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy("dateline", "event_id")))
    return e.orderBy("rn", (F.col("company_id") + 20 - 7) % 20).limit(50).select("event_id")


_Q = """q AS (SELECT company_id, MAX(close_price) FILTER (rn = 1) AS close, MAX(close_price) FILTER (rn = 2) AS prev, MAX(close_price) FILTER (rn <= 250) AS high, MIN(low_price) FILTER (rn <= 250) AS low, SUM(volume) FILTER (rn <= 7) AS news, SUM(volume) FILTER (rn <= 60) AS usual
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY trading_date DESC) AS rn FROM fx_price) GROUP BY 1)"""


def quotes(spark, d):
    """One row per company from one pass over its newest 250 bars."""
    p = fixture(spark, d, "fx_price").withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("trading_date")))).filter("rn <= 250")

    def when(k, c):
        return F.when(k, F.col(c))

    rn = F.col("rn")
    return p.groupBy("company_id").agg(F.max(when(rn == 1, "close_price")).alias("close"), F.max(when(rn == 2, "close_price")).alias("prev"), F.max("close_price").alias("high"), F.min("low_price").alias("low"), F.sum(when(rn <= 7, "volume")).alias("news"), F.sum(when(rn <= 60, "volume")).alias("usual"))


@query("C_01_per_share", f"WITH {_Q} SELECT company_id, round(CASE WHEN close > 0 AND news > 0 THEN CAST(usual AS DOUBLE) / (CAST(high AS DOUBLE) / CAST(close AS DOUBLE)) END, 6) AS per_share FROM q")
def c01(spark, d):
    q = quotes(spark, d)
    return q.select("company_id", F.round(F.when((F.col("close") > 0) & (F.col("news") > 0), F.col("usual").cast("double") / (F.col("high").cast("double") / F.col("close").cast("double"))), 6).alias("per_share"))


_REASONS = f"""WITH {_Q} SELECT company_id, concat_ws(',', CASE WHEN news >= 5 AND news >= 2 * usual / 60.0 * 7 THEN 'NEWS' END, CASE WHEN abs(CAST(close AS DOUBLE) / CAST(prev AS DOUBLE) - 1) >= 0.05 THEN 'MOVE' END,
 CASE WHEN CAST(close AS DOUBLE) >= 0.95 * CAST(high AS DOUBLE) THEN 'HIGH' WHEN CAST(close AS DOUBLE) <= 1.05 * CAST(low AS DOUBLE) THEN 'LOW' END) AS reasons FROM q"""


@query("C_02_watch_reasons", _REASONS)
def c02(spark, d):
    q = quotes(spark, d)
    dbl = {c: F.col(c).cast("double") for c in ("close", "prev", "high", "low")}
    news = F.when((F.col("news") >= 5) & (F.col("news") >= 2 * F.col("usual") / 60.0 * 7), "NEWS")
    move = F.when(F.abs(dbl["close"] / dbl["prev"] - 1) >= 0.05, "MOVE")
    edge = F.when(dbl["close"] >= 0.95 * dbl["high"], "HIGH").when(dbl["close"] <= 1.05 * dbl["low"], "LOW")
    return q.select("company_id", F.concat_ws(",", news, move, edge).alias("reasons"))


@query("C_03_watch_score", f"WITH {_Q} SELECT company_id, round(LEAST(20, news / (usual / 60.0 * 7)) + abs(CAST(close AS DOUBLE) / CAST(prev AS DOUBLE) - 1) * 100 + 1, 6) AS score FROM q")
def c03(spark, d):
    q = quotes(spark, d)
    return q.select("company_id", F.round(F.least(F.lit(20.0), F.col("news") / (F.col("usual") / 60.0 * 7)) + F.abs(F.col("close").cast("double") / F.col("prev").cast("double") - 1) * 100 + 1, 6).alias("score"))


@query("C_04_sort_quotes", "SELECT company_id, ROW_NUMBER() OVER (ORDER BY CASE WHEN market_cap > 0 THEN market_cap END ASC NULLS LAST, name) AS up, ROW_NUMBER() OVER (ORDER BY CASE WHEN market_cap > 0 THEN market_cap END DESC NULLS LAST, name) AS down FROM fx_company")
def c04(spark, d):
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap"))
    c = fixture(spark, d, "fx_company").select("company_id", "name", cap.alias("cap"))
    up = S.ranked_by(c, [F.asc_nulls_last("cap"), F.col("name")]).select("company_id", (F.col("rank") + 1).alias("up"))
    return up.join(S.ranked_by(c, [F.desc_nulls_last("cap"), F.col("name")]).select("company_id", (F.col("rank") + 1).alias("down")), "company_id")


@query("C_05_preset", f"WITH {_Q} SELECT company_id, news FROM q WHERE CAST(close AS DOUBLE) < CAST(high AS DOUBLE) ORDER BY news DESC, company_id LIMIT 10")
def c05(spark, d):
    return quotes(spark, d).filter(F.col("close").cast("double") < F.col("high").cast("double")).orderBy(F.desc("news"), "company_id").limit(10).select("company_id", "news")


@query("C_06_last_days", "SELECT trading_date, close_price FROM fx_index ORDER BY trading_date DESC LIMIT 61")
def c06(spark, d):
    return fixture(spark, d, "fx_index").orderBy(F.desc("trading_date")).limit(61).select("trading_date", "close_price")


_ALIGN = """SELECT company_id, trading_date, round(CAST(p.close_price AS DOUBLE) / first_value(CAST(p.close_price AS DOUBLE)) OVER w - 1, 8) AS stock, round(CAST(i.close_price AS DOUBLE) / first_value(CAST(i.close_price AS DOUBLE)) OVER w - 1, 8) AS idx_return
 FROM fx_price p JOIN fx_index i USING (trading_date) WINDOW w AS (PARTITION BY company_id ORDER BY trading_date)"""


@query("C_07_align", _ALIGN)
def c07(spark, d):
    i = fixture(spark, d, "fx_index").select("trading_date", F.col("close_price").cast("double").alias("i"))
    p = fixture(spark, d, "fx_price").select("company_id", "trading_date", F.col("close_price").cast("double").alias("p")).join(i, "trading_date")
    w = Window.partitionBy("company_id").orderBy("trading_date")
    return p.select("company_id", "trading_date", F.round(F.col("p") / F.first("p").over(w) - 1, 8).alias("stock"), F.round(F.col("i") / F.first("i").over(w) - 1, 8).alias("idx_return"))


@query("C_08_range_position", f"WITH {_Q} SELECT company_id, round(CASE WHEN high = low THEN 0.5 ELSE GREATEST(0, LEAST(1, CAST(close - low AS DOUBLE) / CAST(high - low AS DOUBLE))) END, 8) AS position FROM q")
def c08(spark, d):
    p = F.when(F.col("high") == F.col("low"), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("close") - F.col("low")).cast("double") / (F.col("high") - F.col("low")).cast("double"))))
    return quotes(spark, d).select("company_id", F.round(p, 8).alias("position"))


@query("C_09_strongest_edge", "SELECT src, dst, rel FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY rel = 'CO_MENTIONED', strength DESC, rel) AS rn FROM fx_edge) WHERE rn = 1")
def c09(spark, d):
    return S.top_per(fixture(spark, d, "fx_edge"), ["src", "dst"], [F.col("rel") == "CO_MENTIONED", F.desc("strength"), F.col("rel")]).select("src", "dst", "rel")


@query("C_10_investor_type", "SELECT company_id, CASE WHEN s < 40 THEN 'CAUTIOUS' WHEN s < 60 THEN 'BALANCED' ELSE 'BOLD' END AS kind FROM (SELECT company_id, AVG(value) AS s FROM fx_event GROUP BY 1)")
def c10(spark, d):
    s = fixture(spark, d, "fx_event").groupBy("company_id").agg(F.avg("value").alias("s"))
    return s.select("company_id", F.when(F.col("s") < 40, "CAUTIOUS").when(F.col("s") < 60, "BALANCED").otherwise("BOLD").alias("kind"))


QUERIES = {k: f for k, (f, _) in _F.items()}
SQL = {k: with_views(s) for k, (_, s) in _F.items() if s}
