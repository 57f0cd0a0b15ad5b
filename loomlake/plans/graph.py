"""Graph queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import graph as G
from loomlake.operators import mentions as M
from loomlake.operators import scores
from loomlake.operators.serving import top_per
from loomlake.plans.fixtures import fixture, with_views
from loomlake.plans.scores import CORR, _correlations
from loomlake.session import written

_F: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _F[name] = (f, sql)
        return f

    return add


def _relations(spark, d):
    """The real relations, spelt alike once and kept: every step of a graph query reads them again."""
    return written(fixture(spark, d, "fx_relation"), "relations")


def _centers(spark):
    return spark.createDataFrame([(1,), (7,), (23,)], "center bigint")


_ADJ = "aj AS (SELECT src AS me, dst AS other, rel, strength FROM fx_edge UNION ALL SELECT dst, src, rel, strength FROM fx_edge)"
_PROP = """WITH aj AS (SELECT src AS me, dst AS other, rel, strength FROM fx_relation UNION ALL SELECT dst, src, rel, strength FROM fx_relation), dg AS (SELECT me, COUNT(*) AS k FROM aj WHERE rel <> 'CO_MENTIONED' GROUP BY 1),
ad AS (SELECT me, other, rel, CASE rel WHEN 'SUPPLY' THEN 0.8 WHEN 'INVEST' THEN 0.6 WHEN 'COMPETE' THEN 0.5 WHEN 'PARTNER' THEN 0.5 WHEN 'CO_MENTIONED' THEN 0.4 ELSE 0 END * strength * LEAST(1.0, COALESCE(sqrt(8.0 / k), 1.0)) AS f, rel <> 'CO_MENTIONED' AS real FROM aj LEFT JOIN dg USING (me)),
p1 AS (SELECT doc, company AS n0, other AS n1, salience * f AS s, real, company || '>' || rel || '>' || other AS path FROM fx_seed m JOIN ad ON ad.me = company WHERE salience >= 0.8 AND NOT EXISTS (SELECT 1 FROM fx_seed r WHERE r.doc = m.doc AND r.company = other)),
p AS (SELECT doc, n1 AS target, s, real, 1 AS hops, path FROM p1 UNION ALL SELECT doc, other, s * f, p1.real OR ad.real, 2, path || '>' || rel || '>' || other FROM p1 JOIN ad ON ad.me = n1 WHERE other <> n0 AND NOT EXISTS (SELECT 1 FROM fx_seed r WHERE r.doc = p1.doc AND r.company = other)),
q AS (SELECT doc, target, round(s, 10) AS s, real, hops, path FROM p WHERE round(s, 10) >= 0.15),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc, target ORDER BY real DESC, s DESC, hops, path) AS rn FROM q),
i AS (SELECT doc, target, s, hops, path, CASE WHEN NOT real THEN 'CO_MENTION_ONLY' WHEN s < 0.25 THEN 'LOW' END AS why, ROW_NUMBER() OVER (PARTITION BY doc ORDER BY s DESC, target) AS k FROM b WHERE rn = 1),
o AS (SELECT *, COUNT(*) FILTER (why IS NULL) OVER (PARTITION BY doc ORDER BY k ROWS UNBOUNDED PRECEDING) AS oks FROM i WHERE k <= 12),
w AS (SELECT doc, target, s, hops, path, CASE WHEN why IS NULL AND oks > 6 THEN 'RANK' ELSE why END AS why FROM o)
SELECT doc, company, 'REPORTED' AS basis, 0 AS hop, salience AS score, '' AS path, 'OK' AS status, NULL AS hold_reason FROM fx_seed
UNION ALL SELECT doc, target, 'INFERRED', hops, s, path, CASE WHEN why IS NULL THEN 'OK' ELSE 'HOLD' END, why FROM w"""


@query("X_19_propagate", _PROP)
def x19(spark, d):
    """All documents with evidence, over the real relations of the companies."""
    return G.propagate(fixture(spark, d, "fx_seed").select("doc", "company", "salience"), _relations(spark, d))


_BFS = f"""WITH RECURSIVE {_ADJ}, b AS (SELECT c AS center, CAST(c AS BIGINT) AS node, 0 AS depth FROM (SELECT unnest([1, 7, 23]) AS c) UNION SELECT center, other, depth + 1 FROM b JOIN aj ON aj.me = b.node WHERE depth < 3) SELECT CAST(center AS BIGINT) AS center, node, MIN(depth) AS depth FROM b GROUP BY 1, 2"""


@query("X_21_frontier", _BFS)
def x21(spark, d):
    return G.frontier(fixture(spark, d, "fx_edge"), _centers(spark))


_SP = f"""WITH RECURSIVE aj AS (SELECT me, other, MAX(strength) AS s FROM (SELECT src AS me, dst AS other, strength FROM fx_edge UNION ALL SELECT dst, src, strength FROM fx_edge) GROUP BY 1, 2),
b AS (SELECT CAST(c AS BIGINT) AS center, CAST(c AS BIGINT) AS node, 0 AS hops, CAST(0 AS DOUBLE) AS penalty, CAST(1e9 AS DOUBLE) AS bottleneck FROM (SELECT unnest([1, 7, 23]) AS c) UNION SELECT center, other, hops + 1, round(penalty + 1 - s / 10, 8), LEAST(bottleneck, s) FROM b JOIN aj ON aj.me = b.node WHERE hops < 3)
SELECT center, node, hops, penalty, bottleneck FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY center, node ORDER BY hops, penalty, bottleneck DESC) AS rn FROM b) WHERE rn = 1 AND hops > 0"""


@query("X_22_shortest_path", _SP)
def x22(spark, d):
    return G.shortest_paths(fixture(spark, d, "fx_edge"), _centers(spark))


#: Pairs of a document's companies, from its distinct mentions.
_PAIRS = "pr AS (SELECT x.company_id AS a, y.company_id AS b, COUNT(*) AS n FROM fx_mention x JOIN fx_mention y ON x.document_id = y.document_id AND x.company_id < y.company_id GROUP BY ALL)"
_WIN = "wn AS (SELECT * FROM (VALUES ('30D', TIMESTAMP '2001-01-01' - INTERVAL 30 DAY), ('1Y', TIMESTAMP '2000-01-01'), ('10Y', TIMESTAMP '1991-01-01')) v(window_type, start_at))"
_COM = f"""WITH {_WIN}, sg AS (SELECT DISTINCT window_type, document_id, segment, company_id FROM fx_segment JOIN wn ON published_at >= start_at AND published_at < TIMESTAMP '2001-01-01'),
dp AS (SELECT DISTINCT x.window_type, x.document_id, x.company_id AS a, y.company_id AS b FROM sg x JOIN sg y ON x.window_type = y.window_type AND x.document_id = y.document_id AND x.segment = y.segment AND x.company_id < y.company_id),
pr AS (SELECT window_type, a, b, COUNT(*) AS n FROM dp GROUP BY ALL HAVING COUNT(*) >= 3), si AS (SELECT window_type, company_id, COUNT(DISTINCT document_id) AS k FROM sg GROUP BY ALL), nd AS (SELECT window_type, COUNT(DISTINCT document_id) AS d FROM sg GROUP BY 1),
st AS (SELECT pr.*, round(CASE WHEN n = d THEN 1 ELSE ln(n * CAST(d AS DOUBLE) / (CAST(x.k AS DOUBLE) * y.k)) / -ln(n / CAST(d AS DOUBLE)) END, 6) AS npmi FROM pr JOIN si x ON x.window_type = pr.window_type AND x.company_id = a JOIN si y ON y.window_type = pr.window_type AND y.company_id = b JOIN nd ON nd.window_type = pr.window_type),
bw AS (SELECT *, a AS me, b AS other FROM st WHERE npmi > 0 UNION ALL SELECT *, b, a FROM st WHERE npmi > 0), ch AS (SELECT DISTINCT window_type, a, b, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY window_type, me ORDER BY n DESC, npmi DESC, other) AS rn FROM bw) WHERE rn <= 5)
SELECT window_type, a, b, n, round(60 * ln(1 + n) / ln(1 + MAX(n) OVER (PARTITION BY window_type)), 6) AS score FROM ch"""


def _pairs(spark, d):
    m = fixture(spark, d, "fx_mention").withColumn("segment", F.lit(0))
    return G.segment_pairs(m, "document_id", "segment", "company_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _windowed(spark, rows, at):
    """For each window its name and the rows inside."""
    w = scores.window_table(spark, "2001-01-01")
    for r in w.select("window_type").collect():  # three windows
        inside = rows.join(F.broadcast(w.filter(F.col("window_type") == r["window_type"])), scores.in_window(at), "left_semi")
        yield r["window_type"], inside


@query("X_15_comention_edges", _COM)
def x15(spark, d):
    """Per window: pairs within a segment, in three documents or more, each company's five best."""
    s = fixture(spark, d, "fx_segment")
    out = [G.comention_edges(G.comention_stats(rows, "document_id", "segment", "company_id")).withColumn("window_type", F.lit(w)) for w, rows in _windowed(spark, s, "published_at")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("X_14_evidence_edges", f"""WITH {_WIN}, sn AS (SELECT CASE WHEN relationship_type IN ('PARTNER', 'COMPETE') THEN LEAST(source_company_id, target_company_id) ELSE source_company_id END AS src, CASE WHEN relationship_type IN ('PARTNER', 'COMPETE') THEN GREATEST(source_company_id, target_company_id) ELSE target_company_id END AS dst, relationship_type AS rel, document_id, published_at, CAST(confidence AS DOUBLE) AS c FROM fx_evidence),
ed AS (SELECT src, dst, rel FROM sn GROUP BY ALL HAVING CASE WHEN MAX(c) >= 1 THEN 1 ELSE round(1 - exp(SUM(ln(1 - c)) FILTER (c < 1)), 6) END >= 0.5)
SELECT src, dst, rel, window_type, CAST(60 + 10 * LEAST(4, COUNT(*)) AS DOUBLE) AS score, round(MAX(c), 6) AS confidence, COUNT(DISTINCT document_id) AS documents FROM sn JOIN wn ON published_at >= start_at AND published_at < TIMESTAMP '2001-01-01' JOIN ed USING (src, dst, rel) GROUP BY ALL""")
def x14(spark, d):
    e = fixture(spark, d, "fx_evidence").select(F.col("source_company_id").alias("src"), F.col("target_company_id").alias("dst"), F.col("relationship_type").alias("rel"), F.col("document_id").alias("doc"), F.col("published_at").alias("published"), "confidence")
    return G.evidence_edges(e, scores.window_table(spark, "2001-01-01"))


@query("X_16_merge_chains", f"WITH {_PAIRS}, u AS (SELECT a, b, 60.0 + 10 * LEAST(4, n) AS score, 0 AS c FROM pr UNION ALL SELECT src, dst, strength * 10, 1 FROM fx_edge) SELECT a, b, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b ORDER BY score DESC, c) AS rn FROM u) WHERE rn = 1")
def x16(spark, d):
    one = _pairs(spark, d).select("a", "b", (60.0 + 10 * F.least(F.lit(4), F.col("n"))).alias("score"))
    two = fixture(spark, d, "fx_edge").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("strength") * 10).alias("score"))
    return G.merge_chains([one, two], ["a", "b"], "score")


_OWN = """WITH h AS (SELECT l_suppkey AS src, l_partkey % 100 AS dst, CAST(round(l_discount * 100) AS BIGINT) AS pct, l_orderkey, l_linenumber FROM lineitem), b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY pct DESC) AS rn FROM h WHERE src <> dst AND pct BETWEEN 1 AND 100) WHERE rn = 1),
nw AS (SELECT source_company_id AS src, target_company_id AS dst, CASE relationship_type WHEN 'SUPPLY' THEN 'INVEST' ELSE relationship_type END AS rel, MAX(CAST(score AS DOUBLE)) AS score FROM fx_evidence GROUP BY ALL)
SELECT nw.src, nw.dst, rel, score, 'NEWS' AS source FROM nw WHERE NOT (rel = 'INVEST' AND EXISTS (SELECT 1 FROM b JOIN fx_company c ON c.company_id = b.src WHERE b.src = nw.src AND b.dst = nw.dst)) UNION ALL SELECT b.src, b.dst, 'INVEST', CAST(b.pct AS DOUBLE), 'DISCLOSED' FROM b JOIN fx_company c ON c.company_id = b.src"""


@query("X_17_ownership", _OWN)
def x17(spark, d):
    """The best stake per holder and investee, of known holders; it replaces what news say of an investment in that direction."""
    from loomlake.sources.tables import table

    h = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.round(F.col("l_discount") * 100).cast("bigint").alias("pct"))
    known = fixture(spark, d, "fx_company").select(F.col("company_id").alias("src"))
    best = G.best_stakes(h.join(known, "src", "left_semi"), "src", "dst", "pct", []).select("src", "dst", F.col("pct").cast("double").alias("score"))
    rel = F.when(F.col("relationship_type") == "SUPPLY", "INVEST").otherwise(F.col("relationship_type"))
    news = fixture(spark, d, "fx_evidence").groupBy(F.col("source_company_id").alias("src"), F.col("target_company_id").alias("dst"), rel.alias("rel")).agg(F.max(F.col("score").cast("double")).alias("score"))
    return G.merge_ownership(news, best)


_X20 = "SELECT document_id, array_to_string(list_sort(list_filter(['CO_MENTIONED', " + ", ".join(f"CASE WHEN regexp_matches(body, '(?i){p.pattern}') THEN '{n}' END" for n, p in sorted(M.RELATION_WORDS.items())) + "], lambda x: x IS NOT NULL)), ',') AS active FROM fx_document WHERE body IS NOT NULL"


@query("X_20_active_relations", _X20)
def x20(spark, d):
    """Which relation types an article's words allow a spread along."""
    return fixture(spark, d, "fx_document").filter("body is not null").select("document_id", F.array_join(M.active_relations(F.col("body")), ",").alias("active"))


_SPECIAL = """WITH nd AS (SELECT ticker AS id, sector AS industry, market, CAST(COALESCE(year(listed_at) - 1980, 0) AS DOUBLE) AS x, CAST(COALESCE(month(listed_at), 0) AS DOUBLE) AS y, CAST(COALESCE(day(listed_at), 0) AS DOUBLE) AS z FROM companies),
ed AS (SELECT src, dst, rel, round(strength * 100, 4) AS score FROM fx_relation), kd AS (SELECT id, COUNT(e.me) AS k FROM nd LEFT JOIN (SELECT src AS me FROM ed UNION ALL SELECT dst FROM ed) e ON e.me = nd.id GROUP BY 1),
pc AS (SELECT id, (ROW_NUMBER() OVER (ORDER BY k, id) - 1) / CAST(COUNT(*) OVER () - 1 AS DOUBLE) AS pct FROM kd),
r AS (SELECT ed.*, LEAST(src, dst) AS lo, GREATEST(src, dst) AS hi, a.industry AS ia, b.industry AS ib, a.market AS ma, b.market AS mb, pa.pct AS pa, pb.pct AS pb, CAST(floor(score / 10) AS BIGINT) AS band, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
 FROM ed JOIN nd a ON a.id = src JOIN nd b ON b.id = dst JOIN pc pa ON pa.id = src JOIN pc pb ON pb.id = dst),
pt AS (SELECT LEAST(src, dst) AS lo, GREATEST(src, dst) AS hi, bool_or(rel = 'COMPETE') AS c, COUNT(DISTINCT rel) AS kinds FROM ed GROUP BY 1, 2),
cb AS (SELECT LEAST(COALESCE(ia, ''), COALESCE(ib, '')) AS l, GREATEST(COALESCE(ia, ''), COALESCE(ib, '')) AS h, rel, COUNT(*) AS k FROM r GROUP BY 1, 2, 3), bd AS (SELECT band, median(dist) AS mid FROM r GROUP BY 1 HAVING COUNT(*) >= 4), al AS (SELECT median(dist) AS mid FROM r),
w AS (SELECT r.src, r.dst, r.rel, r.score, CASE WHEN ia <> ib THEN 0.12 ELSE 0 END AS w_industry, CASE WHEN ma <> mb THEN 0.08 ELSE 0 END AS w_market, CASE WHEN pt.c AND kinds > 1 THEN 0.42 ELSE 0 END AS w_frenemy,
 0.2 * LEAST(1, GREATEST(0, (0.5 - GREATEST(pa, pb)) / 0.5)) AS w_quiet, CASE WHEN ia <> ib AND cb.k <= 1 THEN 0.34 ELSE 0 END AS w_rare, 0.2 * LEAST(1, GREATEST(0, CASE WHEN COALESCE(bd.mid, al.mid) > 0 THEN dist / COALESCE(bd.mid, al.mid) - 1.6 ELSE 0 END)) AS w_far
 FROM r JOIN pt USING (lo, hi) JOIN cb ON cb.l = LEAST(COALESCE(ia, ''), COALESCE(ib, '')) AND cb.h = GREATEST(COALESCE(ia, ''), COALESCE(ib, '')) AND cb.rel = r.rel LEFT JOIN bd USING (band), al WHERE r.score >= 55)
SELECT src, dst, rel, round(LEAST(1, w_industry + w_market + w_frenemy + w_quiet + w_rare + w_far) * (0.6 + 0.4 * score / 100), 6) AS score,
 concat_ws(',', CASE WHEN w_far > 0 THEN 'far' END, CASE WHEN w_frenemy > 0 THEN 'frenemy' END, CASE WHEN w_industry > 0 THEN 'industry' END, CASE WHEN w_market > 0 THEN 'market' END, CASE WHEN w_quiet > 0 THEN 'quiet' END, CASE WHEN w_rare > 0 THEN 'rare' END) AS reasons
FROM w WHERE (w_frenemy > 0 OR w_rare > 0 OR (w_quiet > 0 AND w_far > 0)) AND round(LEAST(1, w_industry + w_market + w_frenemy + w_quiet + w_rare + w_far) * (0.6 + 0.4 * score / 100), 6) >= 0.42"""


@query("X_23_special_links", _SPECIAL)
def x23(spark, d):
    """Over the real relations; the layout stands on the listing dates."""
    from loomlake.sources.tables import table

    at = [F.coalesce(f("listed_at") - k, F.lit(0)).cast("double").alias(c) for f, k, c in ((F.year, 1980, "x"), (F.month, 0, "y"), (F.day, 0, "z"))]
    nodes = table(spark, d, "companies").select(F.col("ticker").alias("id"), F.col("sector").alias("industry"), "market", *at)
    return G.special_links(_relations(spark, d).select("src", "dst", "rel", F.round(F.col("strength") * 100, 4).alias("score")), nodes)


@query("O_09_greedy_list", None)
def o09(spark, d):
    """Ranked links with at most two per company and one per pair, of all links."""
    return G.greedy_list(x23(spark, d))


_EXP = """WITH c AS (SELECT doc, company, MAX(salience) AS s FROM fx_seed GROUP BY ALL), m AS (SELECT ticker AS company, sector AS industry FROM companies WHERE sector IS NOT NULL), z AS (SELECT industry, COUNT(*) AS size FROM m GROUP BY 1),
i AS (SELECT doc, industry, SUM(n) AS n FROM fx_seed JOIN m USING (company) WHERE salience >= 0.8 GROUP BY ALL), e AS (SELECT src, dst, CASE rel WHEN 'INVEST' THEN 'ownership' WHEN 'CO_MENTIONED' THEN 'co_mention' WHEN 'COMPETE' THEN 'sector' ELSE 'other' END AS kind, strength AS w FROM fx_relation WHERE strength >= 0.2),
aj AS (SELECT src AS me, dst AS other, kind, w FROM e UNION ALL SELECT dst, src, kind, w FROM e),
u AS (SELECT doc, company, s, 1 AS o FROM c
 UNION ALL SELECT doc, m.company, LEAST(0.6, 0.6 * (1 + ln(CAST(GREATEST(n, 1) AS DOUBLE))) / sqrt(size)), 2 FROM i JOIN z USING (industry) JOIN m USING (industry) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = i.doc AND c.company = m.company)
 UNION ALL SELECT doc, other, g, 3 FROM (SELECT doc, other, s * w * CASE kind WHEN 'ownership' THEN 0.8 WHEN 'co_mention' THEN 0.5 ELSE 0.3 END / CASE WHEN kind = 'sector' THEN sqrt(COALESCE(size, 1)) ELSE 1 END AS g FROM c JOIN aj ON aj.me = c.company LEFT JOIN m ON m.company = other LEFT JOIN z USING (industry)) x WHERE g >= 0.05 AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc = x.doc AND c.company = x.other))
SELECT doc, company, MAX(round(s, 3)) AS score, CASE min_by(o, (-round(s, 3), o)) WHEN 1 THEN 'direct' WHEN 2 THEN 'industry' ELSE 'graph' END AS source, COUNT(*) AS reasons FROM u GROUP BY 1, 2"""


@query("X_24_expand_impact", _EXP)
def x24(spark, d):
    """All documents with evidence: named companies, their industries' members and their neighbours."""
    from loomlake.sources.tables import table

    seeds = fixture(spark, d, "fx_seed")
    members = table(spark, d, "companies").filter("sector is not null").select(F.col("ticker").alias("company"), F.col("sector").alias("industry"))
    industries = seeds.filter("salience >= 0.8").join(members, "company").groupBy("doc", "industry").agg(F.sum("n").alias("n"))
    kind = F.when(F.col("rel") == "INVEST", "ownership").when(F.col("rel") == "CO_MENTIONED", "co_mention").when(F.col("rel") == "COMPETE", "sector").otherwise("other")
    edges = _relations(spark, d).select("src", "dst", kind.alias("kind"), F.col("strength").alias("weight"))
    return G.expand_impact(seeds.select("doc", "company", F.col("salience").alias("confidence")), industries, members, edges)


@query("X_34_news_evidence", "SELECT document_id, company_id, published_at FROM (SELECT m.document_id, m.company_id, e.published_at, ROW_NUMBER() OVER (PARTITION BY m.document_id ORDER BY m.company_id % 5, m.company_id) AS rn FROM fx_mention m JOIN (SELECT document_id, MIN(published_at) AS published_at FROM fx_evidence GROUP BY 1) e USING (document_id)) WHERE rn = 1")
def x34(spark, d):
    """A document's evidence row belongs to its most salient company."""
    at = fixture(spark, d, "fx_evidence").groupBy("document_id").agg(F.min("published_at").alias("published_at"))
    return top_per(fixture(spark, d, "fx_mention").join(at, "document_id"), ["document_id"], [F.col("company_id") % 5, F.col("company_id")]).select("document_id", "company_id", "published_at")


_X35 = f"""WITH {_PAIRS}, {CORR}, n AS (SELECT MAX(n) AS m FROM pr), g AS (SELECT a, b, n / CAST(m AS DOUBLE) AS v FROM pr, n UNION ALL SELECT a, b, abs(corr) FROM cor UNION ALL SELECT x.company_id, y.company_id, 0.3 FROM fx_company x JOIN fx_company y ON x.industry = y.industry AND x.company_id < y.company_id),
t AS (SELECT a, b, MAX(v) AS v FROM g GROUP BY 1, 2) SELECT e.src, e.dst, e.rel, round(e.strength + 0.25 * COALESCE(v, 0), 6) AS score FROM fx_edge e LEFT JOIN t ON t.a = e.src AND t.b = e.dst"""


@query("X_35_corroborate", _X35)
def x35(spark, d):
    """Signals: how often a pair is named together, how its prices moved together before the as-of time, .3 for one industry."""
    e = fixture(spark, d, "fx_edge").select("src", "dst", "rel", "strength")
    asked = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    pairs = _pairs(spark, d)
    top = F.broadcast(pairs.agg(F.max("n").alias("m")))  # one row
    named = pairs.crossJoin(top).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), (F.col("n") / F.col("m")).alias("value"))
    moved = _correlations(spark, d, asked).select("a", "b", F.abs("corr").alias("value"))
    c = fixture(spark, d, "fx_company").select("company_id", "industry")
    alike = asked.join(c.toDF("a", "i"), "a").join(c.toDF("b", "j"), "b").filter("i = j").select("a", "b", F.lit(0.3).cast("double").alias("value"))
    return G.corroborate(e, [named, moved, alike]).drop("strength")


@query("X_36_master", "SELECT company_id, alias, alias_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY alias ORDER BY alias_id) AS rn FROM fx_alias) JOIN (SELECT company_id FROM fx_company) USING (company_id) WHERE rn = 1")
def x36(spark, d):
    """First writer wins per alias; aliases of unknown companies go."""
    first = top_per(fixture(spark, d, "fx_alias"), ["alias"], ["alias_id"])
    return first.join(fixture(spark, d, "fx_company").select("company_id"), "company_id", "left_semi").select("company_id", "alias", "alias_type")


QUERIES = {k: f for k, (f, _) in _F.items()}
SQL = {k: with_views(s) for k, (_, s) in _F.items() if s}
for _k in ("X_21_frontier", "X_22_shortest_path"):
    SQL[_k] = SQL[_k].replace("WITH ", "WITH RECURSIVE ", 1)
