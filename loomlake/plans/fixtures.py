"""The platform's tables, mapped from the star-schema test tables by one SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlake.sources.tables import table

_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "companies", "company_relationship", "load_relation_evidence")

VIEWS = {
    "fx_company": """SELECT s.s_suppkey AS company_id, s.s_name AS name, n.n_name AS industry, r.r_name AS market,
 CASE WHEN s.s_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, CAST(s.s_acctbal * 1000 AS DECIMAL(20,2)) AS market_cap
 FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "fx_alias": """SELECT p_partkey AS alias_id, p_partkey % 100 AS company_id, p_name AS alias, CASE WHEN p_size % 2 = 0 THEN 'NICKNAME' ELSE 'FORMER' END AS alias_type FROM part""",
    "fx_evidence": """SELECT source_company_id, target_company_id, relationship_type, document_id, document_type, published_at,
 MAX(score) AS score, MAX(confidence) AS confidence, MAX(impact_direction) AS impact_direction FROM (
 SELECT CASE WHEN l.l_returnflag = 'R' THEN l.l_suppkey ELSE LEAST(l.l_suppkey, l.l_partkey % 10) END AS source_company_id,
 CASE WHEN l.l_returnflag = 'R' THEN l.l_partkey % 10 ELSE GREATEST(l.l_suppkey, l.l_partkey % 10) END AS target_company_id,
 CASE l.l_returnflag WHEN 'R' THEN 'SUPPLY' WHEN 'A' THEN 'PARTNER' ELSE 'COMPETE' END AS relationship_type,
 o.o_orderkey AS document_id, CASE WHEN o.o_orderkey % 3 = 0 THEN 'DISCLOSURE' ELSE 'NEWS' END AS document_type,
 o.o_orderdate AS published_at, CAST(l.l_quantity * 2 AS DECIMAL(18,6)) AS score, CAST(l.l_discount * 10 AS DECIMAL(18,6)) AS confidence,
 CASE l.l_linenumber % 4 WHEN 0 THEN 'POSITIVE' WHEN 1 THEN 'NEGATIVE' WHEN 2 THEN 'NEUTRAL' END AS impact_direction
 FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_suppkey <> l.l_partkey % 10) x
 GROUP BY source_company_id, target_company_id, relationship_type, document_id, document_type, published_at""",
    "fx_price": """SELECT o_custkey % 20 AS company_id, CAST(o_orderdate AS DATE) AS trading_date, CAST(MAX(o_totalprice) AS DECIMAL(20,4)) AS close_price,
 CAST(MIN(o_totalprice) AS DECIMAL(20,4)) AS low_price, COUNT(*) AS volume FROM orders GROUP BY o_custkey % 20, CAST(o_orderdate AS DATE)""",
    "fx_index": """SELECT trading_date, MAX(close_price) AS close_price, CAST(ROW_NUMBER() OVER (ORDER BY trading_date) AS BIGINT) AS idx FROM
 (SELECT o_custkey % 20 AS company_id, CAST(o_orderdate AS DATE) AS trading_date, CAST(MAX(o_totalprice) AS DECIMAL(20,4)) AS close_price FROM orders GROUP BY o_custkey % 20, CAST(o_orderdate AS DATE)) p GROUP BY trading_date""",
    "fx_event": """SELECT event_id, ts AS dateline, user_id % 20 AS company_id, event_type, value, user_id,
 CASE WHEN event_type = 'error' THEN 'CANCELLED' ELSE 'ACTIVE' END AS status FROM events""",
    "fx_document": """SELECT doc_id AS document_id, lang, source AS publisher, n_chars, SUBSTR(text, 1, 80) AS title, text AS body, doc_id % 20 AS company_id, published_at FROM documents""",
    "fx_mention": """SELECT DISTINCT document_id, company_id FROM (SELECT o_orderkey AS document_id, l_suppkey % 30 AS company_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 UNION ALL SELECT o_orderkey, l_partkey % 10 FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x""",
    "fx_edge": """SELECT CAST(LEAST(l_suppkey % 40, l_partkey % 40) AS BIGINT) AS src, CAST(GREATEST(l_suppkey % 40, l_partkey % 40) AS BIGINT) AS dst, CASE l_returnflag WHEN 'R' THEN 'SUPPLY' WHEN 'A' THEN 'PARTNER' ELSE 'CO_MENTIONED' END AS rel,
 MAX(l_discount) * 10 AS strength, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40 GROUP BY 1, 2, 3""",
    # The real relations: codes as spelt are brought to one form, undirected pairs merged; co-mentions from the evidence rows.
    "fx_relation": """SELECT src, dst, rel, strength, n FROM (
 SELECT CASE WHEN rel IN ('PARTNER', 'COMPETE') THEN LEAST(s, t) ELSE s END AS src, CASE WHEN rel IN ('PARTNER', 'COMPETE') THEN GREATEST(s, t) ELSE t END AS dst, rel, MAX(confidence) AS strength, CAST(COUNT(*) AS BIGINT) AS n
 FROM (SELECT rel, confidence, CASE WHEN s <> '' AND regexp_replace(s, '^[0-9]+$', '') = '' THEN lpad(s, 6, '0') WHEN s <> '' AND regexp_replace(s, '^A[0-9]{6}$', '') = '' THEN SUBSTR(s, 2) ELSE s END AS s, t
  FROM (SELECT regexp_replace(regexp_replace(upper(trim(source_stock_code)), '^(KRX:|NASDAQ:|NYSE:|KOSPI:|KOSDAQ:|[$])', ''), '[.](KQ|KS|O|N)$', '') AS s, target_stock_code AS t, relationship_type_code AS rel, confidence FROM company_relationship) raw) spelt
 WHERE s <> '' AND t <> '' AND s <> t AND confidence IS NOT NULL GROUP BY 1, 2, 3
 UNION ALL SELECT LEAST(src, dst), GREATEST(src, dst), 'CO_MENTIONED', CAST(LEAST(10, COUNT(*)) AS DOUBLE) / 10, CAST(COUNT(*) AS BIGINT) FROM load_relation_evidence WHERE src <> dst GROUP BY 1, 2) u""",
    "fx_seed": """SELECT doc, company, MAX(salience) AS salience, CAST(COUNT(*) AS BIGINT) AS n FROM (
 SELECT COALESCE(NULLIF(replace(lower(trim(uuid)), '-', ''), ''), NULLIF(trim(rcept_no), '')) AS doc, src AS company, CAST(CASE WHEN source_kind = 'NEWS' THEN 1.0 ELSE 0.8 END AS DOUBLE) AS salience FROM load_relation_evidence
 UNION ALL SELECT COALESCE(NULLIF(replace(lower(trim(uuid)), '-', ''), ''), NULLIF(trim(rcept_no), '')), dst, CAST(0.6 AS DOUBLE) FROM load_relation_evidence) x WHERE doc IS NOT NULL AND company IS NOT NULL GROUP BY doc, company""",
    "fx_segment": """SELECT document_id, published_at, segment, company_id FROM (SELECT o_orderkey AS document_id, o_orderdate AS published_at, l_linenumber AS segment, l_suppkey % 30 AS company_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 UNION ALL SELECT o_orderkey, o_orderdate, l_linenumber, l_partkey % 10 FROM lineitem JOIN orders ON o_orderkey = l_orderkey) x""",
    "fx_impact": """SELECT event_id, user_id % 20 AS company_id, CAST(event_id % 4 AS INT) AS hop, value / 100 AS score, CASE WHEN event_id % 5 = 0 THEN 'HOLD' ELSE 'OK' END AS status, ts AS dateline FROM events""",
}


def fixture(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One fixture as a DataFrame: the text of the view over the Parquet scans."""
    base = {t: table(spark, d, t) for t in _BASE if t in VIEWS[name]}
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in base:
        for word in (f"FROM {t} ", f"JOIN {t} ", f"FROM {t})", f"FROM {t}\n"):
            text = text.replace(word, word.replace(t, "{" + t + "}"))
        if text.endswith(f"FROM {t}"):
            text = text[: -len(t)] + "{" + t + "}"
    return spark.sql(text, **base)


def with_views(sql: str) -> str:
    """The oracle's text with the fixtures it names in front of it."""
    used = [v for v in VIEWS if v in sql]
    if not used:
        return sql
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in used) + " " + (sql.strip().replace("WITH RECURSIVE ", ", ", 1) if sql.strip().startswith("WITH RECURSIVE ") else (", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else sql))
