"""Sources, sinks, checks and streams as queries: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import dq, publish
from loomlake.operators.once import SeenStore
from loomlake.operators.serving import replace_keys
from loomlake.plans.fixtures import fixture, with_views
from loomlake.session import shared_path
from loomlake.sources import readers as R
from loomlake.sources.tables import table
from loomlake.streaming import ingest

_F: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _F[name] = (f, sql)
        return f

    return add


@query("S_01_partitioned", "SELECT event_id, event_type FROM events WHERE event_type = 'purchase'")
def s01(spark, d):
    """K-01 and S-01: written by partition, read with pruning."""
    root = shared_path(spark, "s01")
    table(spark, d, "events").select("event_id", "event_type").write.partitionBy("event_type").parquet(root)
    return R.partitioned(spark, root, F.col("event_type") == "purchase").select("event_id", "event_type")


@query("S_02_many_roots", "SELECT event_id, value, CAST(NULL AS BIGINT) AS user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, user_id FROM events WHERE event_id % 2 = 1")
def s02(spark, d):
    root, e = shared_path(spark, "s02"), table(spark, d, "events")
    e.filter("event_id % 2 = 0").select("event_id", "value").write.parquet(f"{root}/a")
    e.filter("event_id % 2 = 1").select("event_id", "user_id").write.parquet(f"{root}/b")
    return R.many_roots(spark, [f"{root}/a", f"{root}/b"])


@query("S_03_jsonl", "SELECT event_id, event_type, value FROM events")
def s03(spark, d):
    root = shared_path(spark, "s03")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(root)
    return R.strict_jsonl(spark, root, "event_id bigint, event_type string, value double")


@query("S_05_id_list", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events")
def s05(spark, d):
    root = shared_path(spark, "s05")
    table(spark, d, "events").select(F.concat(F.lit(" "), F.col("user_id").cast("string"))).write.text(root)
    return R.id_list(spark, root)


@query("S_06_csv", "SELECT s_suppkey, NULLIF(s_name, 'Supplier#000000001') AS s_name FROM supplier")
def s06(spark, d):
    root = shared_path(spark, "s06")
    table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_name") != "Supplier#000000001", F.col("s_name")).alias("s_name")).write.option("header", True).option("nullValue", "\\N").csv(root)
    return R.dictionary_csv(spark, root, "s_suppkey bigint, s_name string", "\\N")


@query("S_08_offsets", "SELECT kafka_partition AS partition, o AS offset, COUNT(kafka_offset) AS times FROM (SELECT kafka_partition, unnest(range(MIN(kafka_offset), MAX(kafka_offset) + 1)) AS o FROM realtime_analyzer GROUP BY 1) r LEFT JOIN realtime_analyzer t USING (kafka_partition) WHERE t.kafka_offset = o GROUP BY ALL HAVING COUNT(*) <> 1 UNION ALL SELECT kafka_partition, o, 0 FROM (SELECT kafka_partition, unnest(range(MIN(kafka_offset), MAX(kafka_offset) + 1)) AS o FROM realtime_analyzer GROUP BY 1) r WHERE NOT EXISTS (SELECT 1 FROM realtime_analyzer t WHERE t.kafka_partition = r.kafka_partition AND t.kafka_offset = o)")
def s08(spark, d):
    t = table(spark, d, "realtime_analyzer").select(F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), "event_id").filter("partition is not null and offset is not null")
    ranges = t.groupBy("partition").agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))
    bad = F.coalesce(F.trim("event_id"), F.lit("")) == ""
    return R.offsets_accounted(t.filter(~bad), t.filter(bad), ranges)


@query("S_14_article_store", "SELECT document_id, publisher FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id ORDER BY p DESC) AS rn FROM (SELECT document_id, publisher, 'p1' AS p FROM fx_document UNION ALL SELECT document_id, upper(publisher), 'p2' FROM fx_document WHERE document_id % 2 = 0)) WHERE rn = 1")
def s14(spark, d):
    x = fixture(spark, d, "fx_document").select("document_id", "publisher", F.lit("p1").alias("p"))
    y = x.filter("document_id % 2 = 0").select("document_id", F.upper("publisher").alias("publisher"), F.lit("p2").alias("p"))
    return R.article_store(x.unionByName(y), "p", "document_id").select("document_id", "publisher")


@query("S_16_changes", "SELECT company_id, max_by(status, (dateline, status)) AS status, MAX(dateline) AS dateline FROM fx_event GROUP BY 1")
def s16(spark, d):
    return R.changes(fixture(spark, d, "fx_event"), "company_id", "status", "dateline")


@query("S_18_uncovered", "SELECT company_id, trading_date AS day FROM fx_price WHERE NOT (trading_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')")
def s18(spark, d):
    p = fixture(spark, d, "fx_price").select("company_id", F.col("trading_date").alias("day"))
    c = p.select("company_id").distinct().withColumns({"first": F.lit("1996-01-01").cast("date"), "last": F.lit("1999-12-31").cast("date")})
    return R.uncovered(c, p, "company_id")


@query("S_27_requested", "SELECT company_id, name FROM fx_company WHERE (market, company_id) IN (('ASIA', 1), ('EUROPE', 2), ('AFRICA', 3))")
def s27(spark, d):
    ask = R.requested(spark, market=["ASIA", "EUROPE", "AFRICA"], company_id=[1, 2, 3])
    return fixture(spark, d, "fx_company").join(F.broadcast(ask), ["market", "company_id"], "left_semi").select("company_id", "name")  # the request's own rows


@query("K_03_publish", "SELECT company_id, trading_date, close_price FROM fx_price")
def k03(spark, d):
    """K-03, K-06, K-11, S-24: published, verified, then read through the newest marker."""
    root = shared_path(spark, "k03")
    publish.publish(fixture(spark, d, "fx_price").select("company_id", "trading_date", "close_price"), root, "2001-01-01", ["company_id", "trading_date"])
    return spark.read.parquet(f"{root}/{publish.latest(spark, root)['run']}/data")


@query("K_05_promote", "SELECT 'companies' AS dataset, COUNT(*) AS rows FROM fx_company UNION ALL SELECT 'edges', COUNT(*) FROM fx_edge")
def k05(spark, d):
    root = shared_path(spark, "k05")
    publish.promote({"companies": fixture(spark, d, "fx_company"), "edges": fixture(spark, d, "fx_edge")}, root, "r1")
    return spark.read.parquet(f"{root}/r1/companies").agg(F.lit("companies").alias("dataset"), F.count(F.lit(1)).alias("rows")).unionByName(spark.read.parquet(f"{root}/r1/edges").agg(F.lit("edges").alias("dataset"), F.count(F.lit(1)).alias("rows")))


@query("K_12_upsert", "SELECT company_id, CASE WHEN company_id % 2 = 0 THEN upper(name) ELSE name END AS name FROM fx_company")
def k12(spark, d):
    c = fixture(spark, d, "fx_company").select("company_id", "name")
    return replace_keys(c, c.filter("company_id % 2 = 0").withColumn("name", F.upper("name")), ["company_id"])


@query("K_13_prune", "SELECT event_id FROM fx_event WHERE event_id IN (SELECT event_id FROM fx_impact WHERE status = 'OK')")
def k13(spark, d):
    return fixture(spark, d, "fx_event").join(fixture(spark, d, "fx_impact").filter("status = 'OK'"), "event_id", "left_semi").select("event_id")


@query("K_14_bulk_update", "SELECT c.company_id, COALESCE(e.v, 0) AS v FROM fx_company c LEFT JOIN (SELECT company_id, round(MAX(value), 6) AS v FROM fx_event GROUP BY 1) e USING (company_id)")
def k14(spark, d):
    e = fixture(spark, d, "fx_event").groupBy("company_id").agg(F.round(F.max("value"), 6).alias("v"))
    return fixture(spark, d, "fx_company").select("company_id").join(e, "company_id", "left").select("company_id", F.coalesce("v", F.lit(0.0)).alias("v"))


_X38 = """WITH s AS (SELECT event_id AS k, value AS h, event_type = 'purchase' AS a FROM fx_event WHERE event_id % 3 <> 0), i AS (SELECT event_id AS k, event_id % 2 AS later, CASE WHEN event_id % 5 = 0 THEN value ELSE value + 1 END AS h FROM fx_event)
SELECT i.k AS event_id, CASE WHEN s.k IS NULL THEN 'insert' WHEN later = 0 AND i.h <> s.h THEN 'conflict' WHEN i.h = s.h THEN 'keep' WHEN s.a THEN 'protected' ELSE 'replace' END AS action FROM i LEFT JOIN s USING (k)"""


@query("X_38_precedence", _X38)
def x38(spark, d):
    e = fixture(spark, d, "fx_event")
    s = e.filter("event_id % 3 <> 0").select("event_id", F.lit(0).alias("collected_at"), F.col("value").alias("hash"), (F.col("event_type") == "purchase").alias("analysed"))
    i = e.select("event_id", (F.col("event_id") % 2).cast("int").alias("collected_at"), F.when(F.col("event_id") % 5 == 0, F.col("value")).otherwise(F.col("value") + 1).alias("hash"), F.lit(False).alias("analysed"))
    return publish.precedence(s, i, "event_id")


@query("Q_01_null_keys", "SELECT alias_id FROM alias_freq WHERE alias IS NULL OR source IS NULL")
def q01(spark, d):
    return dq.null_keys(table(spark, d, "alias_freq"), ["alias", "source"]).select("alias_id")


@query("Q_02_duplicate_keys", "SELECT l_orderkey, l_linenumber, COUNT(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def q02(spark, d):
    return dq.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q_03_conflicts", "SELECT document_id, COUNT(*) AS versions FROM (SELECT DISTINCT document_id, impact_direction FROM fx_evidence) GROUP BY 1 HAVING COUNT(*) > 1")
def q03(spark, d):
    return dq.conflicts(fixture(spark, d, "fx_evidence"), ["document_id"], ["impact_direction"])


@query("Q_07_incomplete", "SELECT company_id, COUNT(DISTINCT event_type) AS parts FROM fx_event GROUP BY 1 HAVING COUNT(DISTINCT event_type) <> 4")
def q07(spark, d):
    return dq.incomplete(fixture(spark, d, "fx_event"), ["company_id"], "event_type", 4)


@query("Q_08_rederived", "SELECT doc_id FROM documents WHERE (n_chars IS NULL) <> (text IS NULL) OR n_chars <> length(text)")
def q08(spark, d):
    return dq.rederived(table(spark, d, "documents"), "n_chars", F.length("text").cast("bigint")).select("doc_id")


@query("Q_11_contract", "SELECT 'broken' AS part, COUNT(*) AS rows FROM realtime_analyzer WHERE event_id IS NULL OR trim(event_id) = '' OR title IS NULL UNION ALL SELECT 'valid', COUNT(*) FROM realtime_analyzer WHERE event_id IS NOT NULL AND trim(event_id) <> '' AND title IS NOT NULL")
def q11(spark, d):
    valid, broken = dq.contract(table(spark, d, "realtime_analyzer"), {"event_id": F.trim("event_id") != "", "title": F.col("title").isNotNull()})
    return broken.agg(F.lit("broken").alias("part"), F.count(F.lit(1)).alias("rows")).unionByName(valid.agg(F.lit("valid").alias("part"), F.count(F.lit(1)).alias("rows")))


def _feed(spark, d):
    t = table(spark, d, "realtime_analyzer").select("event_id", "source", "url", "title", F.col("ingested_at").cast("timestamp").alias("collected_at"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"))
    root = shared_path(spark, "feed")
    t.repartitionByRange(3, "offset").write.parquet(root)
    return root


@query("ST_01_land", "SELECT COUNT(*) AS valid FROM realtime_analyzer WHERE trim(event_id) <> '' AND trim(source) <> '' AND trim(url) <> '' AND trim(title) <> '' AND ingested_at IS NOT NULL")
def st01(spark, d):
    """Landed in batches through a checkpoint; the valid part is counted."""
    root, out = _feed(spark, d), shared_path(spark, "landed")
    ingest.land(ingest.file_source(spark, root), out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/valid").agg(F.count(F.lit(1)).alias("valid"))


@query("ST_04_once", "SELECT COUNT(DISTINCT event_id) AS messages FROM realtime_analyzer WHERE event_id IS NOT NULL")
def st04(spark, d):
    """Exactly one arrival of each identifier (as spelt) over all batches of the stream."""
    root, out = _feed(spark, d), shared_path(spark, "once")
    ingest.land_once(ingest.file_source(spark, root), f"{out}/rows", f"{out}/checkpoint", SeenStore(spark, f"{out}/seen", 16)).awaitTermination()
    return spark.read.parquet(f"{out}/rows").agg(F.count(F.lit(1)).alias("messages"))


@query("ST_07_upsert", "SELECT COUNT(DISTINCT url) AS urls FROM realtime_analyzer WHERE url IS NOT NULL")
def st07(spark, d):
    """Batches are appended, folded once half way through the reading, and read as one state."""
    root, out = _feed(spark, d), shared_path(spark, "upsert")
    ingest.upsert(ingest.file_source(spark, root).filter("url is not null"), f"{out}/state", f"{out}/checkpoint", "url").awaitTermination()
    before = ingest.state(spark, f"{out}/state", "url").count()
    ingest.compact(spark, f"{out}/state", "url")
    rows = ingest.state(spark, f"{out}/state", "url").agg(F.count(F.lit(1)).alias("urls"))
    if rows.first()["urls"] != before:
        raise RuntimeError("folding changed the state")
    return rows


QUERIES = {k: f for k, (f, _) in _F.items()}
SQL = {k: with_views(s) for k, (_, s) in _F.items() if s}
