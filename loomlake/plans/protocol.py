"""The inventory's protocol entries: each runs the protocol and returns what it leaves behind."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomlake.functions import text as T
from loomlake.operators import mentions, publish
from loomlake.operators.once import SeenStore
from loomlake.operators.serving import ranked_by, replace_keys, top_per
from loomlake.plans.fixtures import fixture, with_views
from loomlake.plans.more import _docs, _matched, by_row, standalone_sql
from loomlake.plans.platform import _feed
from loomlake.session import shared_path
from loomlake.sources import readers
from loomlake.sources.tables import table
from loomlake.streaming import ingest

_F: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _F[name] = (f, sql)
        return f

    return add


@query("S_04_evidence_scan", "SELECT document_id, source_company_id, target_company_id, score FROM fx_evidence")
def s04(spark, d):
    root = shared_path(spark, "s04")
    fixture(spark, d, "fx_evidence").write.parquet(root)
    return spark.read.parquet(root).select("document_id", "source_company_id", "target_company_id", "score")


@query("S_09_manifest_checked", "SELECT event_id, company_id FROM fx_event")
def s09(spark, d):
    """A batch is read only if its rows are as many as its manifest says."""
    root = shared_path(spark, "s09")
    run = publish.publish(fixture(spark, d, "fx_event").select("event_id", "company_id"), root, "2024-01-31", ["event_id"])
    rows = spark.read.parquet(f"{root}/{run}/data")
    if rows.count() != json.loads(publish.Folder(spark, f"{root}/{run}").get("manifest.json"))["rows"]:
        raise ValueError(f"{run}: not the rows of its manifest")
    return rows


@query("S_15_bisected_windows")
def s15(spark, d):
    """Days of the feed cut into windows of at most 2,000 events; the driver sees one row a day."""
    days = fixture(spark, d, "fx_event").groupBy(F.to_date("dateline").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day").collect()
    return spark.createDataFrame(readers.bisected([(r.day, r.n) for r in days], 2000), "first string, last string, hits long")


@query("S_17_chunks", "SELECT CAST((ROW_NUMBER() OVER (ORDER BY company_id) - 1) // 10 AS BIGINT) AS chunk, company_id FROM fx_company")
def s17(spark, d):
    return ranked_by(fixture(spark, d, "fx_company").select("company_id"), ["company_id"]).select(F.floor(F.col("rank") / 10).alias("chunk"), "company_id")


@query("S_26_text_scan", "SELECT COUNT(*) AS lines FROM events")
def s26(spark, d):
    root = shared_path(spark, "s26")
    table(spark, d, "events").select(F.col("event_id").cast("string")).write.text(root)
    return spark.read.text(root).agg(F.count(F.lit(1)).alias("lines"))


@query("S_28_null_marker", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name END AS p_name FROM part")
def s28(spark, d):
    root = shared_path(spark, "s28")
    table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).alias("p_name")).write.option("header", True).option("nullValue", "NULL").csv(root)
    return readers.dictionary_csv(spark, root, "p_partkey bigint, p_name string", "NULL")


@query("K_06_manifest", "SELECT 'edges' AS name, COUNT(*) AS rows FROM fx_edge")
def k06(spark, d):
    root = shared_path(spark, "k06")
    folder = publish.Folder(spark, root)
    folder.put("manifest.json", json.dumps({"name": "edges", "rows": fixture(spark, d, "fx_edge").count()}))
    return spark.read.schema("name string, rows long").json(f"{root}/manifest.json")


@query("K_08_replay", "SELECT COUNT(*) AS rows FROM realtime_analyzer WHERE trim(event_id) <> '' AND trim(source) <> '' AND trim(url) <> '' AND trim(title) <> ''")
def k08(spark, d):
    """The same stream landed twice from the start (a lost checkpoint) leaves one copy of each batch."""
    root, out = _feed(spark, d), shared_path(spark, "replay")
    for k in range(2):
        ingest.land(ingest.file_source(spark, root), out, f"{out}/checkpoint-{k}").awaitTermination()
    return spark.read.parquet(f"{out}/valid").agg(F.count(F.lit(1)).alias("rows"))


@query("K_09_quarantine", "SELECT COUNT(*) AS rows FROM realtime_analyzer WHERE event_id IS NULL OR trim(event_id) = ''")
def k09(spark, d):
    root, out = _feed(spark, d), shared_path(spark, "quarantine")
    ingest.land(ingest.file_source(spark, root), out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/quarantine").filter(F.array_contains("broken", "event_id")).agg(F.count(F.lit(1)).alias("rows"))


@query("K_11_snapshot", "SELECT company_id, name FROM fx_company WHERE company_id > 3")
def k11(spark, d):
    root, c = shared_path(spark, "k11"), fixture(spark, d, "fx_company").select("company_id", "name")
    publish.publish(c, root, "2024-01-01", ["company_id"])
    publish.publish(c.filter("company_id > 3"), root, "2024-01-02", ["company_id"])
    return spark.read.parquet(f"{root}/{publish.latest(spark, root)['run']}/data")


@query("K_18_newest_wins", "SELECT event_id, CASE WHEN event_id % 2 = 1 THEN value + 1 ELSE value END AS value FROM fx_event")
def k18(spark, d):
    e = fixture(spark, d, "fx_event")
    stored = e.select("event_id", F.lit(5).alias("collected_at"), F.col("value").alias("hash"), F.lit(False).alias("analysed"))
    incoming = e.select("event_id", F.when(F.col("event_id") % 2 == 1, 6).otherwise(4).alias("collected_at"), (F.col("value") + 1).alias("hash"), F.lit(False).alias("analysed"))
    take = publish.precedence(stored, incoming, "event_id").filter("action in ('insert', 'replace')")
    new = incoming.join(take.select("event_id"), "event_id", "left_semi").select("event_id", F.col("hash").alias("value"))
    return replace_keys(stored.select("event_id", F.col("hash").alias("value")), new, ["event_id"])


@query("W_02_rank_then_sum", "SELECT company_id, SUM(volume) AS volume FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY company_id ORDER BY trading_date DESC) AS rn FROM fx_price) WHERE rn <= 20 GROUP BY 1")
def w02(spark, d):
    return top_per(fixture(spark, d, "fx_price"), ["company_id"], [F.desc("trading_date")], 20).groupBy("company_id").agg(F.sum("volume").alias("volume"))


@query("F_13_particles", standalone_sql("외국인"))
def f13(spark, d):
    return by_row(_docs(spark, d), "document_id", "body", lambda x: [(T.standalone(x, "외국인"),)], [("at", "int")])


@query("F_14_name_pattern", r"SELECT document_id, regexp_matches(body, '(?i)market\s+share') AS hit FROM fx_document WHERE body IS NOT NULL")
def f14(spark, d):
    return _docs(spark, d).select("document_id", F.col("body").rlike(r"(?i)market\s+share").alias("hit"))


@query("X_03_accepted")
def x03(spark, d):
    return mentions.accepted(_matched(spark, d))


@query("X_10_between")
def x10(spark, d):
    p = mentions.pair_candidates(_matched(spark, d)).filter("sentence rlike '^[\\\\x00-\\\\x7f]*$'")
    return mentions.between(p).select("id", "sentence_order", "a", "b", "gap", "relation")


@query("X_13_snippets")
def x13(spark, d):
    """Evidence of a pair: its sentences with a relation, loose partnership dropped."""
    return mentions.classified(mentions.pair_candidates(_matched(spark, d))).filter("relation is not null and not (relation = 'PARTNER' and pattern = 'near')").select("id", "src", "dst", "relation", "confidence", "sentence")


@query("ST_05_url_once", "SELECT COUNT(DISTINCT url) AS urls FROM realtime_analyzer WHERE url IS NOT NULL")
def st05(spark, d):
    root, out = _feed(spark, d), shared_path(spark, "urls")
    stream = ingest.file_source(spark, root).withColumn("event_id", F.col("url"))
    ingest.land_once(stream, f"{out}/rows", f"{out}/checkpoint", SeenStore(spark, f"{out}/seen", 16)).awaitTermination()
    return spark.read.parquet(f"{out}/rows").agg(F.count(F.lit(1)).alias("urls"))


@query("ST_06_watermark", "SELECT source, CAST(COUNT(*) AS BIGINT) AS n FROM realtime_analyzer WHERE ingested_at IS NOT NULL GROUP BY 1")
def st06(spark, d):
    """Event-time counts over the stream, summed over the windows; nothing is late within the watermark here."""
    root, out = _feed(spark, d), shared_path(spark, "windows")
    counts = ingest.windowed_counts(ingest.file_source(spark, root, files=100), "collected_at", "source")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/v={number}")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = max(int(n[2:]) for n in publish.Folder(spark, out).names() if n.startswith("v="))
    return spark.read.parquet(f"{out}/v={last}").groupBy("source").agg(F.sum("n").alias("n"))


@query("ST_08_resume", "SELECT COUNT(*) AS rows FROM realtime_analyzer WHERE trim(event_id) <> '' AND trim(source) <> '' AND trim(url) <> '' AND trim(title) <> ''")
def st08(spark, d):
    """A second run with the same checkpoint finds nothing new."""
    root, out = _feed(spark, d), shared_path(spark, "resume")
    for _ in range(2):
        ingest.land(ingest.file_source(spark, root), out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/valid").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {k: f for k, (f, _) in _F.items()}
SQL = {k: with_views(s) for k, (_, s) in _F.items() if s}
