"""Protocols end to end: queues, change feeds, guarded loads, snapshots, learning. Each query runs its protocol, faults and replays included,
and returns what can be counted from the tables themselves."""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlake.functions import text as T
from loomlake.operators import dq, learning, mentions, publish
from loomlake.operators import timeseries as TS
from loomlake.operators.outbox import Outbox, paused
from loomlake.plans.fixtures import fixture, with_views
from loomlake.plans.more import _matched
from loomlake.plans.timeseries import _CAL, _CASES, _cases, _series
from loomlake.session import shared_path, written
from loomlake.sources import readers
from loomlake.sources.tables import table
from loomlake.streaming import ingest

_F: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _F[name] = (f, sql)
        return f

    return add


@query("S_10_historical", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'v2' ELSE 'v1' END AS model FROM fx_event")
def s10(spark, d):
    """All verified runs of analysed rows, the newest run of each event; a run without a marker is not read."""
    root, e = shared_path(spark, "s10"), fixture(spark, d, "fx_event").select("event_id")
    publish.publish(e.withColumn("model", F.lit("v1")), root, "2024-01-01", ["event_id"])
    publish.publish(e.filter("event_id % 2 = 0").withColumn("model", F.lit("v2")), root, "2024-02-01", ["event_id"])
    e.withColumn("model", F.lit("unverified")).write.parquet(f"{root}/run-2024-03-01T00/data")
    runs = [json.loads(t) for n, t in ((n, publish.Folder(spark, root).get(n)) for n in publish.Folder(spark, root).names() if n.startswith("VERIFIED-"))]
    rows = None
    for m in runs:
        r = spark.read.parquet(f"{root}/{m['run']}/data").withColumn("as_of", F.lit(m["as_of"]))
        rows = r if rows is None else rows.unionByName(r)
    return readers.article_store(rows, "as_of", "event_id").select("event_id", "model")


@query("S_24_latest_run", "SELECT '2024-02-01' AS as_of, COUNT(*) AS rows FROM fx_company WHERE company_id % 3 <> 0")
def s24(spark, d):
    """Of several runs the verified one with the newest as-of, in whatever order they were written; its own count of rows."""
    root = shared_path(spark, "s24")
    c = fixture(spark, d, "fx_company").select("company_id", "name")
    publish.publish(c, root, "2024-01-01", ["company_id"])
    publish.publish(c.filter("company_id % 3 <> 0"), root, "2024-02-01", ["company_id"])
    publish.Folder(spark, root).put("manifest-of-a-run-under-way", json.dumps({"run": "x", "as_of": "2024-09-01", "rows": 0}))
    m = publish.latest(spark, root)
    return spark.createDataFrame([(m["as_of"], m["rows"])], "as_of string, rows long")


@query("S_25_table_read", "SELECT market, COUNT(*) AS companies FROM fx_company WHERE status = 'ACTIVE' GROUP BY 1")
def s25(spark, d):
    """A service table read in ranges of its key, one query a range as a partitioned JDBC read sends them, filter and columns in each."""
    root = shared_path(spark, "s25")
    fixture(spark, d, "fx_company").write.parquet(root)
    parts = readers.ranged(spark.read.parquet(root), "company_id", 4)
    rows = None
    for where in parts:
        r = spark.read.parquet(root).filter(where).filter("status = 'ACTIVE'").select("market")
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy("market").agg(F.count(F.lit(1)).alias("companies"))


@query("S_19_providers", "WITH k AS (SELECT ticker, market, CASE WHEN market IN ('KOSPI', 'KOSDAQ') THEN 'domestic' ELSE 'overseas' END AS provider, listed_at, delisted_at FROM companies) SELECT provider, market, COUNT(*) AS companies, SUM(CASE WHEN delisted_at IS NULL THEN 1 ELSE 0 END) AS open_ended FROM k GROUP BY 1, 2")
def s19(spark, d):
    """Which provider is asked for which company, and where the range asked for has no end."""
    c = table(spark, d, "companies")
    asked = readers.asked_of(c, "market", {"KOSPI": "domestic", "KOSDAQ": "domestic"}, "overseas")
    return asked.groupBy("provider", "market").agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("delisted_at").isNull()).alias("open_ended"))


@query("S_20_combined_prices", "SELECT company_id, trading_date, close_price, low_price, volume FROM fx_price")
def s20(spark, d):
    """Collected price files, one CSV a company, combined into one typed Parquet table that holds each bar once; one file came twice."""
    root, out, p = shared_path(spark, "s20"), shared_path(spark, "s20-combined"), fixture(spark, d, "fx_price")
    p.write.partitionBy("company_id").option("header", True).csv(f"{root}/first")
    p.filter("company_id = 3").write.partitionBy("company_id").option("header", True).csv(f"{root}/again")
    schema = "trading_date date, close_price decimal(20,4), low_price decimal(20,4), volume long, company_id long"
    readers.combine_csv(spark, [f"{root}/first", f"{root}/again"], schema, ["company_id", "trading_date"]).write.parquet(out)
    return spark.read.parquet(out).select("company_id", "trading_date", "close_price", "low_price", "volume")


@query("S_21_landed_statements", "SELECT json_extract_string(record, '$.form') AS form, COUNT(*) AS records, SUM(CAST(json_extract_string(record, '$.size') AS BIGINT)) AS size, SUM(CAST(json_extract_string(record, '$.items') AS BIGINT)) AS items FROM run_sec_incremental WHERE record IS NOT NULL AND json_valid(record) GROUP BY 1")
def s21(spark, d):
    """Landed filings with their figures, the schema given, unreadable records left out and counted by the check before (S-12)."""
    r = table(spark, d, "run_sec_incremental").filter("record is not null").select(F.from_json("record", "form string, size long, items long").alias("r"), F.get_json_object("record", "$").isNotNull().alias("ok"))
    return r.filter("ok").groupBy("r.form").agg(F.count(F.lit(1)).alias("records"), F.sum("r.size").alias("size"), F.sum("r.items").alias("items"))


@query("S_22_landed_news", "SELECT source, COUNT(*) AS rows, COUNT(*) FILTER (title IS NULL OR trim(title) = '') AS untitled FROM realtime_analyzer WHERE source IS NOT NULL GROUP BY 1")
def s22(spark, d):
    """Landed news as JSON lines, read with a given schema; a line that does not parse would fail the read."""
    root = shared_path(spark, "s22")
    table(spark, d, "realtime_analyzer").select("event_id", "source", "title", "content").write.json(root)
    n = readers.strict_jsonl(spark, root, "event_id string, source string, title string, content string").filter("source is not null")
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("title").isNull() | (F.trim("title") == "")).alias("untitled"))


@query("S_23_landed_filings", "SELECT status, COUNT(*) AS files, COUNT(*) FILTER (hdfs_path IS NULL) AS without_path, CAST(SUM(file_bytes) AS BIGINT) AS bytes, MAX(failures) AS failures FROM run_sec_incremental GROUP BY 1")
def s23(spark, d):
    """The collectors' own index of filings by state."""
    t = table(spark, d, "run_sec_incremental")
    return t.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("hdfs_path").isNull()).alias("without_path"), F.sum("file_bytes").alias("bytes"), F.max("failures").alias("failures"))


@query("K_01_write_once", "SELECT market, COUNT(*) AS rows, 1 AS refused FROM fx_company GROUP BY 1")
def k01(spark, d):
    """A second write to the same place is refused and leaves the first as it was."""
    root, refused = shared_path(spark, "k01"), 0
    c = fixture(spark, d, "fx_company")
    c.write.mode("errorifexists").partitionBy("market").parquet(root)
    try:
        c.union(c).write.mode("errorifexists").partitionBy("market").parquet(root)
    except AnalysisException:
        refused = 1
    return spark.read.parquet(root).groupBy("market").agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused))


@query("K_04_shard", "SELECT * FROM (SELECT 'missing' AS side, src, dst, rel, n FROM (SELECT src, dst, rel, n FROM fx_edge EXCEPT ALL SELECT src, dst, rel, CASE WHEN n % 7 = 0 THEN n + 1 ELSE n END FROM fx_edge WHERE n % 5 <> 0)) UNION ALL SELECT 'extra', src, dst, rel, n FROM (SELECT src, dst, rel, CASE WHEN n % 7 = 0 THEN n + 1 ELSE n END AS n FROM fx_edge WHERE n % 5 <> 0 EXCEPT ALL SELECT src, dst, rel, n FROM fx_edge)")
def k04(spark, d):
    """A shard read back against what it should hold, in both directions with repeats; this one was damaged on purpose."""
    root, e = shared_path(spark, "k04"), fixture(spark, d, "fx_edge").select("src", "dst", "rel", "n")
    e.filter("n % 5 <> 0").withColumn("n", F.when(F.col("n") % 7 == 0, F.col("n") + 1).otherwise(F.col("n"))).write.parquet(root)
    stored = spark.read.parquet(root)
    if publish.same_bag(e, stored):
        raise ValueError("a damaged shard was taken for whole")
    return e.exceptAll(stored).withColumn("side", F.lit("missing")).unionByName(stored.exceptAll(e).withColumn("side", F.lit("extra")))


@query("K_07_manifest_text", "SELECT line FROM (SELECT 'events: ' || COUNT(*) AS line FROM fx_event UNION ALL SELECT 'companies: ' || COUNT(*) FROM fx_company UNION ALL SELECT 'edges: ' || COUNT(*) FROM fx_edge)")
def k07(spark, d):
    """The manifest as a text file of one line a dataset, written by the JVM and read back."""
    root, lines = shared_path(spark, "k07"), None
    for name, view in (("events", "fx_event"), ("companies", "fx_company"), ("edges", "fx_edge")):
        n = fixture(spark, d, view).agg(F.concat(F.lit(f"{name}: "), F.count(F.lit(1)).cast("string")).alias("value"))
        lines = n if lines is None else lines.unionByName(n)
    lines.coalesce(1).write.text(root)
    return spark.read.text(root).select(F.col("value").alias("line"))


_K10 = """WITH t AS (SELECT row_id, event_id, url, region, kafka_partition p, kafka_offset o FROM realtime_analyzer WHERE url IS NOT NULL AND trim(event_id) <> ''), e AS (SELECT event_id, url, p, MAX(o) AS o, MIN(region) AS region FROM t GROUP BY 1, 2, 3),
q AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY url ORDER BY p, o DESC, event_id DESC) AS rn FROM e) WHERE rn = 1)
SELECT region, CASE WHEN o % 5 = 0 THEN 'pending' ELSE 'sent' END AS state, COUNT(*) AS rows, SUM(CASE WHEN o % 5 = 0 THEN 2 ELSE 1 END) AS attempts FROM q GROUP BY 1, 2"""


@query("K_10_outbox", _K10)
def k10(spark, d):
    """Pages are queued once, partition by partition, one batch replayed; a fifth of the deliveries fails, twice; the rest is acknowledged."""
    t = table(spark, d, "realtime_analyzer").filter("url is not null and trim(event_id) <> ''")
    e = written(t.groupBy("event_id", "url", "kafka_partition").agg(F.max("kafka_offset").alias("o"), F.min("region").alias("region")), "k10-events")
    box = Outbox(spark, shared_path(spark, "outbox"), "event_id string, url string, o long, region string")
    parts = sorted(r[0] for r in e.select("kafka_partition").distinct().collect() if r[0] is not None)  # a topic's partitions
    for p in [*parts[:2], *parts[1:2], *parts[2:]]:
        box.enqueue(e.filter(F.col("kafka_partition") == p).drop("kafka_partition"), F.col("o"), f"partition-{p}")

    def deliver(rows):
        rows = rows.withColumn("bad", F.col("o") % 5 == 0)
        acks = rows.filter("not bad").select("event_id", F.lit("2024-01-01").cast("timestamp").alias("delivered_at"), F.lit(0).alias("partition"), F.col("o").alias("offset"))
        return acks, rows.filter("bad").select("event_id", F.lit("broker is away").alias("error"))

    for k in range(2):
        box.publish(deliver, ["o", "event_id"], 1_000_000, f"run-{k}")
    return box.events().groupBy("region", "state").agg(F.count(F.lit(1)).alias("rows"), F.sum("attempts").alias("attempts"))


@query("K_15_supersede", "SELECT '2024-01-01' AS as_of, 'SUPERSEDED' AS status, COUNT(*) AS scores FROM fx_edge UNION ALL SELECT '2024-02-01', 'CURRENT', COUNT(*) FROM fx_edge WHERE strength >= 0.5")
def k15(spark, d):
    """Scores are replaced as a whole by one marker; the snapshot before is superseded, and a failed third leaves both as they are."""
    root, e = shared_path(spark, "k15"), fixture(spark, d, "fx_edge")
    publish.publish(e, root, "2024-01-01", ["src", "dst", "rel"])
    publish.publish(e.filter("strength >= 0.5"), root, "2024-02-01", ["src", "dst", "rel"])
    try:
        publish.publish(e.union(e), root, "2024-03-01", ["src", "dst", "rel"])  # repeated keys
    except ValueError:
        pass
    return publish.snapshots(spark, root).select("as_of", "status", F.col("rows").alias("scores"))


_K21 = """WITH s AS (SELECT l_orderkey AS evidence_id, s_name AS name, l_quantity AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1), k AS (SELECT evidence_id, MAX(name) AS name, MAX(score) AS score FROM s GROUP BY 1),
r AS (SELECT k.*, c.company_id FROM k LEFT JOIN (SELECT * FROM fx_company WHERE company_id % 10 <> 0) c USING (name)), o AS (SELECT o_orderkey AS evidence_id, o_custkey AS company_id, CAST(-1 AS DOUBLE) AS score FROM orders)
SELECT CASE WHEN r.company_id IS NOT NULL THEN 'loaded' WHEN o.evidence_id IS NOT NULL THEN 'kept' ELSE 'rejected' END AS state, COUNT(*) AS rows FROM r FULL JOIN o USING (evidence_id) GROUP BY 1"""


@query("K_21_staged_load", _K21)
def k21(spark, d):
    """Staged rows get their keys by natural name; what has no key is set aside, guards must hold, then rows of the same key are replaced."""
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    stage = table(spark, d, "lineitem").filter("l_linenumber = 1").join(names, "l_suppkey").groupBy(F.col("l_orderkey").alias("evidence_id")).agg(F.max("name").alias("name"), F.max("l_quantity").alias("score"))
    target = table(spark, d, "orders").select(F.col("o_orderkey").alias("evidence_id"), F.col("o_custkey").alias("company_id"), F.lit(-1.0).alias("score"))
    known = fixture(spark, d, "fx_company").filter("company_id % 10 <> 0").select("name", "company_id")
    loaded, rejected = publish.staged_load(stage, target, known, "name", "evidence_id", least_resolved=0.5)
    mine = loaded.select("evidence_id", F.when(F.col("score") < 0, "kept").otherwise("loaded").alias("state"))
    lost = rejected.join(target.select("evidence_id"), "evidence_id", "left_anti").select("evidence_id", F.lit("rejected").alias("state"))
    return mine.unionByName(lost).groupBy("state").agg(F.count(F.lit(1)).alias("rows"))


@query("K_22_stale", "SELECT src, dst, rel FROM fx_edge e WHERE EXISTS (SELECT 1 FROM lineitem WHERE LEAST(l_suppkey % 40, l_partkey % 40) = e.src AND GREATEST(l_suppkey % 40, l_partkey % 40) = e.dst AND l_discount >= 0.1 AND l_quantity >= 49)")
def k22(spark, d):
    """Rows that the resolved set, computed anew from its sources, does not hold are removed."""
    a, b = F.col("l_suppkey") % 40, F.col("l_partkey") % 40
    resolved = table(spark, d, "lineitem").filter("l_discount >= 0.1 and l_quantity >= 49").select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()
    return fixture(spark, d, "fx_edge").join(resolved, ["src", "dst"], "left_semi").select("src", "dst", "rel")


@query("Q_05_schema", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS stored, 'date' AS declared FROM (DESCRIBE lineitem) WHERE column_name LIKE 'l_ship%' UNION ALL SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' ELSE column_type END, 'string' FROM (DESCRIBE lineitem) WHERE column_name = 'l_partkey' UNION ALL SELECT 'l_comment', NULL, 'string'")
def q05(spark, d):
    """A declaration with three faults: another type, another type, a column that is not there."""
    df = table(spark, d, "lineitem")
    declared = dict(df.dtypes) | {"l_shipdate": "date", "l_partkey": "string", "l_comment": "string"}
    rows = [(n, dict(df.dtypes).get(n), t) for n, t in declared.items() if dict(df.dtypes).get(n) != t]
    if len(rows) != len(dq.schema_differences(df, declared)):
        raise ValueError("the check and the list of differences disagree")
    return spark.createDataFrame(rows, "name string, stored string, declared string")


@query("Q_09_monotonic", "SELECT company_id, name FROM fx_company WHERE company_id > 3")
def q09(spark, d):
    """Two runs in order, an exact retry, and two that are refused: an older one and another content under the same as-of. What is read is the second run."""
    root, c = shared_path(spark, "q09"), fixture(spark, d, "fx_company").select("company_id", "name")
    second = c.filter("company_id > 3")
    publish.publish(c, root, "2024-01-01", ["company_id"])
    run = publish.publish(second, root, "2024-02-01", ["company_id"])
    if publish.publish(second, root, "2024-02-01", ["company_id"]) != run:
        raise ValueError("a retry made another run")
    for rows, as_of in ((c, "2023-01-01"), (c, "2024-02-01")):
        try:
            publish.publish(rows, root, as_of, ["company_id"])
        except ValueError:
            continue
        raise RuntimeError(f"{as_of} was taken")
    return spark.read.parquet(f"{root}/{publish.latest(spark, root)['run']}/data")


@query("ST_02_bounded_batches", "SELECT kafka_partition AS partition, 1 AS batches, COUNT(*) AS rows FROM realtime_analyzer WHERE trim(event_id) <> '' AND trim(source) <> '' AND trim(url) <> '' AND trim(title) <> '' AND ingested_at IS NOT NULL AND kafka_partition IS NOT NULL GROUP BY 1")
def st02(spark, d):
    """One file a trigger, one file a topic partition: every partition comes in one batch of its own."""
    root, out = shared_path(spark, "bounded-feed"), shared_path(spark, "bounded")
    t = table(spark, d, "realtime_analyzer").filter("kafka_partition is not null")
    rows = t.select("event_id", "source", "url", "title", F.col("ingested_at").cast("timestamp").alias("collected_at"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"))
    rows.repartition(1, "partition").write.option("maxRecordsPerFile", 0).partitionBy("partition").parquet(root)
    stream = spark.readStream.schema(ingest.EVENT).option("maxFilesPerTrigger", 1).parquet(root)
    ingest.land(stream, out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/valid").groupBy("partition").agg(F.count_distinct("batch").cast("int").alias("batches"), F.count(F.lit(1)).alias("rows"))


_ST03 = """WITH b AS (SELECT kafka_partition AS partition, MIN(kafka_offset) AS low, MAX(kafka_offset) + 1 AS high FROM realtime_analyzer WHERE kafka_partition IS NOT NULL GROUP BY 1),
p AS (SELECT partition, CASE partition % 4 WHEN 0 THEN low - 1 WHEN 1 THEN high + 5 WHEN 2 THEN low + 3 ELSE high END AS n, CASE WHEN partition % 4 = 2 THEN low + 4 ELSE low END AS c FROM b UNION ALL SELECT 99, 0, 0)
SELECT * FROM (SELECT p.partition, CASE WHEN low IS NULL THEN 'unknown' WHEN n < low THEN 'gap' WHEN n > high THEN 'truncated' WHEN c > n THEN 'commit_ahead' END AS fault FROM p LEFT JOIN b USING (partition)) WHERE fault IS NOT NULL"""


@query("ST_03_offset_faults", _ST03)
def st03(spark, d):
    """Where each partition would read on, against what the topic keeps; a start with faults is refused."""
    b = table(spark, d, "realtime_analyzer").filter("kafka_partition is not null").groupBy(F.col("kafka_partition").alias("partition")).agg(F.min("kafka_offset").alias("low"), (F.max("kafka_offset") + 1).alias("high"))
    k = F.col("partition") % 4
    p = b.select("partition", F.when(k == 0, F.col("low") - 1).when(k == 1, F.col("high") + 5).when(k == 2, F.col("low") + 3).otherwise(F.col("high")).alias("next_offset"), F.when(k == 2, F.col("low") + 4).otherwise(F.col("low")).alias("committed"))
    p = p.unionByName(spark.createDataFrame([(99, 0, 0)], "partition int, next_offset long, committed long"))
    try:
        ingest.checked(p, b)
    except ValueError:
        return ingest.offset_faults(p, b)
    raise RuntimeError("faulty offsets were taken")


@query("ST_06_change_feed", "SELECT user_id, event_type, dateline FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY dateline DESC, status DESC) AS rn FROM fx_event) WHERE rn = 1 AND status <> 'CANCELLED'")
def st06(spark, d):
    """Polls of five days that overlap by a quarter of an hour, one of them repeated: the state is the newest change of each key, the cancelled taken out."""
    feed = written(fixture(spark, d, "fx_event").select("user_id", "event_type", "status", "dateline"), "st06-feed")
    first, last = feed.agg(F.date_format(F.min("dateline"), "yyyy-MM-dd"), F.date_format(F.max("dateline"), "yyyy-MM-dd")).first()
    if first is None:
        return feed.select("user_id", "event_type", "dateline")
    a, b = date.fromisoformat(first), date.fromisoformat(last)
    days = [str(a + timedelta(days=k)) for k in range(0, (b - a).days + 6, 5)]
    state = None
    polls = list(zip(days, days[1:]))
    for since, until in [*polls[:2], *polls[1:2], *polls[2:]]:
        state = written(ingest.apply_changes(state, ingest.poll_changes(feed, "user_id", "status", "dateline", f"{since} 00:00:00", f"{until} 00:00:00"), "user_id", "dateline"), "st06-state")
    return state.filter("status <> 'CANCELLED'").select("user_id", "event_type", "dateline")


@query("ST_10_backpressure", "SELECT region, COUNT(*) AS rows, CAST(COALESCE(SUM(length(content)), 0) AS BIGINT) AS bytes, COUNT(*) >= 200 OR COALESCE(SUM(length(content)), 0) >= 1000000000 AS paused FROM realtime_analyzer WHERE region IS NOT NULL GROUP BY 1")
def st10(spark, d):
    """Collection of a region pauses at 200 rows pending."""
    t = table(spark, d, "realtime_analyzer").filter("region is not null")
    out = None
    for r in sorted(x[0] for x in t.select("region").distinct().collect()):  # two regions
        p = paused(t.filter(F.col("region") == r), F.length("content"), 200, 1_000_000_000).withColumn("region", F.lit(r))
        out = p if out is None else out.unionByName(p)
    return out


_TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_X30 = f"""WITH {_CAL}, {_CASES}, dl AS (SELECT company_id, idx, CASE WHEN idx - lag(idx) OVER w = 1 THEN close / lag(close) OVER w - base / lag(base) OVER w END AS ar, lag(close, 1) OVER w / lag(close, 6) OVER w - 1 AS r5 FROM sr WINDOW w AS (PARTITION BY company_id ORDER BY idx)),
sg AS (SELECT *, CASE WHEN COUNT(ar) OVER v >= 20 AND stddev_samp(ar) OVER v > 0 THEN stddev_samp(ar) OVER v END AS s FROM dl WINDOW v AS (PARTITION BY company_id ORDER BY idx RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING)),
bz AS (SELECT news_id, COUNT(*) OVER (PARTITION BY company_id ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) / (COUNT(*) OVER (PARTITION BY company_id ORDER BY dn RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) / 30.0 + 1) AS buzz FROM (SELECT *, CAST(trading_date - DATE '1990-01-01' AS BIGINT) AS dn FROM cs))
SELECT cs.news_id, cs.company_id, round(sg.s, 6) AS vol_60, round(sg.r5, 8) AS ret_5d, round(buzz, 8) AS buzz_ratio, round(sg.ar / sg.s, 6) AS z, CASE WHEN sg.ar IS NULL OR sg.s IS NULL THEN NULL WHEN round(sg.ar / sg.s, 6) < -0.5 THEN 'NEGATIVE' WHEN round(sg.ar / sg.s, 6) > 0.5 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS label,
 {", ".join(f"CAST(event_type = '{t}' AS INT) AS cat_{k}" for k, t in enumerate(_TYPES))} FROM cs JOIN bz USING (news_id) LEFT JOIN sg ON sg.company_id = cs.company_id AND sg.idx = cs.idx"""


def features(spark, d, least: int = 20):
    """A row per case: abnormal return of its day in deviations and the label, buzz, five-day return, volatility, the vocabulary as columns."""
    cases = written(_cases(spark, d), "x30-cases")
    series = TS.rolling_sigma(TS.daily_abnormal(_series(spark, d), "company_id"), "company_id", 60, least)
    w = Window.partitionBy("company_id").orderBy("idx")
    bars = series.select("company_id", "idx", "ar", "sigma", (F.lag("close", 1).over(w) / F.lag("close", 6).over(w) - 1).alias("r5"))
    day = F.datediff("trading_date", F.lit("1990-01-01").cast("date"))
    c = {n: F.count(F.lit(1)).over(Window.partitionBy("company_id").orderBy("dn").rangeBetween(-n, -1)) for n in (1, 30)}
    rows = cases.withColumn("dn", day).withColumn("buzz_ratio", F.round(c[1] / (c[30] / 30 + 1), 8)).join(bars, ["company_id", "idx"], "left")
    z = F.round(F.col("ar") / F.col("sigma"), 6)
    cats = [(F.col("event_type") == t).cast("int").alias(f"cat_{k}") for k, t in enumerate(learning.vocabulary(cases, "news_id", "event_type"))]
    return rows.select("news_id", "company_id", "trading_date", F.round("sigma", 6).alias("vol_60"), F.round("r5", 8).alias("ret_5d"), "buzz_ratio", z.alias("z"), TS.z_label(z).alias("label"), *cats)


@query("X_30_features", _X30)
def x30(spark, d):
    return features(spark, d).drop("trading_date")


@query("X_31_time_split", "SELECT CASE WHEN trading_date <= DATE '1999-12-31' THEN 'TRAIN' WHEN trading_date <= DATE '2000-12-31' THEN 'VALID' ELSE 'TEST' END AS part, COUNT(*) AS n FROM fx_price GROUP BY 1")
def x31(spark, d):
    return fixture(spark, d, "fx_price").groupBy(learning.split_by_time(F.col("trading_date"), "1999-12-31", "2000-12-31").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("X_31_pair_split", "SELECT part, COUNT(*) AS pairs FROM (SELECT CASE WHEN b < 80 THEN 'TRAIN' WHEN b < 90 THEN 'VALID' ELSE 'TEST' END AS part FROM (SELECT ('0x' || substr(sha1(LEAST(src::VARCHAR, dst::VARCHAR) || '|' || GREATEST(src::VARCHAR, dst::VARCHAR)), 1, 8))::BIGINT % 100 AS b FROM (SELECT DISTINCT src, dst FROM fx_edge))) GROUP BY 1")
def x31_pairs(spark, d):
    p = fixture(spark, d, "fx_edge").select("src", "dst").distinct()
    return p.groupBy(learning.split_by_pair(F.col("src"), F.col("dst")).alias("part")).agg(F.count(F.lit(1)).alias("pairs"))


@query("X_31_purged")
def x31_purged(spark, d):
    """Sentences of two companies, split by pair; those of the validation and test parts that stand nearly so in training are purged."""
    p = mentions.pair_candidates(_matched(spark, d)).select("id", "sentence", "a", "b", learning.split_by_pair(F.col("a"), F.col("b")).alias("part"))
    p = written(p, "x31-sentences")
    train = p.filter("part = 'TRAIN'")
    left = learning.purge_seen(p.filter("part <> 'TRAIN'"), train, "id", "sentence")
    return train.unionByName(left).groupBy("part").agg(F.count(F.lit(1)).alias("sentences"), F.count_distinct("sentence").alias("texts"))


@query("X_32_boosted")
def x32_boosted(spark, d):
    """Boosted trees on the feature frame, calibrated on the half year after training, scored on the rest; the grid of thresholds and the one chosen.
    Five days are enough for a deviation here, as the stand-in prices have many gaps."""
    f = written(features(spark, d, 5).filter("label is not null").withColumn("part", learning.split_by_time(F.col("trading_date"), "1999-12-31", "2000-06-30")), "x32-frame")
    cols = ["vol_60", "ret_5d", "buzz_ratio", *[c for c in f.columns if c.startswith("cat_")]]
    model = learning.Boosted(cols, "label", ["NEGATIVE", "NEUTRAL", "POSITIVE"]).fit(f.filter("part = 'TRAIN'"), f.filter("part = 'VALID'"))
    grid = written(learning.tau_grid(model.predict(f.filter("part = 'TEST'")), "label", (0.34, 0.4, 0.45, 0.5, 0.6, 0.7), "NEUTRAL"), "x32-grid")
    return grid.withColumn("chosen", F.col("tau") == learning.choose_tau(grid))


@query("F_09_uuid5", "SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h, 17, 1))::BIGINT % 4 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT event_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(CAST(event_id AS VARCHAR))) AS h FROM fx_event)")
def f09(spark, d):
    return fixture(spark, d, "fx_event").select("event_id", T.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("event_id").cast("string")).alias("uuid"))


@query("F_10_bucket", "SELECT event_id, ('0x' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS bucket FROM fx_event")
def f10(spark, d):
    return fixture(spark, d, "fx_event").select("event_id", T.bucket(F.col("event_id").cast("string")).alias("bucket"))


@query("F_16_shingles", "WITH t AS (SELECT document_id, title, substr(body, length(title) + 1) AS rest FROM fx_document WHERE title IS NOT NULL), g AS (SELECT document_id, list_distinct(list_transform(range(1, GREATEST(1, length(title) - 2) + 1), lambda k: substr(title, k, 3))) AS a, list_distinct(list_transform(range(1, GREATEST(1, length(rest) - 2) + 1), lambda k: substr(rest, k, 3))) AS b FROM t) SELECT document_id, round(len(list_intersect(a, b)) / CAST(LEAST(len(a), len(b)) AS DOUBLE), 6) AS overlap FROM g")
def f16(spark, d):
    """A title against all of the text behind it."""
    t = fixture(spark, d, "fx_document").filter("title is not null")
    return t.select("document_id", F.round(T.shingle_overlap(F.col("title"), F.substring("body", F.length("title") + 1, F.length("body"))), 6).alias("overlap"))


@query("E_01_event_detail", "WITH i AS (SELECT event_id, COUNT(*) AS impacts, MAX(round(score, 6)) AS top FROM fx_impact WHERE status = 'OK' GROUP BY 1) SELECT e.event_id, c.name, c.industry, e.event_type, COALESCE(i.impacts, 0) AS impacts, i.top, COALESCE(n.documents, 0) AS documents FROM fx_event e JOIN fx_company c USING (company_id) LEFT JOIN i USING (event_id) LEFT JOIN (SELECT company_id, COUNT(*) AS documents FROM fx_document GROUP BY 1) n ON n.company_id = e.company_id WHERE e.status = 'ACTIVE'")
def e01(spark, d):
    """The event page: the event with its company, impacts that are sure, and documents of the company; all events at once."""
    i = fixture(spark, d, "fx_impact").filter("status = 'OK'").groupBy("event_id").agg(F.count(F.lit(1)).alias("impacts"), F.max(F.round("score", 6)).alias("top"))
    n = fixture(spark, d, "fx_document").groupBy("company_id").agg(F.count(F.lit(1)).alias("documents"))
    e = fixture(spark, d, "fx_event").filter("status = 'ACTIVE'").join(fixture(spark, d, "fx_company").select("company_id", "name", "industry"), "company_id").join(i, "event_id", "left").join(n, "company_id", "left")
    return e.select("event_id", "name", "industry", "event_type", F.coalesce("impacts", F.lit(0)).alias("impacts"), "top", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("E_02_company_page", "WITH p AS (SELECT company_id, max_by(close_price, trading_date) AS close, MAX(trading_date) AS day FROM fx_price GROUP BY 1), r AS (SELECT me, COUNT(*) AS relations, COUNT(DISTINCT other) AS counterparts FROM (SELECT src AS me, dst AS other FROM fx_edge UNION ALL SELECT dst, src FROM fx_edge) GROUP BY 1), v AS (SELECT company_id, COUNT(*) FILTER (status = 'ACTIVE') AS events, MAX(dateline) AS latest FROM fx_event GROUP BY 1) SELECT c.company_id, c.name, c.market, p.close, p.day, COALESCE(relations, 0) AS relations, COALESCE(counterparts, 0) AS counterparts, COALESCE(events, 0) AS events, latest FROM fx_company c LEFT JOIN p USING (company_id) LEFT JOIN r ON r.me = c.company_id LEFT JOIN v USING (company_id) WHERE c.status = 'ACTIVE'")
def e02(spark, d):
    """The company page: last close, relations and counterparts, events; all active companies at once."""
    p = fixture(spark, d, "fx_price").groupBy("company_id").agg(F.max_by("close_price", "trading_date").alias("close"), F.max("trading_date").alias("day"))
    ends = fixture(spark, d, "fx_edge").select(F.inline(F.array(F.struct(F.col("src").alias("company_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("company_id"), F.col("src").alias("other")))))
    r = ends.groupBy("company_id").agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("other").alias("counterparts"))
    v = fixture(spark, d, "fx_event").groupBy("company_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("events"), F.max("dateline").alias("latest"))
    c = fixture(spark, d, "fx_company").filter("status = 'ACTIVE'").join(p, "company_id", "left").join(r, "company_id", "left").join(v, "company_id", "left")
    return c.select("company_id", "name", "market", "close", "day", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("relations", "counterparts", "events")], "latest")


QUERIES = {k: f for k, (f, _) in _F.items()}
SQL = {k: with_views(s) for k, (_, s) in _F.items() if s}
