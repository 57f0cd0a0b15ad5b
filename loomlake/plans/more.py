"""Further inventory entries: row-wise text rules through Arrow batches, remaining joins, checks and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions import text as T
from loomlake.functions.normalise import folded_with_offsets
from loomlake.operators import dq, linking, mentions, publish, scores
from loomlake.operators.serving import replace_keys, top_per
from loomlake.plans.fixtures import fixture, with_views
from loomlake.session import shared_path
from loomlake.sources import readers
from loomlake.sources.tables import table

_F: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _F[name] = (f, sql)
        return f

    return add


def by_row(df: DataFrame, id_: str, text: str, rule: Callable[[str], list[tuple]], fields: list[tuple[str, str]]) -> DataFrame:
    """Rows (id, fields ...) that a text rule yields; Arrow batches in, Arrow batches out."""
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for r in rule(t) if t is not None else ():
                    at.append(k)
                    rows.append(r)
            cols = list(zip(*rows)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(list(c), types[t]) for c, (_, t) in zip(cols, fields)]], names=["id", *[n for n, _ in fields]])

    kind = df.schema[id_].dataType.simpleString()
    return df.select(df[id_].alias("id"), df[text].alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in fields))


def _docs(spark, d):
    return fixture(spark, d, "fx_document").filter("body is not null")


@query("F_01_sentences")
def f01(spark, d):
    return by_row(_docs(spark, d), "document_id", "body", T.sentences, [("start", "int"), ("end", "int"), ("sentence", "string")])


@query("F_02_sentences_seen")
def f02(spark, d):
    """No visible character is lost: the sentences of a document hold all of them; one without a visible character counts 0."""
    s = by_row(_docs(spark, d), "document_id", "body", lambda x: [(sum(len("".join(r[2].split())) for r in T.sentences(x)),)], [("n", "int")])
    return s.select(F.col("id").alias("document_id"), F.col("n").cast("long").alias("visible"))


@query("F_03_segments", "SELECT document_id, length(body) AS n FROM fx_document WHERE length(body) > 0")
def f03(spark, d):
    """Segments concatenate to the text, so their lengths add up to it."""
    s = by_row(_docs(spark, d), "document_id", "body", lambda x: [(len(p),) for p in T.segments(x)], [("n", "int")])
    return s.groupBy(F.col("id").alias("document_id")).agg(F.sum("n").alias("n"))


def standalone_sql(word: str) -> str:
    """Where a word of its own stands first, or -1; the particles are those of the operator."""
    edge = "[^0-9A-Za-z가-힣]"
    pattern = rf"(?is)^(.*?{edge}|){word}(?:$|{edge}|(?:{T.PARTICLES})(?:$|{edge}))"
    return f"SELECT document_id AS id, CASE WHEN regexp_matches(body, '{pattern}') THEN length(regexp_extract(body, '{pattern}', 1)) ELSE -1 END AS at FROM fx_document WHERE body IS NOT NULL"


@query("F_12_standalone", standalone_sql(r"market\s*share"))
def f12(spark, d):
    return by_row(_docs(spark, d), "document_id", "body", lambda x: [(T.standalone(x, "market share"),)], [("at", "int")])


@query("F_15_folded")
def f15(spark, d):
    def rule(x):
        t, at = folded_with_offsets(x)
        return [(t[:80], at[min(79, len(at) - 1)] if at else 0)]

    return by_row(_docs(spark, d), "document_id", "body", rule, [("folded", "string"), ("source_offset", "int")])


@query("F_23_saturation", "SELECT event_id, round(100 * (1 - exp(-value / 5)), 6) AS saturated, round(ln(1 + value) / ln(101), 6) AS share FROM fx_event")
def f23(spark, d):
    v = F.col("value")
    return fixture(spark, d, "fx_event").select("event_id", F.round(-100 * F.expm1(-v / 5), 6).alias("saturated"), F.round(F.log1p(v) / F.log1p(F.lit(100.0)), 6).alias("share"))


@query("F_24_npmi", "WITH x AS (SELECT DISTINCT 1 + event_id % 100 AS n, 1 + event_id % 100 + user_id % 7 AS a, 100 + user_id % 11 AS b FROM fx_event) SELECT n, a, b, round(CASE WHEN n = 120 THEN 1 ELSE ln(n * 120.0 / (CAST(a AS DOUBLE) * b)) / -ln(n / 120.0) END, 6) AS npmi FROM x")
def f24(spark, d):
    """Pairs in n of 120 documents, their ends in a and b of them."""
    from loomlake.operators.graph import npmi

    x = fixture(spark, d, "fx_event").select((1 + F.col("event_id") % 100).alias("n"), (1 + F.col("event_id") % 100 + F.col("user_id") % 7).alias("a"), (100 + F.col("user_id") % 11).alias("b")).distinct()
    return x.select("n", "a", "b", npmi(F.col("n"), F.col("a"), F.col("b"), F.lit(120)).alias("npmi"))


@query("F_35_probabilities", "SELECT event_id, a / s AS neg, b / s AS neu, c / s AS pos FROM (SELECT event_id, 1 + event_id % 3 AS a, 1 + event_id % 5 AS b, 1 + event_id % 7 AS c, 3 + event_id % 3 + event_id % 5 + event_id % 7 AS s FROM fx_event)")
def f35(spark, d):
    """Probabilities come as (pos, neg, neu), leave as (neg, neu, pos), and must sum to one."""
    e = F.col("event_id")
    w = [1 + e % k for k in (7, 3, 5)]
    s = w[0] + w[1] + w[2]
    x = fixture(spark, d, "fx_event").select("event_id", F.map_from_arrays(F.array(*map(F.lit, ("pos", "neg", "neu"))), F.array(*[c / s for c in w])).alias("p"))
    ok = F.abs(F.aggregate(F.map_values("p"), F.lit(0.0), lambda a, v: a + v) - 1) <= 1e-5
    return x.filter(ok).select("event_id", *[F.col("p")[k].alias(k) for k in ("neg", "neu", "pos")])


@query("J_07_empty_windows", "WITH w AS (SELECT * FROM (VALUES ('30D', TIMESTAMP '2001-01-01' - INTERVAL 30 DAY), ('1Y', TIMESTAMP '2000-01-01'), ('10Y', TIMESTAMP '1991-01-01')) v(window_type, start_at)), k AS (SELECT DISTINCT source_company_id FROM fx_evidence), n AS (SELECT source_company_id, window_type, COUNT(*) AS n FROM fx_evidence JOIN w ON published_at >= start_at AND published_at < TIMESTAMP '2001-01-01' GROUP BY 1, 2) SELECT k.source_company_id, w.window_type, COALESCE(n, 0) AS n FROM k CROSS JOIN w LEFT JOIN n USING (source_company_id, window_type)")
def j07(spark, d):
    ev, w = fixture(spark, d, "fx_evidence"), scores.window_table(spark, "2001-01-01")
    grid = ev.select("source_company_id").distinct().crossJoin(F.broadcast(w.select("window_type")))  # three windows
    n = ev.join(F.broadcast(w), scores.in_window("published_at")).groupBy("source_company_id", "window_type").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["source_company_id", "window_type"], "left").select("source_company_id", "window_type", F.coalesce("n", F.lit(0)).alias("n"))


def _matched(spark, d):
    c = table(spark, d, "companies")
    return mentions.mentions(_docs(spark, d), "document_id", "body", c.select(F.col("name_official").alias("alias"), "ticker").union(c.select("name_en", "ticker")), "alias", "ticker")


@query("J_20_sentence_spans")
def j20(spark, d):
    return mentions.sentence_spans(_matched(spark, d)).select("id", "sentence_order", "sent_start", "sent_end", F.size("spans").alias("spans"))


@query("J_21_two_companies")
def j21(spark, d):
    return mentions.pair_candidates(_matched(spark, d)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("sentences"))


@query("X_02_ellipsis")
def x02(spark, d):
    """Lists in the first line of documents; heads are the first names that companies share."""
    c = table(spark, d, "companies")
    first = c.select(F.regexp_extract("name_en", r"^(\w{3,})", 1).alias("head")).union(c.select(F.regexp_extract("name_official", "^([가-힣]{2})", 1)))
    heads = first.filter("head <> ''").groupBy("head").count().filter("count > 1").select("head")
    names = c.select(F.col("name_official").alias("name")).union(c.select("name_en"))
    lines = _docs(spark, d).select("document_id", F.regexp_extract("body", r"^([^\n]*)", 1).alias("line"))
    return mentions.expand_lists(lines, "document_id", "line", heads, names)


@query("X_05_linked")
def x05(spark, d):
    """All typed aliases against all names: exact, else the one best from .90 on."""
    c = table(spark, d, "companies")
    names = c.select("ticker", F.col("name_official").alias("name")).union(c.select("ticker", "name_en")).union(table(spark, d, "company_alias").select("ticker", "alias_name"))
    return linking.link_surfaces(table(spark, d, "alias_freq"), "alias", names, "name", "ticker", blocked=c.select("sector").distinct())


@query("X_08_bio")
def x08(spark, d):
    """Tags per sentence with its split by a hash bucket."""
    s = mentions.sentence_spans(_matched(spark, d))

    def run(batches):
        for b in batches:
            tags = [" ".join(mentions.bio(t, [(x["start"] - a, x["end"] - a) for x in spans])) for a, t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tags, pa.string())], names=["id", "sentence", "tags"])

    out = s.select("id", "sent_start", "sentence", "spans").mapInArrow(run, "id bigint, sentence string, tags string")
    return out.withColumn("part", F.when(T.bucket(F.col("sentence")) < 80, "train").when(T.bucket(F.col("sentence")) < 90, "valid").otherwise("test"))


@query("X_12_relations")
def x12(spark, d):
    """Relations of a document with the number of sentences behind them and the surest, rejects counted by reason."""
    c = mentions.classified(mentions.pair_candidates(_matched(spark, d)))
    return c.groupBy("id", F.coalesce("relation", F.lit("NONE")).alias("relation"), F.coalesce("reject", F.lit("")).alias("reject")).agg(F.count(F.lit(1)).alias("sentences"), F.max("confidence").alias("confidence"))


@query("X_11_invest_patterns", "SELECT document_id, regexp_matches(body, '지분 [0-9.]+%를|bought [0-9.]+% of') AS invest FROM fx_document WHERE body IS NOT NULL")
def x11(spark, d):
    return _docs(spark, d).select("document_id", F.col("body").rlike("지분 [0-9.]+%를|bought [0-9.]+% of").alias("invest"))


@query("X_18_holders", "SELECT l_orderkey AS id, n_name AS holder, CAST(l_linenumber * 3 + 0.5 AS DOUBLE) AS pct FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey")
def x18(spark, d):
    """Ownership tables as filings print them, one an order: a heading, a line a holder with shares and percent, a total."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    line = F.concat(F.lit("  "), "n_name", F.lit("   "), F.format_number(F.col("l_quantity") * 1000, 0), F.lit("  "), (F.col("l_linenumber") * 3 + F.lit(0.5)).cast("string"), F.lit(" % "))
    t = table(spark, d, "lineitem").join(s, "l_suppkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))  # an order's own lines
    text = t.select("l_orderkey", F.concat(F.lit("주주명  주식수  지분율(%)\n"), "lines", F.lit("\n합 계  1,000,000  100.0 %\n(단위: 주)")).alias("text"))
    return by_row(text, "l_orderkey", "text", mentions.parse_holders, [("holder", "string"), ("pct", "double")])


@query("X_33_first_group")
def x33(spark, d):
    """Order-dependent grouping of the whole texts of one company, in one task by its nature; groups are numbered within the company."""
    t = _docs(spark, d).select("company_id", "document_id", "body")

    def group(pdf):
        pdf = pdf.sort_values("document_id")
        return pdf.assign(grp=mentions.first_group_wins(pdf["body"].tolist()))[["company_id", "document_id", "grp"]]

    return t.groupBy("company_id").applyInPandas(group, "company_id bigint, document_id bigint, grp int")


@query("Q_04_conflicting_rows", "SELECT l_orderkey, l_linenumber, COUNT(*) AS versions FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem) GROUP BY 1, 2 HAVING COUNT(*) > 1")
def q04(spark, d):
    return dq.conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("Q_06_reconcile", "SELECT (SELECT COUNT(*) FROM lineitem) AS before, (SELECT COUNT(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS after")
def q06(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.agg(F.count(F.lit(1)).alias("before")).crossJoin(li.join(o, li["l_orderkey"] == o["o_orderkey"]).agg(F.count(F.lit(1)).alias("after")))  # one row each


@query("Q_10_inventory")
def q10(spark, d):
    root = shared_path(spark, "q10")
    fixture(spark, d, "fx_company").coalesce(1).write.parquet(root)
    return publish.inventory(spark, root).select("bytes", F.length("sha256").alias("digits"))


@query("K_02_export", "SELECT company_id, name FROM fx_company")
def k02(spark, d):
    root = shared_path(spark, "k02")
    fixture(spark, d, "fx_company").select("company_id", "name").coalesce(1).write.mode("overwrite").json(root)
    return readers.strict_jsonl(spark, root, "company_id bigint, name string")


@query("K_16_additive", "SELECT src, dst, rel FROM fx_edge UNION SELECT LEAST(source_company_id, target_company_id), GREATEST(source_company_id, target_company_id), relationship_type FROM fx_evidence WHERE confidence >= 0.99")
def k16(spark, d):
    """New relations are added where the snapshot has none."""
    e = fixture(spark, d, "fx_edge").select("src", "dst", "rel")
    new = fixture(spark, d, "fx_evidence").filter("confidence >= 0.99").select(F.least("source_company_id", "target_company_id").alias("src"), F.greatest("source_company_id", "target_company_id").alias("dst"), F.col("relationship_type").alias("rel")).distinct()
    return e.unionByName(new.join(e, ["src", "dst", "rel"], "left_anti"))


@query("K_17_sentiment_upsert", "SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN value / 2 ELSE value END, 6) AS value FROM fx_event")
def k17(spark, d):
    e = fixture(spark, d, "fx_event").select("event_id", F.round("value", 6).alias("value"))
    new = fixture(spark, d, "fx_event").filter("event_id % 10 = 0").select("event_id", F.round(F.col("value") / 2, 6).alias("value"))
    return replace_keys(e, new, ["event_id"])


@query("K_19_no_shrink", "SELECT company_id, MIN(trading_date) AS first, COUNT(*) AS bars FROM fx_price GROUP BY 1")
def k19(spark, d):
    """A refresh replaces bars but never loses days that were kept before."""
    p = fixture(spark, d, "fx_price").select("company_id", "trading_date", "close_price")
    fresh = p.filter("trading_date >= date'1998-01-01'")
    return replace_keys(p, fresh, ["company_id", "trading_date"]).groupBy("company_id").agg(F.min("trading_date").alias("first"), F.count(F.lit(1)).alias("bars"))


@query("K_20_price_upsert", "SELECT company_id, trading_date, CASE WHEN company_id = 3 THEN close_price * 2 ELSE close_price END AS close_price FROM fx_price")
def k20(spark, d):
    p = fixture(spark, d, "fx_price").select("company_id", "trading_date", "close_price")
    return replace_keys(p, p.filter("company_id = 3").withColumn("close_price", (F.col("close_price") * 2).cast("decimal(20,4)")), ["company_id", "trading_date"])


@query("S_11_unique_receipts", "SELECT rcept_no, COUNT(*) AS rows FROM collect_dart_rank_range GROUP BY 1 HAVING COUNT(*) > 1")
def s11(spark, d):
    return dq.duplicate_keys(table(spark, d, "collect_dart_rank_range"), ["rcept_no"])


@query("S_12_sec_index", "SELECT form, COUNT(*) AS filings, COUNT(*) FILTER (json_valid(record)) AS readable FROM run_sec_incremental GROUP BY 1")
def s12(spark, d):
    r = F.from_json("record", "cik string, form string")
    return table(spark, d, "run_sec_incremental").groupBy("form").agg(F.count(F.lit(1)).alias("filings"), F.count_if(r["cik"].isNotNull()).alias("readable"))


@query("S_13_tolerant", "SELECT event_id FROM events WHERE event_id % 2 = 0")
def s13(spark, d):
    """Every second line is broken; gzip by name."""
    root = shared_path(spark, "s13")
    line = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct("event_id"))).otherwise(F.lit("{broken"))
    table(spark, d, "events").select(line.alias("value")).write.option("compression", "gzip").text(root)
    return readers.tolerant_jsonl(spark, root, "event_id bigint")


@query("ST_09_retry_quota", "SELECT event_id FROM (SELECT event_id, status, ROW_NUMBER() OVER (PARTITION BY status ORDER BY dateline, event_id) AS rn FROM fx_event) WHERE (status = 'CANCELLED' AND rn <= 25) OR (status = 'ACTIVE' AND rn <= 75)")
def st09(spark, d):
    """A quarter of a batch of 100 is for retries."""
    e = fixture(spark, d, "fx_event")
    parts = [top_per(e.filter(F.col("status") == s), ["status"], ["dateline", "event_id"], n) for s, n in (("CANCELLED", 25), ("ACTIVE", 75))]
    return parts[0].unionByName(parts[1]).select("event_id")


QUERIES = {k: f for k, (f, _) in _F.items()}
SQL = {k: with_views(s) for k, (_, s) in _F.items() if s}
