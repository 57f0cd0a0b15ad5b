"""Operators without SQL, and the hostile cases of those with it."""

import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomlake.functions import text as T
from loomlake.operators import graph, mentions, publish, scores, serving
from loomlake.operators import timeseries as ts
from loomlake.session import shared_path
from loomlake.sources import readers


def test_mean_rounds_once(spark):
    """10,001 scores whose decimal average rounded twice would be one micro-unit off."""
    rows = [(1, 2, "PARTNER" if k % 2 else "PARTNER", k, "NEWS", datetime(2000, 12, 20), "50.000001" if k < 5001 else "50.000000", "0.5", "POSITIVE") for k in range(10_001)]
    rows += [(2, 1, "PARTNER", 20_000, "DISCLOSURE", datetime(2001, 1, 1), "10", "0.5", None), (3, 3, "SUPPLY", 1, "NEWS", datetime(2000, 12, 20), "1", "1", None), (4, 5, "SUPPLY", 1, "NEWS", datetime(1980, 1, 1), "0", "1", None)]
    cols = "source_company_id long, target_company_id long, relationship_type string, document_id long, document_type string, published_at timestamp_ntz, score string, confidence string, impact_direction string"
    ev = spark.createDataFrame(rows, cols).withColumns({c: F.col(c).cast("decimal(18,6)") for c in ("score", "confidence")})
    out = {(r.source_company_id, r.window_type): r for r in scores.evidence_mean(ev, scores.window_table(spark, "2001-01-01")).collect()}
    assert out[(1, "30D")].news_micro == 50_000_001 and out[(1, "30D")].disclosure_micro is None  # the cut-off itself is outside
    assert out[(1, "30D")].direction == "POSITIVE" and (3, "30D") not in out
    assert out[(4, "10Y")].score_micro is None and len(out) == 6


def test_propagation_equals_brute_force(spark):
    """The rules walked node by node: hubs, parallel edges, idle types, named companies in the way."""
    rng = random.Random(1)
    for most, most_ok in ((12, 6), (3, 1)):
        weights = graph.TYPE_WEIGHTS
        edges = sorted({(min(a, b), max(a, b), rng.choice([*weights, "LITIGATION"]), rng.randrange(1, 11) / 10) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(70)) if a != b})
        seeds = [("d1", 1, 1.0), ("d1", 2, 0.8), ("d1", 3, 0.6), ("d2", 5, 0.9), ("d3", 6, 0.7)]
        adj, degree = {}, {}
        for a, b, rel, s in edges:
            for x, y in ((a, b), (b, a)):
                adj.setdefault(x, []).append((y, rel, s))
                degree[x] = degree.get(x, 0) + (rel != "CO_MENTIONED")

        def step(n, rel, s):
            return weights.get(rel, 0) * s * (min(1.0, (8 / degree[n]) ** 0.5) if degree.get(n) else 1.0)

        want = set()
        for doc in ("d1", "d2", "d3"):
            own = {k for d, k, _ in seeds if d == doc}
            best = {}
            for _, k, sal in [x for x in seeds if x[0] == doc and x[2] >= 0.8]:
                for y, r1, s1 in adj.get(k, []):
                    if y in own:
                        continue
                    one = sal * step(k, r1, s1)
                    paths = [(y, one, r1 != "CO_MENTIONED", 1, f"{k}>{r1}>{y}")]
                    for z, r2, s2 in adj.get(y, []):
                        if z not in own and z not in (k, y):
                            paths.append((z, one * step(y, r2, s2), r1 != "CO_MENTIONED" or r2 != "CO_MENTIONED", 2, f"{k}>{r1}>{y}>{r2}>{z}"))
                    for z, score, real, hops, path in paths:
                        if round(score, 10) >= 0.15:
                            item = (not real, -round(score, 10), hops, path)
                            best[z] = min(best.get(z, item), item)
            oks = 0
            for z, (co, s, hops, path) in sorted(best.items(), key=lambda x: (x[1][1], x[0]))[:most]:
                why = "CO_MENTION_ONLY" if co else "LOW" if -s < 0.25 else None
                oks += why is None
                why = "RANK" if why is None and oks > most_ok else why
                want.add((doc, z, hops, path, why))
        m = spark.createDataFrame(seeds, "doc string, company long, salience double")
        e = spark.createDataFrame(edges, "src long, dst long, rel string, strength double")
        got = {(r.doc, r.company, r.hop, r.path, r.hold_reason) for r in graph.propagate(m, e, most=most, most_ok=most_ok).filter("basis = 'INFERRED'").collect()}
        assert got == want and len(want) > 5


def test_abnormal_returns_over_a_weekend(spark):
    days = ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09"]
    cal = spark.createDataFrame([(d, 100.0 + k, k + 1) for k, d in enumerate(days)], "trading_date string, close_price double, idx long").withColumn("trading_date", F.to_date("trading_date"))
    price = spark.createDataFrame([("x", d, 10.0 + 2 * k) for k, d in enumerate(days) if k != 3], "k string, trading_date string, close_price double").withColumn("trading_date", F.to_date("trading_date"))
    s = ts.on_calendar(price, "k", cal)
    e = spark.createDataFrame([("x", datetime(2024, 1, 5, 6, 29)), ("x", datetime(2024, 1, 5, 6, 31)), ("x", datetime(2024, 1, 20))], "k string, at timestamp_ntz")
    idx = {r.at: r.idx for r in ts.next_trading_day(e, "at", cal).collect()}
    assert idx == {datetime(2024, 1, 5, 6, 29): 3, datetime(2024, 1, 5, 6, 31): 4, datetime(2024, 1, 20): None}
    got = ts.abnormal_returns(spark.createDataFrame([("x", 3), ("x", 4)], "k string, idx long"), "k", s, (1, 2, 3)).orderBy("idx").collect()
    assert got[0].ar_1 == pytest.approx(14 / 12 - 102 / 101) and got[0].ar_2 is None and got[0].ar_3 == pytest.approx(18 / 12 - 104 / 101)
    assert got[1].ar_1 is None and got[1].ar_2 == pytest.approx(18 / 14 - 104 / 102)


def test_sentences_and_segments():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["He said. ", "3.5 ", "Mr. X ", "다.", "그는 ", "Q! ", "\n", "U.S. ", "“a.” ", "x", "😀"]) for _ in range(rng.randrange(12)))
        assert "".join(T.segments(t)) == t
        for a, b, s in T.sentences(t):
            assert t[a:b] == s and s == s.strip() and s
    assert T.segments("It rose 3.5 percent. Mr. Kim left.") == ["It rose 3.5 percent. ", "Mr. Kim left."]
    assert [s for _, _, s in T.sentences("갔다.그는 왔다. End.")] == ["갔다.", "그는 왔다.", "End."]


def test_standalone_and_matcher():
    assert T.standalone("삼성전자는 올랐다", "삼성전자") == 0 and T.standalone("대삼성전자", "삼성전자") == -1 and T.standalone("Alpha Bets", "alpha  bet") == -1
    m = mentions.Matcher([(a, "name", k, None) for a, k in (("Alpha", "a"), ("Alpha Bet", "b"), ("감마", "g"), ("감마", "h"), ("델타", "d"), ("x", "x"))])
    assert m.spans("😀 Alpha Bet and alpha, 감마와 델타의 Alphabet") == [("b", "Alpha Bet", 2, 11), ("a", "alpha", 16, 21), ("d", "델타", 27, 29)]
    assert mentions.Matcher([]).spans("x") == [] and m.spans(None) == []
    assert mentions.bio("Alpha Bet rose", [(0, 9)]) == ["B", "I", "O"]
    assert mentions.parse_holders("홍길동 1,000 12.5%\nKim Co 3 %\nbad 120%\n합 계 100 %\n  Total 1,000 50.0% ") == [("홍길동", 12.5), ("Kim Co", 3.0)]
    assert mentions.first_group_wins(["abcdef", "abcdeg", "zzzzzz", "abcxyz"]) == [0, 0, 1, 2]


def test_pairs_within_sentences(spark):
    docs = spark.createDataFrame([(1, "Alpha bought Beta. Gamma alone."), (2, None), (3, "Alpha and Beta and Gamma agreed together. x")], "id long, text string")
    names = spark.createDataFrame([("Alpha", "a"), ("Beta", "b"), ("Gamma", "g")], "alias string, key string")
    got = {(r.id, r.src, r.dst, r.relation, r.reject) for r in mentions.classified(mentions.pair_candidates(mentions.mentions(docs, "id", "text", names, "alias", "key"))).collect()}
    assert got == {(1, "a", "b", "INVEST", None), (3, "a", "b", "PARTNER", None), (3, "a", "g", "PARTNER", None), (3, "b", "g", "PARTNER", None)}
    one, many = (mentions.mentions(docs, "id", "text", names, "alias", "key", most=n).collect() for n in (10, 1))
    assert sorted(one) == sorted(many)


def test_uuid5_and_hash(spark):
    ns = uuid.NAMESPACE_DNS
    got = {r.n: r.u for r in spark.createDataFrame([("a",), ("가",), ("x" * 300,)], "n string").withColumn("u", T.uuid5(ns.hex, F.col("n"))).collect()}
    assert got == {n: str(uuid.uuid5(ns, n)) for n in got}


def test_publish_is_verified_monotonic_and_idempotent(spark):
    root = shared_path(spark, "test-publish")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    run = publish.publish(df, root, "2024-01-01", ["k"])
    assert publish.publish(df, root, "2024-01-01", ["k"]) == run
    for bad, as_of in ((df.limit(1), "2024-01-01"), (df, "2023-12-31"), (df.unionByName(df), "2024-02-01"), (df.withColumn("k", F.lit(None).cast("long")), "2024-02-01")):
        with pytest.raises(ValueError):
            publish.publish(bad, root, as_of, ["k"])
    assert publish.latest(spark, root)["run"] == run
    newer = publish.publish(df.filter("k = 1"), root, "2024-03-01", ["k"])
    assert publish.latest(spark, root)["run"] == newer and spark.read.parquet(f"{root}/{newer}/data").count() == 1


def test_strict_and_tolerant_lines(spark):
    root = shared_path(spark, "test-lines")
    spark.createDataFrame([('{"a": 1}',), ("{bad",), ('{"a": 2}',)], "value string").coalesce(1).write.text(root)
    assert sorted(r.a for r in readers.tolerant_jsonl(spark, root, "a int").collect()) == [1, 2]
    with pytest.raises(Exception):
        readers.strict_jsonl(spark, root, "a int").collect()


def test_counts_before_equal_brute_force_and_slide_over_no_rows(spark):
    """W-11: rows of one time, on the edge of a window, before 1970, without key or time; no frame as long as the rows of a month."""
    rng = random.Random(11)
    day = 86_400_000_000
    rows = [(k, rng.choice([1, 1, 2, None]), rng.choice([None, rng.randrange(-40 * day, 40 * day), rng.randrange(-40, 40) * day, rng.randrange(-40, 40) * day - 1, 5 * day, 35 * day])) for k in range(500)]
    out = serving.counts_before(spark.createDataFrame(rows, "id long, k long, us long"), "k", "us", (1, 30))

    def want(key, us, d):
        return sum(y == key and (x is None if us is None else x is not None and us - d * day <= x < us) for _, y, x in rows)

    assert sorted((r.id, r.n1, r.n30) for r in out.collect()) == [(k, want(key, us, 1), want(key, us, 30)) for k, key, us in rows]
    from loomlake.plans.serving import w11

    assert "2592000000000, -1" not in w11(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
