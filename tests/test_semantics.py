"""Operators whose rules are easily got wrong, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loomlake.functions import text as T
from loomlake.operators import graph as G
from loomlake.operators import scores as S
from loomlake.operators import timeseries as TS
from loomlake.operators.serving import ranked_by

EDGES = [("C", "A", "SUPPLY", 1.0), ("A", "D", "COMPETE", 1.0), ("E", "C", "SUPPLY", 1.0), ("A", "F", "CO_MENTIONED", 0.9)]


def spread(spark, mentions, edges, **options):
    m = spark.createDataFrame([("d", k, s) for k, s in mentions], "doc string, company string, salience double")
    rows = G.propagate(m, spark.createDataFrame(edges, "src string, dst string, rel string, strength double"), **options).collect()
    return {r.company: r for r in rows}, rows


def test_spread_over_two_hops(spark):
    got, rows = spread(spark, [("A", 1.0)], EDGES)
    assert (got["A"].basis, got["A"].hop, got["A"].status) == ("REPORTED", 0, "OK") and len(rows) == 5
    assert (got["C"].score, got["C"].path, got["C"].status) == (pytest.approx(0.8), "A>SUPPLY>C", "OK")
    assert (got["E"].score, got["E"].hop, got["E"].path) == (pytest.approx(0.64), 2, "A>SUPPLY>C>SUPPLY>E")
    assert (got["F"].score, got["F"].status, got["F"].hold_reason) == (pytest.approx(0.36), "HOLD", "CO_MENTION_ONLY")
    got, _ = spread(spark, [("A", 1.0)], EDGES + [("A", "G", "COMPETE", 0.4), ("A", "H", "PARTNER", 0.2), ("A", "K", "COMPETE", 0.5)])
    assert (got["G"].status, got["G"].hold_reason) == ("HOLD", "LOW") and "H" not in got and got["K"].status == "OK"


def test_spread_prefers_a_relation_and_spares_named_companies(spark):
    got, _ = spread(spark, [("A", 1.0)], [("A", "F", "CO_MENTIONED", 1.0), ("A", "X", "SUPPLY", 1.0), ("X", "F", "SUPPLY", 0.6)])
    assert (got["F"].status, got["F"].hop, got["F"].score) == ("OK", 2, pytest.approx(0.384))
    # any real step makes the path a relation
    got, _ = spread(spark, [("A", 1.0)], [("A", "X", "SUPPLY", 1.0), ("X", "F", "CO_MENTIONED", 1.0)])
    assert (got["F"].score, got["F"].status) == (pytest.approx(0.32), "OK")
    # C is named too weakly to spread, and being named it is no way to E
    got, rows = spread(spark, [("A", 1.0), ("C", 0.6)], EDGES)
    assert got["C"].basis == "REPORTED" and "E" not in got and sum(r.company == "C" for r in rows) == 1
    got, _ = spread(spark, [("A", 1.0)], EDGES, active=["COMPETE", "CO_MENTIONED"])
    assert "C" not in got and "E" not in got and got["D"].status == "OK"


def test_spread_caps_and_hubs(spark):
    star = [("A", f"N{i:02d}", "SUPPLY", 1.0 - i / 100) for i in range(30)]
    damp = (8 / 30) ** 0.5
    got, rows = spread(spark, [("A", 1.0)], star)
    inferred = sorted((r for r in rows if r.basis == "INFERRED"), key=lambda r: r.company)
    assert [r.company for r in inferred] == [f"N{i:02d}" for i in range(12)] and got["N00"].score == pytest.approx(0.8 * damp)
    assert [r.status for r in inferred] == ["OK"] * 6 + ["HOLD"] * 6 and {r.hold_reason for r in inferred[6:]} == {"RANK"}
    none, rows = spread(spark, [], EDGES)
    assert rows == []


def test_the_closing_minute_is_the_next_day(spark):
    cal = spark.createDataFrame([("2024-05-02", 1), ("2024-05-03", 2), ("2024-05-07", 3)], "d string, idx long").select(F.to_date("d").alias("trading_date"), "idx")
    at = ["2024-05-02 06:29:59", "2024-05-02 06:30:00", "2024-05-03 06:30:00", "2024-05-04 01:00:00", "2024-05-07 06:30:00", "2024-05-09 02:00:00", "2024-05-11 02:00:00", None]
    e = spark.createDataFrame([(k, a) for k, a in enumerate(at)], "k int, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {r.k: r.idx for r in TS.next_trading_day(e.filter("at is not null"), "at", cal).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: None, 5: None, 6: None}
    late = {r.k: r.after_close for r in TS.after_close(e, "at", cal).collect()}
    # within the calendar a missing day is closed; beyond it a Thursday is open and a Saturday is not
    assert late == {0: False, 1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: None}


def test_labels_are_strict(spark):
    z = spark.createDataFrame([(0.5,), (0.500001,), (-0.5,), (-0.51,), (None,)], "z double").select(TS.z_label(F.col("z"))).collect()
    assert [r[0] for r in z] == ["NEUTRAL", "POSITIVE", "NEUTRAL", "NEGATIVE", None]


def test_signals_and_their_reasons(spark):
    stats = [("T", "P", "own", 3, 12, -0.03, 10, 2), ("T", "P", None, 3, 40, 0.02, 10, 30), ("U", "P", None, 3, 9, 0.1, 0, 9), ("V", "P", None, 3, 20, 0.005, 2, 18), ("W", "P", None, 3, 20, -0.02, 2, 18), ("X", "P", None, 3, 20, 0.02, 9, 11)]
    s = spark.createDataFrame(stats, "event_type string, position string, company_id string, win int, n long, mean double, down long, up long")
    ask = spark.createDataFrame([("T", "own", "OK"), ("T", "other", "OK"), ("T", "other", "HOLD"), ("OTHER", "own", "OK"), ("U", "own", "OK"), ("V", "own", "OK"), ("W", "own", "OK"), ("X", "own", "OK"), ("Y", "own", "OK")], "event_type string, company_id string, status string").withColumn("position", F.lit("P"))
    got = {(r.event_type, r.company_id, r.status): (r.label, r.hold_reason, r.scope, r.cases) for r in TS.signals(ask, s, 3, 0.01).collect()}
    assert got == {
        ("T", "own", "OK"): ("DOWN", None, "COMPANY", 12), ("T", "other", "OK"): ("UP", None, "POSITION", 40), ("T", "other", "HOLD"): ("HOLD", "WEAK_LINK", None, 0),
        ("OTHER", "own", "OK"): ("HOLD", "NO_TYPE", None, 0), ("U", "own", "OK"): ("HOLD", "FEW", "POSITION", 9), ("V", "own", "OK"): ("HOLD", "SMALL", "POSITION", 20),
        ("W", "own", "OK"): ("HOLD", "SPLIT", "POSITION", 20), ("X", "own", "OK"): ("HOLD", "SPLIT", "POSITION", 20), ("Y", "own", "OK"): ("HOLD", "FEW", "POSITION", 0),
    }


def test_shown_scores(spark):
    rows = [(70.0, 50.0, None), (70.0, None, 50.0), (70.0, 50.0, 30.0), (70.0, None, None)]
    df = spark.createDataFrame(rows, "s double, n double, f double")
    got = df.select(T.blend(F.col("s"), F.col("n"), F.col("f"), 0.6).alias("a"), T.blend(F.col("s"), F.col("n"), F.col("f"), 0.5).alias("b")).collect()
    assert [tuple(r) for r in got] == [(50.0, 50.0), (40.0, 50.0), (42.0, 70.0), (None, None)]


def test_relevance_news_types_and_npmi(spark):
    df = spark.createDataFrame([(1, 1), (4, 2), (9, 0)], "n int, k int")
    assert [tuple(r) for r in df.select(T.relevance(F.col("n"), F.col("k")), T.sentence_confidence(F.col("n"))).collect()] == [(0.45, 0.55), (0.9, 1.0), (1.0, 1.0)]
    rules = (("A", ("fire", "quake")), ("B", ("deal", "order")))
    t = spark.createDataFrame([("fire", "deal order"), ("deal", "fire quake order"), ("x", "fire"), ("fire", "deal deal"), (None, "fire quake"), ("fire deal", "")], "t string, b string")
    assert [tuple(r[0]) for r in t.select(T.news_type(F.col("t"), F.col("b"), rules)).collect()] == [("A", 0.6), ("B", pytest.approx(4 / 6, abs=1e-6)), ("OTHER", 0.0), ("A", 0.75), ("A", 1.0), ("A", 0.5)]
    p = spark.createDataFrame([(10, 10, 10, 10), (2, 4, 5, 10)], "a long, b long, c long, d long").select(G.npmi(*[F.col(x) for x in "abcd"])).collect()
    assert [r[0] for r in p] == [1.0, 0.0]


def test_best_stakes_and_what_they_replace(spark):
    h = spark.createDataFrame([("I", "X", 5.0, 1), ("I", "X", 7.0, 2), ("J", "X", 3.0, 3), ("I", "I", 50.0, 4), ("I", "Y", 0.5, 5), ("I", "Z", None, 6), ("I", "W", 101.0, 7)], "i string, e string, p double, r int")
    best = G.best_stakes(h, "i", "e", "p", [F.col("r")])
    assert sorted((r.i, r.e, r.p) for r in best.collect()) == [("I", "X", 7.0), ("J", "X", 3.0)]
    news = spark.createDataFrame([("I", "X", "INVEST", 70.0), ("X", "I", "INVEST", 80.0), ("I", "X", "SUPPLY", 60.0)], "src string, dst string, rel string, score double")
    out = G.merge_ownership(news, best.select(F.col("i").alias("src"), F.col("e").alias("dst"), F.col("p").alias("score")))
    assert sorted(tuple(r) for r in out.collect()) == [("I", "X", "INVEST", 7.0, "DISCLOSED"), ("I", "X", "SUPPLY", 60.0, "NEWS"), ("J", "X", "INVEST", 3.0, "DISCLOSED"), ("X", "I", "INVEST", 80.0, "NEWS")]


def test_evidence_edges_merge_both_ways_and_count_snippets(spark):
    rows = [("B", "A", "PARTNER", 1, "2024-01-20", 0.3), ("A", "B", "PARTNER", 1, "2024-01-21", 0.4), ("A", "B", "SUPPLY", 2, "2024-01-20", 0.9), ("B", "A", "SUPPLY", 3, "2023-06-01", 0.2)]
    s = spark.createDataFrame(rows, "src string, dst string, rel string, doc int, p string, confidence double").withColumn("published", F.col("p").cast("timestamp_ntz"))
    got = sorted((r.src, r.dst, r.rel, r.window_type, r.score, r.confidence, r.documents) for r in G.evidence_edges(s, S.window_table(spark, "2024-02-01", (("30D", "days", 30), ("1Y", "years", 1)))).collect())
    assert got == [("A", "B", "PARTNER", "1Y", 80.0, 0.4, 1), ("A", "B", "PARTNER", "30D", 80.0, 0.4, 1), ("A", "B", "SUPPLY", "1Y", 70.0, 0.9, 1), ("A", "B", "SUPPLY", "30D", 70.0, 0.9, 1)]


def test_exposure_by_name_industry_and_edge(spark):
    c = spark.createDataFrame([("d", "A", 0.9)], "doc string, company string, confidence double")
    i = spark.createDataFrame([("d", "S", 3)], "doc string, industry string, n long")
    m = spark.createDataFrame([("A", "S"), ("B", "S"), ("C", "S"), ("D", "S"), ("E", "T")], "company string, industry string")
    e = spark.createDataFrame([("A", "B", "ownership", 1.0), ("E", "A", "sector", 0.8), ("A", "F", "co_mention", 0.19), ("A", "G", "unknown", 0.5)], "src string, dst string, kind string, weight double")
    got = {r.company: (r.score, r.source, r.reasons) for r in G.expand_impact(c, i, m, e).collect()}
    industry = round(0.6 * (1 + 1.0986122886681098) / 2, 3)
    assert got == {"A": (0.9, "direct", 1), "B": (0.72, "graph", 2), "C": (min(industry, 0.6), "industry", 1), "D": (min(industry, 0.6), "industry", 1), "E": (0.216, "graph", 1), "G": (0.135, "graph", 1)}


def test_ranks_over_ranges(spark):
    df = spark.range(5000).withColumn("k", (F.col("id") * 7919) % 5000)
    assert ranked_by(df, ["k"]).filter("rank <> k").count() == 0
    assert ranked_by(df.limit(0), ["k"]).count() == 0


def test_greedy_list_takes_a_pair_once(spark):
    rows = [("a", "b", "X", 9.0), ("a", "b", "Y", 8.0), ("b", "c", "X", 7.0), ("b", "d", "X", 6.0), ("c", "d", "X", 5.0)]
    got = [(r.src, r.dst, r.rel) for r in G.greedy_list(spark.createDataFrame(rows, "src string, dst string, rel string, score double")).collect()]
    assert got == [("a", "b", "X"), ("b", "c", "X"), ("c", "d", "X")]
