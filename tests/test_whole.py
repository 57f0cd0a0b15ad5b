"""Queries over whole tables and whole texts, against plain Python."""

import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomlake.functions import text as T
from loomlake.operators import graph, mentions
from loomlake.plans.fixtures import fixture
from tests.test_registry import norm

DATA = Path("/root/testdata/sf0.001")


def views():
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}'")
    return con


def same(df, con, sql, some=True):
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    cur = con.execute(sql)
    order = sorted(range(len(cur.description)), key=lambda i: cur.description[i][0])
    assert (got or not some) and got == sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def test_every_document_and_company_is_in_the_graph_queries(spark):
    docs = {r.doc for r in fixture(spark, str(DATA), "fx_seed").select("doc").distinct().collect()}
    assert {r.doc for r in entry.queries()["X_19_propagate"](spark, str(DATA)).select("doc").distinct().collect()} == docs
    assert {r.doc for r in entry.queries()["X_24_expand_impact"](spark, str(DATA)).select("doc").distinct().collect()} == docs
    e = fixture(spark, str(DATA), "fx_edge")
    n = spark.read.parquet(str(DATA / "lineitem.parquet")).filter("l_suppkey % 40 <> l_partkey % 40").count()
    assert e.agg(F.sum("n")).first()[0] == n


def plain_groups(texts, threshold=0.5, n=3):
    """X-33 by all pairs."""
    members, out = [], []
    for text in texts:
        t = "".join(re.findall("[0-9A-Za-z가-힣]", text))
        g = {t[k : k + n] for k in range(max(1, len(t) - n + 1))}
        hit = next((k for k, m in enumerate(members) if any(len(g & x) / min(len(g), len(x)) >= threshold - 1e-9 for x in m)), len(members))
        if hit == len(members):
            members.append([])
        members[hit].append(g)
        out.append(hit)
    return out


def test_groups_equal_all_pairs():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd 가나.") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    assert mentions.first_group_wins(texts) == plain_groups(texts) and len(set(plain_groups(texts))) > 20
    assert mentions.first_group_wins([]) == []
    # a prefix, an overlap behind character 40, and a chain whose end shares nothing with its head
    a, b = "the quick brown fox jumps over", "a lazy dog sleeps in the sun today"
    assert mentions.first_group_wins([a, "Update: " + a, "0123456789" * 5 + b, b, a + b, b + "zyxwvut", "q1w2e3r4"]) == plain_groups([a, "Update: " + a, "0123456789" * 5 + b, b, a + b, b + "zyxwvut", "q1w2e3r4"])
    assert mentions.first_group_wins(["abcdefgh", "efghijkl", "ijklmnop"], 0.3) == [0, 0, 0]


def test_groups_of_a_company_are_its_own(spark):
    got = {}
    for r in entry.queries()["X_33_first_group"](spark, str(DATA)).collect():
        got.setdefault(r.company_id, []).append((r.document_id, r.grp))
    texts = {r.document_id: r.body for r in fixture(spark, str(DATA), "fx_document").filter("body is not null").collect()}
    assert sum(map(len, got.values())) == len(texts)
    for rows in got.values():
        rows.sort()
        assert [g for _, g in rows] == plain_groups([texts[k] for k, _ in rows])


def test_windows_count_their_own_evidence(spark):
    df = entry.queries()["J_07_empty_windows"](spark, str(DATA))
    n = {r.window_type: r.n for r in df.groupBy("window_type").agg(F.sum("n").alias("n")).collect()}
    assert n["10Y"] > n["1Y"] > n["30D"] > 0
    same(df, views(), entry.oracle_sql()["J_07_empty_windows"])


def bodies(spark):
    return {r.document_id: r.body for r in fixture(spark, str(DATA), "fx_document").filter("body is not null").collect()}


def plain_fragments(text):
    pieces = re.split(r"\.{2,}", re.sub(r"</?b>", "", text))
    return [f for f in (s.strip() for p in pieces for s in re.split(r"(?<=다\.)\s*", p)) if f]


def test_fragments_equal_plain_python(spark):
    got = {r.document_id: (r.n, r.fragments) for r in entry.queries()["F_05_fragments"](spark, str(DATA)).collect()}
    want = {k: plain_fragments(t) for k, t in bodies(spark).items()}
    assert got == {k: (len(f), f) for k, f in want.items()} and any("다." in t for t in bodies(spark).values())
    texts = ["<b>가</b>나다. 다음　이다.끝", "a..b...c", "하다... 그리고 <b>x", " \n ", "했다..다.다.", "", "😀다.\n😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.fragments(F.col("t")).alias("f")).collect()
    assert {r.k: r.f for r in rows} == {k: plain_fragments(t) for k, t in enumerate(texts)}


def test_no_visible_character_is_lost_in_any_document(spark):
    got = {r.document_id: r.visible for r in entry.queries()["F_02_sentences_seen"](spark, str(DATA)).collect()}
    assert got == {k: len("".join(t.split())) for k, t in bodies(spark).items()}
    assert any(re.search("[^\x00-힣]", t) for t in bodies(spark).values())


def test_overlap_reads_the_whole_text(spark):
    def grams(t):
        return {t[k : k + 3] for k in range(max(1, len(t) - 2))}

    got = {r.document_id: r.overlap for r in entry.queries()["F_16_shingles"](spark, str(DATA)).collect()}
    pairs = {k: (grams(t[:80]), grams(t[80:])) for k, t in bodies(spark).items()}
    assert got == pytest.approx({k: len(a & b) / min(len(a), len(b)) for k, (a, b) in pairs.items()}, abs=1e-6)


def test_overlap_of_short_texts_and_emoji(spark):
    rows = spark.createDataFrame([("", "abc"), ("ab", "ab"), ("😀가나", "x😀가나다"), ("", ""), ("abcd", "bcde"), (None, "a")], "a string, b string")
    assert [r[0] for r in rows.select(T.shingle_overlap(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 1.0, 1.0, 0.5, 0.0]


def plain_cut(text):
    """F-06 by single finds."""
    at = [i for m in T.BOILERPLATE if (i := text.find(m)) >= 0]
    at += [m.start() for w in T.BOILERPLATE_LINES for m in re.finditer(re.escape(w), text) if m.start() == 0 or text[m.start() - 1] == "\n"]
    at += [m.start() for m in [re.search(r"(?:#[^\s#]{2,}\s*){3,}", text)] if m]
    return min(at, default=len(text))


def test_boilerplate_is_cut_and_no_text_is_left_out(spark):
    got = {r.document_id: (r.cut, r.trimmed, r.kept) for r in entry.queries()["F_06_boilerplate"](spark, str(DATA)).collect()}
    want = {k: (plain_cut(t), plain_cut(t) < len(t), t[: plain_cut(t)]) for k, t in bodies(spark).items()}
    assert got == want
    texts = {
        "본문이다. 관련 기사 더 보기": None, "본문이다.\n관련 기사 더": 6, "주요 뉴스 앞": 0, "끝 #하나 이다": None, "끝 #하나 #둘둘 이다": None, "끝 #하나 #둘둘　#셋셋 #넷넷 이다": 2, "#1 #2 #3": None,
        "😀😀 본문 무단전재 금지": 6, "\r관련기사": None, "[주요포토] a": 0, "a All rights reserved. ⓒ b": 2, "": None, "x\n\n마켓 뉴스\n무단전재": 3, "plain": None,
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("t", T.trim_boilerplate(F.col("t")).alias("kept")).collect()
    assert {r.t: r.kept for r in rows} == {t: t if n is None else t[:n] for t, n in texts.items()} == {t: t[: plain_cut(t)] for t in texts}


def test_greedy_list_reads_links_behind_the_500th(spark):
    rng = random.Random(3)
    links = [(0, k, 1.0 - k / 10_000) for k in range(1, 700)] + [(1000 + rng.randrange(60), 1100 + rng.randrange(60), rng.randrange(1, 500) / 1000) for _ in range(3000)]
    used, pairs, want = {}, set(), []
    for a, b, s in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        if (a, b) not in pairs and used.get(a, 0) < 2 and used.get(b, 0) < 2:
            pairs.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.append((a, b, s))
    df = spark.createDataFrame(links, "src long, dst long, score double").repartition(5)
    assert [tuple(r) for r in graph.greedy_list(df).collect()] == want and len(want) > 100
    assert [tuple(r) for r in graph.greedy_list(df, most=7).collect()] == want[:7]
