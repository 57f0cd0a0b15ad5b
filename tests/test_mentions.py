"""The dictionary matcher, relations between the companies of a sentence, and linking by likeness."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomlake.functions.text import normal_name
from loomlake.operators import linking as L
from loomlake.operators import mentions as M
from loomlake.session import shared_path

ENTRIES = [
    ("누리전자", "name", "100001", None), ("Nuri Electronics", "name", "100001", None), ("누리", "group", "100001", None), ("누리", "group", "100002", None), ("누리생명", "name", "100002", None),
    ("한빛", "group", "100003", "100003"), ("한빛물산", "name", "100004", None), ("한빛", "group", "100004", "100003"), ("누리전자우", "block", "x", None), ("한빛 독수리", "block", "x", None),
    ("Orbit", "name", "ORBT", None), ("Orbix", "product", "ORBT", None), ("반도체", "industry", "SEMI", None), ("KR", "name", "KRCO", None), ("Twin", "name", "T1", None), ("Twin", "name", "T2", None), ("Twin One", "name", "T1", None),
]
CODES = {"100001": "100001", "100002": "100002", "ORBT": "ORBT", "KRX": "KRCO"}


def found(title, body):
    m, u, i = M.Matcher(ENTRIES, CODES).match([("title", title), ("body", body)])
    return {x[0] for x in m}, m, {x[0] for x in u}, {x[0] for x in i}


def test_names_particles_and_blocks():
    keys, m, _, _ = found("누리전자, 투자 확대", "누리전자는 이날 밝혔다.")
    assert keys == {"100001"} and [(x[2], x[3], x[4]) for x in m] == [("title", 0, 4), ("body", 0, 4)]
    assert found("", "누리전자우 강세, 누리전자우도 상승")[0] == set()
    assert found("", "누리전자기기 시장")[0] == set()  # another word
    assert found("한빛 독수리 4연승", "한빛 독수리가 이겼다.")[0] == set()
    assert found("", "KRX와 AKR 요금")[0] == set() and found("", "KR는 발표했다.")[0] == {"KRCO"}


def test_groups_are_settled_by_the_document():
    assert found("", "누리가 발표했다. 누리전자는 실적을 공개했다.")[0] == {"100001"}
    keys, m, _, _ = found("", "한빛이 신사업을 발표했다.")
    assert keys == {"100003"} and m[0][5:] == ("holder", 0.5)
    keys, _, open_, _ = found("", "누리가 발표했다.")
    assert keys == set() and open_ == {"누리"}
    # one name of two companies is a group as well
    assert found("", "Twin rose.")[2] == {"twin"} and found("Twin One", "Twin rose.")[0] == {"T1"}


def test_products_industries_and_longest():
    assert found("", "Orbix sold well.")[0] == set() and found("", "Orbix sold well.")[2] == {"orbix"}
    keys, m, _, _ = found("Orbit", "Orbix sold well.")
    assert keys == {"ORBT"} and {x[5] for x in m} == {"name", "product"}
    assert found("반도체 수출", "")[3] == {"SEMI"}
    assert found("", "누리생명과 한빛물산이 참여")[0] == {"100002", "100004"}


def test_codes_need_their_context():
    assert found("", "신제품(100001) 발표")[0] == {"100001"} and found("", "$ORBT is up while KRX: 100002 fell.")[0] == {"ORBT", "100002"}
    assert found("", "치료(ORBT) 개발")[0] == set() and {x[5] for x in found("", "Orbit(ORBT) rose")[1]} == {"name", "code"}


def test_one_pass_and_blocks_agree(spark):
    rng = random.Random(3)
    texts = ["누리전자", "누리", "한빛", "Orbit", "Orbix", "반도체", "누리전자우", "Twin", "Twin One", "KR", "그리고", "rose", "(100001)", "는"]
    docs = [(k, " ".join(rng.choice(texts) for _ in range(3)), " ".join(rng.choice(texts) for _ in range(rng.randrange(12)))) for k in range(80)] + [(90, None, None), (91, "", ""), (92, None, "누리전자 " + "무단전재 Orbit")]
    df = spark.createDataFrame(docs, "doc int, t string, b string").withColumn("id", F.lit("clash"))
    entries = spark.createDataFrame(ENTRIES * 2, "alias string, kind string, key string, holder string")
    codes = spark.createDataFrame(list(CODES.items()), "code string, key string")
    one = {r.id: r for r in M.match_documents(df, "doc", "t", "b", entries, codes).collect()}
    many = {r.id: r for r in M.match_documents(df, "doc", "t", "b", entries, codes, most=4).collect()}
    assert one == many and len(one) == 83 and [m.key for m in one[92].mentions] == ["100001"] and one[90].mentions == []
    tables = M.mention_batch(M.match_documents(df, "doc", "t", "b", entries, codes), shared_path(spark, "test-batch"))
    assert tables["spans"].count() == sum(len(r.mentions) for r in one.values()) and tables["data"].select("id", "key").distinct().count() == tables["data"].count()
    assert M.match_documents(df.limit(0), "doc", "t", "b", entries.limit(0)).count() == 0


def rel(sentence, a="AAA", b="BBB", companies=2):
    i, j = sentence.index(a), sentence.index(b)
    first, second = ((i, i + len(a)), (j, j + len(b))) if i < j else ((j, j + len(b)), (i, i + len(a)))
    r, flip, _, p = M.relation_of(sentence, first, second, companies)
    return (r, ("AAA" if (i < j) != flip else "BBB") if r else None, p)


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("AAA와 BBB는 공동 개발에 합의했다.", ("PARTNER", "AAA", "enum")),
        ("AAA는 지난해 BBB와 협력을 넓혔다.", ("PARTNER", "AAA", "clause")),
        ("AAA, 그 밖에 BBB 협력", ("PARTNER", "AAA", "near")),
        ("AAA와 BBB 등 경쟁사가 늘었다.", (None, None, "listed")),
        ("AAA and BBB and other rivals fell.", (None, None, "listed")),
        ("AAA는 배터리를 BBB에 공급한다.", ("SUPPLY", "AAA", "subject")),
        ("AAA에 부품을 공급하는 BBB", ("SUPPLY", "BBB", "relative")),
        ("AAA에 지난달 BBB가 납품했다.", ("SUPPLY", "BBB", "subject")),
        ("AAA와 BBB에 납품했다.", (None, None, "co_listed")),
        ("AAA 공급 소식 BBB", (None, None, "no_direction")),
        ("AAA ships parts to BBB every week.", ("SUPPLY", "AAA", "subject")),
        ("AAA bought 12% of BBB for cash.", ("INVEST", "AAA", "stake")),
        ("AAA was bought by BBB.", ("INVEST", "BBB", "passive")),
        ("AAA는 BBB 지분 17%를 사들였다.", ("INVEST", "AAA", "stake")),
        ("AAA는 BBB와 협력을 검토한다.", (None, None, "hedged")),
        ("AAA rose. Then BBB agreed.", (None, None, "break")),
        ("AAA " + "x" * 70 + " BBB 협력", (None, None, "far")),
        ("AAA와 BBB는 올랐다.", (None, None, "no_keyword")),
    ],
)
def test_relations(sentence, want):
    assert rel(sentence) == want


def test_crowded_sentences():
    assert rel("AAA와 BBB는 협력한다.", companies=4) == (None, None, "crowded")


def test_linking_equals_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 26))) for _ in range(60)]
    names = [(n, f"k{i}") for i, n in enumerate(base)] + [(base[0], "other"), (None, "k"), ("", "k")]
    forms = []
    for n in base:
        t = list(n)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t))
            rng.choice([lambda: t.insert(k, "z"), lambda: t.__delitem__(k) if len(t) > 2 else None, lambda: t.__setitem__(k, "y")])()
        forms.append("".join(t))
    forms += [base[0], base[1].upper() + " Inc.", None, "", base[2]]
    got = {r.surface: r.key for r in L.link_surfaces(spark.createDataFrame([(f,) for f in forms + forms], "s string"), "s", spark.createDataFrame(names, "n string, k string"), "n", "k", blocked=spark.createDataFrame([(base[2],)], "b string")).collect()}
    form_of = {r.s: r.f for r in spark.createDataFrame([(f,) for f in set(forms) if f], "s string").select("s", normal_name(F.col("s")).alias("f")).collect()}
    want = {}
    for s, f in form_of.items():
        exact = {k for n, k in names if n and n == f}
        if f == base[2] or not f:
            continue
        if exact:
            if len(exact) == 1:
                want[s] = exact.pop()
            continue
        r = {}
        for n, k in names:
            if n:
                r[k] = max(r.get(k, 0), SequenceMatcher(None, n, f, autojunk=False).ratio())
        top = max(r.values())
        best = [k for k, v in r.items() if v == top]
        if top >= 0.9 and len(best) == 1:
            want[s] = best[0]
    assert got == want and len(want) > 20


def test_segments_meet_whatever_the_edits():
    for n, ratio in itertools.product(range(1, 40), (0.9, 0.8)):
        own = L.cuts(n, ratio)
        assert not own or sum(k for _, k in own) == n and all(k > 0 for _, k in own)
