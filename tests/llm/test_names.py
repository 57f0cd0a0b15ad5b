"""Name variants: completeness of the segment join against brute force, and each kind of variant."""

import random

from pyspark.sql import functions as F

from loomlake.llm.names import business_words, candidates, hangul_of_keys, link_names, parts


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def within_rule(p, w):
    """The typing errors that the linker takes: one edit from four characters on (a replaced one of three), a swap of neighbours, two edits from nine."""
    n, lev = min(len(p), len(w)), levenshtein(p, w)
    if n < 4:
        return len(p) == len(w) == 3 and lev <= 1
    swap = len(p) == len(w) and any(p[:k] + p[k + 1] + p[k] + p[k + 2 :] == w for k in range(len(p) - 1))
    return lev <= 1 or swap or (lev == 2 and n >= 9)


def test_no_pair_within_the_errors_of_its_length_is_missed(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 14))) for _ in range(300)}
    probes = set()
    for w in words:
        t = list(w)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t) + 1)
            rng.choice([lambda: t.insert(k, "d"), lambda: t.__delitem__(slice(k, k + 1)), lambda: t.__setitem__(slice(k, k + 1), "a"), lambda: t.__setitem__(slice(k, k + 2), t[k : k + 2][::-1])])()
        probes.add("".join(t))
    entries = spark.createDataFrame([(w, "full") for w in words], "spelling string, kind string")
    asked = spark.createDataFrame([(p, "full") for p in probes], "probe string, kind string")
    got = {(r.probe, r.spelling) for r in candidates(asked, entries).collect()}
    want = {(p, w) for p in probes if len(p) >= 3 for w in words if within_rule(p, w)}
    assert want <= got and len(want) > 200


def test_keys_and_parts():
    assert hangul_of_keys("gksrmf") == "한글" and hangul_of_keys("Rkrenrl") == "깍두기" and hangul_of_keys("hello") is None
    assert parts("The Korvan, Logistics Co., Ltd.") == ["korvan", "logistics"] and parts("㈜가나전자(005930)") == ["가나전자"]


CORES = [("Korvanel", "코르반엘"), ("Pumdarik", "품다릭"), ("Zelmotek", "젤모텍"), ("Havunore", "하부노레"), ("Tirbasuk", "티르바숙"), ("Wenlocar", "웬로카르")]


def test_each_variant(spark):
    words = [("Logistics", "물류"), ("Electronics", "전자"), ("Heavy Industries", "중공업")]
    names, k = [], 0
    for latin, hangul in CORES:
        for word, ko in words if latin != "Korvanel" else words[:1]:
            names += [(f"t{k}", hangul + ko), (f"t{k}", f"{latin} {word} Co., Ltd.")]
            k += 1
    names += [("t0", "파란우체통"), ("t1", None), (None, "nobody"), ("t0", "파란우체통")]
    one = {n: t for t, n in names if t and n}
    want = {
        "KORVANEL LOGISTICS INC": "t0", "Logistics Korvanel": "t0", "Korvanel Lgstcs.": "t0", "코르반엘": "t0", "Korvanel": "t0", "Korvanel물류": "t0",
        "zhfmqksdpfanffb": "t0", "파란우채통": "t0", "Ko​rvanel-Logistics": "t0", "Kovranel Logistics": "t0", "코물": "t0",
        "Pumdarik Logistics plc": one["품다릭물류"], "PumdarikHeavy Industries": one["품다릭중공업"], '"품다릭 전자"': one["품다릭전자"], "Pumdarik Electroncis": one["품다릭전자"],
        "Korvanel Electronics": None, "Pumdarik": None, "Quite Another": None, "물류": None, "": None, "  ": None, "()": None, None: None, "x" * 5000: None,
    }
    rows = spark.createDataFrame([(a,) for a in want] + [("Korvanel",)], "alias string").withColumn("entity", F.lit("clash"))
    got = {r.alias: r.entity for r in link_names(rows, "alias", spark.createDataFrame(names, "t string, n string"), "t", "n").collect()}
    assert got == {a: t for a, t in want.items() if t}
    nothing = spark.createDataFrame([], "t string, n string")
    assert link_names(rows, "alias", nothing, "t", "n").count() == 0
    assert link_names(rows.limit(0), "alias", nothing, "t", "n").count() == 0


def test_business_words_are_counted_over_all_names(spark):
    """A word that only the last names hold is learned as well, and an entity with very many names weighs once."""
    rows = [(f"a{k:05d}", f"Core{k} Alpha") for k in range(40)] + [("a00000", f"Other{k} Single") for k in range(500)]
    rows += [(f"z{k}", n) for k in range(4) for n in (f"Last{k} Omega", f"라스{k}오메가")]
    b = business_words(spark.createDataFrame(rows, "entity string, name string"))
    assert b.latin == {("alpha",), ("omega",)} and b.hangul == {"오메가": ("omega",)}
    assert b.expanded("omg") == ("omega",) and b.expanded("omega") == ()
