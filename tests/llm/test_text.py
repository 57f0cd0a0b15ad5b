"""The text operators against plain Python on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.llm import tokens
from loomlake.llm.leaks import leaked
from loomlake.llm.stuffing import stuffed
from loomlake.llm.words import streams, words

tiktoken = pytest.importorskip("tiktoken")


def test_words_and_streams():
    texts = ["Ab​c, d-e １２ ﬁ", None, "", "  ", "x", " 가나 다", "ét", "a" * 300]
    assert words(texts[0]) == ["abc", "d", "e", "12", "fi"] and words(texts[6]) == ["ét"]
    stream, begin = streams(texts)
    for k, t in enumerate(texts):
        own = "".join(map(chr, stream[begin[k] : begin[k + 1]]))
        assert own.split() == words(t) and own.startswith(" ") and "  " not in own


def test_tokens_equal_the_library(spark):
    ranks = tokens.load_ranks(tokens.BYTE_BPE_50K)
    plain = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab aé한글 \n\t 1234!?'s  　\0🙂") for _ in range(rng.randrange(80))) for _ in range(500)]
    texts += [None, "", "   ", "<|endoftext|> x", "가" * 4000, "=" * 3000, "ab" * 2000, "a  b   c\n\n d"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("key", F.lit("x"))
    got = tokens.encode_corpus(rows, "doc_id", "text").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == plain.encode_ordinary(texts[r.doc_id] or ""), texts[r.doc_id]
    for w in (b"hello", "관계자는".encode(), bytes(range(200)), b"aaaaabbbbb" * 20):
        assert tokens.merge_short(w, ranks) == tokens.merge_long(w, ranks)
    assert tokens.encode_corpus(rows.limit(0), "doc_id", "text").count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(40)] + ["가격", "이", "보험료"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 20, 40])))) for k in range(30)] + [(90, None), (91, "")]
    docs = []
    for k in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        source = words(items[rng.randrange(30)][1])
        a = rng.randrange(max(1, len(source) - 8))
        w[5:5] = source[a : a + rng.choice([8, 11, 12, 13, 30])]
        docs.append((k, ", ".join(w).upper() if k % 3 else "​ ".join(w)))
    docs += [(400, None), (401, ""), (402, " \n"), (403, "x" * 200_000), (404, items[3][1] if len(words(items[3][1])) > 11 else items[4][1])]
    want = set()
    for d, t in docs:
        w = words(t)
        runs = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, x in items:
            y = words(x)
            if any(tuple(y[k : k + 12]) in runs for k in range(len(y) - 11)):
                want.add((d, i))
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    right = spark.createDataFrame(items, "item_id long, text string")
    for block in (2000, 7):
        got = leaked(left, "doc_id", "text", right, "item_id", "text", block=block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 40
    assert leaked(left.limit(0), "doc_id", "text", right, "item_id", "text").count() == 0
    assert leaked(left, "doc_id", "text", right.limit(0), "item_id", "text").count() == 0


def test_leaks_within_edits(spark):
    item = "the coupon resets every 3102 days while the spread widens 5 percent per period of the bond"
    docs = [(1, "so " + item.replace("resets", "reset").replace("widens", "widen")), (2, item[:40]), (3, item.replace("coupon", "dividend").replace("days", "years").replace("widens", "falls"))]
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in leaked(left, "doc_id", "text", right, "item_id", "text", edits=3).collect()] == [(1, 7)]
    assert leaked(left, "doc_id", "text", right, "item_id", "text").count() == 0


def test_edited_passages_equal_brute_force_with_either_plan(spark):
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([8, 14, 20])))) for k in range(12)]
    docs = []
    for k in range(60):
        t = list(items[rng.randrange(12)][1])
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(t))
            rng.choice([lambda: t.insert(at, "z"), lambda: t.__delitem__(at), lambda: t.__setitem__(at, "q")])()
        docs.append((k, " ".join(rng.choice(vocab) for _ in range(9)) + " " + "".join(t) + " " + " ".join(rng.choice(vocab) for _ in range(7))))

    def close(p, t, most):
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return min(row) <= most

    want = set()
    for d, t in docs:
        text = " " + " ".join(words(t)) + " "
        for i, x in items:
            y = words(x)
            if any(close(" " + " ".join(y[k : k + 12]) + " ", text, 2) for k in range(len(y) - 11)):
                want.add((d, i))
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert 10 < len(want) < 60
    for block in (2000, 5):
        assert {tuple(r) for r in leaked(left, "doc_id", "text", right, "item_id", "text", edits=2, block=block).collect()} == want
    assert leaked(left, "doc_id", "text", right, "item_id", "text").count() < len(want)


def test_stuffing(spark):
    rng = random.Random(6)
    base = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ro", "sa", "te") for b in ("ba", "ding", "fort", "gel", "hun", "jar", "kel", "lim", "mon", "nor", "pel", "quin")]
    lexicon = [x + y for x in base for y in ("", "s", "ed", "ly")]

    def prose(n):
        return " ".join(rng.choice(lexicon) if rng.random() < 0.7 else rng.choice(("the", "of", "and", "in", "a", "to")) for _ in range(n)) + "."

    good = [(k, prose(rng.randrange(30, 700))) for k in range(300)]
    good += [(300, prose(150) + " ".join(f"[{k}] https://example.net/{k}" for k in range(4))), (301, None), (302, ""), (303, "  "), (304, "buy buy"), (305, "🙂")]
    keywords = ["loan", "cheap", "bonus", "picks", "vip"]
    bad = [(500 + k, " ".join(rng.choice(keywords) for _ in range(60 + k))) for k in range(10)]
    bad += [(520 + k, " ".join(f'<a href="http://best{j}.example.com/{j}">{rng.choice(keywords)}</a>' for j in range(40))) for k in range(5)]
    bad += [(540, prose(30) + " " + "cheap loan bonus " * 60), (541, "cheap loan bonus " * 30_000)]
    docs = spark.createDataFrame(good + bad + [bad[0]], "doc_id long, text string").withColumn("page", F.lit(1))
    got = sorted(r.doc_id for r in stuffed(docs, "doc_id", "text").collect())
    assert got == sorted([*[k for k, _ in bad], bad[0][0]])
    assert stuffed(docs.limit(0), "doc_id", "text").count() == 0
