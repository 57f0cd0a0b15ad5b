"""Scalar text rules. Offsets are code points; native where the JVM counts code points too, Arrow batches elsewhere."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = re.compile(r"(?<=[.!?。…])[\"'”’)\]]*\s+|\n+|(?<=다\.)(?=[가-힣A-Z])")
_ABBREVIATION = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|St|vs|No|Inc|Corp|Co|Ltd|U\.S|e\.g|i\.e)|\b[A-Z])\.$")


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """F-01, F-02: (start, end, sentence) without surrounding white space; text[start:end] is the sentence."""
    out, at = [], 0
    for m in [*_END.finditer(text or ""), None]:
        stop = m.start() if m else len(text or "")
        if m and text[m.start() : m.end()].strip():
            stop = m.start() + len(m[0].rstrip())
        raw = (text or "")[at:stop]
        lead = len(raw) - len(raw.lstrip())
        body = raw.strip()
        if body:
            out.append((at + lead, at + lead + len(body), body))
        at = m.end() if m else at
    return out


def segments(text: str) -> list[str]:
    """F-03: pieces that concatenate to the text; a dot of an abbreviation, an initial or a decimal ends none."""
    out, at = [], 0
    for m in re.finditer(r"[.!?。…]+[\"'”’)\]]*\s*|\n+", text):
        before = text[at : m.start() + 1]
        if m[0][0] == "." and (_ABBREVIATION.search(before) or (text[m.start() - 1 : m.start()].isdigit() and text[m.end() : m.end() + 1].isdigit() and not m[0][1:])):
            continue
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]] if at < len(text) else out


def cut_sentences(c: Column, size: int) -> Column:
    """F-04: sentences of the first ``size`` characters; a cut tail ends in an ellipsis."""
    head = F.substring(c, 1, size)
    parts = F.filter(F.split(head, r"(?<=[.!?])\s+"), lambda x: F.length(F.trim(x)) > 0)
    tail = F.element_at(parts, -1)
    return F.when(F.length(c) > size, F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(tail, F.lit("…"))))).otherwise(parts)


def fragments(c: Column) -> Column:
    """F-05: highlight fragments without tags, split at gaps and sentence ends."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"</?b>", ""), r"\.{2,}|(?<=다\.)"), lambda x: F.regexp_replace(x, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")), lambda x: x.rlike(r"[^\s\p{Z}]"))


#: Markers of F-06: anywhere, and at the start of a line alone; three hashtags in a row are one as well.
BOILERPLATE = (
    "무단전재", "저작권자", "All rights reserved", "ⓒ", "[뉴스핌 베스트 기사]", "blog.naver.com", "Stocks that made our list", "Stock Advisor",
    "if you invested $", "made this list on", "The Motley Fool", "StockStory", "Our Top 5", "Read more here", "Sign up for", "Subscribe to",
    "Disclosure:", "Disclaimer:", "This article was originally published", "Benzinga does not provide",
)
BOILERPLATE_LINES = ("많이 본 뉴스", "주요 뉴스", "오늘의 상승종목", "마켓 뉴스", "실시간 암호화폐 시세", "[주요포토]", "종목 추적기", "관련기사", "관련 기사", "함께 보면 좋은", "추천 기사", "인기 기사")
_BLANK = r"\s\p{Z}\x1c-\x1f\x85"


def trim_boilerplate(c: Column, markers: tuple[str, ...] = BOILERPLATE, lines: tuple[str, ...] = BOILERPLATE_LINES) -> Column:
    """F-06: the text before the first marker, line-start marker or run of three hashtags; its length is the cut in code points."""
    def either(words):
        return "|".join(rf"\Q{w}\E" for w in words)

    return F.element_at(F.split(c, rf"{either(markers)}|(?<![^\n])(?:{either(lines)})|(?:#[^{_BLANK}#]{{2,}}[{_BLANK}]*){{3}}", 2), 1)


def _boilerplate_pattern() -> re.Pattern:
    anywhere, lines = ("|".join(map(re.escape, w)) for w in (BOILERPLATE, BOILERPLATE_LINES))
    return re.compile(rf"{anywhere}|(?<![^\n])(?:{lines})|(?:#[^\s#]{{2,}}\s*){{3}}")


_BOILERPLATE_AT = _boilerplate_pattern()


def boilerplate_at(text: str) -> int:
    """F-06 for a plain string: where its boilerplate begins, or its length."""
    m = _BOILERPLATE_AT.search(text)
    return m.start() if m else len(text)


def canonical_url(c: Column) -> Column:
    """F-07: scheme and host lower-case, no default port, no fragment, no trailing slash; the query stays."""
    bare = F.regexp_replace(F.trim(c), r"#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1))
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    return F.concat(F.regexp_replace(head, r":(80|443)$", ""), F.regexp_replace(rest, r"/+(?=\?|$)", ""))


def identity_hash(*cs: Column) -> Column:
    """F-08: SHA-256 of the parts joined by line feeds."""
    return F.sha2(F.concat_ws("\n", *cs), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """F-09: name-based UUID (version 5): SHA-1 over the namespace's bytes and the name, version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def bucket(c: Column, n: int = 100) -> Column:
    """F-10: the first eight hex digits of SHA-1, modulo n."""
    return F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("long") % n


def normal_name(c: Column) -> Column:
    """F-11: lower-case, legal marks and punctuation removed."""
    low = F.regexp_replace(F.lower(c), r"㈜|\(주\)|주식회사|\b(inc|corp|co|ltd|plc)\b\.?", "")
    return F.regexp_replace(low, r"[\s.,&'\-#()]+", "")


PARTICLES = "은|는|이|가|을|를|의|에|와|과|도|로|만|에서|에게|까지|부터|으로|이나|라며"


def standalone(text: str, alias: str) -> int:
    """F-12, F-13, F-14: where alias stands by itself (a Korean particle may follow), or -1."""
    body = r"\s*".join(map(re.escape, alias.split()))
    m = re.search(rf"(?<![0-9A-Za-z가-힣]){body}(?=$|[^0-9A-Za-z가-힣]|(?:{PARTICLES})(?![0-9A-Za-z가-힣]))", text, re.I)
    return m.start() if m else -1


_FOLLOWED = re.compile(rf"(?:{PARTICLES})(?![0-9A-Za-z가-힣])")


def stands_alone(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] is a word of its own, a Korean particle behind it aside."""
    if a and text[a - 1].isalnum():
        return False
    return b >= len(text) or not text[b].isalnum() or _FOLLOWED.match(text, b) is not None


def shingle_overlap(a: Column, b: Column, n: int = 3) -> Column:
    """F-16: shared character n-grams over those of the shorter text; two texts without any have 0."""
    def let(value, use):  # evaluated once, not once for every use
        return F.element_at(F.transform(F.array(value), use), 1)

    def grams(c):
        return let(F.split(c, ""), lambda x: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(x) - n)), lambda k: F.concat(*[F.coalesce(F.get(x, k + i), F.lit("")) for i in range(n)]))))

    def overlap(p):
        return F.coalesce(F.try_divide(F.size(F.array_intersect(p["a"], p["b"])).cast("double"), F.least(F.size(p["a"]), F.size(p["b"]))), F.lit(0.0))

    return let(F.struct(grams(a).alias("a"), grams(b).alias("b")), overlap)


def number(c: Column) -> Column:
    """F-21: thousands separators removed, a dash or blank is null, a triangle is minus."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), ",", ""), r"^[△▲]", "-")
    return F.when(~t.isin("", "-"), t).try_cast("double")


def blend(score: Column, news: Column, filed: Column, weight: float, usual: float = 0.5) -> Column:
    """F-31: the score shown for a weight of news. Both parts: the stored score at the usual weight, else their weighted mean. One part: double
    its weight of it, itself at most. None: null. One decimal, halves up."""
    def shown(c):
        return F.floor(c * 10 + 0.5) / 10

    one = F.when(filed.isNull(), F.least(news, 2 * weight * news)).otherwise(F.least(filed, 2 * (1 - weight) * filed))
    both = score if weight == usual else shown(weight * news + (1 - weight) * filed)
    return F.when(news.isNotNull() & filed.isNotNull(), both).otherwise(shown(one))


def relevance(sentences: Column, companies: Column) -> Column:
    """F-27: .25 + .55 x depth + .20 / companies, depth rising from one to four sentences; at most 1."""
    depth = (F.greatest(F.lit(1), F.least(F.lit(4), sentences)) - 1) / 3.0
    return F.round(F.least(F.lit(1.0), 0.25 + 0.55 * depth + 0.2 / F.greatest(companies, F.lit(1))), 6)


def sentence_confidence(sentences: Column) -> Column:
    """F-27: .40 + .15 for each sentence, at most 1."""
    return F.round(F.least(F.lit(1.0), 0.4 + 0.15 * sentences), 6)


#: Types of F-33 with their patterns, the more special first. A caller may bring rules of its own.
NEWS_TYPES = (
    ("LEGAL", ("소송", "제소", "patent case", "lawsuit", "reaches court")),
    ("EARNINGS", ("영업이익", "실적", "operating profit", "net income", "cash flow")),
    ("CONTRACT", ("계약", "공급", "licensing deal", "contract", "ships")),
    ("CAPITAL", ("유상증자", "회사채", "notes worth", "rights offering")),
    ("PLANT", ("공장", "증설", "a plant for", "trial runs")),
)


def news_type(title: Column, body: Column, rules=NEWS_TYPES, least: int = 2, other: str = "OTHER") -> Column:
    """F-33: struct(kind, confidence). Each pattern found in the title gives three points to its type, in the body one; the type with most points wins
    from ``least`` on, an earlier type wins a tie; confidence is its share of all points. Else ``other`` with 0."""
    def found(c, p):
        return F.coalesce(c.rlike(p), F.lit(False)).cast("int")

    def let(value, use):  # evaluated once, not once for every use
        return F.element_at(F.transform(F.array(value), use), 1)

    points = F.array(*[sum(3 * found(title, p) + found(body, p) for p in patterns) for _, patterns in rules])
    names = F.array(*[F.lit(n) for n, _ in rules])

    def decide(x):
        top = F.array_max(x)
        share = F.round(top / F.aggregate(x, F.lit(0), lambda a, v: a + v), 6)
        return F.struct(F.when(top >= least, F.element_at(names, F.array_position(x, top).cast("int"))).otherwise(other).alias("kind"), F.when(top >= least, share).otherwise(0.0).alias("confidence"))

    return let(points, decide)


def argmax_label(probabilities: Column, labels: tuple[str, ...]) -> Column:
    """F-34: the label of the greatest probability, null on a tie."""
    top = F.array_max(probabilities)
    alone = F.size(F.filter(probabilities, lambda x: x == top)) == 1
    return F.when(alone, F.element_at(F.array(*map(F.lit, labels)), F.array_position(probabilities, top).cast("int")))
