"""Problem 9: pages of stuffed keywords, link lists and product tags.

Each page has a rank-frequency curve: the counts of its word types in falling order. The curve is determined by how many types
occur how often, a handful of numbers per page, so a page is reduced to these where it is read, and SQL windows over them give
ranks and covered tokens. Per page the fit yields

* ``slope`` and ``residual`` of log count on log rank (least squares over the types, ties at their middle rank);
* ``cover_k``, the share of tokens that the k most frequent types hold, k = 1, 2, 4 ... 32, from 4k tokens on;
* ``tail``, distinct types over tokens beyond the four most frequent types. A page about one company repeats the name, an
  interview its questioner; prose beyond them is still varied, and stuffing is not.

A text of more than ``SEGMENT`` tokens is measured in equal consecutive segments, so that lengths stay comparable and a long
text is never judged by its finite vocabulary. What prose of the same language has at the same length is fitted over all
segments: a line of each feature against ln length, and how far prose strays from it, its 1st and 99th percentile within three
classes of length. Segments that are far off a first, coarser fit are no prose and are left out, three times over.

A segment's ``score`` counts, in units of that stray (1 is where one prose segment in a hundred is),

* how extreme its slope is, to either side,
* how much its residual is above prose's,
* how far its ``tail`` falls short, twice, and
* how far the worst of its ``cover_k`` exceeds, in logarithms: the divergence.

A segment is stuffed from ``limit`` on; a page is flagged if stuffed segments hold more than half of its tokens. A language is the script of most
letters and, where the table states languages, the stated one, if ``ENOUGH`` segments share both; else the script alone.

A type is a run of letters, digits not counting (product-817 and product-204 are one type); all links are one type.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.words import _INVISIBLE, folded
from loomlake.session import written

_LINK = re.compile(r"""<a\s[^>]*>|(?:https?://|www\.)[^\s<>"']+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+/[^\s<>"']*""")
_TAG = re.compile(r"</?[a-z]+>")
_TYPE = re.compile(r"[^\W\d_]+|\0")
#: Scripts that are told apart, and how many letters of an alphabet one of theirs is worth.
SCRIPTS = (("hangul", "[가-힣]+", 3), ("kana", "[぀-ヿ]+", 2), ("han", "[一-鿿㐀-䶿]+", 2), ("cyrillic", "[Ѐ-ӿ]+", 1), ("arabic", "[؀-ۿ]+", 1), ("devanagari", "[ऀ-ॿ]+", 1), ("thai", "[฀-๿]+", 1), ("hebrew", "[֐-׿]+", 1), ("greek", "[Ͱ-Ͽ]+", 1))
_SCRIPTS = tuple((name, re.compile(p), w) for name, p, w in SCRIPTS)
ENOUGH = 1000
COVERS = (1, 2, 4, 8, 16, 32)
HEAD = 4
SEGMENT = 256
_CURVE = "array<struct<f:int,m:int>>"


def script(whole: str) -> str:
    """The script of most letters, a syllable or ideogram counting for several; latin if no other leads. Kana marks a text that han fills."""
    if whole.isascii():
        return "latin"
    found = {name: w * sum(map(len, p.findall(whole))) for name, p, w in _SCRIPTS}
    if found["kana"]:
        found["kana"] += found.pop("han")
    rest = len(whole) - sum(n // dict((x, w) for x, _, w in SCRIPTS)[name] for name, n in found.items())
    best = max(found, key=lambda k: found[k])
    return best if found[best] > rest else "latin"


def segments(text: str) -> list[tuple[Counter, str]]:
    """For each segment its tokens by type (a link is NUL), and its script."""
    t = folded(text)
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    if "<" in t or "/" in t or "www." in t:
        t = _TAG.sub(" ", _LINK.sub(" \0 ", t))
    types = _TYPE.findall(t)
    parts = -(-len(types) // SEGMENT)
    out = []
    for k in range(parts):
        part = types[k * len(types) // parts : (k + 1) * len(types) // parts]
        out.append((Counter(part), script("".join(part))))
    return out


def _curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("f", pa.int32()), ("m", pa.int32())]))
    for batch in batches:
        for part in range(0, batch.num_rows, 1000):
            piece = batch.slice(part, 1000)
            at, seq, scripts, curves = [], [], [], []
            for k, t in enumerate(piece.column(1).to_pylist()):
                for i, (types, own) in enumerate(segments(t) if t else ()):
                    at.append(k)
                    seq.append(i)
                    scripts.append(own)
                    curves.append([{"f": f, "m": m} for f, m in sorted(Counter(types.values()).items(), reverse=True)])
            rows = piece.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(seq, pa.int32()), pa.array(scripts, pa.string()), pa.array(curves, kind)], names=["id", "page", "stated", "segment", "script", "curve"])


def rank_frequency(docs: DataFrame, doc_id: str, text: str, lang: str | None = None) -> DataFrame:
    """One row per segment of a document row: id, page (the row), segment, script, stated (language), n (tokens), types, slope, residual, tail, cover_1 ... cover_32."""
    kind = docs.schema[doc_id].dataType.simpleString()
    stated = F.lit(None).cast("string") if lang is None else F.lower(docs[lang].cast("string"))
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"), F.monotonically_increasing_id().alias("page"), stated.alias("stated"))
    rows = rows.mapInArrow(_curves, f"id {kind}, page bigint, stated string, segment int, script string, curve {_CURVE}")
    points = rows.select("id", "page", "stated", "segment", "script", F.inline("curve"))
    before = Window.partitionBy("page", "segment").orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("r", F.coalesce(F.sum("m").over(before), F.lit(0)))
    x, y, w = F.log(F.col("r") + (F.col("m") + 1) / 2), F.log(F.col("f").cast("double")), F.col("m")
    sums = {"sw": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "sxy": w * x * y, "syy": w * y * y}
    head = {f"c{k}": F.col("f") * F.least(w, F.greatest(F.lit(0), k - F.col("r"))) for k in COVERS}
    page = points.groupBy("page", "segment").agg(
        F.first("id").alias("id"), F.first("script").alias("script"), F.first("stated").alias("stated"), F.sum(F.col("f") * w).alias("n"), F.sum(w).alias("types"),
        *[F.sum(e).alias(k) for k, e in (sums | head).items()],
    )
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")
    vxy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    rest = F.col("n") - F.col(f"c{HEAD}")
    return page.select(
        "id", "page", "segment", "script", "stated", "n", "types",
        F.when(vx > 1e-9, vxy / vx).alias("slope"),
        F.when(vx > 1e-9, F.sqrt(F.greatest(F.lit(0.0), vy - vxy * vxy / vx) / F.col("sw"))).alias("residual"),
        F.when(rest >= 1, (F.col("types") - HEAD) / rest).when(F.col("n") >= 3 * HEAD, 0.0).alias("tail"),
        *[F.when(F.col("n") >= 4 * k, F.col(f"c{k}") / F.col("n")).alias(f"cover_{k}") for k in COVERS],
    )


#: Features, and the least stray that counts as one unit.
FEATURES = {"slope": 0.05, "residual": 0.03, "tail": 0.03} | {f"cover_{k}": 0.1 for k in COVERS}


def _value(name: str) -> F.Column:
    return F.log(name) if name.startswith("cover_") else F.col(name)


def _expected(name: str) -> F.Column:
    return F.coalesce(f"{name}_i", F.lit(0.0)) + F.coalesce(f"{name}_s", F.lit(0.0)) * F.log("n")


def _taught(prose: DataFrame) -> DataFrame:
    """Each segment for its own norm and for that of its script, which stands in where a language has no norm."""
    return prose.withColumn("norm", F.explode(F.array_distinct(F.array("norm", "script"))))


def _with_lines(rows: DataFrame, prose: DataFrame, names: list[str]) -> DataFrame:
    """rows with the line (_s, _i) of each feature in the prose of their norm."""
    fit = _taught(prose).groupBy("norm").agg(*[f(_value(name), F.log("n")).alias(f"{name}_{part}") for name in names for part, f in (("s", F.regr_slope), ("i", F.regr_intercept))])
    return rows.join(F.broadcast(fit), "norm", "left")  # a row a norm, see above


def scored(curves: DataFrame, rounds: int = 3) -> DataFrame:
    """curves (from ``rank_frequency``) with norm, the four parts of the score and score itself."""
    whole = curves.count()
    both = curves.filter("stated is not null").groupBy("script", "stated").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= max(ENOUGH, whole // 10_000)).select("script", "stated", F.concat_ws("/", "script", "stated").alias("_both"))
    rows = curves.join(F.broadcast(both), ["script", "stated"], "left").withColumn("norm", F.coalesce("_both", "script")).drop("_both")
    rows = rows.withColumn("class", F.when(F.col("n") < 48, 0).when(F.col("n") < 128, 1).otherwise(2))
    rows = written(rows, "stuffing-rows")
    prose, covers = rows.filter("tail is not null"), [f"cover_{k}" for k in COVERS]
    for _ in range(rounds):
        lined = _with_lines(rows, prose, ["tail", *covers])
        excess = F.greatest(*[F.col(c) - F.exp(_expected(c)) for c in covers])
        shortfall = F.least(F.lit(1.0), _expected("tail")) - F.col("tail")
        prose = lined.filter(shortfall + F.coalesce(F.greatest(F.lit(0.0), excess), F.lit(0.0)) / 2 < 0.15).select(*rows.columns)
    names = list(FEATURES)
    off = _with_lines(rows, prose, names).withColumns({f"{x}_r": _value(x) - _expected(x) for x in names}).select(*rows.columns, *[f"{x}_r" for x in names])
    spread = _with_lines(_taught(prose), prose, names).groupBy("norm", "class").agg(*[F.percentile_approx(_value(x) - _expected(x), [0.01, 0.5, 0.99], 10_000).alias(f"{x}_q") for x in names])
    off = off.join(F.broadcast(spread), ["norm", "class"], "left")  # three rows a norm

    def units(x: str) -> F.Column:
        """How far beyond the middle of prose, in its own stray to that side."""
        q, floor = F.col(f"{x}_q"), F.lit(FEATURES[x])
        e = F.col(f"{x}_r") - F.coalesce(q[1], F.lit(0.0))
        side = F.when(e > 0, F.coalesce(q[2] - q[1], floor)).otherwise(F.coalesce(q[1] - q[0], floor))
        return F.coalesce(e / F.greatest(side, floor), F.lit(0.0))

    zero, cap = F.lit(0.0), F.lit(8.0)
    parts = {
        "steep": F.least(cap, F.abs(units("slope"))),
        "rough": F.least(cap, F.greatest(zero, units("residual"))),
        "short": F.least(cap, F.greatest(zero, -units("tail"))),
        "heavy": F.least(cap, F.greatest(zero, *[units(c) for c in covers])),
    }
    return off.withColumns(parts).withColumn("score", F.col("steep") + F.col("rough") + 2 * F.col("short") + F.col("heavy")).select(*rows.columns, *parts, "score")


def stuffed(docs: DataFrame, doc_id: str, text: str, lang: str | None = None, limit: float = 7.0) -> DataFrame:
    """Ids of the stuffed pages, one row per flagged document row.

    Null, empty, blank and wordless texts are never flagged; a scrap of a few words has too little of a curve to reach the limit. The corpus
    gives the norm: it must be prose for the most part. lang: the column that states languages, if any; null and wrong ones do no
    harm. Other columns are not read; an empty table gives no row.
    """
    parts = scored(written(rank_frequency(docs, doc_id, text, lang), "stuffing-curves"))
    pages = parts.groupBy("page").agg(F.first("id").alias(doc_id), F.sum("n").alias("_n"), F.sum(F.when(F.col("score") >= limit, F.col("n")).otherwise(0)).alias("_bad"))
    return pages.filter(2 * F.col("_bad") > F.col("_n")).select(doc_id)
