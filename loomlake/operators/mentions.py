"""Dictionary matching and sentence evidence over text (X-01 to X-13, X-18, X-33): Arrow batches, nothing per row crosses the JVM."""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.text import boilerplate_at, sentences, stands_alone
from loomlake.session import written

_SPAN = "array<struct<key:string,alias:string,start:int,end:int>>"
_HIT = "array<struct<key:string,alias:string,part:string,start:int,end:int,method:string,confidence:double>>"
#: Confidence of a mention by the way it was found.
CONFIDENCE = {"name": 1.0, "member": 1.0, "code": 0.9, "product": 0.7, "holder": 0.5}
_CODES = re.compile(r"\$([A-Z]{1,5})\b|\b(?:NASDAQ|NYSE|KOSPI|KOSDAQ|KRX)\s?[:：]\s?([A-Z]{1,5}|\d{6})\b|[(（]\s?(\d{6}|[A-Z]{2,5})\s?[)）]")


class Matcher:
    """Leftmost-longest dictionary matches that stand by themselves, and what they mean within their document.

    entries: (alias, kind, key, holder). Kinds: ``name`` of a company; ``product``, which counts only where its company is named
    as well; ``group``, a name that several companies share (one entry a member): it means the members named elsewhere in the
    document, else its holder, else nothing; ``industry``; ``block``, a longer word that hides the names inside it. A name of several
    keys is such a group without a holder. A code counts in the form $CODE or EXCHANGE: CODE, or in brackets right behind a name of its company or,
    if it is a number, behind anything.
    """

    def __init__(self, entries: list[tuple[str, str, str, str | None]], codes: dict[str, str] | None = None):
        import ahocorasick

        known: dict[str, dict[str, set]] = {}
        self.holder: dict[str, str] = {}
        for alias, kind, key, holder in entries:
            if alias and len(alias) > 1:
                known.setdefault(alias.lower(), {}).setdefault(kind, set()).add(key)
                if kind == "group" and holder:
                    self.holder[alias.lower()] = holder
        self.trie = ahocorasick.Automaton()
        for alias, kinds in known.items():
            kind = next(k for k in ("block", "name", "group", "product", "industry") if k in kinds)
            keys = frozenset(kinds[kind])
            if kind in ("name", "product") and len(keys) > 1:
                kind = "group"
            self.trie.add_word(alias, (len(alias), alias, kind, keys))
        self.any = len(self.trie) > 0
        if self.any:
            self.trie.make_automaton()
        self.codes = codes or {}

    def raw(self, text: str | None) -> list[tuple[int, int, str, str, frozenset]]:
        """(start, end, dictionary alias, kind, keys), leftmost and longest, offsets in code points."""
        if not text or not self.any:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found = sorted(((end - n + 1, end + 1, alias, kind, keys) for end, (n, alias, kind, keys) in self.trie.iter(low)), key=lambda x: (x[0], -x[1]))
        return leftmost(text, found)

    def match(self, parts: list[tuple[str, str | None]]) -> tuple[list, list, list]:
        """(mentions, unresolved, industries) of a document's (part, text): (key, alias, part, start, end, method, confidence) each."""
        return resolve(parts, [self.raw(text) for _, text in parts], self.holder, self.codes)

    def spans(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """(key, alias as written, start, end) of the mentions in one text."""
        return [(m[0], m[1], m[3], m[4]) for m in self.match([("body", text)])[0]]


def leftmost(text: str, found: list[tuple]) -> list[tuple]:
    """Of matches sorted by start and falling end, those that stand by themselves and overlap none before them."""
    out, at = [], 0
    for m in found:
        if m[0] >= at and stands_alone(text, m[0], m[1]):
            out.append(m)
            at = m[1]
    return out


def resolve(parts: list[tuple[str, str | None]], raws: list[list[tuple]], holder: dict[str, str], codes: dict[str, str]) -> tuple[list, list, list]:
    mentions, industries, open_ = [], [], []
    for (part, text), raw in zip(parts, raws):
        taken = []
        for a, b, alias, kind, keys in raw:
            if kind == "block":
                continue
            taken.append((a, b))
            row = [None, text[a:b], part, a, b]
            if kind == "industry":
                industries += [(k, *row[1:], "industry", 1.0) for k in sorted(keys)]
            elif kind == "name":
                mentions.append((next(iter(keys)), *row[1:], "name", CONFIDENCE["name"]))
            else:
                open_.append((alias, kind, keys, row))
        own = {(m[3], m[4]): m[0] for m in mentions if m[2] == part}
        for m in _CODES.finditer(text or "") if codes else ():
            code = m[1] or m[2] or m[3]
            key = codes.get(code)
            named = m[3] is None or code.isdigit() or any(k == key and 0 <= m.start() - e <= 1 for (_, e), k in own.items())
            at = m.start(m.lastindex)
            if key and named and not any(x <= at < y for x, y in taken):
                mentions.append((key, code, part, at, m.end(m.lastindex), "code", CONFIDENCE["code"]))
    named = {m[0] for m in mentions}
    unresolved = []
    for alias, kind, keys, row in open_:
        here = sorted(keys & named)
        if here:
            method = "product" if kind == "product" else "member"
            mentions += [(k, *row[1:], method, CONFIDENCE[method]) for k in here]
        elif kind == "group" and alias in holder:
            mentions.append((holder[alias], *row[1:], "holder", CONFIDENCE["holder"]))
        else:
            unresolved.append((alias, *row[1:], kind, 0.0))
    order = {p: k for k, (p, _) in enumerate(parts)}
    mentions.sort(key=lambda m: (order[m[2]], m[3], m[4], m[0]))
    return mentions, unresolved, industries


_FIELDS = ("key", "alias", "part", "start", "end", "method", "confidence")
_ARROW = pa.list_(pa.struct([("key", pa.string()), ("alias", pa.string()), ("part", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("method", pa.string()), ("confidence", pa.float64())]))


def _hits(rows: list[list[tuple]]) -> pa.Array:
    return pa.array([[dict(zip(_FIELDS, r)) for r in own] for own in rows], _ARROW)


def _match(dictionary, cut: bool):
    """One pass over (id, title, body): the body's length, mentions, unresolved names, industries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(*dictionary.value)
        for batch in batches:
            out = []
            for title, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = body[: boilerplate_at(body)] if cut and body else body
                out.append((own, m.match([("title", title), ("body", own)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o for o, _ in out], pa.string()), *[_hits([r[k] for _, r in out]) for k in range(3)]], names=["id", "text", "mentions", "unresolved", "industries"]
            )

    return run


def _raw(dictionary, first: bool):
    """Adds a block of the dictionary's matches to those of the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(dictionary.value[0])
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                old = [[], []] if first else [pickle.loads(batch.column(c)[k].as_py()) for c in (3, 4)]
                texts = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                found.append([pickle.dumps(o + m.raw(t)) for o, t in zip(old, texts)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], names=["id", "title", "body", "t", "b"])

    return run


def _settle(rest):
    """The longest of all blocks' matches, and what they mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder, codes = rest.value
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                title, body = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                raws = [leftmost(t or "", sorted(pickle.loads(batch.column(c)[k].as_py()), key=lambda x: (x[0], -x[1]))) for t, c in ((title, 3), (body, 4))]
                out.append(resolve([("title", title), ("body", body)], raws, holder, codes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[_hits([r[k] for r in out]) for k in range(3)]], names=["id", "text", "mentions", "unresolved", "industries"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t[: boilerplate_at(t)] if t else t for t in batch.column(2).to_pylist()], pa.string())], names=["id", "title", "body"])


def match_documents(docs: DataFrame, doc_id: str, title: str | None, body: str, entries: DataFrame, codes: DataFrame | None = None, cut: bool = True, most: int = 200_000) -> DataFrame:
    """X-01: (id, text, mentions, unresolved, industries) of every document in one pass; text is the body before its boilerplate.

    entries: (alias, kind, key, holder) as for ``Matcher``; codes: (code, key). Null texts have no matches. The dictionary travels to the tasks,
    so it is held in blocks of ``most`` entries: one block in the usual case; more are matched one after the other, each with a task's memory
    for one block, and the longest of all blocks' matches is settled at the end. An alias's entries are always of one block.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"id {kind}, text string, mentions {_HIT}, unresolved {_HIT}, industries {_HIT}"
    rows = docs.select(docs[doc_id].alias("id"), (F.lit(None).cast("string") if title is None else docs[title].cast("string")).alias("title"), docs[body].alias("body"))
    known = entries.select(F.col("alias").cast("string"), "kind", F.col("key").cast("string"), F.col("holder").cast("string")).filter("alias is not null").distinct()
    code_map = {r[0]: r[1] for r in codes.select("code", F.col("key").cast("string")).collect()} if codes is not None else {}  # one code a company
    few = known.limit(most + 1).collect()
    if len(few) <= most:
        return rows.mapInArrow(_match(spark.sparkContext.broadcast(([tuple(r) for r in few], code_map)), cut), out)
    n = known.count() // most + 1
    rows = rows.mapInArrow(_cut, f"id {kind}, title string, body string") if cut else rows
    raw_schema = f"id {kind}, title string, body string, t binary, b binary"
    holder: dict[str, str] = {}
    # Twice as many blocks as needed, so that no block is much over its share.
    known = known.withColumn("_block", F.pmod(F.xxhash64(F.lower("alias")), F.lit(2 * n)).cast("int"))
    for k in range(2 * n):
        block = [(r[0], r[1], r[2], r[3]) for r in known.filter(F.col("_block") == k).collect()]
        holder |= Matcher(block).holder
        rows = written(rows.mapInArrow(_raw(spark.sparkContext.broadcast((block,)), k == 0), raw_schema), "mentions-raw")
    return rows.mapInArrow(_settle(spark.sparkContext.broadcast((holder, code_map))), out)


def mentions(docs: DataFrame, doc_id: str, text: str, aliases: DataFrame, alias: str, key: str, most: int = 200_000) -> DataFrame:
    """(id, text, spans): the names of a plain (alias, key) dictionary in one text, uncut; an alias of several keys only beside one of them."""
    entries = aliases.select(F.col(alias).alias("alias"), F.lit("name").alias("kind"), F.col(key).alias("key"), F.lit(None).cast("string").alias("holder"))
    m = match_documents(docs, doc_id, None, text, entries, cut=False, most=most)
    return m.select("id", "text", F.transform("mentions", lambda x: F.struct(x["key"].alias("key"), x["alias"].alias("alias"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def mention_batch(matched: DataFrame, root: str) -> dict[str, DataFrame]:
    """The four tables of a mention batch from one pass: spans, data (a row per document and company), unresolved, industries; each read back."""
    spark = matched.sparkSession
    matched = written(matched.drop("text"), "mentions-batch")
    spans = matched.select("id", F.inline("mentions"))
    data = spans.groupBy("id", "key").agg(
        F.count(F.lit(1)).alias("n_mentions"), F.min_by("part", F.struct(F.when(F.col("part") == "title", 0).otherwise(1).alias("p"), "start")).alias("first_pos"), F.max("confidence").alias("confidence"),
        F.array_join(F.array_sort(F.collect_set("method")), "+").alias("method"), F.array_sort(F.collect_set("alias")).alias("aliases"),
    )
    tables = {"spans": spans, "data": data, "unresolved": matched.select("id", F.inline("unresolved")), "industries": matched.select("id", F.inline("industries"))}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{root}/{name}") for name, df in tables.items()}


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("key", pa.string()), ("alias", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        take, order, start, end, body, own = [], [], [], [], [], []
        for k, (text, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if not spans:
                continue
            for i, (a, b, s) in enumerate(sentences(text)):
                inside = [x for x in spans if a <= x["start"] < b]
                if inside:
                    take.append(k), order.append(i), start.append(a), end.append(b), body.append(s), own.append(inside)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(take, pa.int64())), pa.array(order, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(body, pa.string()), pa.array(own, kind)],
            names=["id", "sentence_order", "sent_start", "sent_end", "sentence", "spans"],
        )


def sentence_spans(matched: DataFrame) -> DataFrame:
    """J-20: sentences with the spans that begin in them, from ``mentions``."""
    kind = matched.schema["id"].dataType.simpleString()
    return matched.mapInArrow(_sentences, f"id {kind}, sentence_order int, sent_start int, sent_end int, sentence string, spans {_SPAN}")


def evidence_sentences(matched: DataFrame) -> DataFrame:
    """X-07: one row per document, key and sentence with the number of mentions."""
    s = sentence_spans(matched)
    return s.select("id", "sentence_order", "sent_start", "sent_end", "sentence", F.inline("spans")).groupBy("id", "key", "sentence_order", "sent_start", "sent_end", "sentence").agg(F.count(F.lit(1)).alias("mentions"))


def pair_candidates(matched: DataFrame) -> DataFrame:
    """X-06, J-21: pairs of different keys within one sentence in order of first mention, with the place of that mention in the sentence
    and the number of companies there."""
    s = sentence_spans(matched)
    first = s.select("id", "sentence_order", "sentence", "sent_start", F.inline("spans")).groupBy("id", "sentence_order", "sentence", "key").agg(F.min(F.struct(F.col("start") - F.col("sent_start"), F.col("end") - F.col("sent_start"))).alias("at"))
    own = first.groupBy("id", "sentence_order", "sentence").agg(F.array_sort(F.collect_list(F.struct(F.col("at.col1").alias("s"), F.col("at.col2").alias("e"), "key"))).alias("own")).filter(F.size("own") > 1)
    a = own.select("id", "sentence_order", "sentence", F.posexplode("own").alias("i", "x"), "own")
    p = a.select("id", "sentence_order", "sentence", "x", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("y"), F.size("own").alias("companies"))
    return p.select("id", "sentence_order", "sentence", F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.s").alias("a_start"), F.col("x.e").alias("a_end"), F.col("y.s").alias("b_start"), F.col("y.e").alias("b_end"), "companies")


#: Words of each relation (X-09 to X-11); undirected ones are tried first.
RELATION_WORDS = {
    "PARTNER": re.compile(r"협력|제휴|공동|맞손|합의|손잡|team(?:s|ed)? up|partner|alliance|agreed|together|jointly", re.I),
    "COMPETE": re.compile(r"경쟁|맞수|라이벌|rival|compet", re.I),
    "SUPPLY": re.compile(r"공급|납품|suppl|deliver|ships", re.I),
    "INVEST": re.compile(r"지분|사들여|매입|취득|인수|bought|stake|acquir", re.I),
    "LITIGATION": re.compile(r"소송|제소|patent case|lawsuit|sued", re.I),
}
_HEDGE = re.compile(r"검토|가능성|전망|\bmay\b|\bcould\b|\bmight\b|weigh|consider", re.I)
_ENUM = re.compile(r"\s*(?:[·,/&]|와|과|및|,? and|or)\s*")
_BREAK = re.compile(r"[.!?。]\s|\n")
_SUBJECT = re.compile(r"\s?(?:은|는|이|가)(?=\s|,|$)")
_TARGET = re.compile(r"\s?(?:에게|에|와|과|을|를)(?=\s|,|$)")
_LISTED = re.compile(r"\s*(?:등\s?(?:경쟁|협력|파트너|고객)\w*|(?:and|or) (?:other )?(?:rivals|peers|partners|customers))", re.I)
_GIVEN = re.compile(r"(?:공급|납품)(?:하는|한|할|해\s?온)\s*$")
_TO = re.compile(r"\b(?:suppl\w+|deliver\w*|ships)\b.*\bto\s*$", re.I)
_BY = re.compile(r"\b(?:supplied|delivered|bought|acquired|owned|brought) by\s*$", re.I)
_OWNS = re.compile(r"\b(?:bought|acquir\w+|stake in|holds)\b|% of\s*$", re.I)
GAP, WINDOW = 60, 45


def relation_of(sentence: str, a: tuple[int, int], b: tuple[int, int], companies: int = 2, crowd: int = 3) -> tuple[str | None, bool, float, str]:
    """X-09 to X-12: (relation, reversed, confidence, pattern) of the companies at a and b, a first; without a relation the pattern is the reason.

    Reasons: crowded (more than ``crowd`` companies), far (over ``GAP`` characters between them), break (a sentence ends there), hedged, no_keyword,
    listed (both are somebody else's rivals or partners), co_listed, no_direction. A keyword counts within ``WINDOW`` characters.
    """
    gap, after = sentence[a[1] : b[0]], sentence[b[1] :]
    if companies > crowd:
        return None, False, 0.0, "crowded"
    if len(gap) > GAP:
        return None, False, 0.0, "far"
    if _BREAK.search(gap):
        return None, False, 0.0, "break"
    window = sentence[max(0, a[0] - WINDOW) : b[1] + WINDOW]
    if _HEDGE.search(window):
        return None, False, 0.0, "hedged"
    enum = bool(_ENUM.fullmatch(gap))
    subject_a, subject_b = bool(_SUBJECT.match(gap)), bool(_SUBJECT.match(after))
    target_a, target_b = bool(_TARGET.match(gap)), bool(_TARGET.match(after))
    why = "no_keyword"
    for rel, words in RELATION_WORDS.items():
        if not words.search(window):
            continue
        if rel in ("PARTNER", "COMPETE"):
            if _LISTED.match(after):
                return None, False, 0.0, "listed"
            return (rel, False, 0.8, "enum") if enum else (rel, False, 0.6, "clause") if target_b or subject_a else (rel, False, 0.5, "near")
        if enum:
            why = "co_listed"
            continue
        if rel == "SUPPLY":
            if target_a and _GIVEN.search(gap):
                return rel, True, 0.75, "relative"
            if subject_a and target_b or _TO.search(gap):
                return rel, False, 0.7, "subject"
            if subject_b and target_a or _BY.search(gap):
                return rel, True, 0.7, "subject"
        elif rel == "INVEST":
            if _BY.search(gap):
                return rel, True, 0.7, "passive"
            if _OWNS.search(gap) or subject_a and re.match(r"\s?지분", after):
                return rel, False, 0.7, "stake"
        else:
            if _BY.search(gap):
                return rel, True, 0.7, "passive"
            return rel, False, 0.6, "clause"
        why = "no_direction"
    return None, False, 0.0, why


def _relations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(2, 10)]
        src, dst, rel, conf, pat, rej = [], [], [], [], [], []
        for sentence, a, b, as_, ae, bs, be, n in zip(*cols):
            r, flip, c, p = relation_of(sentence, (as_, ae), (bs, be), n)
            src.append(b if flip else a)
            dst.append(a if flip else b)
            rel.append(r)
            conf.append(c)
            pat.append(p if r else None)
            rej.append(None if r else p)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(rel, pa.string()), pa.array(conf, pa.float64()), pa.array(pat, pa.string()), pa.array(rej, pa.string())],
            names=["id", "sentence_order", "sentence", "src", "dst", "relation", "confidence", "pattern", "reject"],
        )


def classified(pairs: DataFrame) -> DataFrame:
    """X-09 to X-12: (id, sentence_order, sentence, src, dst, relation, confidence, pattern, reject) of every pair of ``pair_candidates``."""
    kind = pairs.schema["id"].dataType.simpleString()
    own = pairs.select("id", "sentence_order", "sentence", "a", "b", "a_start", "a_end", "b_start", "b_end", "companies")
    return own.mapInArrow(_relations, f"id {kind}, sentence_order int, sentence string, src string, dst string, relation string, confidence double, pattern string, reject string")


def expand_lists(lists: DataFrame, list_id: str, text: str, heads: DataFrame, names: DataFrame, mark: str = "·") -> DataFrame:
    """X-02: (id, pos, part) of each list "Alpha Motors·Foods, more": the parts before the first comma, those that leave out the first part's head given it back
    (Alpha Motors, Alpha Foods). heads and names: one column each. The longest head that begins the first part is borrowed; a part that
    begins with a head, or is a name itself, stays as it is. All by joins on prefixes, so heads and names may be any number.
    """
    kind = lists.schema[list_id].dataType.simpleString()
    rows = lists.filter(F.instr(text, mark) > 0).select(F.col(list_id).cast(kind).alias("id"), F.posexplode(F.split(F.regexp_extract(text, r"^([^,]*)", 1), mark)).alias("pos", "part"))
    rows = rows.withColumn("part", F.trim("part")).filter("part <> ''")
    rows = written(rows.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1), "lists")
    h = heads.select(F.col(heads.columns[0]).alias("head")).filter("head is not null and head <> ''").distinct()
    begins = rows.select("id", "pos", "part", F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda k: F.substring("part", F.lit(1), k))).alias("head")).join(h, "head")
    first = begins.filter((F.col("pos") == 0) & (F.col("head") != F.col("part"))).groupBy("id").agg(F.max_by("head", F.length("head")).alias("head"), F.first("part").alias("whole"))
    own = begins.select("id", "pos").distinct().withColumn("kept", F.lit(True))
    known = names.select(F.col(names.columns[0]).alias("part")).distinct().withColumn("named", F.lit(True))
    out = rows.join(first, "id", "left").join(own, ["id", "pos"], "left").join(known, "part", "left")
    gap = F.when(F.substring("whole", F.length("head") + 1, F.lit(1)) == " ", " ").otherwise("")
    stays = (F.col("pos") == 0) | F.col("head").isNull() | F.col("kept").isNotNull() | F.col("named").isNotNull()
    return out.select("id", "pos", F.when(stays, F.col("part")).otherwise(F.concat("head", gap, "part")).alias("part"))


def bio(sentence: str, spans: list[tuple[int, int]]) -> list[str]:
    """X-08: a tag per token; tokens are runs without white space, spans are offsets in the sentence. A span that cuts a token gives none."""
    out = []
    for m in re.finditer(r"\S+", sentence):
        tag = "O"
        for a, b in spans:
            if a == m.start():
                tag = "B"
            elif a < m.start() < b:
                tag = "I"
        out.append(tag)
    return out


_TOTAL = re.compile(r"(?:합\s*계|소\s*계|계|total|subtotal)", re.I)


def parse_holders(text: str) -> list[tuple[str, float]]:
    """X-18: (holder, percent) of the lines of an ownership table; lines of totals and shares above 100 are none."""
    rows = ((m[1].strip(), float(m[2])) for m in re.finditer(r"^[^\S\n]*(\S[^\n]*?)[^\S\n]+(?:[\d,]+[^\S\n]+)?(\d{1,3}(?:\.\d+)?)[^\S\n]*%[^\S\n]*$", text, re.M))
    return [(h, p) for h, p in rows if 0 < p <= 100 and re.search(r"[^\W\d_]", h) and not _TOTAL.fullmatch(h)]


def active_relations(text: F.Column) -> F.Column:
    """X-20: the relation types whose words a text holds, and CO_MENTIONED, which needs none; none for a null text."""
    found = [F.when(text.rlike("(?i)" + p.pattern), name) for name, p in sorted(RELATION_WORDS.items())]
    return F.when(text.isNotNull(), F.array_sort(F.array_compact(F.array(F.lit("CO_MENTIONED"), *found))))


def first_group_wins(texts: list[str], threshold: float = 0.5, n: int = 3) -> list[int]:
    """X-33: group of each text: the first earlier group with any member that shares enough n-grams (over the shorter one).

    n-grams are of letters and digits alone. Candidates are exact: all earlier texts that share a gram are counted through postings.
    """
    postings: dict[str, array] = {}
    sizes, groups = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    last = 0
    for k, text in enumerate(texts):
        t = re.sub(r"[^0-9A-Za-z가-힣]", "", text)
        g = {t[i : i + n] for i in range(max(1, len(t) - n + 1))}
        sizes[k], groups[k] = len(g), last
        known = [np.frombuffer(postings[x], np.int32) for x in g if x in postings]
        if known:
            shared = np.bincount(np.concatenate(known), minlength=k)
            near = groups[:k][shared >= (threshold - 1e-9) * np.minimum(sizes[:k], len(g))]
            if len(near):
                groups[k] = near.min()
        last += groups[k] == last
        del known
        for x in g:
            postings.setdefault(x, array("i")).append(k)
    return groups.tolist()


RISK = r"채용|스포츠|부동산|recruit|sports|real estate"


def accepted(matched: DataFrame) -> DataFrame:
    """X-03: (id, key, n, risky): mentions by sentence; a key whose every sentence speaks of a risky context is marked."""
    s = sentence_spans(matched).select("id", "sentence", F.inline("spans"))
    return s.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("sentence").rlike(RISK)).alias("risky"))


def between(pairs: DataFrame) -> DataFrame:
    """X-10: pairs with the text between the two names and the first relation whose word stands there."""
    gap = F.expr("substring(sentence, a_end + 1, b_start - a_end)")
    relation = F.lit(None).cast("string")
    for name, p in reversed(RELATION_WORDS.items()):
        relation = F.when(F.col("gap").rlike("(?i)" + p.pattern), name).otherwise(relation)
    return pairs.withColumn("gap", gap).withColumn("relation", relation)
