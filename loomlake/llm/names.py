"""Problem 2: variant spellings of names typed by people.

Names of entities are entries of an inverted index, cut into one segment more than the edits their length allows; the readings of an
alias look up position-shifted substrings in it. Two spellings within k edits share one of k + 1 segments unharmed (pigeonhole),
shifted no further than the edits before and after it allow.

* From nine characters: two edits, three segments; one to three places to look for each length of entry.
* Four to eight: one edit or one swap of neighbours, two segments; a swap across the cut harms both, so the reading with its two middle
  characters swapped is looked up as well.
* Three: one replaced character; the two others are the key, one key for each place.

So a key is of two characters at least. Pairs that meet are verified with the banded edit distance of the JVM.

A name is a core and a business word (``Korvan | Logistics``). Business words are learned: what follows the core in the names
themselves, in either script, paired over the entities that have both. An alias may

* drop or change the legal form, case, width, spaces and punctuation, or have invisible characters: none of that is part of a spelling;
* be made of syllables: the first of the core, or its first two, or its first and last, and the first of the business word;
* put the business word first, abbreviate it, take it from the other language, or leave it out (then its core must be one entity's alone);
* have been typed on the wrong keyboard layout;
* have typing errors: one edit or one swap of neighbours from four characters on (a replaced one of three), two edits from nine.

An alias that ends in another known business word than the entity's is another company. The readings with the least cost count;
an alias is linked if they all mean one entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.words import _INVISIBLE
from loomlake.session import written

#: Legal forms at the end of a Latin name, and the mark in front of it (fixed values).
LEGAL = frozenset({"inc", "corp", "corporation", "company", "co", "ltd", "limited", "plc", "incorporated", "llc"})
_LEGAL_MARK = re.compile(r"\((?:주|株|유)\)|주식회사")
_CODE = re.compile(r"\(\s*(?:[a-z]{1,5}|\d{6})\s*\)")
_TOKEN = re.compile(r"[^\W_]+")
_HANGUL = re.compile(r"[가-힣]")
#: Keys of the two-set Hangul layout in the order of the jamo of a syllable's parts (fixed values).
_LEAD = "r R s e E f a q Q t T d w W c z x v g".split()
_VOWEL = "k o i O j p u P h hk ho hl y n nj np nl b m ml l".split()
_TAIL = " r R rt s sw sg e f fr fa fq ft fx fv fg a q qt t T d w c z x v g".split(" ")
_SYLLABLE = re.compile("(" + "|".join(sorted(_LEAD, key=len, reverse=True)) + ")(" + "|".join(sorted(_VOWEL, key=len, reverse=True)) + ")((?:" + "|".join(sorted(filter(None, _TAIL), key=len, reverse=True)) + ")?)(?=[rRseEfaqQtTdwWczxvg][hkoijpuPOynbml]|$)")
_SHIFTED = frozenset("RQTEWOP")


def hangul_of_keys(text: str) -> str | None:
    """The Hangul that these keys type, or null if they do not make whole syllables."""
    keys = "".join(c if c in _SHIFTED else c.lower() for c in text)
    out, at = [], 0
    while at < len(keys):
        m = _SYLLABLE.match(keys, at)
        if not m:
            return None
        out.append(chr(0xAC00 + (_LEAD.index(m[1]) * 21 + _VOWEL.index(m[2])) * 28 + _TAIL.index(m[3])))
        at = m.end()
    return "".join(out) or None


def parts(name: str, fold: bool = True) -> list[str]:
    """Tokens of a name without legal form and mark."""
    t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", name))
    low = t.lower()
    low = _CODE.sub(" ", _LEGAL_MARK.sub(" ", low)).replace("'", "")
    tokens = _TOKEN.findall(low)
    while len(tokens) > 1 and tokens[-1] in LEGAL:
        tokens.pop()
    if len(tokens) > 1 and tokens[0] == "the":
        del tokens[0]
    return tokens


class Business:
    """Business words: Latin phrases (token tuples) and the Hangul suffix that goes with each, if any."""

    def __init__(self, phrases: list[tuple[tuple[str, ...], str | None]]):
        """phrases: (phrase, its Hangul suffix or None), a suffix with one phrase."""
        self.latin = {p for p, _ in phrases}
        self.hangul: dict[str, tuple[str, ...]] = {h: p for p, h in phrases if h}
        self.of = {p: h for h, p in self.hangul.items()}
        self.words = {w for p in self.latin for w in p}
        self.begun: dict[str, list[str]] = {}
        for w in sorted(self.words):
            self.begun.setdefault(w[0], []).append(w)
        self.longer: dict[str, list[tuple[str, ...]]] = {}
        for p in sorted(self.latin):
            if len(p) > 1:
                self.longer.setdefault(p[-1], []).append(p)
        self.suffixes = set(self.hangul)
        self.phrase = {"".join(p): p for p in sorted(self.latin)}
        self.lengths = sorted({len(s) for s in self.phrase}, reverse=True), sorted({len(s) for s in self.suffixes}, reverse=True)
        self.expanded = lru_cache(maxsize=200_000)(self._expanded)

    def __getstate__(self):
        return sorted((p, self.of.get(p)) for p in self.latin)

    def __setstate__(self, phrases):
        self.__init__(phrases)

    def _ending(self, whole: str, known, lengths: list[int], more: int = 0) -> str | None:
        """The longest known word, longer than ``more``, that ends the text and leaves something before it: a look-up a length."""
        for k in lengths:
            if more < k < len(whole) and whole[-k:] in known:
                return whole[-k:]
        return None

    def split(self, tokens: list[str]) -> tuple[str, tuple[str, ...] | None]:
        """Core and business word of a name's tokens, the word null if there is none."""
        whole = "".join(tokens)
        known = [k for k in (1, 2, 3) if len(tokens) > k and tuple(tokens[-k:]) in self.latin]
        if known:
            # "korvanheavy industries" ends in the longer phrase
            longer = self._ending(whole, self.phrase, self.lengths[0], len("".join(tokens[-known[-1] :])))
            if longer:
                return whole[: -len(longer)], self.phrase[longer]
            return "".join(tokens[: -known[-1]]), tuple(tokens[-known[-1] :])
        suffix = self._ending(whole, self.suffixes, self.lengths[1])
        if suffix:
            return whole[: -len(suffix)], self.hangul[suffix]
        joined = self._ending(whole, self.phrase, self.lengths[0])
        if joined:
            return whole[: -len(joined)], self.phrase[joined]
        return whole, None

    def _expanded(self, token: str) -> tuple[str, ...]:
        """Business words that a token abbreviates (same first letter, letters in order), itself not being one. Of words with its first
        letter alone; each token is worked out once."""
        if token in self.words or len(token) < 2 or not token.isascii():
            return ()
        out = []
        for w in self.begun.get(token[0], ()):
            if len(token) < len(w):
                rest = iter(w)
                if all(c in rest for c in token):
                    out.append(w)
        begun = [w for w in out if w.startswith(token)]
        return tuple(begun or out)

    def entries(self, name: str) -> set[tuple[str, str, str]]:
        """(spelling, kind, business word) of a name; kind full, core for the core alone, short for syllables picked from core and word."""
        out = set()
        core, phrase = self.split(parts(name)) if name else ("", None)
        if core and phrase is None:
            out.add((core, "full", ""))
        elif core:
            key = "".join(phrase)
            out.add((core, "core", key))
            out.add((core + key, "full", key))
            if phrase in self.of:
                word = self.of[phrase]
                out.add((core + word, "full", key))
                if _HANGUL.match(core) and len(core) > 1:
                    out |= {(x, "short", key) for x in (core[0] + word[0], core[:2] + word[0], core[0] + core[-1] + word[0])}
        return out

    def readings(self, alias: str) -> set[tuple[str, str, str]]:
        """(spelling, kind, business word or empty) of an alias."""
        out: set[tuple[str, str, str]] = set()
        tokens = parts(alias)
        if not tokens:
            return out

        def add(t: list[str]) -> None:
            core, phrase = self.split(t)
            out.add(("".join(t), "full", "".join(phrase or ())))
            if phrase is None:
                out.add((core, "core", ""))
                if len(core) < 4 and _HANGUL.match(core):
                    out.add((core, "short", ""))

        add(tokens)
        if len(tokens) == 1 and tokens[0].isascii() and tokens[0].isalpha():
            # The keys' case tells doubled consonants, so the text before folding is asked.
            raw = "".join(_TOKEN.findall(_INVISIBLE.sub("", unicodedata.normalize("NFKC", alias))))
            for keys in {raw, raw.lower()}:
                typed = hangul_of_keys(keys)
                if typed and len(typed) > 1:
                    add([typed])
        for k in (1, 2):
            if len(tokens) > k:
                moved = tokens[k:] + tokens[:k]
                if self.split(moved)[1] is not None or k == 1 and self.expanded(tokens[0]):
                    add(moved)
        if 1 < len(tokens) <= 4:
            for t in (tokens, tokens[1:] + tokens[:1]):
                options = [[x, *self.expanded(x)] for x in t[1:]]
                if any(len(o) > 1 for o in options):
                    for choice in product(*options):
                        # "ins" may stand for a phrase's last word alone
                        full = [t[0], *choice]
                        if self.split(full)[1] is not None:
                            add(full)
                        elif len(choice) == 1:
                            for p in self.longer.get(choice[0], ()):
                                add([t[0], *p])
        return {r for r in out if r[0]}


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a name may teach: its words after the first (Latin), or the whole of it (with Hangul)."""
    for batch in batches:
        at, phrase, whole = [], [], []
        for k, n in enumerate(batch.column(1).to_pylist()):
            t = parts(n)
            joined = "".join(t)
            if not t or len(t) == 1 and not _HANGUL.search(joined):
                continue
            korean = _HANGUL.search(joined) is not None
            at.append(k)
            phrase.append(None if korean else " ".join(t[1:]))
            whole.append(joined if korean else None)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(phrase, pa.string()), pa.array(whole, pa.string())], names=["entity", "phrase", "whole"])


def business_words(names: DataFrame, least: int = 3, share: float = 5e-5) -> Business:
    """Learned from all names (entity, name): what follows the first word in the Latin names of ``least`` entities and of ``share`` of
    them, with the Hangul ending that most of their Hangul names have.

    Counted in Spark. An entity has few such phrases, so no more than (its phrases) / share can pass: what comes to the driver does
    not grow with the names.
    """
    taught = written(names.mapInArrow(_phrases, "entity string, phrase string, whole string").distinct(), "names-taught")
    latin = taught.filter("phrase is not null").select("entity", "phrase").distinct()
    least = max(least, int(share * names.select("entity").distinct().count()))
    good = latin.groupBy("phrase").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least).select("phrase")
    pairs = latin.join(F.broadcast(good), "phrase").join(taught.filter("whole is not null").select("entity", "whole"), "entity").select("phrase", "whole").distinct()  # good: bounded, see above
    total = pairs.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    ends = pairs.select("phrase", F.explode(F.array_compact(F.array(*[F.when(F.length("whole") > k, F.expr(f"right(whole, {k})")) for k in (2, 3, 4)]))).alias("end"))
    ends = ends.groupBy("phrase", "end").agg(F.count(F.lit(1)).alias("c")).join(total, "phrase").filter((F.col("n") >= least) & (F.col("c") > 0.6 * F.col("n")))
    best = ends.groupBy("phrase").agg(F.max(F.struct(F.length("end").alias("l"), "c", "end")).alias("b"))
    rows = good.join(best, "phrase", "left").select("phrase", "b.end", "b.c").collect()
    owner: dict[str, tuple] = {}
    for r in rows:
        if r["end"]:
            owner[r["end"]] = max(owner.get(r["end"], (0, "")), (r["c"], r["phrase"]))
    return Business([(tuple(r["phrase"].split(" ")), r["end"] if r["end"] and owner[r["end"]][1] == r["phrase"] else None) for r in rows])


def _readings(business):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, *r) for a in batch.column(0).to_pylist() for r in sorted(business.value.readings(a))]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["alias", "probe", "kind", "word"])

    return run


def _entries(business):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(e, *x) for e, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in sorted(business.value.entries(n))]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["entity", "spelling", "kind", "word"])

    return run


def _thirds(n: F.Column) -> list[tuple[F.Column, F.Column]]:
    """Starts (from 0) and lengths of three segments of an entry of n characters; the last ones are the longer."""
    a, r = F.floor(n / 3).cast("int"), (n % 3).cast("int")
    lengths = [a, a + (r > 1).cast("int"), a + (r > 0).cast("int")]
    return [(F.lit(0), lengths[0]), (lengths[0], lengths[1]), (lengths[0] + lengths[1], lengths[2])]


def _halves(n: F.Column) -> list[tuple[F.Column, F.Column]]:
    a = F.floor(n / 2).cast("int")
    return [(F.lit(0), a), (a, (n - a).cast("int"))]


LONG = 9


def candidates(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of probes (probe, kind, ...) and entries (spelling, kind, ...) of one kind that share a segment, each once."""
    n, m = F.length("spelling"), F.length("probe")

    def key(i: int, seg: F.Column, length: F.Column) -> F.Column:
        return F.struct(length.cast("int").alias("n"), F.lit(i).alias("i"), seg.alias("seg"))

    def part(text: F.Column, at: F.Column, k: F.Column) -> F.Column:
        return F.substring(text, at + 1, k)

    def others(text: F.Column) -> list[F.Column]:
        """The two other characters for each place of three."""
        return [F.concat(F.substring(text, 2, 2)), F.concat(F.substring(text, 1, 1), F.substring(text, 3, 1)), F.substring(text, 1, 2)]

    s = F.col("spelling")
    cut = [F.when(n >= LONG, key(i, part(s, at, k), n)) for i, (at, k) in enumerate(_thirds(n))]
    cut += [F.when((n >= 4) & (n < LONG), key(i, part(s, at, k), n)) for i, (at, k) in enumerate(_halves(n))]
    cut += [F.when(n == 3, key(i, x, n)) for i, x in enumerate(others(s))]
    index = entries.filter(n >= 3).select("spelling", "kind", F.explode(F.array_compact(F.array(*cut))).alias("c")).select("spelling", "kind", "c.n", "c.i", "c.seg")
    p, looks = F.col("probe"), []
    for edits, of, low, high in ((2, _thirds, LONG, None), (1, _halves, 4, LONG)):
        for delta in range(-edits, edits + 1):  # the probe is longer than the entry by delta
            length = m - delta
            fits = (length >= low) & (F.lit(True) if high is None else length < high)
            for i, (start, k) in enumerate(of(length)):
                for shift in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1):
                    at = start + shift
                    looks.append(F.when(fits & (at >= 0) & (at + k <= m), key(i, part(p, at, k), length)))
    half = F.floor(m / 2).cast("int")
    swapped = F.concat(part(p, F.lit(0), half - 1), part(p, half, F.lit(1)))  # the first half of the entry whose two middle characters were swapped
    looks.append(F.when((m >= 4) & (m < LONG), key(0, swapped, m)))
    looks += [F.when(m == 3, key(i, x, m)) for i, x in enumerate(others(p))]
    asked = probes.filter(m >= 3).select("probe", "kind", F.explode(F.array_compact(F.array(*looks))).alias("c")).select("probe", "kind", "c.n", "c.i", "c.seg").distinct()
    return asked.join(index, ["n", "i", "seg", "kind"]).select("probe", "spelling", "kind").distinct()


def link_names(aliases: DataFrame, alias: str, names: DataFrame, entity: str, name: str) -> DataFrame:
    """(alias, entity): each distinct alias that means exactly one entity.

    Null, blank and letterless aliases are linked to nothing; repeated aliases are linked once; names may repeat, be null or be
    shared (a shared name links nothing). The business words are counted over all names.
    """
    known = names.filter(F.col(entity).isNotNull() & F.col(name).isNotNull()).select(F.col(entity).cast("string").alias("entity"), F.col(name).cast("string").alias("name")).distinct()
    business = aliases.sparkSession.sparkContext.broadcast(business_words(known))
    entries = written(known.mapInArrow(_entries(business), "entity string, spelling string, kind string, word string").distinct(), "names-entries")
    typed = aliases.select(F.col(alias).cast("string").alias("alias")).filter("alias is not null").distinct()
    readings = written(typed.mapInArrow(_readings(business), "alias string, probe string, kind string, word string"), "names-readings")

    def agree(a: str, b: str) -> F.Column:
        return (F.col(a) == "") | (F.col(b) == "") | (F.col(a) == F.col(b))

    own = entries.withColumnRenamed("word", "w")
    exact = readings.join(own.withColumnRenamed("spelling", "probe"), ["probe", "kind"]).filter(agree("word", "w")).select("alias", "entity", F.lit(0).alias("cost"))
    exact = written(exact, "names-exact")
    open_ = readings.join(exact.select("alias").distinct(), "alias", "left_anti")
    long = F.col("kind") != "short"  # picked syllables are looked up exactly
    pairs = candidates(open_.filter(long).select("probe", "kind").distinct(), entries.filter(long).select("spelling", "kind").distinct())
    lev = F.levenshtein(F.col("probe"), F.col("spelling"), 2)
    n, p = F.least(F.length("probe"), F.length("spelling")), F.col("probe")
    swap = (F.length("probe") == F.length("spelling")) & F.exists(
        F.sequence(F.lit(1), F.length("probe") - 1), lambda k: F.concat(F.substring(p, F.lit(1), k - 1), F.substring(p, k + 1, F.lit(1)), F.substring(p, k, F.lit(1)), F.substring(p, k + 2, F.length(p))) == F.col("spelling")
    )
    cost = F.when(n < 4, F.when((F.col("lev") == 1) & (F.length("probe") == 3) & (F.length("spelling") == 3), 1)).when(F.col("lev") == 1, 1).when((F.col("lev") == 2) & swap, 1).when((F.col("lev") == 2) & (n >= LONG), 2)
    near = pairs.withColumn("lev", lev).filter("lev between 1 and 2").withColumn("cost", cost).filter("cost is not null").drop("lev")
    near = open_.join(near, ["probe", "kind"]).join(own, ["spelling", "kind"]).filter(agree("word", "w")).select("alias", "entity", "cost")
    hits = exact.unionByName(near).groupBy("alias", "entity").agg(F.min("cost").alias("cost"))
    best = hits.groupBy("alias").agg(F.min(F.struct("cost", "entity")).alias("b"), F.min("cost").alias("least"), F.count(F.lit(1)).alias("k"))
    ties = hits.join(best.select("alias", "least"), "alias").filter("cost = least").groupBy("alias").agg(F.count(F.lit(1)).alias("k"), F.first("entity").alias("entity"))
    return ties.filter("k = 1").select("alias", "entity")
