"""Problem 8: evaluation texts leaking into training text.

Q-gram lemma: two texts that agree in a region of L characters up to e edits share at least L - q + 1 - e*q character q-grams
there, and all of them lie within e diagonals. So the shared q-grams of a document and an item are counted in overlapping
diagonal bands; a band with fewer than the bound holds for the item's shortest passage is done with; what remains is verified
by alignment within the band. Characters are those of the words (see ``words``) with single spaces between them, so neither
punctuation nor spelling of the same word matters. Counting is arithmetic on arrays over many documents at once.

Up to ``block`` items are held by every task, and the documents are read once. More items are joined on q-grams: of both sides the
least gram of every run of ``window`` grams is kept, so texts that agree in q + window - 1 characters share a kept one, and a passage
with e edits has an unharmed run of at least its e + 1-th part. Only grams that pass a bitmap of fixed size made from the items
leave the documents. The pairs that meet go through the same bands and the same alignment; neither items nor documents ever come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.words import gram_hashes, streams
from loomlake.session import written


class Items:
    """Items with at least ``least`` words, their q-grams sorted by hash."""

    def __init__(self, ids: list, texts: list[str], least: int, edits: int, q: int | None = None):
        stream, begin = streams(texts)
        self.ids, self.text, self.spaces, lengths = [], [], [], []
        for k, i in enumerate(ids):
            own = np.append(stream[begin[k] : begin[k + 1]], np.uint32(32))
            at = np.flatnonzero(own == 32)
            if len(at) > least:
                self.ids.append(i)
                self.text.append(own)
                self.spaces.append(at)
                lengths.append(int((at[least:] - at[:-least] - 1).min()))
        shortest = min(lengths, default=1)
        # The longest q with a bound of about a third of the shortest passage: long grams are shared by few items.
        self.least, self.edits = least, edits
        self.q = q or max(2, min(32, (2 * shortest // 3) // (edits + 1)))
        self.bound = np.array([max(1, n - self.q + 1 - edits * self.q) for n in lengths], np.int64)
        hashes = [gram_hashes(t, self.q) for t in self.text]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        pos = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, np.int64)
        self.whole = np.concatenate(self.text) if self.text else np.zeros(0, np.uint32)
        self.offset = np.cumsum([0, *[len(t) for t in self.text]])[:-1] if self.text else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.hash, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.near = np.zeros(1 << 20, bool) if len(ids) > 8 else None
        if self.near is not None:
            self.near[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def bands(self, stream: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(document, item, least diagonal, the item's positions of the shared q-grams) of the bands that meet the bound of the item's
        shortest passage; diagonals by positions in the stream."""
        h = gram_hashes(stream, self.q)
        at = np.arange(len(h)) if self.near is None else np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
        if not len(self.hash) or not len(at):
            return
        where = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        same = self.hash[where] == h[at]
        at, where = at[same], where[same]
        if not len(at):
            return
        n = self.first[where + 1] - self.first[where]
        flat = np.repeat(self.first[where] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, pos = self.item[flat], self.pos[flat]
        diagonal = np.repeat(at, n) - pos
        doc = np.repeat(np.searchsorted(begin, at, side="right") - 1, n)
        width = self.edits + 1
        band = diagonal // width
        if self.edits:
            item, doc, pos, band = np.tile(item, 2), np.tile(doc, 2), np.tile(pos, 2), np.concatenate([band, band - 1])
        key = np.stack([doc, item, band, pos])
        key = key[:, np.lexsort(key[::-1])]
        key = key[:, np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])]  # a gram that the document repeats counts once
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:3, 1:] != key[:3, :-1]).any(0)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, key.shape[1]))
        for k in np.flatnonzero(count >= self.bound[key[1, first]]).tolist():
            a, n = first[k], count[k]
            yield int(key[0, a]), int(key[1, a]), int(key[2, a]) * width, key[3, a : a + n]

    def able(self, item: int, shared: np.ndarray) -> np.ndarray:
        """The lemma once more, passage by passage: which of the item's passages have enough shared grams of their own."""
        starts, ends = self.spaces[item][: -self.least], self.spaces[item][self.least :] + 1
        inside = np.searchsorted(shared, ends - self.q, side="right") - np.searchsorted(shared, starts)
        return np.flatnonzero(inside >= np.maximum(1, ends - starts - self.q + 1 - self.edits * self.q))

    def same(self, doc: np.ndarray, item: int, diagonal: int) -> bool:
        """Whether ``least`` consecutive words of the item stand in doc along one diagonal, letter by letter."""
        own = self.text[item]
        lo, hi = max(0, -diagonal), min(len(own), len(doc) - diagonal)
        if hi - lo <= 0:
            return False
        same = own[lo:hi] == doc[lo + diagonal : hi + diagonal]
        gaps = np.concatenate([[0], np.cumsum(own[lo:hi] == 32)])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        return bool(((gaps[edges[1::2]] - gaps[edges[::2]]) > self.least).any())

    def found(self, stream: np.ndarray, begin: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) of all texts of a stream. Without edits a band is compared along its diagonal; with edits the passages of all
        bands are aligned at once."""
        stream = np.append(stream, np.uint32(32))  # every text ends where the next one's leading space stands
        e, out, rest = self.edits, set(), []
        for d, i, diagonal, shared in self.bands(stream[:-1], begin):
            if (d, i) in out:
                continue
            passages = self.able(i, shared)
            if len(passages):
                if e:
                    rest.append((d, i, diagonal, passages))
                elif self.same(stream[begin[d] : begin[d + 1] + 1], i, diagonal - begin[d]):
                    out.add((d, i))
        if rest:
            n = [len(r[3]) for r in rest]
            d, i, diagonal = (np.repeat(np.array([r[c] for r in rest], np.int64), n) for c in range(3))
            starts = np.concatenate([self.spaces[r[1]][r[3]] for r in rest])
            ends = np.concatenate([self.spaces[r[1]][r[3] + self.least] + 1 for r in rest])
            # The shared grams lie on 2e + 2 diagonals from this one on; the alignment may leave them by e on either side.
            ok = aligned(self.whole, self.offset[i] + starts, ends - starts, stream, starts + diagonal - e, begin[d], begin[d + 1] + 1, 4 * e + 2, e)
            out |= set(zip(d[ok].tolist(), i[ok].tolist()))
        return out


def aligned(own: np.ndarray, first: np.ndarray, length: np.ndarray, doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, most: int) -> np.ndarray:
    """For each passage own[first : first + length]: whether it can be turned into some run of doc[low:high] by ``most`` edits, its first character
    at one of the ``width`` places from ``at`` on and the others along these diagonals. All passages advance together, a character at a
    time; a row of the table is the band alone."""
    k = np.arange(width)
    live, cost = np.arange(len(first)), np.zeros((len(first), width), np.int32)
    found = np.zeros(len(first), bool)
    for i in range(int(length.max(initial=0))):
        j = (at[live] + i)[:, None] + k
        inside = (j >= low[live][:, None]) & (j < high[live][:, None])
        same = (doc[np.clip(j, 0, len(doc) - 1)] == own[first[live] + i][:, None]) & inside
        new = cost + ~same
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        cost = np.minimum.accumulate(new - k, axis=1) + k  # any run of insertions along the row
        can = cost.min(1) <= most
        found[live[can & (length[live] == i + 1)]] = True
        can &= length[live] > i + 1
        live, cost = live[can], cost[can]
        if not len(live):
            break
    return found


def _search(ids: list, texts: list[str], least: int, edits: int, out_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, least, edits)
        for batch in batches:
            for part in _parts(batch):
                stream, begin = streams(part.column(1).to_pylist())
                rows = sorted(items.found(stream, begin))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([d for d, _ in rows], pa.int64())), pa.array([items.ids[i] for _, i in rows], out_type)], names=["key", "item"])

    return run


def _parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text each (a longer text stays whole)."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0), np.int64)
    whole = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(whole, whole[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def kept_grams(h: np.ndarray, window: int) -> np.ndarray:
    """The distinct values that are least in some run of ``window`` of them; all of a shorter array's least."""
    if not len(h):
        return h
    if len(h) <= window:
        return h.min(keepdims=True)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(1))


def _grams(q: int, window: int, near, kinds: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                stream, begin = streams(part.column(1).to_pylist())
                at, out = [], []
                for k in range(part.num_rows):
                    h = kept_grams(gram_hashes(np.append(stream[begin[k] : begin[k + 1]], np.uint32(32)), q), window)
                    if near is not None:
                        h = h[near.value[(h >> np.uint64(44)).astype(np.int64)]]
                    at.append(np.full(len(h), k))
                    out.append(h)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int64())), pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64))], names=[kinds[0], "gram"])

    return run


def _check(least: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(Items([0], [item], least, edits).found(*streams([text]))) for text, item in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["text_id", "item"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shortest(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stream, begin = streams(batch.column(0).to_pylist())
            out = []
            for k in range(batch.num_rows):
                at = np.flatnonzero(np.append(stream[begin[k] : begin[k + 1]], np.uint32(32)) == 32)
                if len(at) > least:
                    out.append(int((at[least:] - at[:-least] - 1).min()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["n"])

    return run


def leaked_by_join(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, least: int, edits: int) -> DataFrame:
    """The pairs of ``leaked`` for any number of items."""
    spark, kind = docs.sparkSession, items.schema[item_id].dataType.simpleString()
    own = items.select(items[item_id].alias("item"), items[item_text].alias("text")).filter("text is not null")
    shortest = own.select("text").mapInArrow(_shortest(least), "n int").agg(F.min("n")).first()[0]
    if shortest is None:
        return docs.select(docs[doc_id].alias(doc_id), F.lit(None).cast(kind).alias(item_id)).filter("false")
    run = max(2, (shortest - edits) // (edits + 1))
    q = max(2, 2 * run // 3)
    window = run - q + 1
    grams = written(own.mapInArrow(_grams(q, window, None, ("item", kind)), f"item {kind}, gram bigint"), "leaks-grams")
    near = np.zeros(1 << 20, bool)
    for r in grams.select(F.shiftrightunsigned("gram", 44).alias("g")).distinct().toLocalIterator():  # of 2 ** 20 values at most
        near[r["g"]] = True
    texts = docs.select(docs[doc_id].alias("key"), F.md5(docs[doc_text]).alias("text_id"), docs[doc_text].alias("text")).filter("text is not null")
    found = texts.select("text_id", "text").mapInArrow(_grams(q, window, spark.sparkContext.broadcast(near), ("text_id", "string")), "text_id string, gram bigint").distinct()
    pairs = written(found.join(grams, "gram").select("text_id", "item").distinct(), "leaks-pairs")
    once = texts.select("text_id", "text").join(pairs.select("text_id").distinct(), "text_id", "left_semi").dropDuplicates(["text_id"])
    whole = pairs.join(once, "text_id").join(own.dropDuplicates(["item", "text"]).withColumnRenamed("text", "item_text"), "item")
    good = whole.select("text_id", "item", "text", "item_text").mapInArrow(_check(least, edits), f"text_id string, item {kind}").distinct()
    return texts.select("key", "text_id").join(good, "text_id").select(F.col("key").alias(doc_id), F.col("item").alias(item_id))


def leaked(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, edits: int = 0, block: int = 2000) -> DataFrame:
    """Pairs (doc_id, item_id), each once per document row, where the document holds ``least`` consecutive words of the item,
    up to ``edits`` character edits in the passage.

    Null, blank and wordless texts hold nothing; an item with fewer words leaks nowhere; repeated document rows give repeated
    pairs; other columns are not read. Empty documents or items give no row.
    """
    if item_id == doc_id:
        raise ValueError("document and item need different names")
    few = items.select(item_id, item_text).limit(block + 1).collect()
    if len(few) > block:
        return leaked_by_join(docs, doc_id, doc_text, items, item_id, item_text, least, edits)
    rows = [(r[0], r[1]) for r in few if r[1]]
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    arrow = pa.string() if kinds[1] == "string" else {"bigint": pa.int64(), "int": pa.int32()}[kinds[1]]
    source = docs.select(docs[doc_id].alias("key"), docs[doc_text].alias("text"))
    return source.mapInArrow(_search([i for i, _ in rows], [t for _, t in rows], least, edits, arrow), f"key {kinds[0]}, item {kinds[1]}").toDF(doc_id, item_id)
