"""Problem 7: encoding of a corpus with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern, a word into tokens by merging: one contiguous array holds the ranks of
all adjacent pairs of parts; the least rank is found by a scan, its boundary deleted, and the ranks of the two neighbours
refreshed, until no pair has a rank. Words of more than ``SHORT`` bytes, where repeated scans would be quadratic, take a heap
instead, with the same merges in the same order.

Words repeat, so each Python worker keeps what it has encoded: by word, and by chunk (a single space and what follows it up to
the next), which spares the pattern for most of a text. Both caches are emptied at a bound, which changes no result.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary lies on every executor; a parameter, for the file is never part of this repository.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary cuts a text into words (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 256
_NONE = 1 << 60
_MOST_WORDS, _MOST_CHUNKS = 300_000, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by scans of the rank array."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    get = ranks.get
    at = list(range(len(word) + 1))
    near = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == _NONE:
            break
        i = near.index(least)
        del at[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[at[i] : at[i + 2]], _NONE)
        if i:
            near[i - 1] = get(word[at[i - 1] : at[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(at, at[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list of parts."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = 0, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b : end[i]])) is not None:
            heapq.heappush(heap, (r, b, end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class _Words(dict):
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        ids = merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        out = array("i", ids).tobytes()
        if len(word) <= 64:
            if len(self) >= _MOST_WORDS:
                self.clear()
            self[word] = out
        return out


class _Chunks(dict):
    def __init__(self, words: _Words):
        self.words, self.find = words, regex.compile(PATTERN).findall

    def __missing__(self, chunk: str) -> bytes:
        out = b"".join(map(self.words.__getitem__, self.find(chunk)))
        if len(chunk) <= 64:
            if len(self) >= _MOST_CHUNKS:
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    """Little-endian 32-bit ids of a text, as bytes."""

    def __init__(self, path: str = BYTE_BPE_50K):
        self.chunks = _Chunks(_Words(load_ranks(path)))
        # A single space between two characters that are no space always begins a word, so a text may be cut there. Where
        # white space is longer, or a space stands next to another kind of it, the pattern looks at the whole text.
        self.mixed = re.compile(r" \s|[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ").search

    def __call__(self, text: str) -> bytes:
        if "\0" in text or self.mixed(text):
            return b"".join(map(self.chunks.words.__getitem__, self.chunks.find(text)))
        return b"".join(map(self.chunks.__getitem__, text.replace(" ", "\0 ").split("\0")))


_encoders: dict[str, Encoder] = {}


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encode = _encoders[path]
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                piece = batch.slice(part, 2000)
                raws = [encode(t) if t else b"" for t in piece.column(1).to_pylist()]
                offsets = np.zeros(len(raws) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in raws], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(raws), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["key", "ids"])

    return run


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): one row per row of docs, ids an array of int without special tokens.

    Null and empty texts have the empty list; strings that look like special tokens are ordinary text; repeated rows and keys
    stay repeated; other columns are not read. No shuffle: each partition is encoded where it is read.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(_encode(vocabulary), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
