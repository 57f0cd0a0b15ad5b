"""Words as the project defines them: maximal runs of letters or digits after NFKC and lower-casing, invisible characters not counted."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_table: list[np.ndarray] = []
_WORD = re.compile(r"[^\W_]+")


def classes() -> np.ndarray:
    """By code point: 1 a letter or digit, 2 invisible, 0 anything else."""
    if not _table:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            x = chr(c)
            if x.isalnum():
                out[c] = 1
        for lo, hi in ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)):
            out[lo : hi + 1] = 2
        _table.append(out)
    return _table[0]


_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]+")


def folded(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for a null text."""
    if not text:
        return []
    t = folded(text)
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    return _WORD.findall(t)


def streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, the words of each set between single spaces, and where each text begins (and the end).

    Every text begins and ends with a space; a text without words is one space.
    """
    folds = [folded(t) if t else "" for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(folds) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, folds), np.int64, len(folds))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # each text's own leading separator
    kind = classes()[codes]
    seen = kind != 2
    word = kind == 1
    # A separator stays if the last visible character before it was of a word, or if a text begins with it.
    vis = np.flatnonzero(seen)
    w = word[vis]
    keep = w.copy()
    keep[1:] |= w[:-1]
    first = np.zeros(len(codes), bool)
    first[starts] = True
    keep |= first[vis]
    # Two separators side by side (the end of one text, the start of the next) become one.
    at = vis[keep]
    out = np.where(word[at], codes[at], 32).astype(np.uint32)
    begin = np.searchsorted(at, starts)
    # A text that ends in a separator has it just before the next text's own: drop the former.
    double = np.zeros(len(out), bool)
    prev = begin[1:] - 1
    ok = (prev >= 0) & (out[np.maximum(prev, 0)] == 32) & (prev > begin[:-1])
    double[prev[ok]] = True
    if double.any():
        moved = np.cumsum(double)
        begin = begin - np.where(begin > 0, moved[np.maximum(begin - 1, 0)], 0)
        out = out[~double]
    return out, begin


_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(stream: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every run of q code points (the last q - 1 positions have none)."""
    h = (stream.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    done, out, base = 1, None, np.uint64(0xD6E8FEB86659FD93)
    left, out_len = q, 0
    while left:
        if left & 1:
            if out is None:
                out, out_len = h, done
            else:
                n = len(out) - done
                out = out[:n] * base + h[out_len : out_len + n] if n > 0 else out[:0]
                out_len += done
        left >>= 1
        if left:
            n = len(h) - done
            h = h[:n] * base + h[done : done + n] if n > 0 else h[:0]
            with np.errstate(over="ignore"):
                base = base * base + np.uint64(2)
            done *= 2
    n = max(0, len(stream) - q + 1)
    return out[:n]
