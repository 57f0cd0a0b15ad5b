"""NFKC with a map of offsets (F-15): where each character of the folded text came from."""

from __future__ import annotations

import unicodedata


def folded_with_offsets(text: str) -> tuple[str, list[int]]:
    """(folded text, for each of its characters the index of the source cluster it came from).

    A cluster is a character with the combining marks and jamo that compose with it, so folding by clusters equals folding the whole.
    """
    out, at = [], []
    start = 0
    while start < len(text):
        end = start + 1
        while end < len(text) and (unicodedata.combining(text[end]) or 0x1160 <= ord(text[end]) <= 0x11FF or ord(text[end]) in (0xFF9E, 0xFF9F)):
            end += 1
        for c in unicodedata.normalize("NFKC", text[start:end]).lower():
            out.append(c)
            at.append(start)
        start = end
    return "".join(out), at
