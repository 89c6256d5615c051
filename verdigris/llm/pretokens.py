"""Splits texts into pre-tokens, vectorised, as the byte-level BPE pattern does.

The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
Each code point has a class (letter, number, white space, other); pre-tokens begin where
the class changes, except that the last white space before a word goes its own way.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

from .ragged import span_hashes

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
#: Code points with Unicode's White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    out[list(WHITE_SPACE)] = WHITE
    return out


class PreTokens:
    """data: all texts' bytes; start, end: each pre-token's span in it; bounds: pre-token offsets of the texts."""

    def __init__(self, texts: list[bytes | None]):
        strings = [(x or b"").decode("utf-8", "replace") for x in texts]
        points = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")
        self.data = np.frombuffer("".join(strings).encode(), np.uint8)
        lengths = np.array([len(s) for s in strings], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        n = len(points)
        begins = np.zeros(n + 3, bool)
        begins[offsets[:-1]] = True
        kind = classes()[points]
        fresh = begins[:n].copy()
        fresh[1:] |= kind[1:] != kind[:-1]
        flag = np.zeros(n + 3, bool)
        flag[:n] = fresh
        inner = np.flatnonzero(fresh & (kind != WHITE) & ~begins[:n])
        after_white = inner[kind[inner - 1] == WHITE]
        flag[after_white - 1] = True
        flag[after_white[points[after_white - 1] == 0x20]] = False
        self._contractions(points, kind, begins, flag, n)
        place = np.flatnonzero(flag[:n])
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate(([0], np.cumsum(widths)))
        self.start = at[place]
        self.end = np.append(self.start[1:], at[n]) if len(place) else self.start
        self.bounds = np.searchsorted(place, offsets)
        self.n_bytes = at[offsets[1:]] - at[offsets[:-1]]

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, begins: np.ndarray, flag: np.ndarray, n: int) -> None:
        quote = np.flatnonzero(flag[:n] & (points == 0x27))
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & ~begins[quote + 1]]
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~begins[quote + 2], points[np.minimum(quote + 2, n - 1)], 0) if len(quote) else one
        pair = one.astype(np.int64) << 32 | two
        short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), "<u4"))
        long = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        step = np.where(short, 2, np.where(long, 3, 0))
        quote, step = quote[step > 0], step[step > 0]
        flag[quote + 1] = False
        flag[quote + step] = True

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, 11)
