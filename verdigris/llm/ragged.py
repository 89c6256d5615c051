"""Vectorised kernels over many texts at once.

Texts are held as one flat numpy array plus offsets ("ragged" form), so that a
Python worker spends its time inside numpy and not in per-word interpreter
loops.  All kernels work on whole texts; ``chunks`` only decides how many
*documents* are handled together, never where a document is cut.

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
SPACE, END = 0x20, 0x0A
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), seeded by an additive constant."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


#: A random-looking 64-bit value for each byte, so that short keys spread over the whole range.
BYTE_KEYS = mix(np.arange(256, dtype=U64), 77)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, U64(_BASE)), np.full(size, U64(_INVERSE))
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once.

    A prefix sum of byte keys times powers of an odd base modulo 2**64 lets any
    span be read off in constant time; the power of its start is divided out.
    """
    return hashes_of_spans(BYTE_KEYS[data], start, end, seed)


def hashes_of_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """The same over 64-bit values."""
    up, down = _power_tables(len(values) + 1)
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64), seed)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[9:14] = SPACE
#: White space becomes 0x20, so that 0x0A is free to end each document.
FOLD = _FOLD.tobytes()
FOLD_LOWER = _LOWER[_FOLD].tobytes()


def chunks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about `limit` bytes together; a longer document stands alone."""
    first, size = 0, 0
    for k, x in enumerate(texts):
        n = len(x) if x is not None else 0
        if k > first and size + n > limit:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of many texts: `stream` holds each text's words, each followed by 0x20, then 0x0A.

    start, end: each word's span; doc: the text that it is in; bounds: word offsets of the
    texts (one more than texts); stops: position of each text's 0x0A.  `table` may map
    further bytes to 0x20, so that they part words too.
    """

    def __init__(self, texts: list[bytes | None], lower: bool, table: bytes | None = None):
        table = table or (FOLD_LOWER if lower else FOLD)
        joined = b"\n" + b"".join([(x or b"").translate(table) + b" \n" for x in texts])
        raw = np.frombuffer(joined, np.uint8)
        gap = raw == SPACE
        before = (raw == END) | gap
        gap[1:] &= before[:-1]
        self.stream = s = raw[~gap]
        blank = s <= SPACE
        blank &= (s == SPACE) | (s == END)
        self.stops = np.flatnonzero(s == END)[1:]
        edge = np.flatnonzero(blank)
        self.end = edge[s[edge] == SPACE]
        self.start = edge[np.searchsorted(edge, self.end) - 1] + 1 if len(self.end) else self.end
        self.bounds = np.searchsorted(self.end, np.concatenate(([0], self.stops)))
        self.counts = np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hashes(self.stream, self.start, self.end, seed)


def window_hashes(h: np.ndarray, width: int, seed: int = 2) -> np.ndarray:
    """Hashes of `width` neighbours; the last width - 1 places are of no use."""
    out = np.zeros(len(h), U64)
    for k in range(min(width, len(h))):
        out[: len(h) - k] += mix(h[k:], seed + 101 * k) if k == 0 else mix(out[: len(h) - k] + h[k:], seed + 101 * k)
    return out


def window_mask(counts: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """True where a window of `width` words begins that stays inside its document."""
    ok = np.ones(int(bounds[-1]), bool)
    for k in range(1, width):
        last = bounds[1:] - k
        ok[last[last >= bounds[:-1]]] = False
    return ok


def sums_by(doc_bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring bounds; empty ranges give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[doc_bounds[1:]] - total[doc_bounds[:-1]]


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... start + length - 1 of each range, one range after the other."""
    n = int(length.sum())
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return shift + np.arange(n)
