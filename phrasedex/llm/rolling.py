"""Vectorised hashes of words and windows inside tasks (numpy, 64-bit wrap-around arithmetic).

The hash of a run v0..vn is the sum of v_i * B^i, Rabin-Karp style, taken from
prefix sums, so all windows of a text cost one pass. Values are random 64-bit
numbers and sums are mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
#: Bytes handled at once; texts are cut at separators.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(_B))


class _Powers:
    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = pow(self.base, len(self.known), 1 << 64)
            self.known = np.concatenate([self.known, self.known * U(step)])
        return self.known[:n]


_POWERS, _INVERSE = _Powers(_B), _Powers(_B_INV)


def inverse_powers(n: int) -> np.ndarray:
    """B^-t for t in [0, n)."""
    return _INVERSE.upto(n)


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j] - P[i] = the sum of values[t] * B^t over t in [i, j)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, _POWERS.upto(len(values)), out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


def spans(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the runs [start, end) by their prefix sums; equal runs get equal hashes wherever they stand."""
    inv = _INVERSE.upto(len(p))
    return mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Mixed hash of every window of n values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    p = prefix(values)
    return mix((p[n:] - p[:m]) * _INVERSE.upto(m))


def separators(bytes_: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(bytes_)] = True
    return out


#: Everything but the words of ``[^\x20\x09-\x0D]+``.
SPACES = separators(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, seps: np.ndarray = SPACES, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of a byte array, in order; words are runs of non-separators."""
    sep = seps[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], sep, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, side="right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        part = data[lo:hi]
        p = prefix(BYTE_VALUES[LOWER[part] if lower else part])
        out[a:b] = spans(p, starts[a:b] - lo, ends[a:b] - lo)
        a = b
    return out, starts, ends


def batches(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, one text at least."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def joined_words(texts: list[bytes], seps: np.ndarray = SPACES, lower: bool = False):
    """Words of several texts at once: (data, hash, start, end, first word of each text and, last, the word count)."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    h, s, e = word_hashes(data, seps, lower)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, h, s, e, np.searchsorted(s, begins)
