"""Word-shingle sets of texts as 64-bit hashes, vectorised.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A set has the different shingles of ``width``
words; a text with fewer words gives its whole sequence as one shingle, one without words an empty set.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_BASE = pow(0x9E3779B97F4A7C15 | 1, 1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 20), U(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (byte + 1) * base**place over [i, j)."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def bounds(data: np.ndarray, at: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; ``at``: where each text begins (one entry more than texts); ``gaps``: bytes between words."""
    gap = gaps[data]
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    full = at[:-1] < at[1:]
    first[at[:-1][full]] = True
    last[at[1:][full] - 1] = True
    first[1:] |= gap[:-1]
    last[:-1] |= gap[1:]
    return np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap) + 1


def hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word."""
    s = prefix_sums(data)
    out = mix((s[end] - s[begin]) * powers(len(data))[1][begin])
    # Modulo 2**64, words of 1,024 bytes and more can be made to share a polynomial.
    for i in np.flatnonzero(end - begin > 512).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words lie before each text's begin (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    begin, end = bounds(data, at)
    return hashed(_LOWER[data], begin, end), np.searchsorted(begin, at)


def sets(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    w, before = words(data, at)
    if not len(w):
        return [np.zeros(0, U)] * (len(at) - 1)
    h = mix(w)
    n = max(0, len(w) - width + 1)
    whole = h[:n].copy()
    for k in range(1, width):
        whole = mix(whole + w[k : k + n] * U(0x9E3779B97F4A7C15))
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            x = h[a : a + 1]
            for k in range(a + 1, b):
                x = mix(x + w[k : k + 1] * U(0x9E3779B97F4A7C15))
            out.append(mix(x + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
