"""Vectorised word and shingle hashing over whole texts."""

from __future__ import annotations

import numpy as np

_M1, _M2, _G = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(33)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_MULT = [np.uint64(x | 1) for x in _rng.integers(1, 2**63, 64, dtype=np.uint64).tolist()]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0xD6E8FEB86659FD93)


def times_g(i: int) -> np.uint64:
    return np.uint64(i * int(_G) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(64)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case, in order."""
    if not text:
        return np.empty(0, np.uint64)
    b = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.flatnonzero(~_SPACE[b])
    if not len(inside):
        return np.empty(0, np.uint64)
    first = np.empty(len(inside), bool)
    first[0] = True
    np.not_equal(inside[1:], inside[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    lens = np.diff(np.append(starts, len(inside)))
    off = np.arange(len(inside)) - np.repeat(starts, lens)
    powers = _POWERS if (longest := int(lens.max())) <= len(_POWERS) else _powers(longest)
    return mix(np.add.reduceat(_BYTE[b[inside]] * powers[off], starts) + lens.astype(np.uint64))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; the whole sequence is one shingle if it is shorter; empty without words."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    m = max(1, n - k + 1)
    s = np.zeros(m, np.uint64)
    for j in range(min(k, n)):
        s += w[j : j + m] * _MULT[j]
    return np.unique(mix(s + times_g(min(k, n))))
