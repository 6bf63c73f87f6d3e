"""Vectorised text work on the UTF-8 buffer of many rows at once: words, hashes, windows."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD1342543DE82EF95)
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
with np.errstate(over="ignore"):
    _VALUE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_VALUE[IS_SEPARATOR] = 0


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the number of words before it."""
    solid = ~IS_SEPARATOR[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _BLOCK)))
        lo = starts[i]
        at = starts[i:j] - lo
        part = data[lo : ends[j - 1]]
        span = np.diff(np.append(at, len(part)))
        within = np.arange(len(part)) - np.repeat(at, span)
        value = _VALUE[part] * _powers(_STEP, int(span.max()))[within]
        length = (ends[i:j] - starts[i:j]).astype(U64)
        out[i:j] = mix(np.add.reduceat(value, at) + length * _BASE)
        i = j
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values (over all rows; the caller drops windows that cross rows)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    step = U64(0xA0761D6478BD642F)
    if width <= 12:
        total = hashes[:n].copy()
        power = U64(1)
        with np.errstate(over="ignore"):
            for k in range(1, width):
                power = power * step
                total += hashes[k : k + n] * power
        return mix(total)
    inverse = U64(pow(int(step), -1, 1 << 64))
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * _powers(step, len(hashes)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _powers(inverse, n))


def window_rows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the whole word list) where a window of ``width`` words of one row starts, and its row."""
    counts = np.diff(first)
    n = np.maximum(counts - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return first[:-1][row] + start, row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each row, and the bounds of the rows in them.

    A shingle is ``width`` consecutive words; a row with fewer words has one, of all its words.
    """
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    values = np.empty(int(bounds[-1]), U64)
    windows = window_hashes(hashes, width)
    fresh = np.ones(len(values), bool)
    for r in range(len(n)):
        a, b = bounds[r], bounds[r + 1]
        if counts[r] >= width:
            part = values[a:b]
            part[:] = windows[first[r] : first[r] + b - a]
            part.sort()
            fresh[a + 1 : b] = part[1:] != part[:-1]
        elif b > a:
            values[a:b] = mix(hash_sequence(hashes[first[r] : first[r + 1]])[None])
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return values[fresh], kept[bounds]


def hash_sequence(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole sequence of values."""
    total = hashes * _powers(U64(0xE7037ED1A0B428DB), len(hashes))
    with np.errstate(over="ignore"):
        return np.asarray(total.sum(dtype=U64) + U64(len(hashes)) * _BASE)
