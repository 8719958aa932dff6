"""Words of a batch of texts as 64-bit hashes, worked out over bytes in numpy.

A word is a longest run of ASCII letters, digits and characters beyond ASCII; A to Z count as a
to z. Every byte of a character beyond ASCII is one, so bytes decide as characters would.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once.
SLICE = 1 << 15
#: An odd factor, and its inverse modulo 2^64, of the polynomial hash.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B] += 0x20
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _CLASS[_low : _high + 1] = 0


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_UP, _DOWN = _powers(FACTOR, SLICE), _powers(INVERSE, SLICE)


def _words(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of some bytes; no word goes across a cut."""
    kind = _CLASS[part]
    word = kind != 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[cuts] = word[cuts]
    last[cuts[cuts > 0] - 1] = word[cuts[cuts > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = (_UP, _DOWN) if len(part) <= SLICE else (_powers(FACTOR, len(part)), _powers(INVERSE, len(part)))
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(kind * up[: len(part)], out=total[1:])
    h = (total[ends + 1] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(FACTOR)
    h ^= h >> np.uint64(29)
    h[h == 0] = 1
    return starts, h


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the hashes of all words in order, none of them zero, and the number of words of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    counts = np.zeros(len(texts), np.int64)
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint64), counts
    at = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    found, low = [], int(at[0])
    while low < at[-1]:
        high = min(low + SLICE, int(at[-1]))
        if high < at[-1]:
            # Back to the last byte between words; a run without one is taken whole.
            gaps = np.flatnonzero(_CLASS[data[low:high]] == 0)
            while not len(gaps) and high < at[-1]:
                more = min(high + SLICE, int(at[-1]))
                gaps = np.flatnonzero(_CLASS[data[high:more]] == 0)[:1] + (high - low)
                high = more
            high = low + int(gaps[-1]) + 1 if len(gaps) else high
        some = np.unique(at[np.searchsorted(at, low) : np.searchsorted(at, high)]) - low
        starts, h = _words(data[low:high], some)
        counts += np.bincount(np.searchsorted(at, starts + low, side="right") - 1, minlength=len(texts))
        found.append(h)
        low = high
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts
