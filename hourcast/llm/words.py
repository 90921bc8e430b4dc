"""Words and shingles of Arrow text columns as arrays of 64-bit hashes.

A word is a run of ``[^\\x20\\x09-\\x0D]``, with A-Z in lower case.  All steps run
over the bytes of many texts at once; texts are taken in runs of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once (one text may be longer).
RUN_BYTES = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of up to so many bytes are polynomials in BASE.  Modulo 2^64 those of longer words can be made to agree
#: (a Thue-Morse word of 1,024 letters and its complement do), so each of their bytes is mixed with its place.
PLAIN = 64
#: Stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


#: A value for each byte, and what lower case does to it.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE = mix(LOWER.astype(np.uint64) + np.uint64(1))
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, BASE, np.uint64))


def runs(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, bounds) for runs of texts of ``size`` bytes (RUN_BYTES) or one text; nulls are empty."""
    size = size or RUN_BYTES
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1)
        own = bounds[first : end + 1]
        yield first, end, data[own[0] : own[-1]], own - own[0]
        first = end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of each text's first word); the latter has one place more than texts."""
    word = ~BLANK[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    starts[inner] = word[inner]
    at = np.flatnonzero(starts)
    firsts = np.searchsorted(at, bounds)
    if not len(at):
        return np.zeros(0, np.uint64), firsts
    kept = np.flatnonzero(word)
    begin = np.searchsorted(kept, at) if len(kept) < len(data) else at
    sizes = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept)) - np.repeat(begin, sizes)
    values = VALUE[data[kept]]
    terms = values * _powers(PLAIN)[np.minimum(place, PLAIN - 1)]
    if sizes.max() > PLAIN:
        long = np.repeat(sizes > PLAIN, sizes)
        terms[long] = mix(values[long] + mix(place[long].astype(np.uint64) + END))
    sums = np.add.reduceat(terms, begin)
    return mix(sums + sizes.astype(np.uint64) * END), firsts


def shingles(words: np.ndarray, firsts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of ``k`` words, or of all its words if they are fewer."""
    n = max(0, len(words) - k + 1)
    sums = np.zeros(n, np.uint64)
    for j in range(k):
        sums += words[j : j + n] * _powers(64)[j]
    whole = mix(sums).view(np.int64)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            yield mix((words[a:b] * _powers(64)[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.array([b - a], np.uint64) * END).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
