"""Hashes of all runs of a fixed number of words of a text, by prefix sums modulo 2**64."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Odd multipliers of two independent polynomials.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words that are hashed at once, so that a very long text needs no more memory than this many.
BLOCK = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _tables:
        base = _BASES[which]
        _tables[which] = _powers(base, BLOCK + 1024), _powers(pow(base, -1, 2**64), BLOCK + 1024)
    return _tables[which]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, starts: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of the ``size`` words from each of ``starts`` (ascending), as signed 64-bit integers."""
    powers, inverse = _table(which)
    out = np.empty(len(starts), np.uint64)
    for at, part in _blocks(starts):
        low = int(part[0])
        h = hashes[low:int(part[-1]) + size]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:len(h)], dtype=np.uint64)])
        p = part - low
        out[at:at + len(part)] = (sums[p + size] - sums[p]) * inverse[p]
    return out.view(np.int64)


def _blocks(starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + BLOCK))
        yield at, starts[at:to]
        at = to
