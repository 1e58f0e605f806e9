"""Hashes of all windows of texts whose lengths are powers of two, and a filter of keys.

A string of n characters is met by two windows of p characters, p the largest
power of two up to n: its first and its last.  So any length is met by the
hashes of few lengths, each made of two of half its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
_PROBE = tuple(np.uint64(x) for x in (1, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
#: Bits that a key sets in a filter.
PROBES = len(_PROBE)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair."""
    x = a * _A
    x ^= x >> np.uint64(29)
    x += b
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def levels(codes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(p, hash of each window of p codes) for p = 1, 2, 4, ... up to ``most``."""
    p, h = 1, codes.astype(np.uint64) * _B
    while len(h):
        yield p, h
        if 2 * p > most or len(h) <= p:
            return
        p, h = 2 * p, joined(h[:-p], h[p:])


def whole(h: np.ndarray, p: int, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Keys of the windows of ``n`` codes at ``at``, p <= n < 2p, from ``h`` of p."""
    return joined(joined(h[at], h[at + n - p]), np.asarray(n).astype(np.uint64))


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the texts, and their code points in one array."""
    return np.fromiter(map(len, texts), np.int64, len(texts)), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def places(keys: np.ndarray, power: int, probe: int) -> np.ndarray:
    """A bit of each key in a filter of 2**power bits; each of the ``PROBES`` probes gives another."""
    return ((keys * _PROBE[probe]) >> np.uint64(64 - power)).astype(np.int64)


def held(bits: np.ndarray, power: int, keys: np.ndarray) -> np.ndarray:
    """Indices of the keys whose bits are all set in ``bits`` (packed, little)."""
    some = np.arange(0)
    for probe in range(PROBES):
        at = places(keys[some] if probe else keys, power, probe)
        good = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        some = some[good] if probe else good
    return some
