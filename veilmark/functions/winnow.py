"""Winnowed fingerprints of texts: the hashes of few of their q-grams, chosen so that equal passages choose alike.

Of every ``w`` neighbouring q-grams the one of least hash (of equal ones the
first) is chosen.  So a string of ``q + w - 1`` characters or more has a
fingerprint, and each of its fingerprints is one of any text that holds it.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(texts: list[str], q: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of texts, fingerprints, offsets of their q-grams), all texts in one pass."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - q + 1
    if n < w:
        return (np.empty(0, np.int64),) * 3
    h = codes[:n].copy()
    for j in range(1, q):
        h *= _BASE
        h += codes[j : j + n]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = (h >> np.uint64(1)).astype(np.int64)
    # The least of each window and the first of equal ones, without an array of all windows.
    m = n - w + 1
    least, at = h[:m].copy(), np.arange(m)
    for j in range(1, w):
        less = h[j : j + m] < least
        np.copyto(least, h[j : j + m], where=less)
        at[less] = np.flatnonzero(less) + j
    owner = np.repeat(np.arange(len(texts)), lengths)
    # Windows that reach into the next text choose nothing.
    picked = np.zeros(n, bool)
    picked[at[owner[:m] == owner[q + w - 2 :]]] = True
    chosen = np.flatnonzero(picked)
    own = owner[chosen]
    return own, h[chosen], chosen - (np.cumsum(lengths) - lengths)[own]
