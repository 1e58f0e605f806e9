"""Word shingle sets as sorted 64-bit hashes, computed over slices of texts with numpy."""

from __future__ import annotations

import numpy as np

_P, _M = 0x9E3779B97F4A7C15, (1 << 64) - 1
_POWERS: list[np.ndarray] = []
#: A-Z to a-z; the blanks of a word split (space and \x09 to \x0D) to a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_P, -1, 1 << 64)
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 19), b, np.uint64))), dtype=np.uint64) for b in (_P, inverse)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in order, and the number of words of each text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer((b"\n".join(parts) + b"\n").translate(LOWER), np.uint8)
    blank = np.concatenate(([True], buf == 32))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(buf) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)))
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_P))
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(starts, bounds))
    return hashes, counts


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as int64; texts of fewer words have one shingle, without words none."""
    hashes, counts = word_hashes(texts)
    odd = [np.uint64(pow(_P, 2 * i + 3, 1 << 64)) for i in range(size + 1)]
    n = len(hashes)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for i in range(size):
        rolled += hashes[i : i + len(rolled)] * odd[i]
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            own = np.unique(rolled[at : at + c - size + 1].view(np.int64))
        elif c:
            whole = np.uint64(c)
            with np.errstate(over="ignore"):
                for i in range(c):
                    whole = whole * odd[size] + hashes[at + i] * odd[i]
            own = mix(np.array([whole], np.uint64)).view(np.int64)
        else:
            own = np.empty(0, np.int64)
        out.append(own)
        at += c
    return out


def signature(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles."""
    u = own.view(np.uint64)
    a, b = mix(u + np.uint64(0x51ED270B)).sum(dtype=np.uint64), mix(u ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
