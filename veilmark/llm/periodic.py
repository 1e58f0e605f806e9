"""Periodic runs of words on a harmonic grid, by longest common extensions.

A run is a stretch of words with smallest period q, of ``MIN_LENGTH`` words and
``MIN_EXPONENT`` periods at least, that no neighbouring word extends.  For each
period p, grid points stand at every multiple of p; a run of three periods holds
two neighbouring points, whose words are then equal.  For each such pair the
common extension forward and backward gives the longest stretch of period p
around it.  Extensions are minima of ranges of the longest common prefixes of
neighbouring suffixes, from the suffix array of the words and that of the words
reversed, with a sparse table each.  A stretch found for several periods has the
smallest of them, as the others are its multiples.

Texts are worked on in slices of about ``SLICE_WORDS`` words in one array, each
text closed by a word of its own, so that no extension leaves its text; a longer
text is a slice alone and takes about 400 bytes of memory a word.  Nothing is
shuffled.

Words are the runs of characters other than space and \\x09 to \\x0D.  Null text
has no words and no runs, and collapses to the empty text.  Repeated rows and ids
each get a row; only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, column_ddl, pa_schema, text_batches

MIN_LENGTH, MIN_EXPONENT = 24, 3
SLICE_WORDS = 1 << 15
#: Grid points that are looked at together.
GRID = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and the longest common prefix of each suffix with the one before it; by prefix doubling.

    The last word must occur once, so that all suffixes differ.
    """
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if rank[order[-1]] == n - 1:
            break
        levels.append(rank)
        k *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        # Ranks of a level compare 2**level words; suffixes that end differ by their last word.
        same = np.flatnonzero((a < n) & (b < n))
        same = same[levels[level][a[same]] == levels[level][b[same]]]
        a[same] += 1 << level
        b[same] += 1 << level
        lcp[same + 1] += 1 << level
    return order, rank, lcp


class Extensions:
    """Common extensions of two places in O(1) each, from a sparse table of range minima."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        _, self.rank, lcp = suffix_order(words)
        self.table = [lcp.astype(np.int32)]
        step = 1
        while 2 * step <= self.n:
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
        return out


def grid_pairs(words: np.ndarray, at: int, n: int) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the text words[at:at + n]: grid points whose word is equal to that one period on."""
    p = 1
    while MIN_EXPONENT * p <= n:
        counts = (n - 1) // np.arange(p, n // MIN_EXPONENT + 1)
        ends = np.cumsum(counts)
        some = max(1, int(np.searchsorted(ends, GRID, side="right")))
        counts, ends = counts[:some], ends[:some]
        period = np.repeat(np.arange(p, p + some), counts)
        place = at + (np.arange(ends[-1]) - np.repeat(ends - counts, counts)) * period
        equal = np.flatnonzero(words[place] == words[place + period])
        yield place[equal], period[equal]
        p += some


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, as an array of word numbers, its runs (start, length, period) by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = [len(t) for t in texts]
    if max(sizes, default=0) < MIN_LENGTH:
        return out
    top = max(int(t.max()) for t in texts if len(t)) + 1
    # The word that closes a text occurs once.
    words = np.concatenate([x for i, t in enumerate(texts) for x in (t, [top + i])]).astype(np.int64)
    starts = np.cumsum([0] + [s + 1 for s in sizes])
    pairs = [x for at, n in zip(starts.tolist(), sizes, strict=False) if n >= MIN_LENGTH for x in grid_pairs(words, at, n)]
    place, period = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if not len(place):
        return out
    forward = Extensions(words)(place, place + period)
    # Of the words reversed, behind the closing word of the text before; the front gets a closing word too.
    n = len(words)
    turned = np.concatenate((words[::-1], [top + len(texts)]))
    backward = Extensions(turned)(n - place, n - place - period)
    start, length = place - backward, period + forward + backward
    good = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    text = np.searchsorted(starts, start[order], side="right") - 1
    for t, s, m, q in zip(text.tolist(), start[order].tolist(), length[order].tolist(), period[order].tolist(), strict=True):
        out[t].append((s - int(starts[t]), m, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without what repeats the first period of a run."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    kept = np.cumsum(cover[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """For each row its ``runs`` (start, length, period; by start, then period) and the text ``collapsed``.

    ``prepare(id, words)`` may change the words (UTF-8) before.
    """
    ddl = f"{column_ddl(docs, id_col)}, runs {RUNS}, collapsed string"
    schema = pa_schema(ddl)

    def run(batches):
        for ids, texts in text_batches(batches):
            words = [t.encode().split() for t in texts]
            if prepare is not None:
                words = [prepare(i, w) for i, w in zip(ids, words, strict=True)]
            at = 0
            while at < len(words):
                end, held = at + 1, len(words[at])
                while end < len(words) and held + len(words[end]) <= SLICE_WORDS:
                    held += len(words[end])
                    end += 1
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                some = words[at:end]
                runs = runs_of([np.fromiter((number[x] for x in w), np.int64, len(w)) for w in some])
                short = [collapsed(w, r).decode() for w, r in zip(some, runs, strict=True)]
                yield arrow([ids[at:end], [[{"start": s, "length": m, "period": q} for s, m, q in r] for r in runs], short], schema)
                at = end

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ddl)


def strongest(runs):
    """Of an array column of runs the one of the greatest length by period, exactly; ties by start, then period; null if there is none."""

    def better(a, x):
        left, right = x["length"] * a["period"], a["length"] * x["period"]
        return a.isNull() | (left > right) | ((left == right) & (F.struct(x["start"], x["period"]) < F.struct(a["start"], a["period"])))

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda a, x: F.when(better(a, x), x).otherwise(a))
