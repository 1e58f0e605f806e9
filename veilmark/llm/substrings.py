"""Substring dedup by hashing lines and runs of sentences.

Units are the lines of a text, and from the start of each line and sentence on
as many sentences as it takes to have ``RUN_WORDS`` words, once to the end of
the line at most and once over line ends.  So a passage is found in a longer
line, and where it is wrapped at other places; short lines count as parts of
runs, and on their own only from ``LINE_WORDS`` words.  Both bounds keep stock
phrases and single common lines where they are: on the synthetic tables most
lines that documents share by chance have 3 to 14 words.  With ``common``, a
shorter line goes too where that many documents have it: the number of documents
tells boilerplate from chance, whatever the length.

A unit is normalised (lower case, white space as one space) and hashed to 96
bits, whichever kind it is.  Digests are grouped over all documents; the
occurrence ranked first by id, text hash and offset stays, the others are
removed.  Digests that very many units share are met by a broadcast (there are
at most ``HOT_SHARE`` of them), the others by a shuffle of digests.
Spans are offsets in the original text, in code points, end exclusive.

Null text has no units and stays null.  Rows of a null id are kept as they are
and not compared.  Rows that share id and text are one document: what the first
keeps, each keeps.  Rows that share an id but not the text are documents of
their own.  Columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, column_ddl, pa_schema, scratch, settled, text_batches

RUN_WORDS = 20
LINE_WORDS = 20
DIGEST_BYTES = 12
#: A digest is hot from this many units on, and from this share of all units; so hot ones are ``HOT_SHARE`` at most.
HOT_UNITS, HOT_SHARE = 10_000, 100_000
#: A word, or the part of one up to the marks that end a sentence.
PART = re.compile(r"[^\s.!?]*+[.!?]++|[^\s.!?]++")
#: Digests are polynomials over the hashes of parts, so that a run costs the same whatever its length.
PRIME, BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F
_POWERS = [1]


class _Hashes(dict):
    """Of a part: its hash, that of the part with no white space before it, and whether it ends a sentence."""

    def __missing__(self, part: str) -> tuple[int, int, bool]:
        if len(self) >= 1 << 17:
            self.clear()
        own = hashlib.blake2b(part.lower().encode("utf-8", "surrogatepass"), digest_size=30).digest()
        self[part] = found = int.from_bytes(own[:15]), int.from_bytes(own[15:]), part[-1] in ".!?"
        return found


_HASHES = _Hashes()


def units(text: str, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> list[tuple[int, int, bytes, int]]:
    """(start, end, digest, words) of the lines and runs of sentences that count."""
    starts, stops, sums, free = [], [], [0], []
    lines, ends, begins = [], [], []  # parts of each line; last parts of sentences; first parts of sentences and lines
    at, total, find, hashes = 0, 0, PART.finditer, _HASHES
    for line in text.split("\n"):
        first, last, ended = len(starts), at, True
        for m in find(text, at, at + len(line)):
            a, z = m.span()
            if ended:
                begins.append(len(starts))
            alone, glued, ended = hashes[m.group()]
            total = (total * BASE + (glued if a == last and a > at else alone)) % PRIME
            starts.append(a)
            stops.append(last := z)
            free.append(alone)
            sums.append(total)
            if ended:
                ends.append(len(starts) - 1)
        if len(starts) > first:
            lines.append((first, len(starts) - 1, at, at + len(line)))
        elif starts and (not ends or ends[-1] != len(starts) - 1):
            ends.append(len(starts) - 1)  # a blank line
        at += len(line) + 1
    n = len(starts)
    if n and (not ends or ends[-1] != n - 1):
        ends.append(n - 1)
    while len(_POWERS) <= n:
        _POWERS.append(_POWERS[-1] * BASE % PRIME)

    def digest(i: int, j: int) -> bytes:
        """Of the parts i to j; the first counts as if white space were before it."""
        power = _POWERS[j - i]
        return ((free[i] * power + sums[j + 1] - sums[i + 1] * power) % PRIME & (1 << 8 * DIGEST_BYTES) - 1).to_bytes(DIGEST_BYTES)

    out, k = [], 0
    for first, last, a, b in lines:
        whole = last - first + 1 >= line_words
        if whole:
            out.append((a, b, digest(first, last), last - first + 1))
        while k < len(begins) and begins[k] <= last:
            i, k = begins[k], k + 1
            far = i + run_words - 1
            if far >= n:
                continue
            j = ends[bisect_left(ends, far)]
            for stop in {j, min(j, last)} if far <= last else {j}:
                if not whole or (i, stop) != (first, last):
                    out.append((starts[i], stops[stop], digest(i, stop), stop - i + 1))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the spans; a line that they leave without words goes with its line end, other blank lines stay."""
    parts, since, cuts, at = [], 0, [], 0
    for a, b in spans:
        parts.append(text[since:a])
        at += a - since
        cuts.append(at)
        since = b
    left = "".join([*parts, text[since:]])
    if not spans:
        return text
    lines, kept, at, k = left.split("\n"), [], 0, 0
    for line in lines:
        while k < len(cuts) and cuts[k] < at:
            k += 1
        touched = k < len(cuts) and cuts[k] <= at + len(line)
        if line.strip() or not touched:
            kept.append(line)
        at += len(line) + 1
    return "\n".join(kept)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, hash, text``: rows that agree in the first two are one document."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, line_words: int = LINE_WORDS, common: int | None = None) -> DataFrame:
    """``id, hash, spans``: spans to remove (they may overlap), for documents that have any; ``hash`` is xxhash64 of the text."""
    rows = _keyed(docs, id_col, text_col)
    ddl = f"{column_ddl(rows, 'id')}, hash long, start int, stop int, digest binary" + (", short boolean, lead int" if common is not None else "")
    schema = pa_schema(ddl)
    least_words = line_words if common is None else 1
    whole = min(line_words, run_words)

    def run(batches):
        for keys, texts in text_batches(batches):
            out = [(k["id"], k["hash"], *u) for k, t in zip(keys, texts, strict=True) for u in units(t, run_words, least_words)]
            if not out:
                continue
            columns = list(zip(*out, strict=True))
            if common is not None:
                met = set()
                lead = [0 if x in met else (met.add(x) or 1) for x in zip(columns[0], columns[1], columns[4], strict=True)]
                columns[5:] = [n < whole for n in columns[5]], lead
            yield arrow(columns[: len(schema)], schema)

    with scratch(docs.sparkSession) as keep:
        found = settled(rows.where("id is not null").select(F.struct("id", "hash").alias("key"), "text").mapInArrow(run, ddl))
        place = F.struct("id", "hash", "start")
        place_and_count = [F.min(place).alias("first"), F.count("*").alias("n")]
        if common is None:
            first = settled(found.groupBy("digest").agg(*place_and_count).where("n > 1"))
        else:
            each = found.groupBy("digest").agg(*place_and_count, F.max("short").alias("short"), F.sum("lead").alias("documents"))
            first = settled(each.where("n > 1").where(~F.col("short") | (F.col("documents") >= common)).drop("short", "documents"))
        least = max(HOT_UNITS, found.count() // HOT_SHARE)
        hot = F.broadcast(first.where(F.col("n") > least).select("digest", "first"))
        # A row of a hot digest needs no exchange; one of a digest of its own has no partner there.
        again = found.join(hot, "digest").where(place != F.col("first"))
        rest = found.join(hot, "digest", "left_anti").join(first.where(F.col("n") <= least).select("digest", "first"), "digest").where(place != F.col("first"))
        spans = again.unionByName(rest).groupBy("id", "hash").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
        return keep(spans)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, line_words: int = LINE_WORDS, common: int | None = None) -> DataFrame:
    """For each row: removed spans with original offsets, their number and length, and the text that stays."""
    spans = repeated_spans(docs, id_col, text_col, run_words, line_words, common)
    both = _keyed(docs, id_col, text_col).join(spans, ["id", "hash"], "left")
    ddl = f"{column_ddl(docs, id_col)}, n_removed long, removed_chars long, removed_spans string, text string"
    schema = pa_schema(ddl)

    def run(batches):
        for keys, texts in text_batches(batches):
            rows = []
            for k, text in zip(keys, texts, strict=True):
                cut = merged([(s["start"], s["stop"]) for s in k["spans"] or []])
                left = None if k["null"] else without(text, cut)
                rows.append((k["id"], len(cut), sum(b - a for a, b in cut), ",".join(f"{a}:{b}" for a, b in cut), left))
            yield arrow(zip(*rows, strict=True), schema)

    key = F.struct("id", "spans", F.col("text").isNull().alias("null"))
    return both.select(key.alias("key"), "text").mapInArrow(run, ddl)
