"""Search for many strings in many texts by an inverted index of fingerprints.

Each string gives one winnowed fingerprint of each form that it is sought by,
the one that the fewest forms of its key have; the fingerprints of a text meet
them by an equality join on key and fingerprint, and group into the few strings
that a text may hold.  Those come back to the row, where the search is exact.
Work follows the length of texts and their hits, not the number of strings; no
row carries all strings of its key, and a hot key is spread by fingerprint.

Rows are known by the key and a hash of their texts, strings by a hash, and a
fingerprint is hashed with its key.  So a run that repeats a task gives the same
rows, copies of a text share their list, and what only shares a hash is only
tried: strings of other keys than the row's drop out where the lists are made.
Strings must have ``LEAST`` characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fresh
from ..functions.forms import BLANKS
from ..functions.spans import once, slicer
from ..functions.windows import PROBES, coded, held, levels, places, whole
from ..functions.winnow import fingerprints

#: Characters of a gram, and neighbouring grams of which one is chosen.
GRAM, WINDOW = 6, 3
LEAST = GRAM + WINDOW - 1
#: A string's fingerprint is chosen from its first characters.
HEAD = 256
#: Characters whose fingerprints are taken together.
SLICE = 1 << 19
#: Least length, gram and window of a class of forms: long grams are shared by few, and a text has few fingerprints of them.
#: With grams of 6, a form in hexadecimal met every three digits that any value has.
CLASSES = ((LEAST, GRAM, WINDOW), (16, 12, 5), (24, 16, 9))
#: Fingerprints of a form of which the rarest is chosen; it decides cost, never results.
OPTIONS = 8
#: Bits of the filter (32 MB at most) that fingerprints of texts pass before they are dealt out; it decides cost, never results.
FILTER_BITS = 1 << 28
#: The filter of ``rows_with`` has 64 bits a string, within these powers of two (64 MB at most), in pieces of 2**18 bits; it decides cost, never results.
POWERS, PIECE = (18, 29), 18
#: Strings whose counts a task holds before it gives them out.
HELD = 1 << 18


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _kind(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def _classed(forms: list[str], tight: bool, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of forms, fingerprints) of each class that ``forms`` may be met by; with ``most``, each form is of one class and gives so many at most.

    A fingerprint carries its class.  Forms with blanks have the first class only, as one of its own.
    """
    lengths = np.fromiter(map(len, forms), np.int64, len(forms))
    for i, (least, gram, window) in enumerate(CLASSES if tight else CLASSES[:1]):
        longer = CLASSES[i + 1][0] if tight and most and i + 1 < len(CLASSES) else None
        some = np.flatnonzero((lengths >= least) & (lengths < longer) if longer else lengths >= least)
        own, grams, _ = fingerprints([forms[j] for j in some.tolist()], gram, window)
        if most:
            count = np.bincount(own, minlength=len(some))
            rank, n = np.arange(len(own)) - (np.cumsum(count) - count)[own], count[own]
            kept = (rank == 0) | (rank * most // n != (rank - 1) * most // n)
            own, grams = own[kept], grams[kept]
        yield some[own], grams >> 2 | np.int64(i if tight else len(CLASSES)) << 61


def _options(strings: DataFrame) -> DataFrame:
    """``id, place, gram``: the fingerprints of each form that a text must have one of, ``sought`` of ``strings`` (k, id, sought), of which one is wanted.

    Forms are taken without blanks, as long as that leaves ``LEAST`` characters.
    """
    schema = _arrow_schema(ddl := f"{_kind(strings, 'k')}, id long, place int, gram long")

    def run(batches):
        for batch in batches:
            k, ids, sought = batch.columns
            size = sought.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            forms, tight = (x.to_pylist() for x in sought.flatten().flatten())
            bare = [f if t else BLANKS.sub("", f) for f, t in zip(forms, tight, strict=True)]
            left = np.array([len(x) >= LEAST for x in bare], bool)
            for some, texts, of in ((np.flatnonzero(left), bare, True), (np.flatnonzero(~left & ~np.array(tight, bool)), forms, False)):
                for own, grams in _classed([texts[i][:HEAD] for i in some.tolist()], of, OPTIONS):
                    at = pa.array(row[some[own]])
                    yield pa.RecordBatch.from_arrays([k.take(at), ids.take(at), pa.array(place[some[own]].astype(np.int32)), pa.array(grams)], schema=schema)

    return strings.select("k", "id", "sought").mapInArrow(run, ddl).select("id", "place", F.xxhash64("k", "gram").alias("gram"))


def anchors(options: DataFrame) -> DataFrame:
    """``id, gram``: of the ``options`` of each form the fingerprint that the fewest have."""
    each = options.withColumn("n", F.count("*").over(Window.partitionBy("gram")))
    return each.groupBy("id", "place").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).select("id", "gram")


def postings(rows: DataFrame) -> DataFrame:
    """``h, gram``: distinct fingerprints of the strings in ``texts`` of ``rows`` (k, h, texts), without blanks and as they are."""
    schema = _arrow_schema(ddl := f"{_kind(rows, 'k')}, h long, gram long")

    def slices(texts):
        """(row, string) pairs, about ``SLICE`` characters at a time; null strings are passed over."""
        some, held = [], 0
        for i, own in enumerate(texts):
            for t in own.as_py() or ():
                if t is not None:
                    some.append((i, t))
                    held += len(t)
                if held >= SLICE:
                    yield some
                    some, held = [], 0
        yield some

    def run(batches):
        for batch in batches:
            k, h, texts = batch.columns
            for some in slices(texts):
                place = np.array([i for i, _ in some], np.int64)
                for tight in (True, False):
                    for own, grams in _classed([BLANKS.sub("", t) if tight else t for _, t in some], tight):
                        row = place[own]
                        order = np.lexsort((grams, row))
                        row, grams = row[order], grams[order]
                        new = np.ones(len(row), bool)
                        new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
                        row, grams = pa.array(row[new]), pa.array(grams[new])
                        yield pa.RecordBatch.from_arrays([k.take(row), h.take(row), grams], schema=schema)

    return rows.select("k", "h", "texts").mapInArrow(run, ddl).select("h", F.xxhash64("k", "gram").alias("gram"))


def _met(own: DataFrame, wanted: DataFrame, marked: DataFrame) -> DataFrame:
    """The equality join of the postings ``own`` and the fingerprints ``wanted``, which are among those ``marked``.

    Few postings meet any: a bitmap of the hashes of ``marked``, of at most ``FILTER_BITS``, goes to every task, and only what passes
    it is shuffled.  Spark's estimate, which takes what Python makes for no larger than its input, must not choose to
    broadcast either side, so the join names its kind.
    """
    bit = F.pmod(F.xxhash64("gram"), F.lit(FILTER_BITS))
    word, mask = fresh([*own.columns, *wanted.columns], "word", "mask")
    flag = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    # 64 numbers of 64 bits a row: a row for each number would take many times the room of its bits.
    bits = marked.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(flag).alias("flags"))
    held = F.map_from_entries(F.collect_list(F.struct((F.col("at") % 64).cast("int"), "flags")))
    bits = bits.groupBy(F.shiftright("at", 6).alias(word)).agg(held.alias("held"))
    bits = bits.select(word, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("held")[i], F.lit(0).cast("long"))).alias(mask))
    some = own.withColumn("bit", bit).withColumn(word, F.shiftright("bit", 12)).join(F.broadcast(bits), word)
    some = some.where(F.get(mask, (F.shiftright("bit", 6) % 64).cast("int")).bitwiseAND(flag) != 0).drop("bit", word, mask)
    return some.join(wanted.hint("merge"), "gram")


def with_candidates(df: DataFrame, key: str, texts: Column, strings: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: ``f`` of those of ``strings`` (k, f, sought) of the row's ``key`` that its ``texts`` (an array column) may hold, as an array; null if none.

    ``sought`` is an array of (form, tight): a text that holds a string has one of
    them, as it stands or, if ``tight``, without the text's blanks.  All such
    strings are in ``out``.  Only numbers are dealt out until each text has its strings.
    """
    h, k, h2 = fresh([*df.columns, out], "h", "k", "h2")
    kind = df.select(F.col(key).alias("k")).union(strings.select("k")).schema["k"].dataType
    rows = df.withColumn(h, F.xxhash64(F.col(key).cast(kind), texts))
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("k"), F.col(h).alias("h"), texts.alias("texts"))
    strings = strings.select(F.col("k").cast(kind).alias("k"), "f", "sought", F.xxhash64("k", "f").alias("id"))
    options = _options(strings)
    met = _met(postings(own), anchors(options), options).select("h", "id").distinct()
    named = met.join(strings.select("id", "k", "f").hint("merge"), "id")
    tried = named.groupBy(F.col("k").alias(k), F.col("h").alias(h2)).agg(F.collect_set("f").alias(out))
    return dealt(rows.join(tried, (F.col(key) == F.col(k)) & (F.col(h) == F.col(h2)), "left").drop(h, k, h2))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly to a fixed number of tasks, before work that takes long for each row.

    After an exchange by key Spark joins partitions of few bytes into one, and copies of a text share a key: one task would do it all.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Lengths of strings from which on a gram and a window of these sizes are used: long strings need few fingerprints of a text.
SIZES = ((LEAST, GRAM, WINDOW), (16, 8, 9))


def _postings_at(rows: DataFrame, gram: int, window: int) -> DataFrame:
    """``h, gram, at``: fingerprints of ``text`` of ``rows`` (h, text) with their offsets; no text is copied."""
    schema = _arrow_schema(ddl := f"{_kind(rows, 'h')}, gram long, at int")

    def run(batches):
        for batch in batches:
            h, texts = batch.columns
            lengths = texts.nbytes // max(1, len(texts)) + 1
            step = max(1, SLICE // lengths)
            for start in range(0, len(texts), step):
                own, grams, at = fingerprints([t or "" for t in texts.slice(start, step).to_pylist()], gram, window)
                yield pa.RecordBatch.from_arrays([h.take(pa.array(own + start)), pa.array(grams), pa.array(at.astype(np.int32))], schema=schema)

    return rows.select("h", "text").mapInArrow(run, ddl)


def with_places(df: DataFrame, text_col: str, strings: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``, array of (string, start): every place where its text holds one of ``strings`` (string; distinct, of ``LEAST`` characters or more).

    A table of postings (fingerprint, hash of the text, offset) meets one
    fingerprint of each string, the rarest, by an equality join; what agrees is
    compared with the text at that offset.  Rows without a place have null.
    """
    h, h2, tried = fresh([*df.columns, out], "h", "h2", "tried")
    text = F.col(text_col).cast("string")
    rows = df.withColumn(h, F.xxhash64(text))
    own = rows.where(text.isNotNull()).select(F.col(h).alias("h"), text.alias("text"))
    met = []
    for i, (least, gram, window) in enumerate(SIZES):
        n = F.length("string")
        some = strings.where((n >= least) & (n < SIZES[i + 1][0]) if i + 1 < len(SIZES) else n >= least)
        each = _postings_at(some.select(F.col("string").alias("h"), F.col("string").alias("text")), gram, window)
        each = each.withColumn("n", F.count("*").over(Window.partitionBy("gram")))
        rare = each.groupBy("h").agg(F.min(F.struct("n", "gram", "at")).alias("r")).select(F.col("h").alias("string"), "r.gram", F.col("r.at").alias("off"))
        both = _met(_postings_at(own, gram, window), rare, rare).select("h", F.struct("string", (F.col("at") - F.col("off")).alias("start")).alias("x"))
        met.append(both.where("x.start >= 0"))
    places = met[0].unionByName(met[1]).groupBy(F.col("h").alias(h2)).agg(F.collect_set("x").alias(tried))
    both = rows.join(places, F.col(h) == F.col(h2), "left")
    exact = slicer(text, lambda between: F.filter(tried, lambda x: between(x["start"], F.least(x["start"] + F.length(x["string"]), F.length(text))) == x["string"]))
    found = F.when(F.col(tried).isNotNull(), exact)
    return once(both, out, F.when(F.size(found) > 0, found)).drop(h, h2, tried)


def _string_filter(strings: DataFrame) -> tuple[int, np.ndarray, dict[int, np.ndarray]]:
    """Power of the filter, its bits, and the lengths of strings of each class (largest power of two up to the length).

    Bits are set for the first window of each string and for the whole of it.  Tasks set them; the driver gets the finished pieces.
    """
    lengths: dict[int, list[int]] = {}
    n = 0
    for row in strings.groupBy(F.length("string").alias("length")).agg(F.count("*").alias("n")).collect():
        lengths.setdefault(1 << row["length"].bit_length() - 1, []).append(row["length"])
        n += row["n"]
    power = min(POWERS[1], max(POWERS[0], (64 * n).bit_length()))
    bits = np.zeros(1 << power >> 3, np.uint8)
    if not n:
        return power, bits, {}
    schema = _arrow_schema(ddl := "piece int, bit int")

    def set_bits(batches):
        for batch in batches:
            texts = batch.column(0)
            step = max(1, SLICE // (texts.nbytes // max(1, len(texts)) + 1))
            for start in range(0, len(texts), step):
                size, codes = coded(texts.slice(start, step).to_pylist())
                first = np.cumsum(size) - size
                for p, h in levels(codes, int(size.max())):
                    own = np.flatnonzero((size >= p) & (size < 2 * p))
                    keys = np.concatenate((h[first[own]], whole(h, p, first[own], size[own])))
                    bit = np.unique(np.concatenate([places(keys, power, probe) for probe in range(PROBES)]))
                    yield pa.RecordBatch.from_arrays([pa.array((bit >> PIECE).astype(np.int32)), pa.array((bit & (1 << PIECE) - 1).astype(np.int32))], schema=schema)

    def packed(table: pa.Table) -> pa.Table:
        one = np.zeros(1 << PIECE, np.uint8)
        one[table["bit"].to_numpy()] = 1
        return pa.table({"piece": table["piece"].slice(0, 1), "bits": pa.array([np.packbits(one, bitorder="little").tobytes()])})

    pieces = strings.select("string").mapInArrow(set_bits, ddl).distinct().groupBy("piece").applyInArrow(packed, "piece int, bits binary")
    size = 1 << PIECE >> 3
    for row in pieces.toLocalIterator():
        bits[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return power, bits, {p: np.array(sorted(own), np.int64) for p, own in lengths.items()}


def _places_in(texts: list[str], power: int, bits: np.ndarray, lengths: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(place of a text, start, length): in each text, the first place of every string that passes the filter."""
    size, codes = coded(texts)
    if not lengths or not len(codes):
        return
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)
    for p, h in levels(codes, max(lengths)):
        if p not in lengths:
            continue
        some = held(bits, power, h)
        for n in lengths[p].tolist():
            at = some[some + n <= ends[owner[some]]]
            keys = whole(h, p, at, np.int64(n))
            good = held(bits, power, keys)
            at, keys = at[good], keys[good]
            order = np.lexsort((at, keys, owner[at]))
            at, keys = at[order], keys[order]
            new = np.ones(len(at), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[at[1:]] != owner[at[:-1]])
            # Two strings of one key are both kept: what is left out is compared with the one that stands for it.
            first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            again, step = np.flatnonzero(~new), max(1, SLICE // n)
            for i in range(0, len(again), step):
                own = again[i : i + step]
                new[own] = (codes[at[own, None] + np.arange(n)] != codes[first[own, None] + np.arange(n)]).any(axis=1)
            kept = at[new]
            own = owner[kept]
            yield from zip(own.tolist(), (kept - (ends - size)[own]).tolist(), [n] * len(kept), strict=True)


def rows_with(texts: DataFrame, text_col: str, strings: DataFrame) -> DataFrame:
    """``string, n``: in how many rows' text each of ``strings`` (string; distinct, of ``LEAST`` characters or more) stands; those in none have no row.

    Texts are not dealt out: a bounded filter of the strings, made here by a job over them, goes to every task, which
    counts what passes by its text.  So nothing but strings with their counts is shuffled, however many places a common
    short string has; what only the filter let through meets no string in the join.
    """
    shared = strings.sparkSession.sparkContext.broadcast(_string_filter(strings))
    ddl = "string string, n long"
    schema = _arrow_schema(ddl)

    def given(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            column = batch.column(0)
            step = max(1, SLICE // (column.nbytes // max(1, len(column)) + 1))
            for start in range(0, len(column), step):
                some = column.slice(start, step).drop_null().to_pylist()
                counts.update(t for _, t in {(i, some[i][a : a + n]) for i, a, n in _places_in(some, *shared.value)})
                if len(counts) >= HELD:
                    yield given(counts)
                    counts = Counter()
        yield given(counts)

    each = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl).groupBy("string").agg(F.sum("n").alias("n"))
    return each.join(strings.select("string").hint("merge"), "string")
