"""Regular expression matches with their offsets, inside a row, from built-in functions.

Offsets are code points; ends are exclusive.  Work grows with the text and the
number of matches, not with their product: a pattern is searched once, sums run
by blocks, overlaps are settled in clusters and long texts are cut in pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
#: Code points in a piece of a long text.
PIECE = 1024
#: Stands between the parts of a searched text; a text that holds it gets a longer mark with its own digest.
MARK = "\ue000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once for each row whatever is done with it later.

    A generator stands between: Spark does not copy what it computes into filters
    below it, as it does with plain columns, which would repeat every search.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def part(x: Column, first: Column, end: Column) -> Column:
    """Elements [first, end) of an array; ``slice`` copies the whole array each time."""
    return F.transform(F.sequence(first, end - 1), lambda j: F.get(x, j))


def _before(values: Column, since: Column, step: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(F.array().cast("array<int>").alias("out"), since.cast("int").alias("at"))
    move = lambda a, n: F.struct(F.array_append(a["out"], a["at"]).alias("out"), step(a["at"], n).cast("int").alias("at"))
    return F.aggregate(values, start, move, lambda a: a["out"])


def running(values: Column, step: Callable[[Column, Column], Column] = lambda a, n: a + n) -> Column:
    """Sums (or what ``step`` makes of 0 and the values) before each element of an integer array.

    By blocks, so that long arrays are not copied for each element.
    """

    def summed(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: part(x, b * BLOCK, F.least((b + 1) * BLOCK, F.size(x))))
        start = F.struct(F.array().cast("array<array<int>>").alias("out"), F.lit(0).alias("at"))

        def block(a: Column, y: Column) -> Column:
            done = F.struct(F.array_append(a["out"], _before(y, a["at"], step)).alias("out"), F.aggregate(y, a["at"], lambda t, n: step(t, n).cast("int")).alias("at"))
            return done

        return F.when(F.size(x) <= BLOCK, _before(x, F.lit(0), step)).otherwise(F.aggregate(blocks, start, block, lambda a: F.flatten(a["out"])))

    return let(values, summed)


def template(*groups: int) -> str:
    """What a match is replaced by, for ``searched``: its groups between marks."""
    return MARK.join(["", *(f"${g}" for g in groups), ""])


def searched(text: Column, pattern: Column, given: Column, n_groups: int, rows: Callable[[Column, Callable[[int], Column], Column], Column]) -> Column:
    """The matches of ``pattern``, searched for once.

    ``given`` is the ``template`` of the groups wanted (the first is 0, the whole
    match), and ``rows(gap, group, at)`` makes a row from the text before a match,
    the function that gives a group, and the match's offset.
    """
    step = n_groups + 1

    def marked(mark: Column) -> Column:
        return let(F.split(F.regexp_replace(text, pattern, F.replace(given, F.lit(MARK), mark)), mark, -1), found)

    def found(x: Column) -> Column:
        index = F.slice(F.sequence(F.lit(0), F.size(x)), 1, ((F.size(x) - 1) / step).cast("int"))
        lengths = F.transform(index, lambda i: F.length(F.get(x, i * step)) + F.length(F.get(x, i * step + 1)))

        def one(i: Column, before: Column) -> Column:
            gap = F.get(x, i * step)
            return rows(gap, lambda g: F.get(x, i * step + 1 + g), before + F.length(gap))

        return F.zip_with(index, running(lengths), one)

    own = F.concat(F.lit(MARK), F.substring(F.sha2(text, 256), 1, 16), F.lit(MARK))
    return let(F.when(text.contains(MARK), own).otherwise(F.lit(MARK)), marked)


def value_row(value: Column, whole: Column, at: Column, *more: Column) -> Column:
    """(start, end, value, ...) of a value that ends its match but for a closing quote."""
    tail = F.substring(whole, F.length(whole) - 1, F.lit(2))
    closed = F.when(whole.endswith(value), 0).when(tail.startswith("\\"), 2).otherwise(F.when(F.substring(tail, F.length(tail), F.lit(1)).isin('"', "'"), 1).otherwise(0))
    end = (at + F.length(whole) - closed).cast("int")
    return F.struct((end - F.length(value)).cast("int").alias("start"), end.alias("end"), value.alias("value"), *more)


def matches(text: Column, pattern: str | Column, group: int = 0, key_group: int = 0, more_group: int | None = None) -> Column:
    """Array of (start, end, value, key) of the matches; ``value`` is ``group``, which ends its match but for a closing quote.

    ``more`` is added for ``more_group``, which may stand in a lookahead.  Null text has no matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    groups = list(dict.fromkeys((0, group, key_group, *((more_group,) if more_group is not None else ()))))

    def rows(gap: Column, field: Callable[[int], Column], at: Column) -> Column:
        of = lambda g: field(groups.index(g))
        more = (of(more_group).alias("more"),) if more_group is not None else ()
        if group == 0:
            return F.struct(at.cast("int").alias("start"), (at + F.length(of(0))).cast("int").alias("end"), of(0).alias("value"), of(key_group).alias("key"), *more)
        return value_row(of(group), of(0), at, of(key_group).alias("key"), *more)

    kind = "array<struct<start:int,end:int,value:string,key:string" + (",more:string>>" if more_group is not None else ">>")
    return F.coalesce(searched(text, pattern, F.lit(template(*groups)), len(groups), rows), F.array().cast(kind))


def overlaps(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def by_cluster(spans: Column, settle: Callable[[Column], Column]) -> Column:
    """``settle`` applied to each cluster of overlapping spans of an array that is sorted by start, and the results joined."""

    def cut(x: Column) -> Column:
        n = F.size(x)
        ends = running(F.transform(x, lambda s: s["end"]), F.greatest)
        firsts = let(ends, lambda e: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(x, i)["start"] >= F.get(e, i)))

        def joined(f: Column) -> Column:
            def cluster(k: Column) -> Column:
                own = part(x, F.get(f, k), F.coalesce(F.get(f, k + 1), n))
                return let(own, lambda c: F.when(F.size(c) == 1, c).otherwise(settle(c)))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(f) - 1), cluster))

        return F.when(n > 1, let(firsts, joined)).otherwise(x)

    return let(spans, cut)


def slicer(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body`` of a function (start, end) that cuts ``text``; of a long text it reads no more than the pieces it needs."""

    def cut(pieces: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            i, j = (a / PIECE).cast("int"), (b / PIECE).cast("int")
            head = F.substring(F.get(pieces, i), a % PIECE + 1, F.lit(PIECE))
            middle = F.when(j - i > 1, F.array_join(part(pieces, i + 1, j), "")).otherwise("")
            tail = F.coalesce(F.substring(F.get(pieces, j), F.lit(1), b % PIECE), F.lit(""))
            short = F.coalesce(F.substring(F.get(pieces, i), a % PIECE + 1, b - a), F.lit(""))
            return F.when(i == j, short).otherwise(F.concat(head, middle, tail))

        return body(between)

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), cut)


def cut_and_join(text: Column, spans: Column, token: Callable[[Column], Column]) -> Column:
    """``text`` with each of the sorted, disjoint spans replaced by ``token(span)``."""

    def joined(own: Column) -> Column:
        def with_pieces(between) -> Column:
            def piece(x, i):
                since = F.when(i == 0, 0).otherwise(F.get(own, i - 1)["end"])
                return F.concat(between(since, x["start"]), token(x))

            return F.concat(F.array_join(F.transform(own, piece), ""), between(F.element_at(own, -1)["end"], F.length(text)))

        return F.when(F.size(own) > 0, slicer(text, with_pieces)).otherwise(text)

    return let(spans, joined)
