"""Joins of stored spans: pairs that overlap, and spans that none of a table of regions holds.

Spans have ``start`` and ``end`` (exclusive) within a document.  Each is dealt to
the buckets of ``size`` characters that it touches; spans of one document and
bucket meet by an equality join and are tested exactly.  A pair is given in the
first bucket that both touch, so once.  A document with very many spans is spread
over its buckets; a region of length n stands in n / size rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fresh

SIZE = 1024


def _dealt(spans: DataFrame, size: int, bucket: str) -> DataFrame:
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return spans.withColumn(bucket, F.explode_outer(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], size: int = SIZE, inside: bool = False) -> DataFrame:
    """Pairs of spans of equal ``keys`` that overlap (``inside``: the left one starts behind the right one's start and ends by its end).

    Columns of ``left``, then ``other_start`` and ``other_end``.  Spans without a key, start or end meet nothing; empty ones are in no other.
    """
    (bucket,) = fresh([*left.columns, "other_start", "other_end"], "bucket")
    regions = right.select(*keys, F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    near = _dealt(regions.withColumnsRenamed({"other_start": "start", "other_end": "end"}), size, bucket).withColumnsRenamed({"start": "other_start", "end": "other_end"})
    own = _dealt(left, size, bucket)
    both = own.join(near, [*keys, bucket])
    first = F.greatest(F.floor(F.col("start") / size), F.floor(F.col("other_start") / size))
    return both.where(_meet(inside) & (F.col(bucket) == first)).drop(bucket)


def _meet(inside: bool) -> Column:
    if inside:
        return (F.col("start") > F.col("other_start")) & (F.col("end") <= F.col("other_end")) & (F.col("end") > F.col("start"))
    return (F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end"))


def excluded(findings: DataFrame, regions: DataFrame, keys: list[str], size: int = SIZE, inside: bool = False) -> DataFrame:
    """``findings`` that overlap none of ``regions`` (``inside``: lie in none); rows that repeat are kept or left together."""
    ids = [*keys, "start", "end"]
    met = overlapping(findings.select(*ids), regions, keys, size, inside).select(*ids).distinct()
    return findings.join(met, ids, "left_anti").select(*findings.columns)
