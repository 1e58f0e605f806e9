"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words.  Sources, by code point with null
last, weigh 1, 2, 3 and so on around; they share all words by weight, but none
gets more than ``most`` times its own words: what is over is shared again by
weight until no source is above.  Within a source every document's expected
copies are target / source size.  Documents stand by falling size, so that
neighbours are alike; their expected copies are summed from the first on, one
random offset of the source is added, and a document is taken once for each
whole number that its sum crosses.

Ranks come from one sort of the slim rows over all partitions, and counts of
rows by partition and source: a source of any size is spread over partitions.
The full rank order is source, size, md5 of the id and id; rows equal in these
stand in any order and have the same size.
Null text has size 0.  Repeated rows are documents of their own.  An empty table
or only empty texts give targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, scratch, settled

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
WEIGHTS = (1, 2, 3)
#: Rows of counts by partition and source up to which they are broadcast.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows``, sorted over all partitions and settled, with ``_part`` and ``_at``: the partition and the place in it."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id64", F.monotonically_increasing_id())
    out = settled(placed)
    return out.withColumn("_part", F.shiftrightunsigned("_id64", 33)).withColumn("_at", F.col("_id64").bitwiseAND((1 << 33) - 1)).drop("_id64")


def _shifts(rows: DataFrame, by: list[str], *sums: tuple[str, str]) -> DataFrame:
    """For numbered ``rows``: by partition (and ``by``) what stands in earlier partitions: ``k`` rows, and sums under the names given."""
    per = rows.groupBy(*by, "_part").agg(F.count("*").alias("k"), F.min("_at").alias("first"), *(F.sum(c).alias(n) for c, n in sums))
    w = Window.partitionBy(*by).orderBy("_part")
    return per.select(*by, "_part", "first", *((F.sum(c).over(w) - F.col(c)).alias(c) for c in ("k", *(n for _, n in sums))))


def source_targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, n_docs, target`` of each source of ``sizes`` (source, size).

    The level, words for each unit of weight, follows from one sort of the
    sources by the level at which each would be full: the first whose cap lies at
    or above what the sources from it on would share has it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    with scratch(sizes.sparkSession) as keep:
        per = numbered(per, F.col("source").asc_nulls_last())
        rank = F.col("k") + F.col("_at")
        weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
        per = keep(per.join(F.broadcast(_shifts(per, [])), "_part").select("source", "source_size", "n_docs", weight.cast("double").alias("weight")))
        size = F.col("source_size").cast("double") * most
        total, share = per.agg(F.sum("source_size"), F.sum("weight")).first()
        full = numbered(per.select((size / F.col("weight")).alias("full"), "source", "source_size", "weight"), F.col("full"), F.col("source").asc_nulls_last())
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        run = full.join(F.broadcast(_shifts(full, [], ("source_size", "closed"), ("weight", "shut"))), "_part")
        closed = F.col("closed") + F.coalesce(F.sum("source_size").over(inside), F.lit(0))
        shut = F.col("shut") + F.coalesce(F.sum("weight").over(inside), F.lit(0.0))
        level = (F.lit(total or 0) - closed * most).cast("double") / (F.lit(share or 0.0) - shut)
        found = run.select(F.struct("_part", "_at").alias("place"), "source_size", "weight", level.alias("level")).where(F.col("source_size").cast("double") * most >= F.col("weight") * F.col("level"))
        level = found.agg(F.min_by("level", "place")).first()[0]
    # Without a level every source is full, to a rounding of the last one's cap.
    target = size if level is None else F.least(size, F.col("weight") * level)
    return per.select("source", "source_size", "n_docs", F.round(target, 6).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for a source, the same in every run of one seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def _taken(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """``rows`` (id, source, size, and what else stands beside) with the source's size and target, and copies.  Settled tables: ``rows`` and a slim one."""
    order = (F.col("source").asc_nulls_last(), F.col("size").desc(), F.md5(F.col("id").cast("string")), F.col("id"))
    rows = numbered(rows, *order)
    with scratch(rows.sparkSession) as keep:
        targets = source_targets(rows.select("source", "size"))
        runs = _shifts(rows, ["source"]).select("source", "_part", (F.col("k") - F.col("first")).alias("shift"))
        per_run = keep(runs.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(F.col("r.source").alias("source"), "_part", "shift", "source_size", "target"))
    if per_run.count() <= BROADCAST_ROWS:
        per_run = F.broadcast(per_run)
    both = rows.alias("d").join(per_run.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d._part") == F.col("p._part")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at, u = F.col("_at") + F.col("shift"), offset(F.col("d.source"), seed)
    taken = F.floor((at + 1) * rate + u) - F.floor(at * rate + u)
    return both.select("d.*", "source_size", "target", F.least(taken, F.lit(most)).alias("copies")).drop("_part", "_at")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *more)


def copies(docs: DataFrame, most: int = MOST, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row its size, its source's size and target, and ``copies``: how often the mix takes it."""
    rows = _taken(_slim(docs, id_col, text_col, source_col), most, seed)
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, most: int = MOST, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: ``docs`` with each row as often as it is taken, and ``copy``, its number from 1.

    Whole rows are sorted, so that each keeps the copies of its own place, also
    among rows of one id or of none.  Where ``docs`` has a column ``copy``, the
    new one is called ``copy_``, with underscores until the name is new.
    """
    rows = _taken(_slim(docs, id_col, text_col, source_col, F.struct("*").alias("row")), most, seed)
    numbers = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(fresh(docs.columns, "copy"))
    return rows.where("copies > 0").select("row", numbers).select("row.*", fresh(docs.columns, "copy"))
