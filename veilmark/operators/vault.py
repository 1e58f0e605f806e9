"""A vault as a DataFrame: session_id, name, value, source, tier, added_at, seq, origins.

Each change returns a new DataFrame.  ``public`` drops values by selecting the
other columns, so no later filter can bring them back.  Values are never literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules as R
from ..functions.columns import fresh
from .index import with_candidates
from .naming import adopted_base, numbered

KEYS = ["session_id", "name"]


def is_storable(name: Column, value: Column) -> Column:
    """A valid, unreserved name, and a value that is not blank and at most 1 MiB."""
    return P.is_valid_name(name) & (name != R.RESERVED) & (P.trimmed(value) != "") & (F.octet_length(value) <= R.MAX_VALUE_BYTES)


def upsert(changes: DataFrame) -> DataFrame:
    """The vault after ``changes`` in order of ``seq``: the latest value of a name, at the place of its first.

    A name whose shell variable an earlier name of the session has is refused:
    a command that asks for one must never get the other.
    """
    good = changes.where(is_storable(F.col("name"), F.col("value")))
    last = F.struct("seq", "value", "source", "added_at")
    merged = good.groupBy(*KEYS).agg(F.max(last).alias("l"), F.min("seq").alias("seq"))
    same = Window.partitionBy("session_id", P.variable_name(F.col("name"))).orderBy("seq", "name")
    return merged.withColumn("n", F.row_number().over(same)).where("n = 1").select(*KEYS, "l.value", "l.source", "l.added_at", "seq")


def by_name(vault: DataFrame, key: str, *columns: str) -> DataFrame:
    """``key`` and the map ``held`` from each name to its columns; of a name held twice the latest (by ``seq``, else the greatest) counts.

    A session's names stay together in one row: some 100 bytes a name, without the values unless asked for.
    """
    one = F.struct(*columns)
    latest = F.max_by(one, F.struct("seq", one)) if "seq" in vault.columns else F.max(one)
    (own,) = fresh([key], "own")
    return vault.groupBy(key, "name").agg(latest.alias(own)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", own))).alias("held"))


def with_details(vault: DataFrame) -> DataFrame:
    return vault.withColumn("length", F.length("value")).withColumn("fingerprint", P.fingerprint(F.col("value"))).withColumn("preview", P.preview(F.col("value")))


def public(vault: DataFrame) -> DataFrame:
    """What may be listed: no value, no origin."""
    return with_details(vault).select(*KEYS, "source", "added_at", "length", "fingerprint", "preview", "seq")


def listing(vault: DataFrame, prefix: str = "") -> DataFrame:
    """Names, lengths and where a value was seen, by order of insertion; ``prefix`` narrows names for completion."""
    seen = F.when(F.col("source") == "output", "seen in tool output").otherwise("")
    return public(vault).where(F.col("name").startswith(prefix)).select(*KEYS, "length", seen.alias("seen"), "seq").orderBy("session_id", "seq")


def names_by_value(vault: DataFrame) -> DataFrame:
    """The name first given to each value of a session."""
    return vault.groupBy("session_id", "value").agg(F.min_by("name", "seq").alias("name"))


def rename(vault: DataFrame, moves: DataFrame) -> DataFrame:
    """Applies ``moves`` (session_id, name, new_name); a move to an invalid, reserved or taken name is left out."""
    free = moves.where(P.is_valid_name(F.col("new_name")) & (F.col("new_name") != R.RESERVED))
    free = free.join(vault.select("session_id", F.col("name").alias("new_name")), ["session_id", "new_name"], "left_anti")
    first = Window.partitionBy("session_id", "new_name").orderBy("name")
    free = free.withColumn("n", F.row_number().over(first)).where("n = 1").select(*KEYS, "new_name")
    return vault.join(free, KEYS, "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name").select(*vault.columns)


def remove(vault: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the names of ``gone`` (session_id, name); null names remove the whole session."""
    whole = gone.where("name is null").select("session_id").distinct()
    return vault.join(gone.select(*KEYS), KEYS, "left_anti").join(whole, "session_id", "left_anti").select(*vault.columns)


def record_origins(vault: DataFrame, reads: DataFrame) -> DataFrame:
    """``session_id, name, origins``: the paths of a session's reads that held a value literally."""
    pairs = held_names(reads.select("session_id", "path", "text"), vault.where(F.length("value") >= R.MIN_VALUE), "text")
    return pairs.groupBy(*KEYS).agg(F.sort_array(F.collect_set("path")).alias("origins"))


def held_names(texts: DataFrame, values: DataFrame, text_col: str) -> DataFrame:
    """``texts`` with ``name``, a row for each value of the text's session that it holds literally; values have ``MIN_VALUE`` characters."""
    (tried,) = fresh([*texts.columns, "name"], "tried")
    raw = values.select(F.col("session_id").alias("k"), F.struct("value", "name").alias("f"), F.array(F.struct(F.col("value").alias("form"), F.lit(False).alias("tight"))).alias("sought"))
    rows = with_candidates(texts, "session_id", F.array(F.col(text_col)), raw, tried).where(F.col(tried).isNotNull())
    names = F.transform(F.filter(tried, lambda x: F.col(text_col).contains(x["value"])), lambda x: x["name"])
    return rows.withColumn("name", F.explode_outer(names)).drop(tried).where("name is not null")


def adopt(hits: DataFrame, vault: DataFrame, cap: int = R.ADOPT_CAP) -> DataFrame:
    """Names for values that masking met: ``session_id, value, name`` (null beyond the cap).

    ``hits`` has session_id, seq, start, value, kind, hint.  A value that the
    vault holds keeps its first name; others are adopted in order up to ``cap``
    values of source ``output`` in a session, each under its base name with a
    number where that is in use.
    """
    first = hits.groupBy("session_id", "value").agg(F.min(F.struct("seq", "start", "kind", "hint")).alias("f"))
    old = names_by_value(vault).withColumnRenamed("name", "old")
    full = vault.groupBy("session_id").agg(F.count_if(F.col("source") == "output").alias("held"))
    rows = first.join(old, ["session_id", "value"], "left").join(full, "session_id", "left")
    new = rows.where("old is null").withColumn("base", adopted_base(F.col("f.kind"), F.col("f.hint"), F.col("f.hint")))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("f.seq", "f.start", "value"))
    new = new.withColumn("n", order).where(F.col("n") + F.coalesce("held", F.lit(0)) <= cap)
    rank = F.row_number().over(Window.partitionBy("session_id", "base").orderBy("n"))
    new = numbered(new.select("session_id", "value", "base", rank.alias("rank")), ["session_id"], vault).select("session_id", "value", F.col("name").alias("new"))
    return rows.join(new, ["session_id", "value"], "left").select("session_id", "value", F.coalesce("old", "new").alias("name"))
