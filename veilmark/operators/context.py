"""Whole conversations as they go out: each request sends all turns so far, masked with the vault as it is then.

A vault has versions: a value is known from one turn of its conversation to
another.  The list of a request holds every earlier message, so a value met in
turn 3 is masked in turn 1 as well, in the lists sent from turn 3 on.  Writing
all lists would grow with the square of a conversation; a message is instead
given once for each interval of requests over which it goes out alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.columns import fresh
from ..functions.forms import BLANKS
from ..functions.spans import cut_and_join, once
from .index import with_candidates
from .mask import known_values, shape_hits, value_forms, with_forms_masked
from .naming import adopted_base
from .vault import adopt

KEYS = ["conv_id", "name"]


def vault_versions(changes: DataFrame) -> DataFrame:
    """``conv_id, name, value, valid_from, valid_to`` from changes (conv_id, turn, name, value), where a null value removes the name.

    A version holds from its turn until that of the name's next change; null: for good.  Of changes in one turn the greatest value counts.
    """
    each = changes.groupBy("conv_id", "name", "turn").agg(F.max("value").alias("value"))
    until = F.lead("turn").over(Window.partitionBy(*KEYS).orderBy("turn"))
    return each.withColumn("valid_to", until).where("value is not null").select(*KEYS, "value", F.col("turn").alias("valid_from"), "valid_to")


def met_values(messages: DataFrame, cap: int = R.ADOPT_CAP) -> DataFrame:
    """Changes (conv_id, turn, name, value): what the shapes in a conversation give away, adopted under a name in the turn that first shows it."""
    hits = messages.select("conv_id", "turn", F.explode_outer(shape_hits(F.coalesce("text", F.lit("")))).alias("h")).where("h is not null")
    hits = hits.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "h.start", "h.value", "h.kind", "h.hint")
    none = hits.sparkSession.createDataFrame([], "session_id string, name string, value string, source string, seq long")
    none = none.withColumn("session_id", F.col("session_id").cast(messages.schema["conv_id"].dataType))
    names = adopt(hits, none, cap).where("name is not null")
    first = hits.groupBy("session_id", "value").agg(F.min("seq").alias("turn"))
    return names.join(first, ["session_id", "value"]).select(F.col("session_id").alias("conv_id"), "turn", "name", "value")


def outgoing(messages: DataFrame, versions: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, text) with ``sent_from, sent_to, masked, hits``: a row for each interval of requests over which a message goes out alike.

    The list of request t has the rows with ``sent_from <= t`` and ``sent_to``
    above t or null.  Known values become references, other shapes the marker.
    Null text stays null.  Values meet messages by an index, so neither long
    conversations nor large vaults stand in one row.
    """
    texts, values, forms, cut, one, done = fresh([*messages.columns, "sent_from", "sent_to", "masked", "hits"], "texts", "values", "forms", "cut", "one", "done")
    every = F.array_compact(F.array("text"))
    rows = with_candidates(messages, "conv_id", every, known_values(versions, "conv_id", None, "valid_from", "valid_to"), values).withColumn(texts, every)
    tight = F.regexp_replace("text", BLANKS.pattern, "")
    given = F.flatten(F.transform(values, lambda v: F.transform(value_forms(v["value"], v["token"]), lambda f: F.struct(f["form"], f["tight"], f["grows"], f["token"], v["valid_from"].alias("since"), v["valid_to"].alias("until")))))
    rows = once(rows, forms, F.filter(given, lambda f: F.when(f["tight"], tight.contains(f["form"])).otherwise(F.col("text").contains(f["form"]))))
    ends = F.flatten(F.transform(F.coalesce(F.col(forms), F.array()), lambda f: F.array_compact(F.array(f["since"], f["until"])))).cast("array<long>")
    later = F.filter(ends, lambda t: t > F.col("turn"))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.col("turn").cast("long")), later)))
    rows = rows.withColumn(cut, bounds)
    interval = F.transform(cut, lambda t, i: F.struct(t.alias("sent_from"), F.get(cut, i + 1).alias("sent_to")))
    rows = rows.withColumn(one, F.explode_outer(interval)).drop(cut)
    known = F.filter(forms, lambda f: (f["since"] <= F.col(one)["sent_from"]) & (f["until"].isNull() | (F.col(one)["sent_from"] < f["until"])))
    rows = with_forms_masked(rows.withColumn(forms, known), texts, forms, done)
    valued = F.get(done, F.lit(0))
    rows = once(rows, cut, shape_hits(valued["masked"], hints=False))
    masked: dict[str, Column] = {
        "sent_from": F.col(one)["sent_from"],
        "sent_to": F.col(one)["sent_to"],
        "masked": cut_and_join(valued["masked"], F.col(cut), lambda x: F.lit(R.MARKER)),
        "hits": F.coalesce(valued["hits"] + F.size(cut), F.lit(0)),
    }
    return rows.withColumns(masked).drop(texts, values, forms, one, done, cut)


def sent(requests: DataFrame, outgoing_rows: DataFrame) -> DataFrame:
    """The lists of ``requests`` (conv_id, request): the rows of ``outgoing`` that each sends, by an equality join on the conversation and a test of the interval."""
    r = requests.select("conv_id", "request")
    held = (F.col("sent_from") <= F.col("request")) & (F.col("sent_to").isNull() | (F.col("request") < F.col("sent_to")))
    return outgoing_rows.join(r, "conv_id").where(held)
