"""Decisions on tool calls: literal secrets, references in paths, what may expand.

Input rows have session_id, tool, path, content and args (the call as text).
A session's names stay together in one row, so a decision is a lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules as R
from .refs import expanded, find_refs
from .vault import by_name, held_names

PATH_TOOLS = ("read", "grep", "find", "ls")
WRITE_TOOLS = ("write", "edit")


def literal_names(calls: DataFrame, vault: DataFrame, id_col: str = "call_id", text_col: str = "args") -> DataFrame:
    """``id, names``: values of a session, not from output, that a call holds literally.

    Calls meet values by the index, then are tested: a session may have many of both.
    """
    values = vault.where((F.length("value") >= R.MIN_VALUE) & (F.col("source") != "output"))
    return held_names(calls.select(id_col, "session_id", text_col), values, text_col).groupBy(id_col).agg(F.sort_array(F.collect_set("name")).alias("names"))


def decide(calls: DataFrame, vault: DataFrame, id_col: str = "call_id", deliver: bool = False) -> DataFrame:
    """``calls`` with ``decision`` and ``expanded``: the first rule that holds decides.

    With ``deliver``, the references that may expand are replaced by their
    values: in ``content`` (never in ``path``) of a write back to the file they
    came from, and in ``args`` of other tools.
    """
    literal = literal_names(calls, vault, id_col).withColumnRenamed("names", "literal")
    sources = vault.withColumn("origins", F.coalesce("origins", F.array().cast("array<string>")))
    held = by_name(sources, "session_id", "origins", *(("value",) if deliver else ()))
    rows = calls.join(literal, id_col, "left").join(held, "session_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.withColumn("in_path", find_refs(text("path"))).withColumn("in_content", find_refs(text("content"))).withColumn("in_args", find_refs(text("args")))
    known = lambda x: F.coalesce(F.map_contains_key("held", x["name"]), F.lit(False))
    # A reference may be written back to a file that its value was read from.
    back = lambda x: known(x) & F.coalesce(F.array_contains(F.element_at("held", x["name"])["origins"], F.col("path")), F.lit(False))
    write, doc = F.col("tool").isin(*WRITE_TOOLS), P.is_doc_path(text("path"))
    content = F.col("in_content")
    stranded = F.exists(content, lambda x: known(x) & ~back(x))
    decision = (
        F.when(F.col("literal").isNotNull(), "block: literal secret")
        .when(F.col("tool").isin(*PATH_TOOLS) & (F.size("in_args") + F.size("in_path") > 0), "block: reference in a path tool")
        .when(write & (F.size("in_path") > 0), "block: reference in a path")
        .when(write & (F.size(content) > 0) & doc & ~F.exists(content, back), "allow: literal in a document")
        .when(write & ~doc & stranded, "block: would strand a value")
        .when(write & ~doc & F.exists(content, lambda x: x["name"] == R.RESERVED), "block: reserved marker")
        .when(write & F.exists(content, back), "expand: restorable")
        .when(write, "allow")
        .when(F.col("tool") == "bash", "allow: left to the shell")
        .when(F.exists("in_args", known), "expand")
        .otherwise("allow")
    )
    used = F.when(F.col("decision") == "expand: restorable", F.filter(content, back)).when(F.col("decision") == "expand", F.filter("in_args", known)).otherwise(F.filter("in_args", lambda x: F.lit(False)))
    rows = rows.withColumn("decision", decision).withColumn("expanded", F.array_distinct(F.transform(used, lambda x: x["name"])))
    if deliver:
        for column, rule in (("content", "expand: restorable"), ("args", "expand")):
            given = expanded(F.col(column), F.col("held"), F.col("expanded"))["text"]
            rows = rows.withColumn(column, F.when(F.col("decision") == rule, given).otherwise(F.col(column)))
    return rows.drop("literal", "held", "in_path", "in_content", "in_args")
