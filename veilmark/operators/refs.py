"""References ``{{sec:name}}``: finding them, and expanding those that a vault holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules as R
from ..functions.columns import fresh
from ..functions.spans import cut_and_join, let, matches
from .vault import by_name


def find_refs(text: Column) -> Column:
    """Array of (start, end, name)."""
    return F.transform(matches(text, R.REF, 0, 1), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["key"].alias("name")))


def expanded(text: Column, held: Column, only: Column | None = None) -> Column:
    """Struct of ``text`` with the references that the map ``held`` (name to struct with ``value``) knows, and the names ``used`` and ``missing``, in order."""

    def of(found: Column) -> Column:
        names = lambda c: F.array_distinct(F.transform(c, lambda x: x["name"]))
        known = lambda x: F.coalesce(F.map_contains_key(held, x["name"]), F.lit(False)) & (F.array_contains(only, x["name"]) if only is not None else F.lit(True))
        hit = F.filter(found, known)
        text_ = cut_and_join(text, hit, lambda x: F.element_at(held, x["name"])["value"])
        return F.struct(text_.alias("text"), names(hit).alias("used"), names(F.filter(found, lambda x: ~known(x))).alias("missing"))

    return let(find_refs(text), of)


def expand_refs(df: DataFrame, vault: DataFrame, key: str, text_col: str = "text", value: str = "value") -> DataFrame:
    """``df`` with ``expanded``, and the distinct names ``used`` and ``missing`` in order; names resolve within the row's ``key``."""
    k, m, x = fresh([*df.columns, "expanded", "used", "missing"], "k", "m", "x")
    held = by_name(vault.withColumn("value", F.col(value)), key, "value").select(F.col(key).alias(k), F.col("held").alias(m))
    both = df.join(held, df[key] == F.col(k), "left").withColumn(x, expanded(F.col(text_col), F.col(m)))
    return both.withColumns({"expanded": F.col(x)["text"], "used": F.col(x)["used"], "missing": F.col(x)["missing"]}).drop(k, m, x)


def variable_collisions(names: DataFrame, name_col: str = "name") -> DataFrame:
    """Variables that more than one name would take."""
    per = names.select(P.variable_name(F.col(name_col)).alias("variable"), F.col(name_col).alias("name"))
    return per.groupBy("variable").agg(F.count_distinct("name").alias("names")).where("names > 1")


def typed_prefix(before: Column) -> Column:
    """Of the text before a cursor, struct of the reference begun there (``prefix``) and of its name so far (``typed``); null if none is."""
    own = F.regexp_extract(before, r"\{\{sec:[a-z0-9_-]*\z", 0)
    return F.when(own != "", F.struct(own.alias("prefix"), F.substring(own, 7, 64).alias("typed")))


def completions(df: DataFrame, vault: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``names``: those of the row's ``key`` that start with what is typed before the cursor, in order of insertion; null if nothing is."""
    k, held, typed = fresh([*df.columns, "names"], "k", "held", "typed")
    own = vault.groupBy(F.col(key).alias(k)).agg(F.array_sort(F.collect_set(F.struct("seq", "name"))).alias(held))
    rows = df.withColumn(typed, typed_prefix(F.col(text_col))).join(own, F.col(key) == F.col(k), "left")
    fit = F.transform(F.filter(held, lambda x: x["name"].startswith(F.col(typed)["typed"])), lambda x: x["name"])
    return rows.withColumn("names", F.when(F.col(typed).isNotNull(), fit)).drop(k, held, typed)
