"""From text to masked text, vault rows and receipts, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.columns import fresh
from ..operators import detect, mask, naming
from ..operators.messages import Options
from ..operators.vault import is_storable


def capture(texts: DataFrame, ids: list[str], text_col: str = "text", vault: DataFrame | None = None, options: Options = Options(), declined: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts with ``rewritten`` and ``captured``, vault rows).  ``declined`` (fingerprint) drops findings of those values.

    All or nothing for each text: if the vault would refuse one of its values, the
    text stays as it was and nothing of it is captured, so no reference points nowhere.
    Switched off, texts stay as they are.
    """
    if not options.enabled:
        kind = "array<struct<start:int,end:int,value:string,name:string>>"
        same = texts.withColumn("captured", F.array().cast(kind)).withColumn("rewritten", F.col(text_col))
        return same, same.select(*ids, F.lit("").alias("name"), F.lit("").alias("value")).limit(0)
    found = detect.findings(texts, ids, text_col, options.tiers)
    if declined is not None:
        found = found.withColumn("fp", F.sha2("value", 256)).join(declined.select(F.col("fingerprint").alias("fp")), "fp", "left_anti").drop("fp")
    named = naming.suggest_names(found, texts, ids, text_col, vault)
    items = named.groupBy(*ids).agg(F.collect_list(F.struct("start", "end", "value", "name")).alias("items"))
    both = texts.join(items, ids, "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<start:int,end:int,value:string,name:string>>")))
    done = mask.apply_capture(both, "items", text_col)
    variables = F.transform("captured", lambda c: P.variable_name(c["name"]))
    apart = F.size(F.array_distinct(variables)) == F.size(F.array_distinct(F.transform("captured", lambda c: c["name"])))
    (kept,) = fresh(done.columns, "kept")
    done = done.withColumn(kept, apart & F.forall("captured", lambda c: is_storable(c["name"], c["value"])))
    done = done.withColumn("rewritten", F.when(F.col(kept), F.col("rewritten")).otherwise(F.col(text_col)))
    done = done.withColumn("captured", F.when(F.col(kept), F.col("captured")).otherwise(F.slice("captured", 1, 0))).drop(kept)
    rows = done.select(*ids, F.explode_outer("captured").alias("c")).where("c is not null").select(*ids, "c.name", "c.value").distinct()
    return done.drop("items"), rows
