"""Masking inside nested columns, driven by the schema; and inside JSON strings.

Structs, arrays and maps are rebuilt around their strings, so a nested column is
masked by one projection.  Binary, dates and numbers pass through.  Strings of
unknown nesting (JSON text) go through a small function with an explicit stack.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions import rules as R
from ..functions.columns import fresh
from ..functions.spans import cut_and_join
from .mask import scrub_texts, shape_hits
from .refs import expanded
from .vault import by_name


def rewrite(column: Column, kind: T.DataType, change: Callable[[Column], Column], keep: frozenset[str] = frozenset()) -> Column:
    """``column`` with ``change`` applied to each string in it, but for fields named in ``keep`` and binary payloads.

    A field ``data`` beside a field that names a medium is a payload, as is long base64 text.
    """
    if isinstance(kind, T.StringType):
        return F.when(~P.is_binary_payload(column), change(column)).otherwise(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: rewrite(x, kind.elementType, change, keep))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda k, v: F.when(k.isin(*keep), v).otherwise(rewrite(v, kind.valueType, change, keep)) if keep and isinstance(kind.keyType, T.StringType) else rewrite(v, kind.valueType, change, keep))
    if isinstance(kind, T.StructType):
        medium = next((column[f] for f in ("mimeType", "type") if f in kind.names), None)
        fields = []
        for f in kind.fields:
            own = column[f.name]
            if f.name not in keep:
                new = rewrite(own, f.dataType, change, keep)
                payload = f.name == "data" and isinstance(f.dataType, T.StringType) and medium is not None
                own = F.when(P.is_binary_payload(column[f.name], medium), column[f.name]).otherwise(new) if payload else new
            fields.append(own.alias(f.name))
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def mask_text(c: Column) -> Column:
    """A string with its credential shapes masked."""
    return cut_and_join(c, shape_hits(c, hints=False), lambda x: F.lit(R.MARKER))


def strings(column: Column, kind: T.DataType, keep: frozenset[str] = frozenset()) -> Column:
    """The strings of a nested column that ``rewrite`` would change, as one array."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(column.isNotNull() & ~P.is_binary_payload(column), F.array(column)).otherwise(none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(column, lambda x: strings(x, kind.elementType, keep))), none)
    if isinstance(kind, T.MapType):
        return strings(F.map_values(column), T.ArrayType(kind.valueType), keep)
    if isinstance(kind, T.StructType):
        return F.concat(none, *(strings(column[f.name], f.dataType, keep) for f in kind.fields if f.name not in keep))
    return none


def scrub_columns(df: DataFrame, columns: list[str], keep: frozenset[str] = frozenset(), vault: DataFrame | None = None, key: str = "session_id") -> DataFrame:
    """``df`` with known values of the row's ``key`` (where a ``vault`` is given) and shapes masked in every string of ``columns``.

    With a vault, what a shape gives away in one string of a row is masked in all of them.
    """
    types = {c: df.schema[c].dataType for c in columns}
    if vault is None:
        return df.withColumns({c: rewrite(F.col(c), types[c], mask_text, keep) for c in columns})
    texts, done = fresh(df.columns, "texts", "done")
    rows = df.withColumn(texts, F.array_distinct(F.concat(*(strings(F.col(c), types[c], keep) for c in columns))))
    rows = scrub_texts(rows, vault, key, texts, done)
    # Each distinct string of a row is masked once; the columns are rebuilt by looking their strings up.
    rows = rows.withColumn(done, F.map_from_arrays(texts, F.transform(done, lambda x: x["masked"])))
    change = lambda t: F.coalesce(F.element_at(done, t), t)
    return rows.withColumns({c: rewrite(F.col(c), types[c], change, keep) for c in columns}).drop(texts, done)


def expand_columns(df: DataFrame, columns: list[str], vault: DataFrame, key: str = "session_id") -> DataFrame:
    """``df`` with the references in every string of ``columns`` replaced by the values that the row's ``key`` holds."""
    k, m = fresh(df.columns, "k", "m")
    held = by_name(vault, key, "value").select(F.col(key).alias(k), F.col("held").alias(m))
    both = df.join(held, df[key] == F.col(k), "left")
    return both.withColumns({c: rewrite(F.col(c), df.schema[c].dataType, lambda t: expanded(t, F.col(m))["text"]) for c in columns}).drop(k, m)


def payloads(column: Column, kind: T.DataType) -> Column:
    """How many strings of a nested column are binary payloads, which masking passes over."""
    if isinstance(kind, T.StringType):
        return F.coalesce(P.is_binary_payload(column).cast("int"), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(F.transform(column, lambda x: payloads(x, kind.elementType)), F.lit(0), lambda a, n: a + n), F.lit(0))
    if isinstance(kind, T.MapType):
        return payloads(F.map_values(column), T.ArrayType(kind.valueType))
    total = F.lit(0)
    if isinstance(kind, T.StructType):
        medium = next((column[f] for f in ("mimeType", "type") if f in kind.names), None)
        for f in kind.fields:
            own = column[f.name]
            media = f.name == "data" and isinstance(f.dataType, T.StringType) and medium is not None
            total = total + (F.coalesce(P.is_binary_payload(own, medium).cast("int"), F.lit(0)) if media else payloads(own, f.dataType))
    return total


def redact_columns(df: DataFrame, columns: list[str], keep: tuple[str, ...] = R.STRUCTURAL_KEYS) -> DataFrame:
    """``df`` with every string of ``columns`` replaced by the marker, but for structural fields: the last resort."""
    marker = lambda c: F.when(c.isNotNull(), F.lit(R.MARKER))
    return df.withColumns({c: rewrite(F.col(c), df.schema[c].dataType, marker, frozenset(keep)) for c in columns})


def redact_json(text: str | None, keep: frozenset[str] = frozenset(R.STRUCTURAL_KEYS)) -> str | None:
    """JSON text with its strings replaced, written again; the marker if it is no JSON."""
    if text is None:
        return None
    try:
        root = [json.loads(text)]
    except (ValueError, RecursionError):
        return R.MARKER
    if not isinstance(root[0], dict | list):
        return R.MARKER
    todo: list = [root]
    while todo:
        box = todo.pop()
        for k, v in list(box.items() if isinstance(box, dict) else enumerate(box)):
            if isinstance(v, dict | list):
                todo.append(v)
            elif isinstance(v, str) and not (isinstance(box, dict) and k in keep):
                box[k] = R.MARKER
    return json.dumps(root[0], ensure_ascii=False, separators=(",", ":"))


def redact_json_column(texts: Column) -> Column:
    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(redact_json, na_action="ignore")

    return redacted(texts)
