"""Masking: known values in raw and encoded form, and credential shapes.

Shapes are masked by a projection.  Values are met by an inverted index of their
forms, and a small function masks the texts that may hold one.  ``hits`` counts
masked regions, not distinct secrets.  Null text stays null with 0 hits.  Values
come in as a DataFrame, never as literals, so that no plan or event log holds one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions import rules as R
from ..functions.columns import fresh
from ..functions.forms import masked as masked_text
from ..functions.spans import by_cluster, cut_and_join, let, matches, once, searched, slicer, template, value_row
from .index import with_candidates

FORM = "array<struct<form:string,tight:boolean,grows:string,token:string>>"


def value_forms(value: Column, token: Column) -> Column:
    """What a value is looked for as: itself; its encodings, where blanks do not count; the head and tail of long encodings, grown over their alphabet."""

    def form(text, tight, grows):
        return F.struct(text.alias("form"), F.lit(tight).alias("tight"), grows.cast("string").alias("grows"), token.alias("token"))

    b64 = P.base64_line(value)
    hexed = F.lower(F.hex(value.cast("binary")))
    encodings = F.array_distinct(F.array(b64, F.rtrim(F.translate(b64, "=", " ")), F.rtrim(F.translate(b64, "+/=", "-_ ")), hexed, F.upper(hexed)))

    def windows(e):
        alphabet = F.when(e.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z"), "hex").when(e.rlike("[-_]"), "url").otherwise("base64")
        body = F.rtrim(F.translate(e, "=", " "))
        parts = F.array(F.substring(e, 1, R.WINDOW), F.substring(body, F.length(body) - R.WINDOW + 1, F.lit(R.WINDOW)))
        return F.when(F.length(e) >= R.WINDOW_FORM, F.transform(parts, lambda x: form(x, True, alphabet))).otherwise(F.array().cast(FORM))

    whole = F.transform(encodings, lambda e: form(e, True, F.lit(None)))
    every = F.concat(F.array(form(value, False, F.lit(None))), whole, F.flatten(F.transform(encodings, windows)))
    return F.when(F.length(value) >= R.MIN_VALUE, F.array_distinct(every)).otherwise(F.array().cast(FORM))


def sought_forms(value: Column) -> Column:
    """Forms (form, tight) of which a text has one if it has any form of the value: a long encoding has its head, a padded one is there without its padding too."""
    needed = lambda f: ~f["tight"] | f["grows"].isNotNull() | (F.length(f["form"]) < R.WINDOW_FORM) & ~f["form"].endswith("=")
    return F.transform(F.filter(value_forms(value, F.lit("")), needed), lambda f: F.struct(f["form"].alias("form"), f["tight"].alias("tight")))


def known_values(vault: DataFrame, key: str, token: str | None = R.MARKER, *more: str) -> DataFrame:
    """``k, f, sought``, as the index takes them: each value of a key with its token and the columns ``more``; a null ``token`` stands for the value's own reference."""
    name = F.lit(token) if token is not None else P.ref_token(F.col("name"))
    return vault.select(F.col(key).alias("k"), F.struct("value", name.alias("token"), *more).alias("f"), sought_forms(F.col("value")).alias("sought"))


def forms_of(values: Column) -> Column:
    """All forms of an array of values with their tokens."""
    return F.flatten(F.transform(values, lambda v: value_forms(v["value"], v["token"])))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("masked", T.StringType()), T.StructField("hits", T.IntegerType())])))
def masked_forms(texts: pa.Array, forms: pa.Array) -> pa.Array:
    """Each of the texts with its forms masked, and their number; rows without texts are passed over."""
    out = [None if own is None else [{"masked": m, "hits": n} for t in own for m, n in [masked_text(t, some or [])]] for own, some in zip(texts.to_pylist(), forms.to_pylist(), strict=True)]
    return pa.array(out, pa.list_(pa.struct([("masked", pa.string()), ("hits", pa.int32())])))


def with_forms_masked(df: DataFrame, texts: str, forms: str, out: str) -> DataFrame:
    """``df`` with ``out``, array of (masked, hits), for the array column ``texts``; only rows that have ``forms`` go to Python."""
    has = F.coalesce(F.size(forms) > 0, F.lit(False))
    done = masked_forms(F.when(has, F.col(texts)), F.when(has, F.col(forms)))
    same = F.transform(texts, lambda t: F.struct(t.alias("masked"), F.lit(0).alias("hits")))
    return df.withColumn(out, F.coalesce(done, same))


def mask_values(df: DataFrame, vault: DataFrame, key: str, text_col: str = "text", token: str | None = R.MARKER, out: str = "masked") -> DataFrame:
    """``df`` with ``out`` and ``hits``: every known value of the row's ``key`` in ``vault`` (key, name, value) is masked.

    A null ``token`` masks a value with its own reference.  Values are met by an
    index (``index.with_candidates``), so a key may have any number.
    """
    texts, values, forms, done = fresh([*df.columns, out, "hits"], "texts", "values", "forms", "done")
    every = F.array_compact(F.array(F.col(text_col)))
    own = with_candidates(df, key, every, known_values(vault, key, token), values).withColumn(texts, every)
    own = with_forms_masked(once(own, forms, forms_of(F.col(values))), texts, forms, done)
    first = F.get(done, F.lit(0))
    return own.withColumns({out: first["masked"], "hits": F.coalesce(first["hits"], F.lit(0))}).drop(texts, values, forms, done)


HIT = "array<struct<start:int,end:int,value:string,kind:string,hint:string>>"


def shape_hits(text: Column, hints: bool = True) -> Column:
    """Credential shapes that are masked: start, end, value, kind (kv, provider, jwt, pem) and hint; null text has none.

    Without ``hints``, kinds but kv and hints are null: masking needs no more.
    """

    def hit(m):
        kv = m["value"] != ""
        value = F.when(kv, m["value"]).otherwise(m["key"])
        provider = value.rlike(rf"(?i)\A{R.ANY_PROVIDER}\z")
        hint = F.lit(None).cast("string")
        if not hints:
            return F.struct((m["end"] - F.length(value)).alias("start"), m["end"].alias("end"), value.alias("value"), F.when(kv & ~provider, "kv").alias("kind"), hint.alias("hint"))
        for name, pattern in reversed(R.PROVIDERS):
            hint = F.when(value.rlike(rf"(?i)\A{pattern}\z"), name).otherwise(hint)
        hint = F.when(provider, hint)
        kind = F.when(kv & ~provider, "kv").when(value.startswith("-----BEGIN"), "pem").when(provider, "provider").otherwise("jwt")
        word = F.when(kv, F.regexp_extract(m["key"], r"\A([A-Za-z0-9_-]+)", 1))
        return F.struct((m["end"] - F.length(value)).alias("start"), m["end"].alias("end"), value.alias("value"), kind.alias("kind"), F.coalesce(hint, word).alias("hint"))

    def kept(own: Column) -> Column:
        def stays(refs, x):
            loose = F.coalesce(x["kind"] == "kv", F.lit(False)) & (P.has_reference_prefix(x["value"]) | P.is_placeholder(x["value"]))
            near = F.exists(refs, lambda r: (r["start"] <= x["end"]) & (x["start"] <= r["end"]))
            return (F.length(x["value"]) >= R.MIN_VALUE) & ~P.is_digest_shaped(x["value"]) & ~loose & ~near

        return F.when(F.size(own) > 0, let(matches(text, R.REF), lambda refs: F.filter(own, lambda x: stays(refs, x)))).otherwise(own)

    def gated(low: Column) -> Column:
        word, form = P.holds_any(low, R.SHAPE_WORDS), P.holds_any(low, R.SHAPE_HEADS)
        # Where only one kind can occur its pattern does alone; the whole one, which tries every name, is the dearest.
        pattern = F.when(word & form, rf"(?i)(?:{R.SHAPE_FORMATS}|{R.SHAPE_KV})").when(word, f"(?i){R.SHAPE_KV_BARE}").when(form, rf"(?i)(?:{R.SHAPE_FORMATS}|(\b\B))")

        def row(gap: Column, group, at: Column) -> Column:
            before = F.when(form, "").otherwise(F.regexp_extract(F.substring(gap, -R.KEY_BEFORE, R.KEY_BEFORE), r"[A-Za-z0-9_-]*\z", 0))
            return hit(value_row(group(1), group(0), at, F.concat(before, group(0)).alias("key")))

        every = let(pattern, lambda p: F.when(p.isNotNull(), searched(text, p, F.lit(template(0, 1)), 2, row)))
        return let(F.coalesce(every, F.array().cast(HIT)), kept)

    return F.coalesce(let(F.lower(text), gated), F.array().cast(HIT))


def mask_shapes(df: DataFrame, text_col: str = "text", out: str = "masked", hits: str = "hits") -> DataFrame:
    """``df`` with credential shapes masked and their number."""
    text = F.col(text_col)
    (own,) = fresh([*df.columns, out, hits], "shapes")
    df = once(df, own, shape_hits(text, hints=False))
    return df.withColumns({out: cut_and_join(text, F.col(own), lambda x: F.lit(R.MARKER)), hits: F.size(own)}).drop(own)


def scrub_texts(df: DataFrame, vault: DataFrame, key: str, texts: str, out: str, shapes: bool | Column = True) -> DataFrame:
    """``df`` with ``out``, array of (masked, hits), for the strings of the array column ``texts``: known values of the row's ``key`` by
    their references, then credential shapes, then the values of these shapes in any string of the row, bare or encoded
    (by the marker, as they have no name yet)."""
    values, forms, known, found, given, bare = fresh([*df.columns, out], "values", "forms", "known", "found", "given", "bare")
    df = with_candidates(df, key, F.col(texts), known_values(vault, key, None), values)
    df = with_forms_masked(once(df, forms, forms_of(F.col(values))), texts, forms, known)
    one = lambda k: F.when(F.lit(shapes) if isinstance(shapes, bool) else shapes, shape_hits(k["masked"], hints=False)).otherwise(F.array().cast(HIT))
    df = once(df, found, F.transform(known, one))
    cut = F.zip_with(known, found, lambda k, h: cut_and_join(k["masked"], h, lambda x: F.lit(R.MARKER)))
    df = df.withColumn(given, cut).withColumn(forms, shape_forms(F.flatten(found)))
    df = with_forms_masked(df, given, forms, bare)
    hits = F.zip_with(F.zip_with(known, found, lambda k, h: k["hits"] + F.size(h)), bare, lambda n, b: F.struct(b["masked"].alias("masked"), (n + b["hits"]).alias("hits")))
    return df.withColumn(out, hits).drop(values, forms, known, found, given, bare)


def scrub(df: DataFrame, vault: DataFrame, key: str, text_col: str = "text", shapes: bool | Column = True) -> DataFrame:
    """``df`` with ``masked`` and ``hits``: known values of the row's ``key``, then credential shapes, then the values of these shapes elsewhere in the text."""
    texts, done = fresh([*df.columns, "masked", "hits"], "texts", "done")
    own = scrub_texts(df.withColumn(texts, F.array_compact(F.array(F.col(text_col)))), vault, key, texts, done, shapes)
    first = F.get(done, F.lit(0))
    return own.withColumns({"masked": first["masked"], "hits": F.coalesce(first["hits"], F.lit(0))}).drop(texts, done)


def shape_forms(found: Column) -> Column:
    """The forms of what shapes gave away."""
    return F.flatten(F.transform(F.array_distinct(F.transform(found, lambda h: h["value"])), lambda v: value_forms(v, F.lit(R.MARKER))))


def apply_capture(df: DataFrame, items: str = "items", text_col: str = "text") -> DataFrame:
    """Replaces captured items (array of start, end, value, name) by references, with ``captured`` and the skip counts.

    Skipped are items whose name stands for two values, and items that overlap
    an earlier one or whose span no longer holds the value.
    """
    text = F.col(text_col)
    kind = "array<struct<start:int,end:int,value:string,name:string>>"
    order = F.transform(F.array_sort(F.transform(items, lambda x: F.struct(x["start"], -x["end"], x["value"], x["name"], x.alias("x")))), lambda k: k["x"])
    names, same, own = fresh([*df.columns, "captured", "name_conflicts", "stale_spans", "rewritten"], "names", "twice", "own")
    df = df.withColumn(names, F.array_sort(F.transform(items, lambda y: F.struct(y["name"].alias("name"), y["value"].alias("value")))))
    other = F.filter(names, lambda n, i: (n["name"] == F.get(names, i - 1)["name"]) & (n["value"] != F.get(names, i - 1)["value"]))
    df = df.withColumn(same, F.array_distinct(F.transform(other, lambda n: n["name"])))
    twice = lambda x: F.array_contains(same, x["name"])
    clear = slicer(text, lambda between: F.filter(order, lambda x: ~twice(x) & (between(x["start"], x["end"]) == x["value"])))
    first = lambda own: F.aggregate(own, F.array().cast(kind), lambda a, x: F.when((F.size(a) > 0) & (x["start"] < F.element_at(a, -1)["end"]), a).otherwise(F.array_append(a, x)))
    df = once(df, own, by_cluster(clear, first)).withColumn("captured", F.col(own)).drop(own).withColumn("name_conflicts", F.size(F.filter(items, twice)))
    df = df.withColumn("stale_spans", F.size(items) - F.size("captured") - F.col("name_conflicts")).drop(same, names)
    return df.withColumn("rewritten", cut_and_join(text, F.col("captured"), lambda x: P.ref_token(x["name"])))
