"""Names for findings, from their hint and the words around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules as R
from ..functions.columns import fresh
from ..functions.spans import let

AROUND = 60


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")


def _alias(word: Column) -> Column:
    out = word
    for k, v in R.ALIASES.items():
        out = F.when(word == k, v).otherwise(out)
    return out


def base_name(hint: Column, context: Column) -> Column:
    """The hint and the first two known words of the context, in the order of the list; ``secret`` if there is neither."""
    known = F.coalesce(F.when(hint.isin(*R.ALIASES), _alias(hint)).otherwise(slug(hint)), F.lit(""))

    # Each step is bound: named in plain columns, every use would repeat all the searches before it.
    def named(low: Column, known: Column, own: Column) -> Column:
        words = F.array_compact(F.array(*(F.when(low.rlike(rf"\b{w}\b"), R.ALIASES.get(w, w)) for w in R.CONTEXT_WORDS)))
        present = F.filter(words, lambda w: ~F.exists(own, lambda t: (t == w) | (_alias(t) == w) | (t == _alias(w))))
        return let(let(present, lambda p: joined(known, p)), lambda base: F.when(P.is_valid_name(base), base).otherwise(F.substring(F.concat(F.lit("s_"), base), 1, 64)))

    def joined(known: Column, present: Column) -> Column:
        related = F.exists(present, lambda w: w.startswith(known) | known.startswith(w))
        parts = F.concat(F.when((known != "") & ~related, F.array(known)).otherwise(F.array().cast("array<string>")), F.slice(present, 1, 2))
        return let(F.substring(F.array_join(parts, "_"), 1, 58), lambda base: F.when(base == "", "secret").otherwise(base))

    return let(F.lower(context), lambda low: let(known, lambda k: let(F.split(k, "_"), lambda own: named(low, k, own))))


def numbered(new: DataFrame, keys: list[str], taken: DataFrame | None) -> DataFrame:
    """``new`` (keys, base, rank) with ``name``: the base, or with the next number from 2 on, so that the rank-th name of a base takes the rank-th number that ``taken`` (keys, name) leaves free.

    Before the i-th taken number t there are t - i free ones.  So the rank-th free
    number is rank and as many more as there are taken ones with t - i < rank: a
    running count over both, in order, whatever the number of names.
    """
    each = new.withColumn("at", F.col("rank").cast("long")).withColumn("is_taken", F.lit(0))
    if taken is not None:
        parts = F.array(F.struct(F.col("name").alias("base"), F.lit(1).cast("long").alias("number")))
        tail = F.regexp_extract("name", r"-([2-9]|[1-9][0-9]{1,8})\z", 1)
        more = F.array(F.struct(F.regexp_replace("name", r"-[0-9]+\z", "").alias("base"), F.expr("try_cast(regexp_extract(name, '-([0-9]+)$', 1) as bigint)").alias("number")))
        used = taken.select(*keys, F.explode_outer(F.when(tail != "", F.concat(parts, more)).otherwise(parts)).alias("t")).select(*keys, "t.base", "t.number").distinct()
        place = F.row_number().over(Window.partitionBy(*keys, "base").orderBy("number"))
        gaps = used.select(*keys, "base", (F.col("number") - place).alias("at"), F.lit(1).alias("is_taken"))
        each = each.unionByName(gaps, allowMissingColumns=True)
    before = Window.partitionBy(*keys, "base").orderBy("at", "is_taken").rowsBetween(Window.unboundedPreceding, 0)
    number = F.col("rank") + F.sum("is_taken").over(before)
    return each.withColumn("number", number).where("is_taken = 0").withColumn("name", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), "number"))).drop("at", "is_taken", "number")


def suggest_names(found: DataFrame, texts: DataFrame, ids: list[str], text_col: str = "text", taken: DataFrame | None = None) -> DataFrame:
    """``found`` (ids, start, end, value, hint) with ``name``: one for each distinct value of a text.

    A value that ``taken`` (ids, name, value) already names keeps that name;
    others take their base name at their first place, or that with the first
    number that neither the same text nor its vault has in use.  The context of a value ends
    where its neighbours stand.
    """
    by = Window.partitionBy(*ids).orderBy("start", "end")
    t, base_col = fresh([*found.columns, *ids], "t", "base")
    rows = found.join(texts.select(*ids, F.col(text_col).alias(t)), ids)
    left = F.greatest(F.col("start") - AROUND, F.coalesce(F.lag("end").over(by), F.lit(0)))
    right = F.coalesce(F.lead("end").over(by) * 0 + F.col("end"), F.col("end") + AROUND)
    rows = rows.withColumn(base_col, base_name(F.col("hint"), F.substring(F.col(t), left + 1, right - left)))
    first = rows.groupBy(*ids, "value").agg(F.min_by(base_col, F.struct("start", "end")).alias("base"), F.min("start").alias("at"))
    if taken is None:
        first = first.withColumn("old", F.lit(None).cast("string"))
    else:
        old = taken.groupBy(*ids, "value").agg(F.min("name").alias("old"))
        # A name that two values ask for stays with the first; the other gets a name of its own.
        asked = F.row_number().over(Window.partitionBy(*ids, "old").orderBy("at", "value"))
        first = first.join(old, [*ids, "value"], "left").withColumn("old", F.when(asked == 1, F.col("old")))
    rank = F.row_number().over(Window.partitionBy(*ids, "base").orderBy("at", "value"))
    new = first.where("old is null").select(*ids, "value", "base", rank.alias("rank"))
    named = numbered(new, ids, taken).select(*ids, "value", "name")
    names = first.where("old is not null").select(*ids, "value", F.col("old").alias("name")).unionByName(named)
    names = names.select(*ids, "value", F.substring("name", 1, 64).alias("name"))
    return found.join(names, [*ids, "value"])


def adopted_base(kind: Column, key: Column, hint: Column) -> Column:
    raw = F.when(kind == "kv", key).when(kind == "provider", hint).when(kind == "pem", "private_key").otherwise("jwt")
    name = F.substring(slug(raw), 1, 56)
    name = F.when(name.rlike(r"\A[a-z]"), name).otherwise(F.concat(F.lit("s_"), name))
    return F.when(name == R.RESERVED, "secret").otherwise(name)


def choose_names(rows: DataFrame, key_col: str = "key", order: str = "line", taken: DataFrame | None = None) -> DataFrame:
    """Names of imported variables: the key in lower case, with the first free number from 1 where that is in use, or a reason.

    A file's keys are named in order, since each name can take the place of a
    later one; they are gathered by file, which is at most 1 MiB.  Names of
    ``taken`` (name) are in use from the start; it is gathered too, so pass the
    names of one vault.
    """
    low = F.lower(key_col)
    reason = (
        F.when(low.rlike(r"\A[0-9]"), "starts with a digit")
        .when(low.rlike(r"\A_"), "starts with an underscore")
        .when(low.rlike("[^a-z0-9_-]"), "has a character that names cannot hold")
        .when(F.length(low) > 64, "longer than 64 characters")
        .when(~P.is_valid_name(low), "has a character that names cannot hold")
    )
    rows = rows.withColumn("reason", reason)
    names = "array<string>"
    files = rows.where("reason is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key_col).alias("key")))).alias("keys"))
    if taken is None:
        files = files.withColumn("used", F.array().cast(names))
    else:
        files = files.join(F.broadcast(taken.agg(F.collect_set("name").alias("used"))))

    def named(a: Column, x: Column) -> Column:
        base = F.lower(x["key"])
        forms = F.transform(F.sequence(F.lit(0), F.size(a["used"])), lambda n: F.when(n == 0, base).otherwise(F.concat(base, n.cast("string"))))
        free = F.get(F.filter(forms, lambda f: ~F.array_contains(a["used"], f)), F.lit(0))
        fits = lambda f: F.struct(F.array_append(a["used"], f).alias("used"), F.array_append(a["out"], F.when(F.length(f) <= 64, f)).alias("out"))
        return let(free, fits)

    start = F.struct("used", F.array().cast(names).alias("out"))
    files = files.select("path", "keys", F.aggregate("keys", start, named, lambda a: a["out"]).alias("names"))
    each = files.select("path", F.explode_outer(F.arrays_zip("keys", "names")).alias("x")).select("path", F.col("x.keys.key").alias(key_col), F.col("x.keys.o").alias(order), F.col("x.names").alias("name"))
    both = rows.join(each, ["path", key_col, order], "left")
    full = F.when(F.col("reason").isNull() & F.col("name").isNull(), "at the limit of 64 characters").otherwise(F.col("reason"))
    return both.withColumn("reason", full).select(*rows.columns, "name")
