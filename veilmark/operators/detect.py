"""Credential findings in text: provider formats, keyword context, randomness.

All three tiers are Column expressions over one row, so detection is a
projection: no shuffle, and it streams as it is.  A finding is a struct of
start, end (code points, end exclusive), value, confidence (anchored, kv,
entropy), hint and evidence.  Null text has no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules as R
from ..functions.columns import fresh
from ..functions.spans import by_cluster, matches, once, overlaps, searched, template, value_row

FINDING = "struct<start:int,end:int,value:string,confidence:string,hint:string,evidence:string,rule:int>"
NONE = f"array<{FINDING}>"


def _rules() -> Column:
    """Tiers 1 and 2 as one array, so that the search stands once in a plan however many rules there are.

    ``words`` and ``marks``: lower-case text of which one each must be there, so
    that a pattern is only compiled and searched for in texts that may hold it.
    """
    rows = [(i, "anchored", hint, pattern, template(0, 0, 0, 0), False, False, [h.lower() for h in R.PROVIDER_HEADS[hint]], []) for i, (hint, pattern) in enumerate(R.PROVIDERS)]
    for hint, pattern, head in (("jwt", R.JWT, "eyj"), ("private_key", R.PEM, "-----begin "), ("private_key", R.PEM_CUT, "-----begin ")):
        rows.append((len(rows), "anchored", hint, pattern, template(0, 0, 0, 0), False, False, [head], []))
    for i, (name, pattern, hint) in enumerate(R.KV_RULES):
        words, marks = R.KV_GATES[name]
        groups = (0, 3, 1, 2) if name == "bare" else (0, 2, 1, 2)
        rows.append((100 + i, "kv", hint, pattern, template(*groups), name in ("bare", "double", "single"), name == "prose", list(words), list(marks or ())))
    names = ("rule", "confidence", "hint", "pattern", "given", "named", "prose", "words", "marks")
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v).cast("string") if v is None else F.lit(v)
    return F.array(*(F.struct(*(lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows))


def evidenced(text: Column, low: Column) -> Column:
    """Tier 1: provider formats, tokens of three dotted parts, private keys whole or cut.  Tier 2: values after a keyword,
    less quotes, brackets and stops around them, with the veto of templates and references and the length floor of the
    keyword.  ``low``: the text in lower case."""

    def each(f: Column) -> Column:
        kv = f["confidence"] == "kv"

        def row(gap: Column, group, at: Column) -> Column:
            x = value_row(group(1), group(0), at)
            right = F.when(kv, F.regexp_replace(group(3), R.TRIM + r"\z", "")).otherwise(group(1))
            body = F.when(kv, F.regexp_replace(right, r"\A" + R.TRIM, "")).otherwise(right)
            start = x["start"] + F.length(right) - F.length(body)
            key = F.when(f["named"], F.concat(F.regexp_extract(F.substring(gap, -R.KEY_BEFORE, R.KEY_BEFORE), r"[A-Za-z0-9_-]*\z", 0), group(2))).otherwise(group(2))
            hint = F.coalesce(f["hint"], key)
            return F.struct(start.alias("start"), (start + F.length(body)).alias("end"), body.alias("value"), f["confidence"].alias("confidence"), hint.alias("hint"), F.lit(None).cast("string").alias("evidence"), f["rule"].alias("rule"))

        def stays(x: Column) -> Column:
            value = x["value"]
            floor = F.when(f["hint"].isNull() & x["hint"].rlike(R.STRONG_KEY), R.STRONG_FLOOR).otherwise(R.FLOOR)
            telling = value.rlike("[0-9]|[^A-Za-z0-9]") | (value.rlike("[a-z]") & value.rlike("[A-Z]"))
            return ~kv | (F.length(value) >= floor) & (~f["prose"] | telling) & ~P.is_vetoed(value)

        return F.filter(searched(text, f["pattern"], f["given"], 4, row), stays)

    held = lambda words: F.exists(words, lambda w: low.contains(w))
    active = F.filter(_rules(), lambda f: held(f["words"]) & ((F.size(f["marks"]) == 0) | held(f["marks"])))
    return F.coalesce(F.flatten(F.transform(active, each)), F.array()).cast(NONE)


def deduped(found: Column) -> Column:
    """By start, longest first; of two that overlap the earlier stays unless the later ends further, which then replaces it."""
    key = F.transform(found, lambda x: F.struct(x["start"], -x["end"], x["rule"], x.alias("x")))
    ordered = F.transform(F.array_sort(key), lambda k: k["x"])

    def fold(a, x):
        last = F.element_at(a, -1)
        further = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(x))
        return F.when(F.size(a) == 0, F.array(x)).when(~overlaps(last, x), F.array_append(a, x)).when(x["end"] > last["end"], further).otherwise(a)

    return by_cluster(ordered, lambda own: F.aggregate(own, F.array().cast(NONE), fold))


def guesses(text: Column, values: Column, uris: Column, refs: Column, regions: Column) -> Column:
    """Tier 3: random-looking tokens that no keyword stands near.  All arrays are columns of the input: each token looks into them."""
    d = R.DELIMITERS
    raw = matches(text, rf"(?<![^{d}])((?:[^{d}]{{18,}}+|[^{d}]*?://[^{d}]*+))(?=([\s\S]{{0,3}}))", 1, 1, 2)

    def padded(x):
        n = F.length(x["value"]) % 4
        need = F.when(n == 2, "==").when(n == 3, "=").otherwise("")
        after = x["more"]
        fits = (need != "") & after.startswith(need) & F.substring(after, F.length(need) + 1, F.lit(1)).rlike(rf"\A(?:[{R.WS}\"',;)\]}}]|)\z")
        pad = F.when(fits, need).otherwise("")
        return F.struct(x["start"].alias("start"), (x["end"] + F.length(pad)).alias("end"), F.concat(x["value"], pad).alias("value"), x["value"].alias("key"))

    def stays(x):
        v = x["value"]
        near = F.array_contains(values, v) | F.exists(values, lambda b: v.contains(b) | b.contains(v))
        base64ish = v.rlike(r"\A(?:[A-Za-z0-9+/]+=*|[A-Za-z0-9_-]+=?)\z")
        parts = F.filter(F.split(v, "[_-]"), lambda s: s != "")
        words = (F.size(parts) >= 3) & F.forall(parts, lambda s: s.rlike(r"\A[A-Za-z]{2,}\z"))
        random = (
            (F.length(v) >= R.GUESS_LENGTH)
            & (P.credentialish_form(v) | base64ish)
            & ~v.rlike(r"[^\x20-\x7E]")
            & ~P.looks_like_identifier_text(v)
            & ~v.rlike(r"(?i)\A[0-9a-f]+\z")
            & v.rlike("[a-z0-9]")
            & (v.rlike("[0-9]") | ~words)
            & (P.shannon_entropy(v) > R.GUESS_BITS)  # the costly test comes last
        )
        wanted = (
            F.when(P.is_digest_shaped(x["key"]), False)
            .when(v.rlike(r"\A[a-z][a-z0-9+.-]*://"), P.is_credential_url(v))
            .when(v.rlike(r"(?i)\A(?:https?|file|git|ssh|node):"), False)
            .when(v.rlike(r"\A(?:\.\.?/|~[/\\]|[A-Za-z]:[/\\])"), False)
            .otherwise(random)
        )
        held = F.exists(refs, lambda r: overlaps(r, x)) | F.exists(regions, lambda r: (x["start"] > r["start"]) & (x["end"] <= r["end"]))
        # The test against all values comes last: few tokens are left for it.
        return wanted & ~P.is_digest_shaped(v) & ~P.is_vetoed(v) & ~F.array_contains(uris, x["start"]) & ~held & ~near

    def told(x):
        v = x["value"]
        evidence = F.concat(
            F.format_string("%.2f bits/char, length %d, ", P.shannon_entropy(v), F.length(v)),
            F.when(v.rlike(r"[^\x20-\x7E]"), "non-ascii, ").otherwise("ascii, "),
            F.when(v.rlike("[0-9]"), "has digit").otherwise("no digit"),
        )
        unknown = F.lit(None).cast("string")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), v.alias("value"), F.lit("entropy").alias("confidence"), unknown.alias("hint"), evidence.alias("evidence"), F.lit(200).alias("rule"))

    return F.transform(F.filter(F.transform(raw, padded), stays), told)


def with_findings(df: DataFrame, text_col: str = "text", out: str = "findings", tiers: str = "all") -> DataFrame:
    """``df`` with the array column ``out``; ``tiers``: ``all``, or ``evidenced`` without the entropy tier."""
    t, l, refs, pem, hits, base, values, uris, every = fresh([*df.columns, out], "t", "low", "refs", "pem", "hits", "base", "values", "uris", "every")
    text, low = F.col(t), F.col(l)
    none = F.array().cast("array<struct<start:int,end:int,value:string,key:string>>")
    df = df.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn(l, F.lower(F.col(t)))
    spans = {refs: ("{{sec:", R.REF), pem: ("-----begin ", R.PEM_REGION)}
    df = df.withColumns({n: F.when(low.contains(gate), matches(text, pattern)).otherwise(none) for n, (gate, pattern) in spans.items()} | {hits: evidenced(text, low)})

    def stays(x):
        held = F.exists(refs, lambda r: overlaps(r, x)) | F.exists(pem, lambda r: (x["start"] > r["start"]) & (x["end"] <= r["end"]))
        url = (x["confidence"] == "kv") & F.lower(F.coalesce(x["hint"], F.lit(""))).contains("url")
        return ~held & ~P.is_path(x["value"]) & (~url | P.is_credential_url(x["value"]))

    df = df.withColumn(base, F.filter(deduped(F.col(hits)), stays))
    found = F.col(base)
    if tiers == "all":
        df = df.withColumn(values, F.transform(base, lambda b: b["value"]))
        df = df.withColumn(uris, F.when(low.contains(";base64"), F.transform(matches(text, rf"(?i)(?<![^{R.WS}])data:[^{R.WS}]*;base64,?"), lambda x: x["end"])).otherwise(F.array().cast("array<int>")))
        found = F.array_sort(F.concat(base, guesses(text, *map(F.col, (values, uris, refs, pem)))))
    return once(df, every, found).withColumn(out, F.col(every)).drop(every, t, l, refs, pem, hits, base, values, uris)


def findings(df: DataFrame, id_cols: list[str], text_col: str = "text", tiers: str = "all") -> DataFrame:
    """One row for each finding, with the columns ``id_cols``."""
    # An outer explode: an inner one makes Spark test the array's size in a filter that repeats every search.
    text, own, f = fresh(id_cols, "text", "found", "f")
    found = with_findings(df.select(*id_cols, F.col(text_col).alias(text)), text, own, tiers)
    each = found.select(*id_cols, F.explode_outer(own).alias(f)).where(F.col(f).isNotNull())
    return each.select(*id_cols, *(F.col(f)[n].alias(n) for n in ("start", "end", "value", "confidence", "hint", "evidence")))
