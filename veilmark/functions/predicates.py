"""Scalar tests and forms of credential text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .spans import let


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{R.WS}]+|[{R.WS}]+\z", "")


def shannon_entropy(c: Column) -> Column:
    """Bits a character; 0 for an empty string."""

    def of(v: Column) -> Column:
        n = F.length(v["v"])
        # Of a long text, runs of one letter are drawn together before it is split.
        once = F.when(n > 1024, F.regexp_replace(v["v"], r"(?s)(.)\1+", "$1")).otherwise(v["v"])
        letters = F.array_distinct(F.split(once, "(?s)(?<=.)(?=.)"))
        share = lambda x: (n - F.length(F.replace(v["v"], x, F.lit("")))) / n
        return F.when(n > 0, F.aggregate(F.transform(letters, share), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))

    return let(F.struct(c.alias("v")), of)


def is_digest_shaped(c: Column) -> Column:
    return c.rlike(R.DIGEST)


def matches_provider_format(c: Column) -> Column:
    return c.rlike(rf"\A{R.ANY_PROVIDER}\z")


def looks_like_identifier_text(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(R.WORD_RUN), F.lit(0))
    covered = F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x))
    return (F.size(runs) >= 2) & (covered >= F.length(c) * R.WORD_RUN_SHARE)


def is_placeholder(c: Column) -> Column:
    t = trimmed(c)
    return (t == "") | t.rlike(R.PLACEHOLDER)


def has_reference_prefix(c: Column) -> Column:
    return trimmed(c).rlike(R.REFERENCE_PREFIX)


def looks_like_reference(c: Column) -> Column:
    t = trimmed(c)
    return t.rlike(R.REFERENCE_PREFIX) | t.rlike(R.REFERENCE)


def is_vetoed(c: Column) -> Column:
    return is_placeholder(c) | looks_like_reference(c)


def looks_like_sensitive_name(c: Column) -> Column:
    return trimmed(c).rlike(R.SENSITIVE_NAME)


def looks_like_setting_name(c: Column) -> Column:
    return trimmed(c).rlike(R.SETTING_NAME)


def credentialish_form(t: Column) -> Column:
    """Trimmed text that looks like a credential but for its randomness."""
    classes = sum((t.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", rf"[^A-Za-z0-9{R.WS}]")), F.lit(0))
    return (
        F.when(F.length(t) < R.GUESS_LENGTH, False)
        .when(is_digest_shaped(t), False)
        .when(t.rlike(R.USERINFO), True)
        .when(t.rlike(R.SCHEME), False)
        .when(t.rlike(R.SHELL_SYNTAX), False)
        .when(t.rlike(R.PATH_STEM), False)
        .when(t.startswith("-"), False)
        .when(~t.contains("://") & t.rlike("[:,]"), False)
        .when(t.rlike(r"\A[A-Za-z0-9._/-]+\z") & t.contains("/"), False)
        .otherwise(classes >= 2)
    )


def looks_credentialish(c: Column) -> Column:
    return let(trimmed(c), lambda t: credentialish_form(t) & (t.rlike(R.USERINFO) | (shannon_entropy(t) > R.CREDENTIALISH_BITS)))


def is_likely_secret(name: Column, value: Column) -> Column:
    return (
        F.when(matches_provider_format(trimmed(value)), True)
        .when(looks_like_setting_name(name), False)
        .when(looks_like_sensitive_name(name), True)
        .otherwise(looks_credentialish(value))
    )


def is_path(c: Column) -> Column:
    base = F.regexp_extract(c, r"([^/\\]*)\z", 1)
    return c.rlike(r"\A(?:\.?\.?/|~[/\\]|[A-Za-z]:[/\\])") | base.rlike(r"(?i)\A(?:id_[a-z0-9]*|.*\.(?:pem|key|p12|pfx))\z")


def is_credential_url(c: Column) -> Column:
    parts = r"(?i)\A[a-z][a-z0-9+.-]*://([^/?#]*)((?:/[^?#]*)?)"
    authority = F.regexp_extract(c, parts, 1)
    host = F.lower(F.regexp_extract(authority, r"\A([^:]*)", 1))
    path = F.lower(F.regexp_extract(c, parts, 2))
    known = F.lit(False)
    for name, below, paths in R.CREDENTIAL_HOSTS:
        own = (host == name) | host.endswith("." + name) if below else host == name
        starts = F.lit(False)
        for p in paths:
            starts = starts | path.startswith(p)
        known = known | (own & starts)
    numeric = ((host == R.NUMERIC_PATH_HOST) | host.endswith("." + R.NUMERIC_PATH_HOST)) & path.rlike(r"\A/[0-9]")
    return c.rlike(parts) & (authority.contains("@") | known | numeric | c.rlike(R.CREDENTIAL_QUERY))


def is_binary_payload(value: Column, kind: Column | None = None) -> Column:
    """Base64 text of 2048 characters or more; or any value that ``kind`` names a medium for."""
    plain = (F.length(value) >= 2048) & (F.length(value) % 4 != 1) & value.rlike(r"\A(?:[A-Za-z0-9+/]+={0,2}|[A-Za-z0-9_-]+={0,2})\z")
    return plain if kind is None else plain | F.coalesce(kind.rlike(r"(?i)\A(?:image|audio|video)(?:/|\z)"), F.lit(False))


def is_valid_name(c: Column) -> Column:
    return c.rlike(rf"\A{R.NAME}\z")


def is_doc_path(c: Column) -> Column:
    return c.rlike(r"(?i)(?:\A|/)(?:docs?|tests?|fixtures?|examples?)(?:/|\z)") | c.rlike(r"(?i)\.(?:md|markdown|example|sample|template)\z")


def fingerprint(c: Column, length: int = 4) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def base64_line(c: Column) -> Column:
    """Base64 without line ends."""
    return F.translate(F.base64(c.cast("binary")), "\r\n", "")


def derived_forms(c: Column) -> Column:
    """The value, its base64, URL-safe base64 without padding, and lower-case hex."""
    b64 = base64_line(c)
    return F.array_distinct(F.array(c, b64, F.rtrim(F.translate(b64, "+/=", "-_ ")), F.lower(F.hex(c.cast("binary")))))


def variable_name(name: Column) -> Column:
    """The environment variable of a reference name."""
    return F.concat(F.lit("__VEIL_"), F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", "_")), F.lit("_"), F.substring(F.sha2(name, 256), 1, 16))


def ref_token(name: Column) -> Column:
    return F.concat(F.lit("{{sec:"), name, F.lit("}}"))


def parse_ref(c: Column) -> Column:
    """The name if the whole string is a reference, else null."""
    return F.nullif(F.regexp_extract(c, rf"\A{R.REF}\z", 1), F.lit(""))


def quote_posix(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def preview(c: Column) -> Column:
    """A few characters of either end of a random-looking value, or null."""
    known = matches_provider_format(c)
    side = (
        F.when(F.length(c) < R.PREVIEW_LENGTH, 0)
        .when(known, R.PREVIEW_SIDE)
        .when(shannon_entropy(c) < R.PREVIEW_BITS, 0)
        .otherwise(F.least(F.lit(R.PREVIEW_SIDE), F.floor(F.length(c) / 10).cast("int")))
    )
    marker = F.regexp_extract(c, r"\A([A-Za-z0-9]{1,6}(?:[-_][A-Za-z0-9]{1,6})*[-_])", 1)
    marker = F.when(~known, "").when(marker != "", marker).otherwise(F.regexp_extract(c, r"\A([A-Z]{4})", 1))
    head = F.substring(c, F.length(marker) + 1, side)
    tail = F.substring(c, F.length(c) - side + 1, side)
    return F.when(side >= 1, F.concat(marker, head, F.lit("…"), tail))


def label(c: Column) -> Column:
    return F.coalesce(preview(c), F.concat(F.lit("sha256:"), fingerprint(c)))


def ago(then: Column, now: Column) -> Column:
    """Rounded age: minutes, hours or days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(s < 3600, F.concat(F.round(s / 60).cast("int"), F.lit("m ago"))).when(s < 86400, F.concat(F.round(s / 3600).cast("int"), F.lit("h ago"))).otherwise(F.concat(F.round(s / 86400).cast("int"), F.lit("d ago")))


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out
