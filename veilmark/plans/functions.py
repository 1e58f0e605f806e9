"""SQL functions: predicates, references and provider formats, for use in any query; their bodies are SQL, no Python worker runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import rules as R

_ENTROPY = "CASE WHEN s = '' THEN 0D ELSE -aggregate(transform(array_distinct(split(s, '')), c -> (length(s) - length(replace(s, c, ''))) / length(s)), 0D, (a, p) -> a + p * log2(p)) END"
_DIGEST = r"s RLIKE r'(?i)\A(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{7})\z'"
_SAID = ", ".join(f"struct('{hint}' AS hint, r'{pattern}' AS pattern)" for hint, pattern in R.PROVIDERS)


def _statements() -> list[str]:
    scalar = {
        "entropy(s STRING) RETURNS DOUBLE": _ENTROPY,
        "is_digest(s STRING) RETURNS BOOLEAN": _DIGEST,
        "is_name(s STRING) RETURNS BOOLEAN": r"s RLIKE r'\A[a-z][a-z0-9_-]{0,63}\z'",
        "fingerprint(s STRING) RETURNS STRING": "substr(sha2(s, 256), 1, 4)",
        "ref(name STRING) RETURNS STRING": "concat('{{sec:', name, '}}')",
        "mask_formats(t STRING) RETURNS STRING": f"regexp_replace(t, r'(?:{R.ANY_PROVIDER})', '{R.MARKER}')",
    }
    start = "CAST(aggregate(slice(split(t, {p}, -1), 1, i + 1), 0, (a, g) -> a + length(g)) + aggregate(slice(regexp_extract_all(t, {p}, 0), 1, i), 0, (a, f) -> a + length(f)) AS INT)"
    ref = f"r'{R.REF}'"
    refs = f"transform(regexp_extract_all(t, {ref}, 0), (m, i) -> struct(regexp_extract(m, {ref}, 1) AS name, {start.format(p=ref)} AS start))"
    formats = f"flatten(transform(array({_SAID}), k -> transform(regexp_extract_all(t, k.pattern, 0), (m, i) -> struct(k.hint AS hint, m AS value, {start.format(p='k.pattern')} AS start))))"
    tables = {
        "refs(t STRING) RETURNS TABLE (name STRING, start INT)": f"SELECT inline({refs})",
        "formats(t STRING) RETURNS TABLE (hint STRING, value STRING, start INT)": f"SELECT inline({formats})",
    }
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION veil_{head} RETURN {body}" for head, body in (scalar | tables).items()]


def register_functions(spark: SparkSession) -> None:
    """Temporary functions ``veil_entropy, veil_is_digest, veil_is_name, veil_fingerprint, veil_ref, veil_mask_formats``, and the table functions
    ``veil_refs(text)`` (name, start) and ``veil_formats(text)`` (hint, value, start; a value that two formats have comes twice).  Null gives null, or no row.
    """
    for statement in _statements():
        spark.sql(statement)
