"""Messages and tool results on their way: what is masked where, which guesses apply, and what the switches change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules as R
from ..functions.columns import fresh
from .mask import mask_shapes, scrub
from .nested import payloads, redact_columns, scrub_columns
from .policy import PATH_TOOLS
from .refs import find_refs

#: Fields whose strings carry structure, not text.
STRUCTURAL = R.STRUCTURAL_KEYS


@dataclass(frozen=True)
class Options:
    """``enabled``: capture and expansion; results are masked even without.  ``mask_file_reads``: shapes in the output
    of file tools.  ``guess_policy``: ``drop`` leaves entropy findings alone, ``apply`` takes them."""

    enabled: bool = True
    mask_file_reads: bool = True
    guess_policy: str = "drop"

    @property
    def tiers(self) -> str:
        return "all" if self.guess_policy == "apply" else "evidenced"


def mask_results(results: DataFrame, options: Options = Options(), tool_col: str = "tool", text_col: str = "text", vault: DataFrame | None = None, key: str = "session_id") -> DataFrame:
    """Tool results with known values of a ``vault`` masked always, and shapes: of file tools only if ``mask_file_reads``."""
    plain = F.lit(False) if options.mask_file_reads else F.coalesce(F.col(tool_col).isin(*PATH_TOOLS), F.lit(False))
    if vault is not None:
        return scrub(results, vault, key, text_col, ~plain)
    done = mask_shapes(results, text_col)
    return done.withColumn("masked", F.when(plain, F.col(text_col)).otherwise(F.col("masked"))).withColumn("hits", F.when(plain, 0).otherwise(F.col("hits")))


def mask_outgoing(messages: DataFrame, columns: list[str], vault: DataFrame, options: Options = Options(), key: str = "session_id", broken: Column | None = None) -> DataFrame:
    """Context or payloads on their way out: known values and shapes masked in every string of ``columns``; unchanged where switched off.

    ``skipped_payloads`` counts the binary strings that were passed over.  Rows
    for which ``broken`` holds close: all their strings but structural ones are replaced.
    """
    count = sum((payloads(F.col(c), messages.schema[c].dataType) for c in columns), F.lit(0))
    if not options.enabled:
        return messages.withColumn("skipped_payloads", F.lit(0))
    rows = messages.withColumn("skipped_payloads", count)
    masked = scrub_columns(rows, columns, frozenset(STRUCTURAL), vault, key)
    if broken is None:
        return masked
    whole = F.coalesce(broken, F.lit(True))
    return scrub_columns(rows.where(~whole), columns, frozenset(STRUCTURAL), vault, key).unionByName(redact_columns(rows.where(whole), columns))


def mask_or_redact(df: DataFrame, columns: list[str], broken: Column) -> DataFrame:
    """Nested columns masked; where ``broken`` holds, every string of them replaced: a row that cannot be trusted closes."""
    (whole,) = fresh(df.columns, "whole")
    rows = df.withColumn(whole, F.coalesce(broken, F.lit(True)))
    return scrub_columns(rows, columns).where(~F.col(whole)).unionByName(redact_columns(rows, columns).where(F.col(whole))).drop(whole)


def without_declined(findings: DataFrame, declined: DataFrame) -> DataFrame:
    """Findings whose value was not declined; ``declined`` has full SHA-256 digests."""
    (d,) = fresh(findings.columns, "digest")
    return findings.withColumn(d, F.sha2("value", 256)).join(declined.select(F.col("digest").alias(d)).distinct(), d, "left_anti").drop(d)


def remembered(declines: DataFrame, limit: int = 200) -> DataFrame:
    """The latest declined digests of each session; the limit is the memory's size."""
    latest = declines.groupBy("session_id", "digest").agg(F.max("seq").alias("seq"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq"), "digest"))
    return latest.withColumn("n", n).where(F.col("n") <= limit).drop("n")


def guess_report(findings: DataFrame) -> DataFrame:
    """Entropy findings as lines of a report: place, length, label and evidence; no value."""
    rows = findings.where("confidence = 'entropy'")
    return rows.select(*[c for c in findings.columns if c not in ("value", "hint")], F.format_string("len %d  %s", F.length("value"), P.label(F.col("value"))).alias("line"))


def refs_in(column: Column) -> Column:
    """Names of the references in a string, each once."""
    return F.array_distinct(F.transform(find_refs(column), lambda x: x["name"]))


def resolve_path(path: Column, home: Column, cwd: Column) -> Column:
    """An absolute path without ``@``, ``~``, ``.`` and ``..``; of ``~user`` nothing is known, so it stays relative."""
    p = F.regexp_replace(path, r"\A@", "")
    full = F.when(p == "~", home).when(p.startswith("~/"), F.concat(home, F.substring(p, F.lit(2), F.length(p)))).when(p.startswith("/"), p).otherwise(F.concat(cwd, F.lit("/"), p))
    parts = F.filter(F.split(full, "/"), lambda x: (x != "") & (x != "."))
    up = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))


def split_path(text: Column) -> Column:
    """Folder and fragment of a typed path; null without a slash: nothing is to be listed then."""
    return F.when(text.contains("/"), F.struct(F.regexp_extract(text, r"\A(.*/)", 1).alias("folder"), F.regexp_extract(text, r"([^/]*)\z", 1).alias("fragment")))


def marker_count(text: Column) -> Column:
    """Markers without a value behind them."""
    return F.size(F.filter(find_refs(text), lambda x: x["name"] == R.RESERVED))
