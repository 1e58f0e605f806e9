"""Variable files: parsing, naming and the classifier of what is worth importing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from .naming import choose_names

LINE = r"\A(?:export\s+)?([^\s=]+)\s*=\s*((?s).*)\z"


def _value(raw: Column) -> Column:
    """Between quotes, what follows them ignored; else up to a blank and ``#``.  Null where a quote does not close."""
    quote = F.substring(raw, 1, 1)
    closed = F.when(quote == '"', F.regexp_extract(raw, r'\A"([^"]*)"', 0)).otherwise(F.regexp_extract(raw, r"\A'([^']*)'", 0))
    inner = F.when(closed != "", F.substring(closed, F.lit(2), F.length(closed) - 2))
    plain = F.regexp_replace(F.regexp_replace(raw, r"(?s)\s#.*\z", ""), r"\s+\z", "")
    return F.when(quote.isin('"', "'"), inner).otherwise(plain)


def parse_lines(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row for each line that assigns or fails to: path, line, key, value (null: skipped), flags."""
    body = F.regexp_replace(F.col(text_col), "\\A\ufeff", "")
    lines = files.select(F.col(path_col).alias("path"), F.posexplode(F.split(body, "\r?\n")).alias("at", "raw"))
    t = F.regexp_replace("raw", r"\A\s+|\s+\z", "")
    rows = lines.select("path", (F.col("at") + 1).alias("line"), t.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    key = F.regexp_extract("t", LINE, 1)
    raw = F.regexp_extract("t", LINE, 2)
    value = F.when(F.col("t").rlike(LINE), _value(raw))
    value = F.when(P.trimmed(value) != "", value)
    flags = F.array_compact(
        F.array(
            F.when(raw.startswith('"') & value.rlike(r'\\[nrt$"\\]'), "escapes"),
            F.when(value.rlike(r"\$\{?[A-Za-z_]"), "unexpanded"),
        )
    )
    return rows.select("path", "line", F.when(value.isNotNull(), key).alias("key"), value.alias("value"), flags.alias("flags"))


def parse(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Assignments of each file: the last value of a key, at the place of its first."""
    rows = parse_lines(files, path_col, text_col).where("key is not null")
    last = F.max(F.struct("line", "value", "flags")).alias("l")
    return rows.groupBy("path", "key").agg(last, F.min("line").alias("place")).select("path", "key", "l.value", "l.line", "l.flags", "place")


def summary(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Assignments, skipped lines and duplicates of each file."""
    rows = parse_lines(files, path_col, text_col)
    return rows.groupBy("path").agg(F.count_distinct("key").alias("assignments"), F.count_if(F.col("key").isNull()).alias("skipped"), (F.count("key") - F.count_distinct("key")).alias("duplicates"))


def import_rows(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Assignments with a name or a reason, whether they look like secrets, and where a list shows them (``shown``, from 1): likely ones first, then by place."""
    rows = choose_names(parse(files, path_col, text_col), "key", "place").withColumn("likely", P.is_likely_secret(F.col("key"), F.col("value")))
    return rows.withColumn("shown", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("likely"), "place")))
