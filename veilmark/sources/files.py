"""Files in and out: variable files, listings, the leak sweep, receipts; masked snapshots are in ``publish``.

All reads go through Spark's readers, so any store that Spark can open will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fresh
from ..operators.index import LEAST, rows_with, with_places

MAX_BYTES, NUL_BYTES, MAX_ROWS = 1 << 20, 8192, 500


def text_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, text`` of regular files of up to ``max_bytes`` without a NUL in their first 8 KiB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= max_bytes)
    clean = ~F.decode(F.substring("content", 1, NUL_BYTES), "ISO-8859-1").contains("\x00")
    return small.where(clean).select("path", F.decode("content", "UTF-8").alias("text"))


def listing(spark: SparkSession, path: str, fragment: str = "", limit: int = MAX_ROWS) -> DataFrame:
    """Names in ``path`` that start with ``fragment``: the folder above (with no fragment only), then folders, then files by name.  The limit is part of the listing.

    One level is listed by the store itself; what lies below is not read.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [("..", True, 0)] if fragment == "" and where.getParent() is not None else []
    steps = store.listStatusIterator(where)
    while steps.hasNext():
        one = steps.next()
        if (name := one.getPath().getName()).startswith(fragment):
            rows.append((name, one.isDirectory(), one.getLen()))
    rows.sort(key=lambda r: (r[0] != "..", not r[1], r[0]))
    return spark.createDataFrame(rows[:limit], "name string, folder boolean, bytes long")


def leak_sweep(texts: DataFrame, canaries: DataFrame, text_col: str = "text") -> DataFrame:
    """``canary, leaks, examined, verdict``: rows that hold each canary, of how many, and clean, hit or nothing examined.

    Any number of canaries is met by a filter of their hashes in every task and
    counted there (``index.rows_with``).  Shorter ones than ``LEAST`` are not looked
    for: their verdict is ``not examined``, without a count.
    """
    wanted = canaries.where("canary is not null").select("canary").distinct()
    strings = wanted.where(F.length("canary") >= LEAST).select(F.col("canary").alias("string"))
    counts = rows_with(texts, text_col, strings).select(F.col("string").alias("canary"), F.col("n").alias("leaks"))
    examined = texts.agg(F.count("*").alias("examined"))
    rows = wanted.join(counts, "canary", "left").crossJoin(F.broadcast(examined))
    short = F.length("canary") < LEAST
    verdict = F.when(short, "not examined").when(F.col("examined") == 0, "nothing examined").when(F.col("leaks") > 0, "hit").otherwise("clean")
    return rows.select("canary", F.when(~short, F.coalesce("leaks", F.lit(0)).cast("long")).alias("leaks"), "examined", verdict.alias("verdict"))


def leak_places(texts: DataFrame, canaries: DataFrame, text_col: str, ids: list[str]) -> DataFrame:
    """``ids, canaries, starts`` of the rows that leak: the distinct canaries each holds, and the first place of each in code points."""
    strings = canaries.where(F.length("canary") >= LEAST).select(F.col("canary").alias("string")).distinct()
    text, places = fresh(ids, "text", "places")
    rows = with_places(texts.select(*ids, F.col(text_col).alias(text)), text, strings, places).where(F.col(places).isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(places, lambda x: x["string"])))
    first = F.transform(names, lambda n: F.array_min(F.transform(F.filter(places, lambda x: x["string"] == n), lambda x: x["start"])))
    return rows.select(*ids, names.alias("canaries"), first.alias("starts"))


def append_receipts(captured: DataFrame, path: str) -> None:
    """Names, fingerprints, lengths, sources: never a value."""
    from ..functions import predicates as P

    rows = captured.select("session_id", "name", P.fingerprint(F.col("value")).alias("fingerprint"), P.label(F.col("value")).alias("label"), F.length("value").alias("length"), "source")
    rows.write.mode("append").parquet(path)
