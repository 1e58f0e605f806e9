"""A corpus from ``documents``: language, near duplicates, decontamination, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder, reads it as the next stage's documents and
deletes all but the last.  All stages but the last return the columns of
``documents``; the mix adds ``copy``, the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import decontaminate, jaccard, language, mixing, pii
from veilmark.llm.shared import scratch, settled, small_batches, table


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` again, after a change of the text."""
    if not {"n_chars", "text"} <= set(docs.columns):
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.keep_identified(docs, language.fit_profiles(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _counted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs, pii.fit(docs)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language id", language_id),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing sources", source_mix),
]

#: SQL cannot express boosting or n-gram profiles; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    (_, last) = STAGES[-1]
    with scratch(spark) as keep:
        for _, stage in STAGES[:-1]:
            docs = settled(stage(spark, docs, sf_dir))
        return keep(last(spark, docs, sf_dir))
