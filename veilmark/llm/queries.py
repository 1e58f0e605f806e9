"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import zlib
from functools import wraps

from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, language, mixing, mpeg, negatives, oracles, pages, periodic, pii, quality, secrets, substrings
from .shared import settled, small_batches, table


def tuned(query):
    """``query`` with Arrow batches that fit small executors."""

    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(docs.where(~language.held_out()))
    return language.identify(docs, profiles).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark, sf_dir):
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("n_entropy")


def op4_quality(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = settled(quality.feature_rows(table(spark, sf_dir, "documents")))
    model = quality.fit_features(rows.where(~quality.held_out("id")), labels.where(~quality.held_out()))
    scored = quality.feature_scores(rows, model)
    return scored.select(F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), "score", "predicted")


def op5_source_mix(spark, sf_dir):
    mixed = mixing.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids", "hit_spans")


def op7_main_text(spark, sf_dir):
    return pages.main_text(table(spark, sf_dir, "pages"))


def op8_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit(docs))


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"), size=4, percent=85)


def op10_mpeg_audio(spark, sf_dir):
    return mpeg.media_features(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.mine(table(spark, sf_dir, "embeddings"), label=negatives.mined_label())


def op12_byte_bpe(spark, sf_dir):
    import public_tokenizers

    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def repeating(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a document, with a period planted in those of every tenth id."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark, sf_dir):
    found = periodic.find_runs(table(spark, sf_dir, "documents"), prepare=repeating)
    best, listed = periodic.strongest("runs"), F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("*", F.explode_outer(F.array(best)).alias("best"))
    digests = (F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, *digests)


QUERIES = {
    "op1_language_id": tuned(op1_language_id),
    "op2_substring_dedup": tuned(op2_substring_dedup),
    "op3_secret_scan": tuned(op3_secret_scan),
    "op4_quality": tuned(op4_quality),
    "op5_source_mix": tuned(op5_source_mix),
    "op6_decontaminate": tuned(op6_decontaminate),
    "op7_main_text": tuned(op7_main_text),
    "op8_personal_data": tuned(op8_personal_data),
    "op9_ngram_jaccard": tuned(op9_ngram_jaccard),
    "op10_mpeg_audio": tuned(op10_mpeg_audio),
    "op11_hard_negatives": tuned(op11_hard_negatives),
    "op12_byte_bpe": tuned(op12_byte_bpe),
    "op13_periodic_runs": tuned(op13_periodic_runs),
}
ORACLE_SQL = {
    "op5_source_mix": oracles.SOURCE_MIX,
    "op6_decontaminate": oracles.DECONTAMINATE,
    "op9_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
}
