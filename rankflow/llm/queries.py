"""The opN_ queries: thin wrappers that apply each operator to its whole table and derive the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import bpe, decontaminate, divergence, filteraudit, jaccard, langid, linededup, media, packing, pii, substrings, tokencount, toxicity
from rankflow.llm.common import table

#: Key of the pseudonyms in op1_pii; production runs pass their own to pii.pseudonymise.
PSEUDONYM_KEY = b"rankflow-demo-key"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def fold(modulus: int):
    """crc32 of doc_id as text, modulo modulus."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = pii.pseudonymise(documents(spark, sf_dir), PSEUDONYM_KEY)
    return hidden.select("doc_id", F.col("private_text").alias("text"), F.size("private_spans").cast("long").alias("n_private"), F.transform("private_spans", lambda s: s.format).alias("formats"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir, "lang"), public_tokenizers.path("piece_bpe_32k.model")
    model = langid.fit(docs.where(fold(3) != 1), path)
    held_out = F.coalesce(fold(3) == 1, F.lit(True)).alias("held_out")
    return langid.predict(docs.select("doc_id", "text"), model, path).select("doc_id", held_out, "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    leak = leaks.select("doc_id", F.explode("leaks").alias("leak"))
    return leak.select("doc_id", "leak.item_id", *(F.round(f"leak.{c}", 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = media.with_media(documents(spark, sf_dir).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    return own.select(
        "doc_id",
        "n_bytes",
        F.octet_length("media_read.payload").cast("long").alias("payload_bytes"),
        F.sha2("media_read.payload", 256).alias("payload_sha256"),
        F.col("media_read.tail_crc32").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("media_read.feature").alias("feature"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(toxicity.sampled(docs, table(spark, sf_dir, "labels").where(fold(5) != 0)))
    held_out = F.coalesce(fold(5) == 0, F.lit(True)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "n_lines", "n_removed")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.with_token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, memo=1_000_000).select(
        "doc_id",
        "n_tokens",
        F.sha2("bpe_ids", 256).alias("ids_sha256"),
        F.sha2("bpe_text", 256).alias("decoded_sha256"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "lang")


QUERIES = {
    "op1_pii": op1_pii,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_langid": op3_langid,
    "op4_decontaminate": op4_decontaminate,
    "op5_media": op5_media,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_bpe": op10_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substrings.ORACLE_SQL,
    "op7_jaccard_join": jaccard.ORACLE_SQL,
    "op8_line_dedup": linededup.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op13_filter_audit": filteraudit.ORACLE_SQL,
}
