"""Corpus cleaning: documents in, clean and tokenised documents out.

Stages, in order: toxic documents go; repeated runs of three lines go; of each group of near duplicates one document
stays; documents that hold benchmark items go; the rest is encoded by byte-level BPE and decoded again. Each stage reads
what the one before kept, as Parquet. All but the last return the columns of documents; the last adds n_tokens,
token_ids (packed little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes decoded from them).

Cases: a null text, or one without letters and digits, is not toxic, repeats nothing, leaks nothing and encodes as it
is, so its row stays; if the labels are all of one class, nothing is toxic; repeated rows are near duplicates, so one
stays; empty tables stay empty; n_chars, where the table has it, follows the text. Extra columns of any name pass
through, but for the last stage, whose three columns replace input columns of the same names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import bpe, decontaminate, jaccard, linededup, toxicity
from rankflow.llm.common import table, written

#: A character of a word.
WORD_CHARACTER = r"[\p{L}\p{M}\p{N}_]"


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """docs under names that no operator uses; the new name of each column; columns that give the old names back."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), {c.lower(): x for c, x in names.items()}, [F.col(x).alias(c) for c, x in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(toxicity.sampled(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    if model["w0"] is None:  # nothing to tell apart
        return docs
    rows, name, old = _numbered(docs)
    text = F.col(name["text"])
    return toxicity.score(rows, model, name["text"]).where((F.col("score") < 0.5) | ~F.coalesce(text.rlike(WORD_CHARACTER), F.lit(False))).select(old)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name, old = _numbered(docs)
    kept = linededup.dedup_lines(rows, name["text"], name["doc_id"]).withColumn(name["text"], F.col("kept_text"))
    if "n_chars" in name:
        kept = kept.withColumn(name["n_chars"], F.length("kept_text").cast(rows.schema[name["n_chars"]].dataType))
    return kept.select(old)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name, old = _numbered(docs)
    return jaccard.one_of_each(rows, name["text"], name["doc_id"]).select(old)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name, old = _numbered(docs)
    return decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), name["text"]).where("size(leaks) = 0").select(old)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, name, old = _numbered(docs)
    encoded = bpe.encode_decode(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, name["text"])
    added = {"n_tokens": F.col("n_tokens"), "token_ids": F.col("bpe_ids"), "decoded_sha256": F.sha2("bpe_text", 256)}
    return encoded.select(*(c for c, was in zip(old, docs.columns) if was.lower() not in added), *(c.alias(x) for x, c in added.items()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", tokenise),
]

#: Scores, retrieval and merges of tokens have no SQL form; the tests check each stage's effect on planted documents, and
#: those of the operators hold line dedup, Jaccard join, decontamination and BPE against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
