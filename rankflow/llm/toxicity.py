"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text: its distinct lower-case words, and the first PREFIX letters of longer ones, hashed into 2**BITS
numbers. The machine's score is w0 + sum of w_i + sum over pairs of <v_i, v_j> x_i x_j, so a pair such as an insult with
a group mention has a weight of its own, which additive weights miss.

Fit (Spark ML's FMClassifier, gradients summed by Spark): at most `max_train_docs` labelled documents, those of the
smallest hashes; the `features` hashed terms that separate the labels most (by a two-sided z-value of their document
counts, counted by Spark over all of these documents) enter the machine. Both bounds also bound what reaches the driver.

Cases: null and empty texts have no terms and get the machine's constant as score; a document labelled twice counts as
toxic if one label says so, and any label above 0 does; null labels are left out; with no labels, or only one class of them, every score is the share
of toxic labels (0 without any). Equal texts get equal scores; texts of any length are scored whole.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rankflow.llm.common import Memo, held, small_batches, written

BITS, PREFIX = 20, 6
#: Documents, hashed terms and factors of a fit; steps of its optimiser.
MAX_TRAIN_DOCS, FEATURES, FACTORS, STEPS = 20_000, 1500, 4, 60

#: Distinct words that a Python worker remembers, twice this many at most.
MEMO = 60_000

_WORDS = re.compile(r"\w+")


def terms(word: str) -> tuple[int, ...]:
    whole = zlib.crc32(word.encode()) & ((1 << BITS) - 1)
    if len(word) <= PREFIX:
        return (whole,)
    return whole, zlib.crc32(b"^" + word[:PREFIX].encode()) & ((1 << BITS) - 1)


def text_terms(text: str | None) -> set[int]:
    return {t for w in set(_WORDS.findall(text.lower())) for t in terms(w)} if text else set()


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", max_train_docs: int = MAX_TRAIN_DOCS, features: int = FEATURES) -> dict:
    """Model {terms: hashed term -> place, w0, w, v} from rows with text and a 0/1 label."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.linalg import Vectors, VectorUDT

    @arrow_udf("array<int>")
    def term_list(column: pa.Array) -> pa.Array:
        return pa.array([sorted(text_terms(x.as_py())) for x in column], pa.list_(pa.int32()))

    sample = written(labelled.select((F.col(label) > 0).cast("int").alias("y"), term_list(F.col(text)).alias("terms")).where("y is not null"))
    positive, total = sample.agg(F.sum("y"), F.count("*")).first()
    positive = positive or 0
    share = positive / total if total else 0.0
    constant = {"terms": {}, "w0": None, "share": share, "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    if not 0 < positive < total:
        return constant
    counts = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).where("n >= 3")
    p = F.lit(share)
    z = (F.col("pos") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    chosen = counts.orderBy(F.abs(z).desc(), "term").limit(features).select("term").collect()
    place = {row.term: i for i, row in enumerate(sorted(chosen))}
    if not place:
        return constant

    @F.udf(VectorUDT())
    def vector(found):
        return Vectors.sparse(len(place), sorted((place[t], 1.0) for t in found if t in place))

    rows = written(sample.select(F.col("y").cast("double").alias("label"), vector("terms").alias("features")))
    fm = FMClassifier(factorSize=FACTORS, maxIter=STEPS, stepSize=0.1, regParam=1e-4, seed=7, initStd=0.05, tol=1e-9).fit(rows)
    return {"terms": place, "w0": fm.intercept, "share": share, "w": fm.linear.toArray(), "v": fm.factors.toArray()}


def sampled(df: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The labelled documents a fit reads: those of the smallest hashes of doc_id, at most max_train_docs."""
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")).where("doc_id is not null and toxic is not null")
    own = own.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    docs = df.select(F.col(doc_id).alias("doc_id"), "text")
    return docs.join(F.broadcast(own), "doc_id")  # max_train_docs rows of two numbers


def score_text(text: str | None, model: dict, memo) -> float:
    if model["w0"] is None:
        return model["share"]
    found = sorted({i for w in set(_WORDS.findall(text.lower())) for i in memo[w]}) if text else []
    v = model["v"][found]
    sums = v.sum(axis=0)
    value = model["w0"] + model["w"][found].sum() + 0.5 * float((sums * sums - (v * v).sum(axis=0)).sum())
    return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, value))))


def score(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df with score (double, 0 to 1)."""
    small_batches(df.sparkSession)
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # `features` places at most

    @arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        own = shared.value
        memo = held(("toxicity", key), lambda: Memo(lambda w: tuple(own["terms"][t] for t in terms(w) if t in own["terms"]), MEMO))
        return pa.array([score_text(x.as_py(), own, memo) for x in column], pa.float64())

    return df.withColumn("score", scores(F.col(text)))
