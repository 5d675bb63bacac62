"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. The likelihood of a word is the sum over
all its segmentations into pieces of the product of their probabilities (forward algorithm); a text's is the product
over its words. Probabilities come from expectation-maximisation over the words of labelled texts: every round is a
Spark job that sums expected piece counts (forward-backward) by language and piece, and only this table, bounded by
languages x vocabulary, reaches the driver.

The fit uses at most `max_train_docs` labelled documents (or one for each language, if there are more languages):
distinct pairs of text and language with a letter, those of the smallest hashes, as many of each language as of any
other while it has some.

Cases: a null text or one without a letter is `und` with score 0; so is every text if nothing is labelled. Ties go to
the first language in alphabetical order. Letters of no piece cost the same in every language. Words are runs of
letters, in lower case, of any length; those of SLICE letters or more are summed one by one, in logarithms.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rankflow.llm.common import held, written
from rankflow.llm.radix import top_k
from rankflow.llm.tokencount import BLANK, read_scores

#: Documents that a fit reads at most, and rounds of expectation-maximisation.
MAX_TRAIN_DOCS, ROUNDS = 3000, 3
#: Added to each expected count; probability of a character outside the vocabulary; longest word summed in a batch.
SMOOTH, UNKNOWN, SLICE = 0.05, 1e-9, 24
#: Words whose scores a Python worker remembers.
MEMO = 200_000

#: \w has fractions, roman numerals and the like besides letters, decimal digits and the underscore.
_WORDS = re.compile(r"[^\W\d_]+")
#: A letter, for Spark.
LETTER = r"\p{L}"


@lru_cache(2)
def _automaton(path: str):
    """Matches (length, piece number) of the vocabulary's pieces in lower-case words; the number of pieces."""
    import ahocorasick

    pieces = sorted(p for p in read_scores(path) if BLANK not in p[1:] and p == p.lower())
    automaton = ahocorasick.Automaton()
    for number, piece in enumerate(pieces):
        automaton.add_word(piece, (len(piece), number))
    automaton.make_automaton()
    return automaton, len(pieces)


@lru_cache(2)
def _lengths(path: str) -> np.ndarray:
    """Characters of each piece."""
    automaton, size = _automaton(path)
    out = np.zeros(size, np.int64)
    for length, number in automaton.values():
        out[number] = length
    return out


def words_of(text: str | None) -> list[str]:
    words = _WORDS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]


def _matches(piece_matches, word: str) -> list[list[tuple[int, int]]]:
    """For each end, (start, piece number); a character without a match of its own has number -1."""
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
    for end, (length, number) in piece_matches(word):
        ends[end + 1].append((end + 1 - length, number))
    for end in range(1, len(word) + 1):
        if not any(start == end - 1 for start, _ in ends[end]):
            ends[end].append((end - 1, -1))
    return ends


def _long_log_likelihood(text: str, probabilities: np.ndarray, automaton) -> np.ndarray:
    """The forward algorithm in logarithms, which no length of a word makes vanish."""
    ends = _matches(automaton.iter, text)
    longest = max(end - start for end, own in enumerate(ends) for start, _ in own)
    forward = {0: np.zeros(probabilities.shape[1])}
    for end in range(1, len(text) + 1):
        own = [forward[s] + (np.log(probabilities[k]) if k >= 0 else math.log(UNKNOWN)) for s, k in ends[end]]
        forward[end] = np.logaddexp.reduce(own)
        forward.pop(end - longest, None)
    return forward[len(text)]


class _Trellis:
    """All pieces in some words of fewer than SLICE letters: forward and backward sums over all words at once, one step
    for each place. Weights are a row for each piece found and a column for each table of probabilities."""

    def __init__(self, words: list[str], path: str):
        automaton, _ = _automaton(path)
        hits, counts = [], []
        for word in words:
            before = len(hits)
            hits.extend(automaton.iter(BLANK + word))
            counts.append(len(hits) - before)
        self.sizes = np.array([len(word) + 1 for word in words], np.int64)
        self.ends, self.numbers = (np.array(x, np.int64) for x in ([end + 1 for end, _ in hits], [match[1] for _, match in hits]))
        self.starts, self.owner = self.ends - _lengths(path)[self.numbers], np.repeat(np.arange(len(words)), counts)
        self.known = np.zeros((SLICE + 1, len(words)), bool)  # characters that are a piece of their own, by their ends
        single = self.ends - self.starts == 1
        self.known[self.ends[single], self.owner[single]] = True

    def _steps(self, places: np.ndarray):
        """For each place, the pieces there by owner, and where each owner's begin."""
        order = np.argsort(places, kind="stable")
        edges = np.searchsorted(places[order], np.arange(SLICE + 2))
        for place in range(SLICE + 1):
            own = order[edges[place] : edges[place + 1]]
            yield place, own, np.flatnonzero(np.diff(self.owner[own], prepend=-1))

    def forward(self, weights: np.ndarray) -> np.ndarray:
        """By place, word and column: the sum over all segmentations of what stands before the place."""
        out = np.zeros((SLICE + 1, len(self.sizes), weights.shape[1]))
        out[0] = 1.0
        for place, own, first in self._steps(self.ends):
            if len(own):
                owner = self.owner[own]
                out[place, owner[first]] = np.add.reduceat(out[self.starts[own], owner] * weights[own], first)
            if place:
                out[place] += np.where(self.known[place], 0.0, UNKNOWN)[:, None] * out[place - 1]
        return out

    def backward(self, weights: np.ndarray) -> np.ndarray:
        """The same of what stands after the place."""
        out = np.zeros((SLICE + 1, len(self.sizes), weights.shape[1]))
        out[self.sizes, np.arange(len(self.sizes))] = 1.0
        for place, own, first in reversed(list(self._steps(self.starts))):
            if len(own):
                owner = self.owner[own]
                out[place, owner[first]] += np.add.reduceat(out[self.ends[own], owner] * weights[own], first)
            if place < SLICE:
                out[place] += np.where(self.known[place + 1], 0.0, UNKNOWN)[:, None] * out[place + 1]
        return out

    def last(self, forward: np.ndarray) -> np.ndarray:
        return forward[self.sizes, np.arange(len(self.sizes))]


def _short(words: list[str]) -> np.ndarray:
    return np.array([len(word) < SLICE for word in words], bool)


def log_likelihoods(words: list[str], probabilities: np.ndarray, path: str) -> np.ndarray:
    """Of each word (rows) in each language (columns), over all segmentations. probabilities: a row for each piece, and
    the last one for unknown characters."""
    short, out = _short(words), np.zeros((len(words), probabilities.shape[1]))
    trellis = _Trellis([w for w, x in zip(words, short) if x], path)
    out[short] = np.log(trellis.last(trellis.forward(probabilities[trellis.numbers])))
    for i in np.flatnonzero(~short):
        out[i] = _long_log_likelihood(BLANK + words[i], probabilities, _automaton(path)[0])
    return out


def add_expected(sums: np.ndarray, words: list[str], languages: np.ndarray, counts: np.ndarray, probabilities: np.ndarray, path: str) -> None:
    """Add to sums (language x piece) the expected uses of pieces in words that came `counts` times; probabilities:
    language x piece."""
    short = _short(words)
    trellis, own, n = _Trellis([w for w, x in zip(words, short) if x], path), languages[short], counts[short]
    weights = probabilities[own[trellis.owner], trellis.numbers][:, None]
    forward, backward = trellis.forward(weights), trellis.backward(weights)
    used = forward[trellis.starts, trellis.owner] * weights * backward[trellis.ends, trellis.owner] / trellis.last(forward)[trellis.owner]
    place = own[trellis.owner] * sums.shape[1] + trellis.numbers
    sums += np.bincount(place, used[:, 0] * n[trellis.owner], sums.size).reshape(sums.shape)
    for i in np.flatnonzero(~short):
        table = probabilities[languages[i]]
        for k, x in _expected(words[i], table.__getitem__, path).items():
            sums[languages[i], k] += counts[i] * x


def _expected(word: str, p, path: str) -> dict[int, float]:
    """Expected uses of each piece in a word under probabilities p (a function of the piece number)."""
    automaton, _ = _automaton(path)
    out: dict[int, float] = defaultdict(float)
    text = BLANK + word
    ends, n = _matches(automaton.iter, text), len(text)
    if n > SLICE:
        return _long_expected(ends, p)
    alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for end in range(1, n + 1):
        alpha[end] = sum(alpha[s] * (UNKNOWN if k < 0 else p(k)) for s, k in ends[end])
    for end in range(n, 0, -1):
        for s, k in ends[end]:
            beta[s] += beta[end] * (UNKNOWN if k < 0 else p(k))
    for end in range(1, n + 1):
        for s, k in ends[end]:
            if k >= 0:
                out[k] += alpha[s] * p(k) * beta[end] / alpha[n]
    return out


def _log_sum(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(x - most) for x in values))


def _long_expected(ends: list[list[tuple[int, int]]], p) -> dict[int, float]:
    """The same in logarithms."""
    n, out = len(ends) - 1, defaultdict(float)
    cost = lambda k: math.log(UNKNOWN if k < 0 else p(k))
    alpha, onward = [0.0] * (n + 1), [[] for _ in range(n + 1)]
    for end in range(1, n + 1):
        alpha[end] = _log_sum([alpha[s] + cost(k) for s, k in ends[end]])
        for s, k in ends[end]:
            onward[s].append((end, k))
    beta = [0.0] * (n + 1)
    for start in range(n - 1, -1, -1):
        beta[start] = _log_sum([beta[end] + cost(k) for end, k in onward[start]])
        for end, k in onward[start]:
            if k >= 0:
                out[k] += math.exp(alpha[start] + cost(k) + beta[end] - alpha[n])
    return out


def fit(labelled: DataFrame, path: str, text: str = "text", lang: str = "lang", max_train_docs: int = MAX_TRAIN_DOCS):
    """Model {languages, probabilities by piece, floor} from rows with text and lang (nulls are left out)."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(F.col("text").rlike(LETTER)).withColumn("h", F.xxhash64("text", "lang"))
    # The least hashes of each language, by histograms of their bits: no task holds the rows of a language.
    order = 2**63 - 1 - F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 1)
    hashes = written(rows.select("lang", "h", order.alias("order"), F.col("h").cast("string").alias("digits")).distinct())
    placed = written(top_k(hashes, ["lang"], "order", "digits", max_train_docs).select("lang", "h", F.col("rank").alias("place")))
    picked = placed.orderBy("place", "h").limit(max_train_docs).union(placed.where("place = 1"))
    edges = picked.groupBy("lang").agg(F.max("h").alias("edge"))
    if not edges.head(1):
        return {"languages": [], "probabilities": {}, "floor": []}

    @arrow_udf("array<string>")
    def split(column: pa.Array) -> pa.Array:
        return pa.array([words_of(x.as_py()) for x in column], pa.list_(pa.string()))

    # A row for each language at most, as in the model.
    sample = rows.join(F.broadcast(edges), "lang").where("h <= edge").dropDuplicates(["text", "lang"])
    words = sample.select("lang", F.explode(split("text")).alias("word")).groupBy("lang", "word").count()
    words = written(words)
    languages = sorted(row.lang for row in edges.select("lang").collect())
    place, (_, size) = {x: i for i, x in enumerate(languages)}, _automaton(path)
    probabilities = np.full((len(languages), size), 1.0 / size)
    for _ in range(ROUNDS):
        shared = labelled.sparkSession.sparkContext.broadcast(probabilities)  # languages x vocabulary

        def expect(batches, shared=shared):
            sums = np.zeros((len(place), size))
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    lang, word, n = (batch.column(i).slice(start, 4096) for i in range(3))
                    add_expected(sums, word.to_pylist(), np.array([place[x] for x in lang.to_pylist()]), n.to_numpy(), shared.value, path)
            language, piece = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[language, piece])], names=["language", "piece", "n"])

        counts = words.mapInArrow(expect, "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n"))
        gathered = counts.toPandas()  # languages x vocabulary rows at most
        found = np.zeros_like(probabilities)
        found[gathered["language"], gathered["piece"]] = gathered["n"]
        probabilities = (found + SMOOTH) / (found.sum(axis=1, keepdims=True) + SMOOTH * size)
    floor = (SMOOTH / (found.sum(axis=1) + SMOOTH * size)).tolist()
    return {"languages": languages, "floor": floor, "probabilities": {int(k): probabilities[:, k].tolist() for k in np.flatnonzero(found.any(axis=0))}}


class Scorer:
    """Log-likelihoods of the words that a Python worker has met, MEMO at most."""

    def __init__(self, model: dict, path: str):
        self.languages, self.path = model["languages"], path
        _, size = _automaton(path)
        self.probabilities = np.tile(np.array(model["floor"]), (size + 1, 1))
        for number, own in model["probabilities"].items():
            self.probabilities[number] = own
        self.probabilities[size] = UNKNOWN
        self.place: dict[str, int] = {}
        self.rows = np.zeros((MEMO, len(self.languages)))

    def learn(self, words: list[str]):
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if len(self.place) + len(new) > len(self.rows):
            new = list(dict.fromkeys(words))
            self.place.clear()
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), len(self.languages)))
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            at = len(self.place)
            self.rows[at : at + len(part)] = log_likelihoods(part, self.probabilities, self.path)
            self.place.update(zip(part, range(at, at + len(part))))

    def predict(self, words: list[str]) -> tuple[str, float]:
        """Of a text's words, learnt before."""
        if not words or not self.languages:
            return "und", 0.0
        total = self.rows[[self.place[w] for w in words]].sum(axis=0)
        best = int(np.argmax(total))
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())

    def predict_all(self, texts: list[str | None], at_once: int = 64) -> list[tuple[str, float]]:
        out = []
        for start in range(0, len(texts), at_once):
            split = [words_of(x) for x in texts[start : start + at_once]]
            if self.languages:
                self.learn([w for words in split for w in words])
            out += map(self.predict, split)
        return out


def predict(df: DataFrame, model: dict, path: str, text: str = "text") -> DataFrame:
    """df with lang_pred (a learned language or `und`) and score (posterior of lang_pred, languages equally likely)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x vocabulary at most
    key = uuid.uuid4().hex

    @arrow_udf("struct<lang:string,score:double>")
    def predicted(column: pa.Array) -> pa.Array:
        out = held(("langid", key), lambda: Scorer(shared.value, path)).predict_all(column.to_pylist())
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["lang", "score"])

    out = df.withColumn("__predicted", predicted(F.col(text)))
    out = out.withColumn("lang_pred", F.col("__predicted.lang")).withColumn("score", F.col("__predicted.score"))
    return out.drop("__predicted")
