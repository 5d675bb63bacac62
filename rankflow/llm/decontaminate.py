"""Benchmark decontamination: BM25 retrieval of test items for every training passage, then verification.

Index: an inverted index of the items in blocks of BLOCK, with BM25 impacts divided by the item's own score (what the
item scores against itself), so one threshold serves all items; block maxima of every term. Query: each passage of a
document, PASSAGE words with half of them shared by the next one (longer if an item is longer than half), so an item
lies whole in some passage. Retrieval: every item of at least THRESHOLD of its own score, by block-max WAND: cursors
over the postings, a pivot where the sum of maxima reaches the threshold, a test of the block maxima there, and jumps
past blocks that can't reach it. Terms of few items are looked up first: passages where these terms and the maximum
that the frequent terms can add stay under the threshold have no result and need no cursors.

Verification: a result counts if the item's question and its answer both have OVERLAP of their five-word shingles in
the passage. The last sentence of an item is its answer, the rest its question; an item of one sentence is halved. A
part of under SPAN words is verified together with its neighbours in the item, up to SPAN words (a short answer with the
words before it, a short question with those after it), or, where that span falls short, alone. SPAN words have enough
shingles for the loss of the one at the edge, so one altered word there decides nothing. An answer of one word is
therefore not told from another one.

The index is broadcast if the items' texts have at most MAX_INDEX_BYTES; more items are split into so many shards by
hash, and each is queried against all passages, one after the other, with its results written. Document frequencies,
mean and longest lengths are those of all items, counted by Spark, so the number of shards changes no result.

Cases: null or empty texts and items match nothing; items of under SPAN words are verified whole, those of under five
words as one shingle of their own length; an item of one word is all question; repeated items each get their rows;
repeated documents too; ties in score keep the first passage. Words are lower-cased (A-Z) runs without white space, less
the punctuation around them (a word of nothing else stays); documents of any length are read whole.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rankflow.llm.common import Memo, same_name, small_batches, written

K1, B = 1.2, 0.75
BLOCK, PASSAGE, SHINGLE = 8, 256, 5
THRESHOLD, OVERLAP = 0.6, 0.8
#: Words of which one at the edge may differ: of SPAN - SHINGLE + 1 shingles OVERLAP are left without the last one.
SPAN = SHINGLE - 1 + round(1 / (1 - OVERLAP))
MAX_INDEX_BYTES = 32 << 20
#: Terms of more than this share of the items count as frequent.
FREQUENT = 0.05

_SENTENCES = re.compile(r"(?<=[.!?])\s+")
#: ASCII punctuation and symbols, and the punctuation of the other scripts.
_EDGES = string.punctuation + "".join(c for c in map(chr, range(128, 1 << 16)) if unicodedata.category(c)[0] == "P")


def _without_marks(word: bytes) -> bytes:
    w = word.decode()
    return word if w[0].isalnum() and w[-1].isalnum() else w.strip(_EDGES).encode() or word


_bare = Memo(_without_marks, 20_000)


def _raw_words(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII letters and the six ASCII blanks only, which is what is wanted."""
    return text.encode().lower().split()


def _byte_words(raw) -> list[bytes]:
    return [w if w.isalnum() else _bare[w] for w in raw]


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in _byte_words(_raw_words(text))] if text else []


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if not words:
        return set()
    k = min(SHINGLE, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def halves(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    sentences = [x for x in map(words_of, _SENTENCES.split(text)) if x]
    if len(sentences) > 1:
        return [w for x in sentences[:-1] for w in x], sentences[-1]
    words = words_of(text)
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer, a short one with its neighbours."""
    question, answer = halves(text)
    words = question + answer
    return words[: max(len(question), SPAN)], words[-max(len(answer), SPAN) :] if answer else []


class Index:
    """BM25 inverted index of items [(id, text)]; df, n, mean_words and longest (words of an item) are the whole
    benchmark's, so shards agree."""

    def __init__(self, items: list[tuple[object, str]], df: dict[str, int], n: int, mean_words: float, longest: int, threshold: float):
        self.ids, self.threshold = [i for i, _ in items], threshold
        self.passage = max(PASSAGE, 2 * longest)
        self.parts = [list(zip(map(shingles, question_answer(text)), map(shingles, halves(text)))) for _, text in items]
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for number, (_, text) in enumerate(items):
            words = words_of(text)
            norm = K1 * (1 - B + B * len(words) / mean_words) if mean_words else K1
            impact = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(words).items()}
            own = sum(impact.values())
            for w, x in impact.items():
                postings[w].append((number, x / own))
        self.items = {w: [i for i, _ in x] for w, x in postings.items()}
        self.impacts = {w: [x for _, x in y] for w, y in postings.items()}
        self.most = {w: max(x) for w, x in self.impacts.items()}
        self.block_most: dict[str, dict[int, float]] = {}
        frequent_sum = [0.0] * len(items)
        self.rare: dict[bytes, list[tuple[int, float]]] = {}
        for w, own in postings.items():
            blocks: dict[int, float] = {}
            for i, x in own:
                blocks[i // BLOCK] = max(blocks.get(i // BLOCK, 0.0), x)
            self.block_most[w] = blocks
            if len(own) > max(2, FREQUENT * len(items)):
                for i, x in own:
                    frequent_sum[i] += x
            else:
                self.rare[w.encode()] = own
        #: By block, the most that frequent terms can add to one of its items.
        self.frequent_most = [max(frequent_sum[i : i + BLOCK]) for i in range(0, len(items), BLOCK)]

    def may_hold(self, words: set[bytes]) -> bool:
        """Whether rare terms, with all that frequent ones could add, let an item reach the threshold."""
        bound, sums = self.threshold - 1e-9, defaultdict(float)
        for w in self.rare.keys() & words:
            for i, x in self.rare[w]:
                sums[i] += x
        if any(x + self.frequent_most[i // BLOCK] >= bound for i, x in sums.items()):
            return True
        return max(self.frequent_most, default=0.0) >= bound

    def wand(self, words: set[str]) -> list[tuple[int, float]]:
        """Every (item number, score) of at least the threshold."""
        bound, out = self.threshold - 1e-9, []
        cursors = [[self.items[w][0], w, 0] for w in sorted(self.items.keys() & words)]
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, (_, w, _) in enumerate(cursors):
                total += self.most[w]
                if total >= bound:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_most[w].get(block, 0.0) for _, w, _ in cursors[: pivot + 1]) >= bound:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    at = bisect_left(self.items[c[1]], item, c[2])
                    if at < len(self.items[c[1]]) and self.items[c[1]][at] == item:
                        score += self.impacts[c[1]][at]
                if score >= bound:
                    out.append((item, score))
                onward = item + 1
            else:  # no item of this block can reach it with these terms, until another term comes in
                onward = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    onward = min(onward, cursors[pivot + 1][0])
                onward = max(onward, item + 1)
            ahead = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < onward:
                    c[2] = bisect_left(self.items[c[1]], onward, c[2])
                    if c[2] == len(self.items[c[1]]):
                        continue
                    c[0] = self.items[c[1]][c[2]]
                ahead.append(c)
            cursors = ahead
        return out

    def matches(self, text: str | None) -> list[tuple[object, float, float, float]]:
        """(item id, score, question overlap, answer overlap) of each item verified in a passage of the text; an item's
        best passage counts."""
        raw = _raw_words(text) if text else []
        if not raw or not self.ids or not self.may_hold(set(_byte_words(set(raw)))):
            return []
        words, best = _byte_words(raw), {}
        for start in range(0, max(1, len(words) - self.passage // 2), self.passage // 2):
            part = words[start : start + self.passage]
            if not self.may_hold(set(part)):
                continue
            part = [w.decode() for w in part]
            found = self.wand(set(part))
            if found:
                grams = {k: {tuple(part[i : i + k]) for i in range(len(part) - k + 1)} for k in range(1, SHINGLE + 1)}
                for item, score in found:
                    shares = []
                    for tests in self.parts[item]:
                        span, own = (len(x & grams[len(next(iter(x)))]) / len(x) if x else 1.0 for x in tests)
                        shares.append(span if span >= OVERLAP else max(span, own))
                    if min(shares) >= OVERLAP and (item not in best or score > best[item][1]):
                        best[item] = (self.ids[item], score, *shares)
        return [best[i] for i in sorted(best)]


def index_shards(benchmark: DataFrame, item_id: str, text: str, threshold: float):
    """An Index for each shard of the items, of at most about MAX_INDEX_BYTES of text each; the number of shards."""

    @arrow_udf("array<string>")
    def split(column: pa.Array) -> pa.Array:
        return pa.array([words_of(x.as_py()) for x in column], pa.list_(pa.string()))

    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    items = items.withColumn("words", split("text")).where("size(words) > 0")
    n, size, mean, longest = items.agg(F.count("*"), F.sum(F.octet_length("text")), F.avg(F.size("words")), F.max(F.size("words"))).first()
    shards = -(-(size or 0) // MAX_INDEX_BYTES)
    counts = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        rows = own.select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text").collect()  # a shard is bounded
        df = own.select(F.explode(F.array_distinct("words")).alias("word")).distinct().join(counts, "word").collect()
        yield Index([(r.item_id, r.text) for r in rows], {r.word: r.df for r in df}, n, mean, longest, threshold), shards


_LEAK = pa.struct([("item_id", pa.string()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _leaks(shared):
    """Column function: the verified items of a broadcast index for each text."""

    @arrow_udf("array<struct<item_id:string,score:double,question_overlap:double,answer_overlap:double>>")
    def leaks(column: pa.Array) -> pa.Array:
        names = _LEAK.names
        return pa.array([[dict(zip(names, m)) for m in shared.value.matches(x.as_py())] for x in column], pa.list_(_LEAK))

    return leaks


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with leaks: array of struct<item_id, score, question_overlap, answer_overlap>, empty where nothing matches."""
    kind = f"array<struct<item_id:{benchmark.schema[item_id].dataType.simpleString()},score:double,question_overlap:double,answer_overlap:double>>"
    small_batches(df.sparkSession)
    context, found = df.sparkSession.sparkContext, None
    key = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    for index, shards in index_shards(benchmark, item_id, item_text, threshold):
        shared = context.broadcast(index)  # MAX_INDEX_BYTES of text at most
        own = _leaks(shared)(F.col(text)).cast(kind)
        if shards == 1:
            return df.withColumn("leaks", own)
        # One shard is on the driver and in the workers at a time; what it finds is written, once for each text.
        hits = written(df.select(key.alias("__key"), own.alias("__own")).where("size(__own) > 0").dropDuplicates(["__key"]))
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    clean = df.drop(*same_name(df, "leaks"))
    if found is None:
        return clean.withColumn("leaks", F.array().cast(kind))
    found = found.groupBy("__key").agg(F.flatten(F.collect_list("__own")).alias("leaks"))
    joined = clean.withColumn("__key", key).join(found, "__key", "left").drop("__key")
    return joined.withColumn("leaks", F.coalesce("leaks", F.array().cast(kind)))
