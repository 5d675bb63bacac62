"""Token counts of a unigram tokenizer by a count-only Viterbi search.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a position, longest first; dynamic
programming keeps, for each position, the best score and the number of pieces that reach it, and no segmentation.

Exact tie rules of unigram tokenizers: a candidate replaces the best one only if its score is strictly greater, and
candidates come in the order of their start, so among equal scores the longest last piece stays. A character that is
no piece of its own counts as its UTF-8 bytes, at the lowest score less 10. Blanks are U+2581, one is put before the text.

Pieces hold U+2581 only at their start, so no piece crosses from another character into U+2581: the search runs on
each stretch from one such place to the next by itself and sums are the same (the scores are whole numbers, exact in
any order). `Vocabulary` checks this property and otherwise searches whole texts.

Cases: null and empty texts have 0 tokens; equal texts get equal counts; long texts are counted whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rankflow.llm.common import Memo, held

BLANK = "▁"
#: Below the lowest score: what a character outside the vocabulary costs more.
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p in scores if len(p) == 1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.stretches = all(BLANK not in p.lstrip(BLANK) for p in scores)

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        n = len(text)
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(text):
            ends[end + 1].append(match)
        single, unknown = self.single, self.unknown
        for end in range(1, n + 1):
            top, pieces = float("-inf"), 0
            for length, score in ends[end]:
                score += best[end - length]
                if score > top:
                    top, pieces = score, count[end - length] + 1
            char = text[end - 1]
            if char not in single and best[end - 1] + unknown > top:
                top, pieces = best[end - 1] + unknown, count[end - 1] + len(char.encode())
            best[end], count[end] = top, pieces
        return best[n], count[n]


def read_scores(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece model file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


def _counter(path: str):
    return held(("tokens", path), lambda: _new_counter(path))


def _new_counter(path: str):
    vocabulary = Vocabulary(read_scores(path))
    memo = Memo(lambda stretch: vocabulary.viterbi(stretch)[1], 200_000)
    cut = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if vocabulary.stretches else r"(?s:.+)").findall
    return cut, memo


def count_text(text: str | None, path: str) -> int:
    if not text:
        return 0
    cut, memo = _counter(path)
    return sum(map(memo.__getitem__, cut(BLANK + text.replace(" ", BLANK))))


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of text (long). path: a sentencepiece model file that every executor has."""

    @arrow_udf("long")
    def counts(column: pa.Array) -> pa.Array:
        return pa.array([count_text(x.as_py(), path) for x in column], pa.int64())

    return counts(text)


def with_token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    return df.withColumn("n_tokens", token_count(F.col(text), path))
