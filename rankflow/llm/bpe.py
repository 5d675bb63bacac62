"""Byte-level BPE encoding and decoding by a monoid of token lists.

Encoded texts form a monoid: the join of two encoded neighbours is the encoding of their concatenated bytes. `join`
re-encodes a window around the boundary and grows it until the tokens outside provably stay: a token list is the BPE
encoding of its bytes exactly if each two adjacent tokens, re-encoded together, give themselves. So a join is final once
the window's outer tokens are compatible with their neighbours outside. Matches of the split pattern never merge with
each other, so above them, where a text's segments are joined by halves, the join is plain concatenation.

Cases: null text encodes as empty; an empty text has no ids and decodes to no bytes; equal texts get equal ids; a text
of any length is encoded whole, in time close to linear in its length. Unknown bytes raise KeyError.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rankflow.llm.common import Memo, held, small_batches

#: Pieces of at most so many bytes are merged directly and remembered; longer ones are cut in halves.
LEAF = 6
#: Distinct pieces remembered by a Python worker at once.
MEMO = 200_000
#: Texts whose Python values are held at once.
AT_ONCE = 256
#: Encoded segments, and ids, of a leaf of the upper tree.
LEAF_SEGMENTS, LEAF_IDS = 16, 4096
#: The characters of Unicode's White_Space property, which `\\s` of the split patterns means.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SEGMENTS = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_INNER_BLANK = re.compile(f"[{WHITE_SPACE}] ")


class Merges:
    """Rank table of a byte-level BPE with the monoid operations on tuples of ids."""

    def __init__(self, ranks: dict[bytes, int], memo: int = MEMO):
        self.ranks, self.memo = ranks, memo
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._fits: dict[int, bool] = {}  # of two ids, packed
        self._window: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost on ties: for short pieces."""
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        scores = [get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while scores:
            low = min(scores)
            if low == 1 << 60:
                break
            i = scores.index(low)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
        return tuple([self.ranks[p] for p in parts])

    def window(self, piece: bytes) -> tuple[int, ...]:
        found = self._window.get(piece)
        if found is None:
            if len(self._window) > self.memo // 2:
                self._window.clear()
            found = self._window[piece] = self.merge(piece)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, re-encoded together, give themselves."""
        pair = left << 32 | right
        fits = self._fits.get(pair)
        if fits is None:
            if len(self._fits) > self.memo:
                self._fits.clear()
            fits = self._fits[pair] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == (left, right)
        return fits

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        if not a or not b or self._fits.get(a[-1] << 32 | b[0]) or self.compatible(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            inner = self.window(b"".join(map(self.bytes_of.__getitem__, a[-i:] + b[:j])))
            left = i == len(a) or self.compatible(a[-i - 1], inner[0])
            right = j == len(b) or self.compatible(inner[-1], b[j])
            if left and right:
                return a[: len(a) - i] + inner + b[j:]
            i, j = min(len(a), i + 2 * (not left)), min(len(b), j + 2 * (not right))

    def tree(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of a piece: that of its halves, joined."""
        known = self._window.get(piece)
        if known is not None:
            return known
        if len(piece) <= LEAF:
            return self.window(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """A whole match of the pattern: a vocabulary entry stands for itself."""
        known = self.ranks.get(piece)
        return self.tree(piece) if known is None else (known,)


class _Segments:
    """Packed ids of a text's segments. A segment is a run of white space and the run of other characters after it:
    where white space stands only at the start of a pattern's matches, no match crosses from one to the next, and what
    matches in a segment depends on it alone. Distinct segments and matches are remembered, within bounds."""

    def __init__(self, merges: Merges, pattern: str, memo: int = MEMO):
        import regex

        matches = regex.compile(pattern).findall
        pack = [i.to_bytes(4, "little") for i in range(1 + max(merges.bytes_of, default=0))].__getitem__
        pieces = Memo(lambda match: b"".join(map(pack, merges.piece(match.encode()))), memo // 4)

        def packed(segment: str) -> bytes:
            found = matches(segment)
            if len(found) == 1:  # remembered as a segment
                return b"".join(map(pack, merges.piece(found[0].encode())))
            return b"".join([pieces[m] for m in found])

        self.packed = Memo(packed, memo // 4)
        self.after_blank = Memo(lambda rest: packed(" " + rest), memo // 2)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def _encoder(path: str, pattern: str, memo: int = MEMO) -> _Segments:
    return held(("bpe", path, pattern, memo), lambda: _Segments(Merges(read_ranks(path), memo), pattern, memo))


def encode_text(text: str, path: str, pattern: str, blank_starts: bool = True, memo: int = MEMO) -> bytes:
    """Packed ids of a text."""
    encoder = _encoder(path, pattern, memo)
    if not blank_starts:
        return encoder.packed[text]
    if _INNER_BLANK.search(text):
        return _joined(list(map(encoder.packed.__getitem__, _SEGMENTS.findall(text))))
    first, *rest = text.split(" ")  # every blank begins a run of white space, so every one begins a segment
    return _joined([encoder.packed[first], *map(encoder.after_blank.__getitem__, rest)])


@lru_cache(2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after another; where each id's begin; how many they are."""
    ranks = read_ranks(path)
    starts, sizes = np.zeros((2, 1 + max(ranks.values(), default=0)), np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    order = sorted(ranks, key=ranks.__getitem__)
    starts[1:] = np.cumsum(sizes)[:-1]
    return np.frombuffer(b"".join(order), np.uint8), starts, sizes


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ids: those of their halves, concatenated up the tree; a leaf's tokens are gathered at once."""
    if len(ids) > LEAF_IDS:
        half = len(ids) // 2
        return decode_ids(ids[:half], path) + decode_ids(ids[half:], path)
    data, starts, sizes = _pieces(path)
    own = sizes[ids]
    if not own.all():
        raise KeyError("an id without a token")
    ends = np.cumsum(own)
    return data[np.repeat(starts[ids] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def _joined(parts: list[bytes]) -> bytes:
    """The upper levels of the tree: a text's encoding is that of the halves of its segments, joined; at the edge of a
    match nothing is encoded again, so a join is concatenation."""
    if len(parts) <= LEAF_SEGMENTS:
        return b"".join(parts)
    half = len(parts) // 2
    return _joined(parts[:half]) + _joined(parts[half:])


def _binary(column: pa.Array, value) -> pa.Array:
    parts = [pa.array([value(x) for x in column.slice(i, AT_ONCE)], pa.binary()) for i in range(0, len(column), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def encode(text: Column, path: str, pattern: str, blank_starts: bool = True, memo: int = MEMO) -> Column:
    """Token ids of text as packed little-endian unsigned 32-bit integers (binary). path: a tiktoken rank file that
    every executor has; pattern: the regular expression whose matches are encoded separately; blank_starts: its matches
    hold white space at their start only (otherwise texts are not cut into segments); memo: pieces that a worker remembers,
    some 400 bytes each: what a text encodes to does not depend on it."""

    @arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        return _binary(column, lambda x: encode_text(x.as_py() or "", path, pattern, blank_starts, memo))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes (binary) of packed ids, concatenated; null ids give null."""

    @arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        return _binary(column, lambda x: decode_ids(np.frombuffer(x.as_buffer(), "<u4"), path) if x.is_valid else None)

    return decoded(ids)


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", memo: int = MEMO) -> DataFrame:
    """df with bpe_ids (binary, packed), n_tokens (long) and bpe_text (binary, decoded from the ids)."""
    small_batches(df.sparkSession)
    out = df.withColumn("bpe_ids", encode(F.col(text), path, pattern, memo=memo))
    out = out.withColumn("n_tokens", F.expr("octet_length(bpe_ids) div 4"))
    return out.withColumn("bpe_text", decode(F.col("bpe_ids"), path))
