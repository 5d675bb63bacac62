"""Packing documents into training sequences of several lengths.

Every document is encoded and closed by an end id. Whole windows of the longest length are cut from it first; what is
left is routed to the tier of the shortest window that holds it. Tiers are packed from long to short: a window opens
with the longest waiting document of its tier, its gap is filled with the longest documents of shorter tiers that fit,
and what no whole document fits is filled by cutting the longest one that waits. So windows are full and few documents
are cut for filling. Windows are dealt to step groups, those of most tokens first, each to the group with the fewest
tokens (then the least attention work, the sum of squared piece lengths), so that the steps of a round weigh the same.

A task packs the documents of its own partition as they come (mapInArrow): nothing is shuffled, and at most `waiting`
remainders and one round of windows are held, whatever the input's size. What is left when a partition ends is cut into
sequences whose lengths are powers of two, so nothing is padded at all. Numbers of sequences and groups carry the
partition's number; a task that is run again gets the same rows in the same order, if df is a table (or `written`), and
so packs alike.

Cases: a null or empty text is its end id alone; repeated rows are packed each; long texts are packed whole; an empty
table has no pieces; a null doc_id stays null. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rankflow.llm.bpe import _INNER_BLANK, _SEGMENTS
from rankflow.llm.common import held, pruned_batches

#: Lengths of windows. Documents are routed to these; each divides the next.
TIERS = (128, 256, 512, 1024)
#: Tokens of a step group; groups of a round, over which windows are balanced.
STEP_TOKENS, ROUND_STEPS = 16_384, 16
#: Remainders of documents that wait for a window in a task.
WAITING = 4096
#: Segments of a generation that a Python worker remembers (two of them), and segments encoded by one call.
MEMO, JOINED = 500_000, 100
PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"


class Encoder:
    """Packed ids (little-endian unsigned 32-bit) of texts by a tokenizers file. Byte-level tokenizers never merge over
    a blank that follows another character than white space, so texts are cut there and distinct segments encoded once;
    texts with an added token's string, and all texts of other tokenizers, are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.cuts = made["normalizer"] is None and made["post_processor"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.added = [token["content"] for token in made["added_tokens"]]
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0] if self.cuts else " "
        self.opens = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith(blank)
        self.after_blank: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the generation of segments before

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, used: set[str]) -> None:
        """Ids of the segments `blank + word` for all words used: many to a call, cut again where a token opens with the
        blank, as the first of a segment does and no other."""
        if len(self.after_blank) > MEMO:
            self.before, self.after_blank = self.after_blank, {w: self.after_blank[w] for w in used if w in self.after_blank}
        new = used - self.after_blank.keys()
        again = new & self.before.keys()
        self.after_blank.update((w, self.before[w]) for w in again)
        new = list(new - again)
        for start in range(0, len(new), JOINED):
            words = new[start : start + JOINED]
            ids = np.array(self.tokenizer.encode(" " + " ".join(words), add_special_tokens=False).ids, "<u4")
            packed, starts = ids.tobytes(), (4 * np.flatnonzero(self.opens[ids])).tolist()
            for word, a, b in zip(words, starts, [*starts[1:], len(packed)]):
                self.after_blank[word] = packed[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.cuts and not _INNER_BLANK.search(x) and not any(a in x for a in self.added) for x in texts]
        cut = [x.removesuffix(" ").split(" ") if ok else [] for x, ok in zip(texts, plain)]
        self._learn(set().union(*(words[1:] for words in cut)))
        return [self._plain(words, x.endswith(" ")) if ok else self._segments(x) for x, words, ok in zip(texts, cut, plain)]

    def _plain(self, words: list[str], last_blank: bool) -> bytes:
        first = self._whole(words[0]) if words[0] else b""
        return b"".join([first, *map(self.after_blank.__getitem__, words[1:]), self._whole(" ") if last_blank else b""])

    def _segments(self, text: str) -> bytes:
        """Texts with white space before a blank."""
        if not self.cuts or any(a in text for a in self.added):
            return self._whole(text)
        distinct = list(dict.fromkeys(_SEGMENTS.findall(text)))
        known = {s: np.array(e.ids, "<u4").tobytes() for s, e in zip(distinct, self.tokenizer.encode_batch(distinct, add_special_tokens=False))}
        return b"".join(map(known.__getitem__, _SEGMENTS.findall(text)))


class _Waiting:
    """Pieces that wait, by length; a bit for each length that has some."""

    def __init__(self):
        self.queues: dict[int, deque] = {}
        self.lengths, self.count = 0, 0

    def add(self, piece: tuple) -> None:
        length = len(piece[2])
        self.queues.setdefault(length, deque()).append(piece)
        self.lengths |= 1 << length
        self.count += 1

    def longest(self, most: int) -> tuple | None:
        """The first that came of the longest pieces of at most so many ids, taken out."""
        fitting = self.lengths & ((2 << most) - 1)
        if not fitting:
            return None
        length = fitting.bit_length() - 1
        queue = self.queues[length]
        piece = queue.popleft()
        if not queue:
            self.lengths ^= 1 << length
        self.count -= 1
        return piece


def _cut(piece: tuple, length: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[:length], total), (doc, start + length, ids[length:], total)


class Packer:
    """Packs pieces (doc, start, ids, tokens of its document) of one partition; `rounds` holds what is to be given out."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, waiting: int = WAITING):
        self.tiers, self.most, self.pool = tiers, waiting, _Waiting()
        self.sequences = self.steps = partition << 33
        self.round: list[list[tuple]] = []
        self.tokens = 0

    def _give(self, window: list[tuple]) -> Iterator[tuple]:
        self.round.append(window)
        self.tokens += sum(len(p[2]) for p in window)
        if self.tokens >= STEP_TOKENS * ROUND_STEPS:
            yield from self._deal()

    def _deal(self) -> Iterator[tuple]:
        """The windows of a round, in step groups."""
        weighed = sorted(((sum(len(p[2]) for p in w), sum(len(p[2]) ** 2 for p in w), i) for i, w in enumerate(self.round)), reverse=True)
        groups = [(0, 0, g) for g in range(-(-self.tokens // STEP_TOKENS))]
        for tokens, work, i in weighed:
            have, done, g = heapq.heappop(groups)
            heapq.heappush(groups, (have + tokens, done + work, g))
            offset = 0
            for doc, start, ids, total in self.round[i]:
                yield doc, start, len(ids), ids.tobytes(), total, self.sequences, offset, tokens, self.steps + g
                offset += len(ids)
            self.sequences += 1
        self.steps += len(groups)
        self.round, self.tokens = [], 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        longest, total = self.tiers[-1], len(ids)
        for start in range(0, total - longest + 1, longest):
            yield from self._give([(doc, start, ids[start : start + longest], total)])
        rest = total % longest
        if rest:
            self.pool.add((doc, total - rest, ids[total - rest :].copy(), total))
        if self.pool.count >= self.most:
            yield from self._pack(self.most // 2)

    def _pack(self, keep: int) -> Iterator[tuple]:
        """Packs windows, from long to short, until only so many pieces wait."""
        while self.pool.count > keep:
            window = [self.pool.longest(self.tiers[-1])]
            size = next(t for t in self.tiers if t >= len(window[0][2]))
            room = size - len(window[0][2])
            while room:
                piece = self.pool.longest(room)
                if piece is None:  # none fits whole: cut the longest
                    piece = self.pool.longest(self.tiers[-1])
                    if piece is None:
                        yield from self._tail(window)
                        window = []
                        break
                    piece, rest = _cut(piece, room)
                    self.pool.add(rest)
                window.append(piece)
                room -= len(piece[2])
            if window:
                yield from self._give(window)

    def _tail(self, pieces: list[tuple]) -> Iterator[tuple]:
        """The last pieces of a partition, cut into sequences whose lengths are powers of two."""
        left = sum(len(p[2]) for p in pieces)
        pieces = deque(pieces)
        while left:
            room, window = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                piece = pieces.popleft()
                if len(piece[2]) > room:
                    piece, rest = _cut(piece, room)
                    pieces.appendleft(rest)
                window.append(piece)
                room -= len(piece[2])
            yield from self._give(window)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(0)
        if self.round:
            yield from self._deal()


def pack(df: DataFrame, path: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id", tiers: tuple[int, ...] = TIERS, waiting: int = WAITING) -> DataFrame:
    """The pieces of all documents: doc_id, start (ids of its document before it), length, ids (packed little-endian
    unsigned 32-bit), doc_tokens (end id included), sequence_id, offset in it, sequence_length, step_group. path: a
    tokenizers file that every executor has; tiers: lengths of windows, powers of two."""
    if any(t & (t - 1) for t in tiers) or sorted(tiers) != list(tiers):
        raise ValueError("tiers must be rising powers of two")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(PIECE)])
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches):
        packer, encoder = Packer(TaskContext.get().partitionId(), tiers, waiting), held(("packing", path), lambda: Encoder(path))
        doc_type, out = None, []

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            kinds = [doc_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names=schema.names)

        for batch, texts in pruned_batches(batches, "text"):
            doc_type = batch.column("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([x or "" for x in texts.to_pylist()])):
                out += packer.add(doc, np.frombuffer(ids + end, "<u4"))
                if len(out) > 2000:
                    yield table(out)
                    out = []
        out += packer.finish()
        if out:
            yield table(out)

    return rows.mapInArrow(packed, schema)
