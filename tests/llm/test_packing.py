"""Packing: ids as the tokenizers library gives them, each in one piece, in full windows or powers of two; balance."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from rankflow.llm import packing
from rankflow.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library():
    pick = random.Random(5)
    characters = ["a", "B", "é", "1", "½", ".", "'", "'s", "'ll", " ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", "​", "日本", "😀", "\x00", "<|endoftext|>", "word", "Ġ", "n't"]
    texts = ["", " ", "  ", " a", "a ", "a  ", "\n a", " \n", "<|endoftext|>"] + ["".join(pick.choices(characters, k=pick.randint(1, 30))) for _ in range(3000)]
    encoder = packing.Encoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == library_ids(texts)


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 20)
    encoder, texts = packing.Encoder(PATH), [" ".join(f"w{i * j}" for j in range(12)) for i in range(60)]
    for text, want in zip(texts, library_ids(texts)):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want
        assert len(encoder.after_blank) <= 20 + 12 and len(encoder.before) <= 20 + 12


def check(pieces, want, most=1024):
    """want: list of (doc, ids), in order; pieces: of one or several partitions."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, ids, total, sequence, offset, size, step in pieces:
        assert length > 0 and len(ids) == 4 * length
        docs[doc].append((start, ids, total))
        sequences[sequence].append((offset, length, size, step))
    assert set(docs) == {doc for doc, _ in want}
    for doc, ids in want:
        own = sorted(docs[doc])
        assert b"".join(x[1] for x in own) == np.array(ids, "<u4").tobytes() and {x[2] for x in own} == {len(ids)}
        assert [x[0] for x in own] == [0, *np.cumsum([len(x[1]) // 4 for x in own])[:-1]]
    for own in sequences.values():
        own.sort()
        assert [x[0] for x in own] == [0, *np.cumsum([x[1] for x in own])[:-1]]
        size = sum(x[1] for x in own)
        assert size <= most and size & (size - 1) == 0 and {x[2] for x in own} == {size} and len({x[3] for x in own}) == 1
    return sequences


@pytest.mark.parametrize("waiting", [1, 7, 500])
@pytest.mark.parametrize("lengths", ["short", "long", "mixed", "one"])
def test_packer(waiting, lengths):
    pick = random.Random(waiting)
    draw = {"short": lambda: pick.randint(1, 60), "long": lambda: pick.randint(600, 1023), "mixed": lambda: int(1.6 ** pick.uniform(0, 20)), "one": lambda: 1}[lengths]
    docs = [(i, [pick.randint(0, 50_000) for _ in range(draw())]) for i in range(400)]
    packer, pieces = packing.Packer(3, waiting=waiting), []
    for doc, ids in docs:
        pieces += packer.add(doc, np.array(ids, "<u4"))
    pieces += packer.finish()
    sequences = check(pieces, docs)
    if waiting == 500 and lengths == "mixed":
        whole = sum(1 for p in pieces if p[2] == p[4])
        assert whole > 0.7 * sum(len(ids) <= 1024 for _, ids in docs)  # most documents that fit a window stay whole
    weights = defaultdict(int)
    for own in sequences.values():
        weights[own[0][3]] += own[0][2]
    assert max(weights.values()) <= packing.STEP_TOKENS + 1024


def test_steps_of_a_round_weigh_the_same():
    pick = random.Random(8)
    packer, pieces = packing.Packer(0, waiting=200), []
    for i in range(3000):
        pieces += packer.add(i, np.zeros(pick.choice([20, 100, 200, 400, 900, 2500]), "<u4"))
    full = defaultdict(int)
    for p in pieces:  # all rounds but the last
        full[p[8]] += p[2]
    assert len(full) >= 2 * packing.ROUND_STEPS and max(full.values()) - min(full.values()) <= 1024


def test_pack(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (5, "word " * 30_000), (6, "x" * 50_000), (7, "<|endoftext|> in a text"), (8, "\n \n")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start int, ids int")
    got = packing.pack(df.coalesce(1), PATH).collect()
    want = [(d, [*ids, 0]) for (d, _), ids in zip(rows, library_ids([t or "" for _, t in rows]))]
    twice = [p for p in got if p.doc_id == 2]
    assert [p.doc_tokens for p in twice] == [1, 1]
    assert sum(p.length for p in got) == sum(len(ids) for _, ids in want)
    for doc, ids in want:
        if doc != 2:
            assert b"".join(bytes(p.ids) for p in sorted((p for p in got if p.doc_id == doc), key=lambda p: p.start)) == np.array(ids, "<u4").tobytes()
    strings = packing.pack(spark.createDataFrame([("a", "b c")], "doc_id string, text string"), PATH).collect()
    assert [(p.doc_id, p.length) for p in strings] == [("a", 2), ("a", 1)]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    with pytest.raises(ValueError, match="powers of two"):
        packing.pack(df, PATH, tiers=(100, 200))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_op12(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: [*x, 0] for r, x in zip(rows, library_ids([r.text or "" for r in rows]))}
    got = QUERIES["op12_packing"](spark, DATA).collect()
    pieces = []
    for p in got:
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert zlib.crc32(own) == p.ids_crc32
        pieces.append((p.doc_id, p.start, p.length, own, p.doc_tokens, p.sequence_id, p.offset, p.sequence_length, p.step_group))
    check(pieces, list(ids.items()))
