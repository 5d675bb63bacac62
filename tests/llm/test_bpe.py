import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rankflow.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MERGES = bpe.Merges(RANKS)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aeinst ", max_size=300), st.text(alphabet="ab", max_size=200), st.text(alphabet=" \n\t\x1c\x85\u2003\u200bab1's.é中", max_size=60)))
def test_matches_tiktoken(text):
    got = np.frombuffer(bpe.encode_text(text, PATH, P.PATTERN), "<u4").tolist()
    assert got == np.frombuffer(bpe.encode_text(text, PATH, P.PATTERN, blank_starts=False), "<u4").tolist() == TIK.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdethn", max_size=60), st.text(alphabet="abcdethn", max_size=60))
def test_join_is_encoding_of_concatenation(a, b):
    a, b = a.encode(), b.encode()
    assert MERGES.join(MERGES.merge(a), MERGES.merge(b)) == MERGES.merge(a + b)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "ab" * 4000, "é" * 2000, "0123456789" * 300, "-" * 4097])
def test_long_pieces(text):
    got = np.frombuffer(bpe.encode_text(text, PATH, P.PATTERN), "<u4").tolist()
    assert got == np.frombuffer(bpe.encode_text(text, PATH, P.PATTERN, blank_starts=False), "<u4").tolist() == TIK.encode_ordinary(text)


def test_columns_nulls_and_clashes(spark):
    texts = [None, "", "Hello  world\n\n x", "naïve 你好   \x1c\u0085", "Hello  world\n\n x", "the the " * 4000]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, N_Tokens string")
    rows = {r.doc_id: r for r in bpe.encode_decode(df, PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = TIK.encode_ordinary(t or "")
        assert np.frombuffer(rows[i].bpe_ids, "<u4").tolist() == want
        assert rows[i]["n_tokens"] == len(want) and bytes(rows[i].bpe_text) == (t or "").encode()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(empty, PATH, P.PATTERN).count() == 0


def test_query_digests(spark, tmp_path):
    from rankflow.llm.queries import QUERIES

    spark.createDataFrame([(1, "A test."), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, str(tmp_path)).collect()}
    ids = np.array(TIK.encode_ordinary("A test."), "<u4").tobytes()
    assert rows[1].ids_sha256 == hashlib.sha256(ids).hexdigest() and rows[1].n_tokens == len(ids) // 4
    assert rows[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
