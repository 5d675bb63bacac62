import random
import re

import pytest

from rankflow.llm import substrings
from rankflow.llm.common import WORD


def brute(rows, n):
    """{(doc_id, text): (kept, words, removed)} of distinct documents [(doc_id, text)]; doc_id None first."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in order:
        words = re.findall(WORD, text or "")
        covered = set()
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                covered.update(range(i, i + n))
            seen.add(window)
        out[doc_id, text] = (" ".join(w for i, w in enumerate(words) if i not in covered), len(words), len(covered))
    return out


def check(spark, rows, n=20, schema="doc_id long, text string"):
    got = substrings.remove_repeats(spark.createDataFrame(rows, schema), window=n).collect()
    want = brute(rows, n)
    assert len(got) == len(rows)
    for r in got:
        assert (r.kept_text, r.n_words, r.n_removed) == want[r.doc_id, r.text], r.doc_id


def corpus(seed, n_docs):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "中文", "a\x0b"[:1]]
    passages = [[pick.choice(vocabulary) for _ in range(pick.randint(15, 70))] for _ in range(8)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(pick.randint(0, 6)):
            words += pick.choice(passages)[pick.randint(0, 6) :] if pick.random() < 0.5 else [pick.choice(vocabulary) for _ in range(pick.randint(0, 50))]
        rows.append((i, pick.choice([" ", "\n", "  "]).join(words)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings.fp, "BATCH_BYTES", 2000)
    monkeypatch.setattr(substrings.fp, "BUCKET_HASHES", 700)
    check(spark, corpus(1, 120))
    check(spark, corpus(2, 60), n=7)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(substrings.fp, "BATCH_BYTES", 300)
    long = " ".join(f"x{i}" for i in range(25))
    check(spark, [(None, long), (3, None), (4, ""), (5, " \t\n"), (7, long), (7, long), (8, "a " * 100), (9, "a b " * 15), (-2, long + " tail")])
    check(spark, [], schema="doc_id long, text string")


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, Kept_Text string, bucket int")
    row = substrings.remove_repeats(df).first()
    assert row["kept_text"] == "a b" and row["bucket"] == 5 and row["n_removed"] == 0


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="doc_id is string"):
        substrings.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
