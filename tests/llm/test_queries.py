"""The queries with a SQL twin against DuckDB on the smallest tables; each other query against a brute-force version."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from rankflow.llm import decontaminate, linededup, media, pii, tokencount, toxicity
from rankflow.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for view in ("documents", "labels"):
        con.sql(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
    twin, df = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(twin.columns)
    want = [dict(zip(twin.columns, r)) for r in twin.fetchall()]
    assert sorted([str([r[c] for c in columns]) for r in df.collect()]) == sorted([str([r[c] for c in columns]) for r in want])


# -- line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        covered = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if window in seen:
                covered.update((i, i + 1, i + 2))
            seen.add(window)
        out[doc] = (None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in covered), len(covered))
    return out


def test_line_dedup(spark):
    pick = random.Random(4)
    rows = [(i, "\n".join(pick.choice("abcd") * pick.randint(1, 2) for _ in range(pick.randint(0, 12)))) for i in range(60)]
    rows += [(None, "a\nb\nc\nd"), (100, None), (101, ""), (102, "a\nb\nc\nd")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.kept_text, r.n_removed) for r in got.collect()} == brute_lines(rows)
    twice = linededup.dedup_lines(spark.createDataFrame([(1, "x\ny\nz", 7), (1, "x\ny\nz", 8)], "doc_id long, text string, N_LINES int"))
    assert [(r.kept_text, r["n_lines"]) for r in twice.collect()] == [("x\ny\nz", 3)] * 2


# -- benchmark decontamination


def brute_leaks(text, items, threshold=decontaminate.THRESHOLD):
    words = {i: decontaminate.words_of(t) for i, t in items}
    words = {i: w for i, w in words.items() if w}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for own in words.values() for w in set(own))
    passage = max(decontaminate.PASSAGE, 2 * max(map(len, words.values())))
    impact = {}
    for i, own in words.items():
        norm = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(own) / mean)
        impact[i] = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (decontaminate.K1 + 1) / (c + norm) for w, c in Counter(own).items()}
    doc, out = decontaminate.words_of(text), {}
    for start in range(0, max(1, len(doc) - passage // 2), passage // 2):
        part = doc[start : start + passage]
        for i, own in impact.items():
            score = sum(x for w, x in own.items() if w in set(part)) / sum(own.values())
            if score < threshold:
                continue
            shares = []
            for side in map(decontaminate.shingles, decontaminate.question_answer(dict(items)[i])):
                k = len(next(iter(side))) if side else 0
                shares.append(sum(any(tuple(part[j : j + k]) == g for j in range(len(part) - k + 1)) for g in side) / len(side) if side else 1.0)
            if min(shares) >= decontaminate.OVERLAP and score > out.get(i, (0,))[0]:
                out[i] = (score, *shares)
    return out


def test_decontamination(spark):
    pick = random.Random(9)
    vocabulary = [f"w{i}" for i in range(120)] + ["the", "of"] * 20
    sentence = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n)) + ". "
    items = [(i, sentence(pick.randint(6, 14)) + sentence(pick.randint(3, 9))) for i in range(30)] + [(30, "alone"), (31, ""), (32, None)]
    docs = []
    for i in range(40):
        body = sentence(pick.randint(0, 300))
        if i % 3 == 0:
            item = items[pick.randint(0, 29)][1].split()
            if i % 2:
                item[pick.randint(0, len(item) - 1)] = "changed"
            body += " ".join(item).upper() + " " + sentence(pick.randint(0, 200))
        docs.append((i, body))
    docs += [(50, None), (51, ""), (52, "w1"), (53, "alone")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {r.doc_id: {x.item_id: (x.score, x.question_overlap, x.answer_overlap) for x in r.leaks} for r in got.collect()}
    want = {i: brute_leaks(t, [x for x in items if x[1]]) if t else {} for i, t in docs}
    assert {i: set(x) for i, x in found.items()} == {i: set(x) for i, x in want.items()}
    assert all(found[i][k] == pytest.approx(v) for i, x in want.items() for k, v in x.items())
    assert sum(map(len, want.values())) > 5
    none = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("size(leaks) > 0").count() == 0


def test_shards_change_no_result(spark, monkeypatch):
    """Passages are as long as the whole benchmark's longest item wants, in every shard; rows and items may repeat."""
    pick = random.Random(4)
    sentence = lambda n: " ".join(f"w{pick.randint(0, 400)}" for _ in range(n)) + ". "
    items = [(i, sentence(8) + sentence(5)) for i in range(20)] + [(20, sentence(150) + sentence(60)), (3, "Seven words that stand in no document. No.")]
    items += items[:1]
    docs = [(i, sentence(90) + items[i % 21][1] + sentence(120) + sentence(60), "mine") for i in range(25)]
    docs += [(7, docs[7][1], "mine"), (30, None, "mine"), (31, "", "mine")]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string, Leaks string"), spark.createDataFrame(items, "item_id long, text string")

    def found():
        rows = decontaminate.find_leaks(df, benchmark).collect()
        return sorted((r.doc_id, sorted((x.item_id, round(x.score, 9), x.question_overlap, x.answer_overlap) for x in r.leaks)) for r in rows)

    whole = found()
    assert len(whole) == len(docs) and sum(len(x) for _, x in whole) >= 26
    monkeypatch.setattr(decontaminate, "MAX_INDEX_BYTES", 700)
    assert found() == whole


def test_decontamination_with_noise_at_the_edges(spark):
    """One altered word at the edge of a passage decides nothing, nor do the marks around words."""
    question = "Which of the seven rivers of the northern plain was the first to carry ships to the sea"
    items = [(1, f"{question}? Az volt heti."), (2, "It was built by nobody at all they say? Quite."), (3, "Short? By the old people of the little mill town under the hill.")]
    docs = [
        (1, f"before {question}? Az volt heti.*** after"), (2, f"before {question}? Az volt hetx after"), (3, f"before {question}; nothing of it after"),
        (4, "so it was built by nobody at all they say? Quirk. after"), (5, "before (It was built by nobody at all they say?) 'Quite' after"), (6, "short? by the old people of the little mill town under the hall"),
        (7, "shirt? by the old people of the little mill town under the hill"), (8, f"before {question}? Az"),
        (9, f"before {question.replace('ships', 'boats')}? Az volt heti. after"),
    ]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in got.collect()} == {1: [1], 2: [1], 3: [], 4: [2], 5: [2], 6: [3], 7: [3], 8: [], 9: []}
    assert decontaminate.words_of("«Ha» (b) *** c-d e's") == ["ha", "b", "***", "c-d", "e's"]


# -- token counts


def test_token_counts_by_enumeration():
    vocabulary = tokencount.Vocabulary({"a": -1.0, "b": -2.0, "ab": -3.0, "aba": -4.0, "ba": -2.5, "▁": -1.5, "▁a": -2.0})

    def every(text):
        if not text:
            yield 0.0, 0
        for k in range(1, len(text) + 1):
            piece = text[:k]
            score = {"a": -1.0, "b": -2.0, "ab": -3.0, "aba": -4.0, "ba": -2.5, "▁": -1.5, "▁a": -2.0}.get(piece)
            if score is None and k == 1:
                score, n = vocabulary.unknown, len(piece.encode())
            elif score is None:
                continue
            else:
                n = 1
            for s, m in every(text[k:]):
                yield s + score, m + n

    pick = random.Random(2)
    for _ in range(200):
        text = "".join(pick.choice("ab▁é") for _ in range(pick.randint(0, 7)))
        best, count = vocabulary.viterbi(text)
        options = list(every(text))
        assert best == pytest.approx(max(s for s, _ in options))
        assert count in {n for s, n in options if s == pytest.approx(best)}


def test_token_count_column(spark):
    path = P.path("piece_bpe_32k.model")
    rows = [(1, "the house"), (2, None), (3, ""), (4, "the house " * 3000), (5, "the house")]
    got = {r.doc_id: r.n_tokens for r in tokencount.with_token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got[2] == got[3] == 0 and got[1] == got[5] > 0 and got[4] >= 3000
    whole = tokencount.Vocabulary(tokencount.read_scores(path)).viterbi("▁the▁house▁über▁中a")[1]
    assert tokencount.count_text("the house über 中a", path) == whole  # stretches give what the whole text gives


# -- media columns


def test_media_round_trip(spark, tmp_path):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 5000), (5, "abc"), (6, "x" * 64)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_media"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        data = (text or "").encode()
        payload = data + bytes((-len(data)) % 64 or (0 if data else 64))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(data), len(payload))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[1][5:] == got[5][5:] and len(got[4].feature) == 16


def test_png_filters_and_checksums():
    image = np.random.default_rng(1).integers(0, 256, (9, 64), dtype=np.uint8)
    assert (media.read_png(media.write_png(image.tobytes())) == image).all()
    rows, above = [], np.zeros(64, np.int64)
    for y, line in enumerate(image.astype(np.int64)):
        kind = y % 5
        left, corner = np.concatenate(([0], line[:-1])), np.concatenate(([0], above[:-1]))
        p = left + above - corner
        distance = np.abs(np.stack([p - left, p - above, p - corner]))
        paeth = np.choose(distance.argmin(axis=0), [left, above, corner])
        guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    data = b"".join([media.SIGNATURE, media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 9, 8, 0, 0, 0, 0)), media._chunk(b"IDAT", zlib.compress(b"".join(rows))), media._chunk(b"IEND", b"")])
    assert (media.read_png(data) == image).all()
    for broken in (data[:-20], b"x" + data[1:], data[:60] + bytes([data[60] ^ 1]) + data[61:]):
        with pytest.raises(ValueError):
            media.read_png(broken)


# -- pseudonyms

KEY = b"test"
VALID = {
    "card": "4111 1111 1111 1111", "phone": "(415) 555-0132", "ssn": "219-09-9999", "iban": "GB82 WEST 1234 5698 7654 32", "date": "2021-02-28", "ipv4": "192.168.0.7", "email": "ann.lee@mail.org",
}


@pytest.mark.parametrize("name", sorted(VALID))
def test_pseudonyms_are_valid_and_reversible(name):
    value, function = VALID[name], pii.FORMATS[name]
    hidden = function(value, KEY)
    shape = lambda x: re.sub(r"\d+" if name == "ipv4" else r"\d", "9", x)
    assert hidden != value and re.sub("[a-z]", "x", shape(hidden).lower()) == re.sub("[a-z]", "x", shape(value).lower())
    assert function(hidden, KEY, inverse=True) == value and function(value, b"other") != hidden
    found = pii.spans(f"see {value} now", KEY)
    assert [(f, p) for _, _, f, p in found] == [(name, hidden)]


def test_feistel_is_a_permutation():
    for size in (2, 10, 97, 1000):
        assert sorted(pii.feistel(i, size, KEY, "x") for i in range(size)) == list(range(size))


def test_invalid_values_stay(spark):
    text = "4111 1111 1111 1112 and 2021-02-30, 999.1.1.1, 000-12-3456, GB00 WEST 1234 5698 7654 32"
    rows = [(1, text), (2, None), (3, ""), (4, "mail ann.lee@mail.org, ann.lee@mail.org"), (5, "x " * 50_000 + "2021-02-28")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert got[1].private_text == text and got[2].private_text is None and got[3].private_text == ""
    a, b = re.findall(r"\S+@mail\.org", got[4].private_text)
    assert a == b != "ann.lee@mail.org" and got[5].private_text.endswith(pii.date("2021-02-28", KEY))


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("in 2024 4111 1111 1111 1111 was", ["4111 1111 1111 1111"]), ("no 2024-4111-1111-1111-1111", ["4111-1111-1111-1111"]), ("3782 822463 10005.", ["3782 822463 10005"]),
        ("3056 930902 5904", ["3056 930902 5904"]), ("2024 3782-822463-10005", ["3782-822463-10005"]), ("6304 0000 0000 0000 000", ["6304 0000 0000 0000 000"]),
        ("4111 1111 1111 1111 124", ["4111 1111 1111 1111"]), ("AB12 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("1 2024 2024 4111 1111 1111 1111 219-09-9999", ["4111 1111 1111 1111", "219-09-9999"]),
    ],
)
def test_values_after_failed_candidates(text, values):
    found = pii.spans(text, KEY)
    assert [text[s:e] for s, e, _, _ in found] == values
    assert all(p == pii.FORMATS[f](text[s:e], KEY) for s, e, f, p in found)


# -- toxicity


def test_toxicity_learns_a_pair(spark):
    """Neither word alone is toxic; both together are: additive weights can't tell, pairs can."""
    pick, rows = random.Random(1), []
    for i in range(600):
        insult, group = i % 2, (i // 2) % 2
        words = ["filth"] * insult + ["peasants"] * group + [f"w{pick.randint(0, 30)}" for _ in range(6)]
        rows.append((i, " ".join(words), insult & group))
    df = spark.createDataFrame([*rows, (900, None, 1), (901, "x", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id % 5 <> 0 OR doc_id >= 900"), features=40)
    scored = toxicity.score(df.where("doc_id < 900 AND doc_id % 5 = 0"), model).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in scored]) > 0.95
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "w1 " * 30_000)], "doc_id long, text string"), model).collect()
    assert all(0 <= r.score <= 1 for r in odd)
    assert toxicity.fit(df.where("toxic = 0"))["share"] == 0.0


def test_long_values_are_permuted_whole():
    """Every part of a long value changes, its leading one too, and the key gives it back."""
    for letters in (40, 230, 300, 2000):
        size, value = 26**letters, int("1" * letters, 26)
        hidden = pii.feistel(value, size, b"key", "letters")
        assert pii.feistel(hidden, size, b"key", "letters", inverse=True) == value and hidden != value
        other = pii.feistel(value + 1, size, b"key", "letters")
        parts = [[(x >> shift) & 0xFFFFFFFF for shift in range(0, size.bit_length() - 40, 32)] for x in (value, hidden, other)]
        assert not any(a == b for a, b in zip(parts[0], parts[1])) and not any(a == b for a, b in zip(parts[1], parts[2]))
