"""Radix select and source divergence against plain versions, with small histograms so that every pass is taken."""

import random
import re
from collections import Counter, defaultdict

import pytest

from rankflow.llm import divergence, radix


@pytest.mark.parametrize("slack", [1, 1000])
def test_top_k(spark, slack):
    pick = random.Random(slack)
    rows = [("big", pick.choice([0, 1, 5, 1 << 17, (1 << 40) + 7, 1 << 62, (1 << 63) - 1]), f"é{'x' * pick.randint(0, 5)}{i}") for i in range(300)]
    rows += [("ties", 9, "same" * 5 + "a" * i) for i in range(9)] + [("ties", 9, "same" * 5 + c) for c in ("é", "日", "😀", "￿", "\x01")]
    rows += [("few", 3, "a"), ("few", 4, "b"), ("one", 0, "z")] + [("equal", 2, f"{i:03d}") for i in range(100)]
    rows += [("prefix", 1, "ab"), ("prefix", 1, "a"), ("prefix", 1, "abc"), ("prefix", 1, "abcd"), ("prefix", 1, "b")]
    for k in (5,):
        got = radix.top_k(spark.createDataFrame(rows, "g string, v long, t string"), ["g"], "v", "t", k, slack).collect()
        want = defaultdict(list)
        for g, v, t in sorted(rows, key=lambda r: (r[0], -r[1], r[2].encode())):
            if len(want[g]) < k:
                want[g].append((len(want[g]) + 1, v, t))
        assert sorted((r.g, r["rank"], r.v, r.t) for r in got) == sorted((g, *x) for g, own in want.items() for x in own)
    assert radix.top_k(spark.createDataFrame([], "g string, v long, t string"), ["g"], "v", "t", 3, slack).collect() == []


def test_groups_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(radix, "BROADCAST_GROUPS", 1)
    rows = [(g, v % 7, f"{v}") for g in "abc" for v in range(40)]
    got = radix.top_k(spark.createDataFrame(rows, "g string, v long, t string"), ["g"], "v", "t", 3, 2).collect()
    assert sorted((r.g, r["rank"], r.t) for r in got) == [(g, i, t) for g in "abc" for i, t in ((1, "13"), (2, "20"), (3, "27"))]


def brute(rows, k):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for text, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        documents, counts = Counter(), defaultdict(Counter)
        for x, source, terms in found:
            if x == lang:
                documents.update(set(terms))
                counts[source].update(terms)
        kept = [t for t, n in documents.items() if n >= 3]
        share = lambda own: {t: 1 + 10**9 * (own[t] + 1) // (sum(own[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: share(own) for s, own in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, own in (("pair", sorted(pairs)), ("term", sorted(terms)[:k])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(own, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit_sources(spark, monkeypatch, small):
    if small:  # nothing that a task holds, and no bucket, stays whole
        for name, value in {"TERMS_HELD": 5, "PAIRS_AT_ONCE": 3, "PAIRS_HELD": 2}.items():
            monkeypatch.setattr(divergence, name, value)
    pick = random.Random(6)
    words = ["the", "The", "été", "É", "日本", "x-y", "a1b", "don't", "ﬁ", "word", "K", "İ", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(pick.choices(words, k=pick.randint(0, 30))), pick.choice(["en", "de", None]), pick.choice(["a", "b", "c", "é", None])) for _ in range(120)]
    rows += [(None, "en", "nothing"), ("", "fr", "x"), ("rare once", "fr", "y"), ("solo solo", "es", "only"), ("solo", "es", "only"), ("solo", "es", "only"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, item int, value int").repartition(3)
    got = divergence.audit_sources(df, k=7)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 7)
    assert divergence.audit_sources(df.limit(0)).collect() == []


def test_shares_are_exact(spark):
    cases = [(0, 1), (8_000_000_000_000_000, 8_999_999_999_999_999), (1, 3), (10**12, 3 * 10**13 + 1), (6, 7)]
    got = spark.createDataFrame(cases, "n long, total long").select(divergence.scaled(divergence.F.col("n"), divergence.F.col("total")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 1) // total for n, total in cases]
