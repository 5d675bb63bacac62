import random
import re

import numpy as np
import pytest

from rankflow.llm import jaccard, sigtree
from rankflow.llm.common import WORD


def shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(WORD, text or "")]
    return {tuple(words[i : i + min(n, len(words))]) for i in range(len(words) - min(n, len(words)) + 1)} if words else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, text, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, text) in enumerate(rows)]


def corpus(seed, families, per_family, spread=0.02):
    pick, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(families):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([3, 9, 11, 12, 14, 25, 40, 120, 500]))]
        for _ in range(pick.randint(1, per_family)):
            words = [pick.choice(vocabulary) if pick.random() < spread * pick.random() else w for w in base]
            if pick.random() < 0.3:
                words = words[: max(1, len(words) - pick.randint(0, 1 + len(words) // 12))]
            rows.append((len(rows) * 3 + pick.randint(0, 2), " ".join(words)))
    pick.shuffle(rows)
    return rows


def check(spark, rows, n=3, percent=90):
    got = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), words=n, percent=percent).drop("component")
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute(rows, n, percent), key=order)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, n, percent):
    check(spark, corpus(n, 60, 6), n, percent)


@pytest.mark.parametrize("weight", [3_000, 12_000])
def test_large_regions_in_chunks(spark, monkeypatch, weight):
    monkeypatch.setattr(jaccard, "TASK_WEIGHT", weight)
    check(spark, corpus(8, 6, 40, 0.06), 3, 90)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30))
    rows = [(None, long), (5, long), (5, long), (7, None), (8, ""), (9, " \t"), (1, "one"), (2, "ONE"), (3, "one two"), (4, "One\ntwo"), (6, "É é"), (10, "é É"), (11, long + " y")]
    check(spark, rows)
    assert jaccard.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 4)], "doc_id long, text string, N_Shingles string, node int")
    row = jaccard.link_documents(df).first()
    assert row["n_shingles"] == 1 and row["component_id"] == 1 and row["node"] == 4


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_linked_sets_share_a_key(percent):
    parts, pick = jaccard.Parts(percent), np.random.default_rng(percent)
    for n in [*range(1, 60), 100, 333, 1000]:
        a = np.unique(pick.integers(0, 2**64, n, dtype=np.uint64))
        for _ in range(6):
            d = parts.differing(n, n)
            gone = pick.integers(0, d + 1)
            b = np.unique(np.concatenate((np.delete(a, pick.choice(n, min(n, gone), replace=False)), pick.integers(0, 2**64, pick.integers(0, d + 1), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 0 < both < max(len(a), len(b)) and sigtree.similar(both, len(a), len(b), percent):
                assert set(parts.keys(a).tolist()) & set(parts.keys(b).tolist())


def test_traversal_finds_every_pair():
    pick = np.random.default_rng(5)
    base = [np.unique(pick.integers(0, 2**64, 80, dtype=np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate((base[k % 12][pick.integers(0, 6) :], pick.integers(0, 2**64, 3, dtype=np.uint64)))) for k in range(90)]
    sizes, labels = np.array([len(x) for x in sets]), np.arange(90)
    trees = [sigtree.Tree(np.vstack([sigtree.bitmap(x, 512) for x in sets[a:b]]), sizes[a:b]) for a, b in ((0, 90), (0, 33), (33, 90))]
    linked = {(i, j) for i in range(90) for j in range(i + 1, 90) if sigtree.similar(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j], 80)}
    seen = set()
    sigtree.traverse(trees[0], trees[0], labels, labels, 80, lambda i, j: seen.add((i, j)))
    assert linked <= seen and len(seen) < 90 * 89 / 2
    seen.clear()
    sigtree.traverse(trees[1], trees[2], labels[:33], labels[33:], 80, lambda i, j: seen.add((i, 33 + j)))
    assert {(i, j) for i, j in linked if i < 33 <= j} <= seen
