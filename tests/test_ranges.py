"""Ranks, quantiles, runs and forward joins over many small ranges, against plain Python and numpy; plans without one-task windows."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.operators import ordered, ranges


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_ranks(spark):
    pick = random.Random(1)
    rows = [(i, pick.choice(["a", "b", None]), pick.choice([None, 1.5, 2.0, *range(3, 40)])) for i in range(400)] + [(1000 + i, "hot", 7.0) for i in range(300)]
    rows = [(i, g, None if v is None else float(v)) for i, g, v in rows]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    for keys in ([], ["g"]):
        names = {"average": "avg", "least": "lo", "most": "hi", "count": "n"}
        got = {r.id: r for r in ranges.with_ranks(df, "v", names, keys).collect()}
        down = {r.id: r for r in ranges.with_ranks(df, "v", {"least": "lo"}, keys, descending=True).collect()}
        assert len(got) == len(rows)
        for i, g, v in rows:
            own = [x for _, h, x in rows if x is not None and (h == g or not keys)]
            if v is None:
                assert got[i].avg is None and got[i].lo is None
                continue
            below, ties = sum(x < v for x in own), own.count(v)
            assert (got[i].avg, got[i].lo, got[i].hi, got[i].n) == (below + (ties + 1) / 2, below + 1, below + ties, len(own))
            assert down[i].lo == sum(x > v for x in own) + 1
    assert "SinglePartition" not in plan_of(ranges.with_ranks(df, "v", {"average": "r"}))


def test_row_numbers(spark):
    rows = [(i, i * 7 % 50) for i in range(200)]
    out = ranges.with_row_numbers(spark.createDataFrame(rows, "id int, v int").repartition(5), ["-v", "id"], "place")
    assert "SinglePartition" not in plan_of(out)
    assert [r.id for r in sorted(out.collect(), key=lambda r: r.place)] == [i for i, v in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert ranges.with_row_numbers(spark.createDataFrame([], "id int"), ["id"], "place").collect() == []


@pytest.mark.parametrize("bracketed", [True, False])
def test_quantiles(spark, monkeypatch, bracketed):
    monkeypatch.setattr(ranges, "SKETCH_ERROR", 0.01)
    monkeypatch.setattr(ranges, "LEAST_BRACKETED", 800 if bracketed else 10**9)
    pick = random.Random(2)
    rows = [("a", pick.gauss(0, 1)) for _ in range(3000)] + [("b", float(pick.randint(0, 3))) for _ in range(2000)] + [("c", 5.0), ("d", None), (None, 1.0), (None, 2.0)] + [("e", float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = {"low": 0.0, "p1": 0.01, "q1": 0.25, "mid": 0.5, "p9": 0.9, "top": 1.0}
    for keys in ([], ["g"]):
        out = ranges.quantiles(df, keys, "v", probabilities)
        assert "SinglePartition" not in plan_of(out).split("== Physical Plan ==")[-1] or not keys
        got = {r.g if keys else "": r for r in out.collect()}
        assert len(got) == (6 if keys else 1)
        for g, row in got.items():
            own = [v for h, v in rows if v is not None and (not keys or h == g)]
            for name, p in probabilities.items():
                assert row[name] == (pytest.approx(np.quantile(own, p), rel=1e-12, abs=1e-12) if own else None)


def test_adjusted_p_values(spark):
    pick = random.Random(3)
    rows = [(i, pick.choice("ab"), pick.choice([None, 0.01, 0.02, pick.random()])) for i in range(300)]
    out = ranges.adjusted_p_values(spark.createDataFrame(rows, "id int, g string, p double"), "p", ["g"], "q")
    got = {r.id: r.q for r in out.collect()}
    for g in "ab":
        own = sorted((p, i) for i, h, p in rows if h == g and p is not None)
        low = 1.0
        for k in range(len(own) - 1, -1, -1):
            most = sum(p <= own[k][0] for p, _ in own)
            low = min(low, own[k][0] * len(own) / most)
            assert got[own[k][1]] == pytest.approx(min(low, own[k][0] * len(own) / most))
    assert all(got[i] is None for i, _, p in rows if p is None)


def python_runs(keys):
    out, number = [], 0
    for i, k in enumerate(keys):
        number += i == 0 or k != keys[i - 1]
        out.append(number)
    return out


def test_runs(spark):
    pick = random.Random(4)
    keys = [k for _ in range(60) for k in [pick.choice(["a", "b", None])] * pick.randint(1, 9)]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k string").repartition(7)
    got = sorted(ordered.with_runs(df, "i", "k").collect())
    assert [r.run for r in got] == python_runs(keys)
    groups = ordered.run_groups(df, "i", "k", [F.count("*").alias("n"), F.min("i").alias("first")]).collect()
    assert sum(r.n for r in groups) == len(keys) and len(groups) == python_runs(keys)[-1]
    assert [r.run for r in ordered.with_runs(df.where("k = 'a'"), "i", "k").collect()].count(1) == keys.count("a")


def test_file_order_keeps_a_key_that_comes_back_apart(spark, tmp_path):
    for name, games in {"b.csv": "ggh", "a.csv": "ghg"}.items():
        (tmp_path / name).write_text("game,loss\n" + "".join(f"{g},{i}\n" for i, g in enumerate(games)))
    scan = spark.read.csv(str(tmp_path), header=True, schema="game string, loss int")
    groups = ordered.run_groups(ordered.with_file_order(scan), "file_order", "game", [F.count("*").alias("n")])
    assert [(r.run, r.game, r.n) for r in sorted(groups.collect())] == [(1, "g", 1), (2, "h", 1), (3, "g", 3), (4, "h", 1)]


def python_merge(left, right):
    """Places on the right of the runs on the left, up to the first that finds none."""
    runs = lambda keys: [k for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k]
    out, place, games = [], -1, runs(right)
    for k in runs(left):
        place = next((j for j in range(place + 1, len(games)) if games[j] == k), None)
        if place is None:
            return out, k
        out.append(place + 1)
    return out, None


@pytest.mark.parametrize("seed", range(4))
def test_merge_join(spark, seed):
    pick = random.Random(seed)
    right = [pick.choice("abcdef") for _ in range(60)]
    left = [k for i, k in enumerate(right) if pick.random() < 0.3] + (["zz"] if seed % 2 else []) + [pick.choice("abcdef") for _ in range(seed * 4)]
    a = spark.createDataFrame(list(enumerate(left)), "i int, k string").repartition(5)
    b = spark.createDataFrame([(i, k, i) for i, k in enumerate(right)], "j int, k string, x int").repartition(4)
    places, lost = python_merge(left, right)
    numbers, games = python_runs(left), python_runs(right)
    want = sorted((i, k, j) for i, k in enumerate(left) for j, h in enumerate(right) if numbers[i] <= len(places) and games[j] == places[numbers[i] - 1])
    got = ordered.merge_join(a, b, "k", "i", "j", absent="stop")
    assert got.columns == ["i", "k", "j", "x"] and sorted((r.i, r.k, r.x) for r in got.collect()) == want
    if lost is not None:
        with pytest.raises(ValueError, match=f"k = {lost}"):
            ordered.merge_join(a, b, "k", "i", "j")
    else:
        assert ordered.merge_join(a, b, "k", "i", "j").count() == len(want)
