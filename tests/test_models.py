"""Absorbed effects, formulas and tests made of them against dense dummies in numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.operators import formula, stats, style


def panel(n=400, seed=1):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = f"p{int(pick.paretovariate(0.7)) % 40}", pick.randint(0, 12), pick.choice("uvw")
        x, z, month = pick.gauss(0, 1), float(pick.randint(0, 3)), pick.randint(-20, 5)
        rows.append((i, a, b, c, x, z, month, month >= 0 and 1.0 or 0.0, 1 + pick.random(), x + 0.5 * z * (month >= 0) + int(a[1:]) % 7 + b + pick.gauss(0, 1)))
    return rows


COLUMNS = "i int, a string, b int, c string, x double, z double, month int, post double, w double, y double"


def dense(rows, design, effects, weight=None):
    """Coefficients of design columns with a dummy for each level of each effect."""
    names = COLUMNS.replace(",", "").split()[::2]
    col = lambda name: np.array([r[names.index(name)] for r in rows])
    dummies = [(col(e) == v).astype(float) for e in effects for v in sorted(set(col(e)))]
    full = np.column_stack([*(f(col) for f in design), *dummies])
    w = np.sqrt(col(weight).astype(float)) if weight else np.ones(len(rows))
    return np.linalg.lstsq(full * w[:, None], col("y").astype(float) * w, rcond=None)[0][: len(design)]


@pytest.mark.parametrize("cells", [10**6, 0])
@pytest.mark.parametrize("weight", [None, "w"])
def test_several_effects(spark, monkeypatch, cells, weight):
    """In the driver's memory and in tables."""
    monkeypatch.setattr(stats, "DRIVER_CELLS", cells)
    rows = panel(120 if cells == 0 else 400)
    if cells == 0 and weight:
        rows = rows[:60]
    model = stats.regress(spark.createDataFrame(rows, COLUMNS), "y", ["x", "z"], ["a", "b", "c"], ["a"], weight)
    want = dense(rows, [lambda c: c("x"), lambda c: c("z")], ["a", "b", "c"], weight)
    assert model["beta"] == pytest.approx(want, rel=1e-6, abs=1e-8) and model["n"] == len(rows)


@pytest.mark.parametrize("effects", [["i", "c"], ["c", "i"], ["a", "c"]])
@pytest.mark.parametrize("weight", [None, "w"])
def test_many_and_few_levels(spark, monkeypatch, effects, weight):
    """Two effects of which one has few levels are solved without steps, as in the driver's memory; parts without a common
    level, and levels of one row, too."""
    rows = [(i // 3, *r[1:]) for i, r in enumerate(panel(240))]
    rows += [(1000 + i // 4, f"own{i // 4}", r[2], "apart" if i < 20 else "alone", *r[4:]) for i, r in enumerate(panel(21))]
    df = spark.createDataFrame(rows, COLUMNS)
    fit = lambda: sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in stats.demean(df, ["x", "z", "y"], effects, weight).collect())
    want = fit()
    few = len({r[3] for r in rows})
    monkeypatch.setattr(stats, "DRIVER_CELLS", 0)
    monkeypatch.setattr(stats, "FEW_LEVELS", few)
    monkeypatch.setattr(stats, "_solve_in_tables", None)
    got = fit()
    assert len(got) == len(want) and all(a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6) for a, b in zip(got, want))


@pytest.mark.parametrize("cells", [10**6, 0])
def test_no_convergence_is_an_error(spark, monkeypatch, cells):
    monkeypatch.setattr(stats, "DRIVER_CELLS", cells)
    with pytest.raises(ValueError, match="did not converge within 1 steps"):
        stats.demean(spark.createDataFrame(panel(100), COLUMNS), ["y"], ["a", "b"], most=1)


def test_two_way_clusters_and_within_r2(spark):
    rows = panel(300)
    model = stats.regress(spark.createDataFrame(rows, COLUMNS), "y", ["x", "z"], ["c"], ["a", "b"])
    names = COLUMNS.replace(",", "").split()[::2]
    data = {n: np.array([r[k] for r in rows]) for k, n in enumerate(names)}
    off = lambda v: v - np.array([v[data["c"] == g].mean() for g in data["c"]])
    design, y = np.column_stack([off(data["x"]), off(data["z"])]), off(data["y"])
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ y
    e = y - design @ beta
    v = np.zeros((2, 2))
    for sign, groups in ((1, data["a"]), (1, data["b"].astype(str)), (-1, np.char.add(data["a"].astype(str), data["b"].astype(str)))):
        sums = np.array([(design[groups == g] * e[groups == g, None]).sum(axis=0) for g in set(groups)])
        v += sign * len(sums) / (len(sums) - 1) * (len(y) - 1) / (len(y) - 2) * bread @ sums.T @ sums @ bread
    assert model["beta"] == pytest.approx(beta) and model["vcov"] == pytest.approx(v) and model["within_r2"] == pytest.approx(1 - e @ e / (y @ y))


def test_formula_terms(spark):
    df = spark.createDataFrame(panel(60), COLUMNS)
    model = formula.expand(df, "y ~ post * x * z + x:w + factor(c) + i(month, x, ref=-1) | a + b")
    fixed = [t for t in model.terms if not t.startswith("i(")]
    assert fixed == ["post", "x", "z", "factor(c)=v", "factor(c)=w", "post:x", "post:z", "x:z", "x:w", "post:x:z"]
    assert model.outcome == "y" and model.effects == ["a", "b"] and "i(month, x)=-1" not in model.terms and "i(month, x)=2" in model.terms
    row = model.df.where("month = 2").first()
    assert row["i(month, x)=2"] == row.x and row["post:x:z"] == row.post * row.x * row.z
    with pytest.raises(ValueError, match="no level 99"):
        formula.expand(df, "y ~ i(month, ref=99)")


def test_pretrends_and_horse_race(spark):
    rows = panel(500)
    df = spark.createDataFrame(rows, COLUMNS)
    got = formula.pretrends(df, ["y"], ["z", "x"], "month", "w", ["c"], ["a"])
    before = [r for r in rows if -18 <= r[6] <= -1]
    for row in got:
        other = lambda c, v=row[1]: c(v)
        want = dense(before, [lambda c, o=other: (c("month") + 1) * o(c), lambda c: c("month") + 1, other, lambda c: c("w")], ["c"])
        assert row[2] == f"month_before:{row[1]}" and row[3] == pytest.approx(want[0]) and row[7] == len(before)
    assert [r[8] for r in got] == stats.adjusted([r[6] for r in got])
    race = formula.horse_race(df, ["y"], "post", ["z", "x"], "w + factor(b)", ["c"], ["a"])
    want = dense(rows, [lambda c: c("post") * c("z"), lambda c: c("post") * c("x"), lambda c: c("w")], ["c", "b"])
    assert [r[1] for r in race] == ["z", "x"] and [r[3] for r in race] == pytest.approx(list(want[:2]))
    assert stats.adjusted([0.01, None, 0.04, 0.03]) == pytest.approx([0.03, None, 0.04, 0.04])


def test_pick_one(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    assert stats.pick_one(df, df.k == "a").v == 1
    for key, found in (("b", "several"), ("c", "none")):
        with pytest.raises(ValueError, match=f"expected one row, found {found}"):
            stats.pick_one(df, df.k == key)


def test_style_tables_are_computed_once(spark):
    """Scores and components read a written table: what computes their input runs once, not once for each fit."""
    runs = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        runs.add(1)
        return float(x)

    df = spark.range(40).select("id", *(seen(F.col("id") % (k + 3)).alias(c) for k, c in enumerate(sorted({*style.CLEAN, *style.CHAOS, *style.SELF_RISK}))))
    columns = df.columns[1:]
    assert style.principal_components(df, columns).count() == 40 and runs.value == 40 * len(columns)
    runs.value = 0
    assert style.style_scores(df, None).count() == 40 and runs.value == 40 * len(columns)
