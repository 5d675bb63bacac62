"""Estimators on distributed panels: absorbed fixed effects, clustered errors, tests and adjustments.

Spark forms the sums (group means, cross products, scores of clusters); the driver only solves systems of as many rows as
there are regressors. Fixed effects are absorbed by group means, or, if there are several, by conjugate gradients over the
sums of their distinct combinations; sums are partial aggregates joined back, so a large group is no bottleneck.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.operators.ranges import adjusted_p_values, quantiles
from rankflow.shared import written


#: Cells of effects that are solved in the driver's memory (some 100 bytes each); with more of them Spark solves.
DRIVER_CELLS = 200_000
#: Levels of an effect whose equations are solved on the driver after the other effect is put into them.
FEW_LEVELS = 200


def demean(df: DataFrame, columns: list[str], effects: list[str], weight: str | None = None, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """columns less what the effects' groups explain of them. One effect: the (weighted) means of its groups. Several: the
    least-squares fit of a value for each level of each effect, by conjugate gradients over the sums of the distinct
    combinations of levels (cells); rows are read once for these and once for the fit. An effect without convergence
    within `most` steps is an error. Rows with a null effect are left out."""
    df = df.dropna(subset=effects)
    w = F.col(weight) if weight else F.lit(1.0)
    if len(effects) == 1:
        means = df.groupBy(*effects).agg(*(F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"__{c}") for c in columns))
        fits = [means.withColumnRenamed(effects[0], "__level")]
    else:
        names = [f"__e{i}" for i in range(len(effects))]
        cells = df.groupBy(*(F.col(e).alias(n) for e, n in zip(effects, names))).agg(F.sum(w).alias("__w"), *(F.sum(w * F.col(c)).alias(f"__{c}") for c in columns))
        cells = written(cells.where("__w > 0"))
        sums = [f"__{c}" for c in columns]
        if cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS:
            fits = _solve_here(cells, names, sums, tolerance, most)
        elif len(names) == 2 and (few := _with_few_levels(cells, names)):
            fits = _solve_by_the_few(cells, names, sums, *few)
        else:
            fits = _solve_in_tables(cells, names, sums, tolerance, most)
    out = df
    for effect, fit in zip(effects, fits):
        out = out.join(fit, out[effect] == fit["__level"]).withColumns({c: F.col(c) - F.col(f"__{c}") for c in columns}).drop("__level", *(f"__{c}" for c in columns))
    return out


def _solve_here(cells: DataFrame, effects: list[str], sums: list[str], tolerance: float, most: int) -> list[DataFrame]:
    """For each effect: __level and a fit of each sum. Of few cells, as arrays."""
    rows = cells.toPandas()  # DRIVER_CELLS at most
    weight, right = rows["__w"].to_numpy(float), rows[sums].to_numpy(float)
    levels, codes = zip(*(np.unique(rows[e].to_numpy(), return_inverse=True) for e in effects))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in levels])])

    def gather(x: np.ndarray) -> np.ndarray:  # sums of cells by level
        return np.concatenate([np.column_stack([np.bincount(c, col, len(v)) for col in x.T]) for c, v in zip(codes, levels)])

    def apply(p: np.ndarray) -> np.ndarray:
        return gather(weight[:, None] * sum(p[start + c] for start, c in zip(starts, codes)))

    diagonal = gather(weight[:, None])
    r = b = gather(right)
    a, p = np.zeros_like(b), r / diagonal
    rz, scale = (r * p).sum(axis=0), np.sqrt((b * b / diagonal).sum(axis=0))
    for _ in range(most):
        if (np.sqrt(rz) <= tolerance * scale).all():
            break
        q = apply(p)
        step = np.divide(rz, (p * q).sum(axis=0), out=np.zeros_like(rz), where=rz > 0)
        a, r = a + step * p, r - step * q
        z = r / diagonal
        new = (r * z).sum(axis=0)
        p = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0) * p
        rz = new
    else:
        raise ValueError(f"the effects did not converge within {most} steps")
    out = []
    for effect, own, start in zip(effects, levels, starts):
        data = [(x.item() if hasattr(x, "item") else x, *map(float, a[start + i])) for i, x in enumerate(own)]
        kind = cells.schema[effect].dataType.simpleString()
        out.append(cells.sparkSession.createDataFrame(data, f"__level {kind}, " + ", ".join(f"{c} double" for c in sums)))
    return out


def _with_few_levels(cells: DataFrame, effects: list[str]) -> tuple[str, list] | None:
    """The effect that has FEW_LEVELS levels at most, where the other has more, and its levels."""
    levels = {e: [r[0] for r in cells.select(e).distinct().limit(FEW_LEVELS + 1).collect()] for e in effects}  # bounded by the limit
    few = [e for e in effects if len(levels[e]) <= FEW_LEVELS]
    return (few[0], sorted(levels[few[0]])) if len(few) == 1 else None


def _solve_by_the_few(cells: DataFrame, effects: list[str], sums: list[str], few: str, levels: list) -> list[DataFrame]:
    """The same of two effects, one of few levels: a value of the other effect is what its own cells leave to it, so it is
    put into the equations of the few, which are solved as they are. Cells are grouped once, by the level of the large effect;
    what leaves the tasks is a matrix of the few levels."""
    spark, k, size = cells.sparkSession, range(len(sums)), len(levels)
    many = next(e for e in effects if e != few)
    kind = cells.schema[few].dataType.simpleString()
    number = F.broadcast(spark.createDataFrame(list(zip(levels, range(size))), f"{few} {kind}, __i int"))
    totals = [F.sum(c).alias(f"r{j}") for j, c in enumerate(sums)]
    grouped = cells.join(number, few).groupBy(many).agg(F.sum("__w").alias("d"), *totals, F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__w").alias("w"))).alias("c"))  # FEW_LEVELS at most
    grouped = written(grouped.select(many, "d", *(f"r{j}" for j in k), F.col("c.i").alias("i"), F.col("c.w").alias("w")))

    def products(batches):
        """i, column (a level, or size + number of a sum), value: what the large effect's levels take from the equations."""
        taken = np.zeros((size, size + len(sums)))
        for batch in batches:
            of = [batch.column(c) for c in ("i", "w")]
            i, w = (x.flatten().to_numpy(zero_copy_only=False) for x in of)
            row = np.repeat(np.arange(batch.num_rows), np.diff(of[0].offsets.to_numpy()))
            d = batch.column("d").to_numpy(zero_copy_only=False)
            r = np.column_stack([batch.column(f"r{j}").to_numpy(zero_copy_only=False) for j in range(len(sums))])
            for start in range(0, batch.num_rows, 4096):  # a matrix of some MB
                stop = min(start + 4096, batch.num_rows)
                own = np.zeros((stop - start, size))
                here = (row >= start) & (row < stop)
                own[row[here] - start, i[here]] = w[here]
                taken += own.T @ (np.hstack([own, r[start:stop]]) / d[start:stop, None])
        a, b = np.nonzero(taken)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(taken[a, b])], names=["i", "c", "v"])

    sent = grouped.mapInArrow(products, "i int, c int, v double").groupBy("i", "c").agg(F.sum("v").alias("v"))
    taken = np.zeros((size, size + len(sums)))
    for x in sent.collect():  # FEW_LEVELS rows and columns, and the sums
        taken[x.i, x.c] = x.v
    own = cells.groupBy(few).agg(F.sum("__w").alias("d"), *totals).collect()  # few levels
    place = {x: n for n, x in enumerate(levels)}
    weight, right = np.zeros(size), np.zeros((size, len(sums)))
    for x in own:
        weight[place[x[few]]], right[place[x[few]]] = x.d, [x[f"r{j}"] for j in k]
    # one level of each connected part is free; the least-norm solution leaves fits as they are
    values = np.linalg.lstsq(np.diag(weight) - taken[:, :size], right - taken[:, size:], rcond=1e-11)[0]
    data = [(x, *map(float, values[n])) for n, x in enumerate(levels)]
    of_few = spark.createDataFrame(data, f"__level {kind}, " + ", ".join(f"{c} double" for c in sums))
    fit = lambda j: F.aggregate(F.arrays_zip("i", "w"), F.lit(0.0), lambda t, x: t + x.w * F.element_at(F.array(*(F.lit(float(v)) for v in values[:, j])), x.i + 1))
    of_many = grouped.select(F.col(many).alias("__level"), *(((F.col(f"r{j}") - fit(j)) / F.col("d")).alias(c) for j, c in enumerate(sums)))
    return [of_few if e == few else of_many for e in effects]


def _solve_in_tables(cells: DataFrame, effects: list[str], sums: list[str], tolerance: float, most: int) -> list[DataFrame]:
    """The same of any number of cells. The state (fit, rest, direction, diagonal) of all levels is a table; a step joins
    the directions with the cells, sums them there, and sums the cells by level."""
    k = range(len(sums))
    cells = written(cells.select(F.monotonically_increasing_id().alias("cell"), "*"))
    names = F.array(*(F.struct(F.lit(i).alias("effect"), F.col(e).cast("string").alias("level")) for i, e in enumerate(effects)))
    long = written(cells.select("cell", F.col("__w").alias("w"), *(F.col(c).alias(f"s{j}") for j, c in enumerate(sums)), F.inline(names)))
    level = ["effect", "level"]
    state = long.groupBy(*level).agg(F.sum("w").alias("d"), *(F.sum(f"s{j}").alias(f"r{j}") for j in k))
    state = written(state.select(*level, "d", *(F.lit(0.0).alias(f"a{j}") for j in k), *(f"r{j}" for j in k), *((F.col(f"r{j}") / F.col("d")).alias(f"p{j}") for j in k)))
    total = lambda df, x, y: np.array([v or 0.0 for v in df.agg(*(F.sum(x(j) * y(j)) for j in k)).first()])
    col = lambda name: lambda j: F.col(f"{name}{j}")
    rz = total(state, col("r"), col("p"))
    scale = np.sqrt(rz)
    for _ in range(most):
        if (np.sqrt(rz) <= tolerance * scale).all():
            break
        of_cell = long.join(state.select(*level, *(f"p{j}" for j in k)), level).groupBy("cell").agg(F.first("w").alias("w"), *(F.sum(f"p{j}").alias(f"p{j}") for j in k))
        of_cell = of_cell.select("cell", *((F.col("w") * F.col(f"p{j}")).alias(f"q{j}") for j in k))
        q = long.select("cell", *level).join(of_cell, "cell").groupBy(*level).agg(*(F.sum(f"q{j}").alias(f"q{j}") for j in k))
        state = written(state.join(q, level))
        pq = total(state, col("p"), col("q"))
        step = np.divide(rz, pq, out=np.zeros_like(rz), where=rz > 0)
        moved = {f"a{j}": F.col(f"a{j}") + F.lit(float(step[j])) * F.col(f"p{j}") for j in k} | {f"r{j}": F.col(f"r{j}") - F.lit(float(step[j])) * F.col(f"q{j}") for j in k}
        state = state.withColumns(moved)
        new = total(state, col("r"), lambda j: F.col(f"r{j}") / F.col("d"))
        turn = np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0)
        state = state.withColumns({f"p{j}": F.col(f"r{j}") / F.col("d") + F.lit(float(turn[j])) * F.col(f"p{j}") for j in k}).drop(*(f"q{j}" for j in k))
        rz = new
    else:
        raise ValueError(f"the effects did not converge within {most} steps")
    state = written(state)
    kinds = [cells.schema[e].dataType for e in effects]
    return [state.where(F.col("effect") == i).select(F.col("level").cast(kind).alias("__level"), *(F.col(f"a{j}").alias(c) for j, c in enumerate(sums))) for i, kind in enumerate(kinds)]


def interactions(df: DataFrame, factors: list[str]) -> tuple[DataFrame, list[str]]:
    """All products of the factors, from each one alone to all together, as columns named a:b."""
    names = []
    for mask in range(1, 1 << len(factors)):
        own = [f for k, f in enumerate(factors) if mask >> k & 1]
        name = ":".join(own)
        if len(own) > 1:
            product = F.col(own[0])
            for f in own[1:]:
                product = product * F.col(f)
            df = df.withColumn(name, product)
        names.append(name)
    return df, sorted(names, key=lambda x: (x.count(":"), x))


def dummies(df: DataFrame, factor: str, levels: list, reference, times: str | None = None) -> tuple[DataFrame, list[str]]:
    """Columns factor=level (times another column), one for each level but the reference."""
    new = {f"{factor}={v}": F.when(F.col(factor) == F.lit(v), F.col(times) if times else F.lit(1)).otherwise(0).cast("double") for v in levels if v != reference}
    return df.withColumns(new), list(new)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        top = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (out - 1)


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def _products(df: DataFrame, names: list[str], weight: Column, *more: Column) -> tuple[np.ndarray, list]:
    """Cross products of the columns, and the values of more aggregates of the same pass."""
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    row = df.agg(*(F.sum(weight * F.col(f"`{names[i]}`") * F.col(f"`{names[j]}`")).alias(f"s{k}") for k, (i, j) in enumerate(pairs)), *more).first()
    out = np.zeros((len(names), len(names)))
    for (i, j), x in zip(pairs, row):
        out[i, j] = out[j, i] = x or 0.0
    return out, list(row[len(pairs) :])


def _independent(xx: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns kept when each that the earlier ones explain is dropped."""
    kept: list[int] = []
    for i in range(len(xx)):
        if xx[i, i] <= 0:
            continue
        rest = xx[i, i]
        if kept:
            rest -= xx[i, kept] @ np.linalg.lstsq(xx[np.ix_(kept, kept)], xx[kept, i], rcond=None)[0]
        if rest > tolerance * xx[i, i]:
            kept.append(i)
    return kept


def regress(df: DataFrame, y: str, terms: list[str], effects: list[str] | None = None, clusters: list[str] | None = None, weight: str | None = None, vcov: str = "cluster") -> dict:
    """Least squares of y on terms with absorbed effects. vcov: `iid`, `hetero` or `cluster` (one or two clusters, by
    inclusion and exclusion). Collinear terms are dropped, in order. Returns terms, estimates, vcov, n, within_r2, table."""
    effects, clusters, names = effects or [], clusters or [], [*terms, y]
    keep = df.select(*dict.fromkeys([*effects, *clusters, *([weight] if weight else [])]), *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).dropna()
    if not effects:
        keep, names = keep.withColumn("(constant)", F.lit(1.0)), ["(constant)", *names]
    plain = {c: f"x{k}" for k, c in enumerate(names)}
    keep = keep.select(*dict.fromkeys([*effects, *clusters, *([weight] if weight else [])]), *(F.col(f"`{c}`").alias(p) for c, p in plain.items()))
    columns = list(plain.values())
    if effects:
        keep = demean(keep, columns, effects, weight)
    keep = keep.cache()
    w = F.col(weight) if weight else F.lit(1.0)
    cross, (n, *groups_of) = _products(keep, columns, w, F.count("*"), *(F.count_distinct(e) for e in effects))
    kept = _independent(cross[:-1, :-1])
    xx, xy = cross[np.ix_(kept, kept)], cross[kept, -1]
    bread = np.linalg.inv(xx) if kept else np.zeros((0, 0))
    beta = bread @ xy
    rss = float(cross[-1, -1] - beta @ xy)
    used = [columns[k] for k in kept]
    degrees = max(1, n - len(kept) - sum(groups_of))
    residual = F.col(columns[-1]) - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, used)), F.lit(0.0))
    scores = keep.select(*dict.fromkeys(clusters), *((w * residual * F.col(c)).alias(c) for c in used))

    def meat(by: list[str] | None) -> tuple[np.ndarray, int]:
        own = scores if by is None else scores.groupBy(*by).agg(*(F.sum(c).alias(c) for c in used))
        products, (g,) = _products(own, used, F.lit(1.0), F.count("*"))
        return products, g

    if vcov == "iid":
        v = bread * rss / degrees
    elif vcov == "hetero" or not clusters:
        v = bread @ meat(None)[0] @ bread * n / degrees
    else:
        sets = [[clusters[0]]] if len(clusters) == 1 else [[clusters[0]], [clusters[1]], clusters[:2]]
        v, groups = np.zeros_like(bread), []
        for by in sets:
            own, g = meat(by)
            groups.append(g)
            v += (1 if len(by) == 1 else -1) * bread @ own @ bread * (g / max(1, g - 1)) * (n - 1) / max(1, n - len(kept))
        degrees = max(1, min(groups[: len(clusters)]) - 1)
    keep.unpersist()
    total = cross[-1, -1] - (cross[0, -1] ** 2 / n if not effects else 0.0)
    inverse = {p: c for c, p in plain.items()}
    se = np.sqrt(np.maximum(0, np.diag(v)))
    table = [(inverse[c], float(b), float(s), float(b / s) if s else None, t_p_value(float(b / s), degrees) if s else None, n) for c, b, s in zip(used, beta, se)]
    return {"terms": [inverse[c] for c in used], "beta": beta, "vcov": v, "n": n, "within_r2": 1 - rss / total if total else None, "degrees": degrees, "table": table}


RESULT = "term string, estimate double, se double, t double, p double, n long"


def as_table(spark, model: dict) -> DataFrame:
    return spark.createDataFrame(model["table"], RESULT)


def contrast(model: dict, weights: dict[str, float]) -> tuple[float, float, float]:
    """Estimate, error and p-value of a linear combination of terms."""
    c = np.array([weights.get(t, 0.0) for t in model["terms"]])
    estimate, se = float(c @ model["beta"]), float(np.sqrt(c @ model["vcov"] @ c))
    return estimate, se, t_p_value(estimate / se, model["degrees"]) if se else float("nan")


def ratio(model: dict, top: str, bottom: str) -> float:
    """Ratio of two coefficients, such as a shadow price."""
    at = dict(zip(model["terms"], model["beta"]))
    return float(at[top] / at[bottom]) if at[bottom] else float("nan")


def specification_grid(df: DataFrame, y: str, samples: dict[str, str], effect_sets: dict[str, list[str]], controls: dict[str, list[str]], focus: list[str], clusters: list[str]) -> list[tuple]:
    """(sample, effects, controls, term, estimate, se, p, n, error) for every combination; a model that fails leaves its
    message instead of stopping the others."""
    out = []
    for sample, predicate in samples.items():
        own = df.where(predicate)
        for effects_name, effects in effect_sets.items():
            for controls_name, extra in controls.items():
                try:
                    model = regress(own, y, [*focus, *extra], effects, clusters)
                    out += [(sample, effects_name, controls_name, t, b, s, p, n, None) for t, b, s, _, p, n in model["table"] if t in focus]
                except (np.linalg.LinAlgError, ValueError, ZeroDivisionError) as error:
                    out.append((sample, effects_name, controls_name, None, None, None, None, None, str(error)))
    return out


def fixed_effects(df: DataFrame, y: str, model: dict, effect: str) -> DataFrame:
    """effect, fixed_effect: group means of what the terms of a one-effect model leave of y."""
    left = F.col(y) - sum((F.lit(float(b)) * F.col(f"`{t}`") for t, b in zip(model["terms"], model["beta"])), F.lit(0.0))
    return df.groupBy(effect).agg(F.avg(left).alias("fixed_effect"))


def benjamini_hochberg(df: DataFrame, p: str, groups: list[str], name: str = "q") -> DataFrame:
    """Adjusted p-values within groups (null p-values stay out)."""
    return adjusted_p_values(df, p, groups, name)


def adjusted(p_values: list[float | None]) -> list[float | None]:
    """Benjamini-Hochberg for the few p-values of a results table."""
    known = sorted((p, i) for i, p in enumerate(p_values) if p is not None and not math.isnan(p))
    out, low = [None] * len(p_values), 1.0
    for k in range(len(known) - 1, -1, -1):
        low = min(low, known[k][0] * len(known) / (k + 1))
        out[known[k][1]] = low
    return out


def placebo_grid(df: DataFrame, date: str, y: str, cutoffs: DataFrame) -> DataFrame:
    """cutoff, n_before, n_after, effect (difference of means) for each fake cutoff: sums by day first, so that the
    cutoffs meet days, not rows."""
    days = df.groupBy(F.to_date(date).alias("__day")).agg(F.sum(y).alias("__sum"), F.count(y).alias("__n"))
    joined = days.crossJoin(F.broadcast(cutoffs.select(F.col(cutoffs.columns[0]).alias("cutoff"))))  # a grid of dates
    after = F.col("__day") >= F.col("cutoff")
    part = lambda c, k: F.sum(F.when(c, F.col(k)))
    return joined.groupBy("cutoff").agg(
        part(~after, "__n").alias("n_before"), part(after, "__n").alias("n_after"), (part(after, "__sum") / part(after, "__n") - part(~after, "__sum") / part(~after, "__n")).alias("effect")
    )


def empirical_p(effects: DataFrame, effect: str, actual: float) -> Column:
    """Two-sided share of placebo effects at least as large, with one added to both counts: an aggregate."""
    return (F.count_if(F.abs(effect) >= abs(actual)) + 1) / (F.count(effect) + 1)


def welch(df: DataFrame, group: str, value: str) -> DataFrame:
    """a, b, difference, t, degrees for each pair of groups (few) from their moments."""
    m = df.groupBy(group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    a, b = (m.select(*(F.col(c).alias(f"{c}_{s}") for c in m.columns)) for s in "ab")
    pair = a.join(b, F.col(f"{group}_a") < F.col(f"{group}_b"))
    va, vb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    difference = F.col("m_a") - F.col("m_b")
    degrees = (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    return pair.select(F.col(f"{group}_a").alias("a"), F.col(f"{group}_b").alias("b"), difference.alias("difference"), (difference / F.sqrt(va + vb)).alias("t"), degrees.alias("degrees"))


def rif(df: DataFrame, column: str, tau: float, name: str) -> DataFrame:
    """Recentred influence function of a quantile: q + (tau - [x <= q]) / f(q), with a Gaussian kernel density at q."""
    q = quantiles(df, [], column, {"__q": tau, "__q25": 0.25, "__q75": 0.75}).join(df.agg(F.stddev_samp(column).alias("__sd"), F.count(column).alias("__n")))
    q = q.withColumn("__iqr", F.col("__q75") - F.col("__q25"))
    q = q.withColumn("__h", 0.9 * F.least("__sd", F.col("__iqr") / 1.34) * F.pow("__n", F.lit(-0.2)))
    z = (F.col(column) - F.col("__q")) / F.col("__h")
    rows = df.join(F.broadcast(q))  # one row
    density = rows.agg(F.avg(F.exp(-z * z / 2) / F.sqrt(F.lit(2 * math.pi)) / F.col("__h")).alias("__f"))
    rows = rows.join(F.broadcast(density))  # one row
    value = F.col("__q") + (F.lit(tau) - (F.col(column) <= F.col("__q")).cast("double")) / F.col("__f")
    return rows.withColumn(name, value).drop("__q", "__q25", "__q75", "__sd", "__iqr", "__n", "__h", "__f")


def inverse_propensity(df: DataFrame, treated: str, features: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """propensity (logit, clipped) and weight: 1 / p for the treated, 1 / (1 - p) for the others. Rows with a null
    feature or treatment are left out of the fit; their propensity, or their weight, is null."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    own = df.select(F.col(treated).cast("double").alias("label"), *(F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(features))).dropna()
    rows = VectorAssembler(inputCols=own.columns[1:], outputCol="features").transform(own)
    fitted = LogisticRegression(maxIter=50).fit(rows.select("label", "features"))
    score = sum((F.lit(float(b)) * F.col(x) for b, x in zip(fitted.coefficients, features)), F.lit(float(fitted.intercept)))
    p = 1 / (1 + F.exp(-score))
    out = df.withColumn("propensity", F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(low)), F.lit(high))))
    weight = F.when(F.col(treated) == 1, 1 / F.col("propensity")).when(F.col(treated).isNotNull(), 1 / (1 - F.col("propensity")))
    return out.withColumn("weight", weight)


def calibrate(df: DataFrame, moments: list[str], targets: list[float], cap: float = 0.995, rounds: int = 50) -> DataFrame:
    """weight = exp(a'x), with a found by Newton steps so that weighted means of moments meet the targets (each step one
    aggregate), then capped at a quantile."""
    a, k = np.zeros(len(moments)), len(moments)
    for _ in range(rounds):
        w = F.exp(sum((F.lit(float(b)) * (F.col(m) - t) for b, m, t in zip(a, moments, targets)), F.lit(0.0)))
        d = [F.col(m) - t for m, t in zip(moments, targets)]
        pairs = list(combinations_with_replacement(range(k), 2))
        row = df.agg(F.sum(w), *(F.sum(w * x) for x in d), *(F.sum(w * d[i] * d[j]) for i, j in pairs)).first()
        gradient, hessian = np.array(row[1 : k + 1]) / row[0], np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k + 1 :]):
            hessian[i, j] = hessian[j, i] = x / row[0]
        if not k or np.abs(gradient).max() < 1e-8:
            break
        a -= np.linalg.solve(hessian - np.outer(gradient, gradient) + 1e-12 * np.eye(k), gradient)
    else:
        raise ValueError(f"weights did not meet the targets within {rounds} rounds")
    out = df.withColumn("__w", F.exp(sum((F.lit(float(b)) * (F.col(m) - t) for b, m, t in zip(a, moments, targets)), F.lit(0.0))))
    edge = quantiles(out, [], "__w", {"__cap": cap})
    return out.join(F.broadcast(edge)).withColumn("weight", F.least("__w", "__cap")).drop("__w", "__cap")  # one row


def pick_one(df: DataFrame, predicate: Column):
    """The one row that meets the predicate; any other number of them is an error."""
    rows = df.where(predicate).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one row, found {'none' if not rows else 'several'}")
    return rows[0]
