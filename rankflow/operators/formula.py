"""Models named by formulas, `y ~ a * b + c:d + factor(f) + i(m, x, ref=-1) | effect + effect`, and tests made of them.

A formula only names columns: products of columns for interactions, 0/1 columns for the levels of a factor. `a * b` stands
for a, b and a:b; terms come by the number of columns in them, then as written. `factor(f)` has a column for each level but
the least, `i(m, ref=r)` for each but r, `i(m, x, ref=r)` those times x.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.operators import stats

#: Levels that a factor may have.
MOST_LEVELS = 1000


@dataclass
class Model:
    """df with the formula's columns, its outcome, terms and absorbed effects."""

    df: DataFrame
    outcome: str
    terms: list[str]
    effects: list[str]


def _parts(text: str, mark: str) -> list[str]:
    """Parts between marks outside parentheses, without blanks around them."""
    return [x.strip() for x in re.split(re.escape(mark) + r"(?![^()]*\))", text) if x.strip()]


def _factor(df: DataFrame, text: str) -> tuple[DataFrame, list[str]] | None:
    """df with the columns that factor(...) or i(...) stands for, and their names."""
    found = re.fullmatch(r"(factor|i)\(\s*([\w.]+)\s*(?:,\s*([\w.]+)\s*)?(?:,\s*ref\s*=\s*([^)]+?)\s*)?\)", text)
    if not found:
        return None
    column, times, reference = found[2], found[3], found[4]
    levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} levels: absorb it as an effect")
    levels.sort()
    if reference is not None and reference not in map(str, levels):
        raise ValueError(f"{column} has no level {reference}")
    omitted = levels[:1] if reference is None else [x for x in levels if str(x) == reference]
    names = {f"{found[1]}({column}{', ' + times if times else ''})={x}": x for x in levels if x not in omitted}
    value = F.col(times) if times else F.lit(1)
    return df.withColumns({name: F.when(F.col(column).isNotNull(), F.when(F.col(column) == F.lit(x), value).otherwise(0).cast("double")) for name, x in names.items()}), list(names)


def expand(df: DataFrame, formula: str) -> Model:
    outcome, right = (x.strip() for x in formula.split("~"))
    terms_text, _, effects_text = right.partition("|")
    factors: dict[str, list[str]] = {}
    wanted: dict[tuple[str, ...], None] = {}
    for term in _parts(terms_text, "+"):
        crossed = [tuple(_parts(x, ":")) for x in _parts(term, "*")]
        for mask in sorted(range(1, 1 << len(crossed)), key=lambda m: (m.bit_count(), m)):
            product = [x for i, own in enumerate(crossed) if mask >> i & 1 for x in own]
            wanted.setdefault(tuple(dict.fromkeys(product)))
    names: list[str] = []
    for product in sorted(wanted, key=len):
        columns = [[]]
        for x in product:
            if x not in factors:
                made = _factor(df, x)
                df, factors[x] = made if made else (df, [x])
            columns = [[*c, own] for c in columns for own in factors[x]]
        for own in columns:
            name = ":".join(own)
            if len(own) > 1:
                value = F.col(f"`{own[0]}`")
                for x in own[1:]:
                    value = value * F.col(f"`{x}`")
                df = df.withColumn(name, value)
            names.append(name)
    return Model(df, outcome, list(dict.fromkeys(names)), _parts(effects_text, "+"))


def estimate(df: DataFrame, formula: str, clusters: list[str] | None = None, weight: str | None = None, vcov: str = "cluster") -> dict:
    """stats.regress of a formula."""
    model = expand(df, formula)
    return stats.regress(model.df, model.outcome, model.terms, model.effects, clusters, weight, vcov)


def with_parts(model: dict, *parts: str) -> list[tuple]:
    """Rows of a model's table whose terms hold all the given strings."""
    return [row for row in model["table"] if all(p in row[0] for p in parts)]


RESULT = "outcome string, variable string, term string, estimate double, se double, t double, p double, n long, q double, error string"


def _adjusted(rows: list[tuple]) -> list[tuple]:
    """Rows with the p-values adjusted within each outcome."""
    q = {}
    for outcome in dict.fromkeys(r[0] for r in rows):
        own = [i for i, r in enumerate(rows) if r[0] == outcome]
        q |= dict(zip(own, stats.adjusted([rows[i][6] for i in own])))
    return [(*r[:8], q[i], r[8]) for i, r in enumerate(rows)]


def pretrends(df: DataFrame, outcomes: list[str], variables: list[str], month: str, controls: str, effects: list[str], clusters: list[str], first: int = -18, last: int = -1) -> list[tuple]:
    """RESULT rows of linear tests before the event: the slope over months first..last, from 0 in the last, of each
    variable's effect. A model that fails leaves its message."""
    sample = df.where(F.col(month).between(first, last)).withColumn("month_before", F.col(month) - last)
    out = []
    for outcome in outcomes:
        for x in variables:
            try:
                model = estimate(sample, f"{outcome} ~ month_before * {x} + {controls} | {' + '.join(effects)}", clusters)
                out += [(outcome, x, *row, None) for row in with_parts(model, "month_before:", x)]
            except ValueError as error:
                out.append((outcome, x, *[None] * 6, str(error)))
    return _adjusted(out)


def horse_race(df: DataFrame, outcomes: list[str], treatment: str, variables: list[str], controls: str, effects: list[str], clusters: list[str]) -> list[tuple]:
    """RESULT rows of one model for each outcome in which the treatment's interactions with all variables stand together;
    of its terms those with the treatment are kept."""
    out = []
    for outcome in outcomes:
        terms = " + ".join(f"{treatment}:{x}" for x in variables)
        model = estimate(df, f"{outcome} ~ {terms} + {controls} | {' + '.join(effects)}", clusters)
        out += [(outcome, row[0].removeprefix(f"{treatment}:"), *row, None) for row in with_parts(model, f"{treatment}:")]
    return _adjusted(out)
