"""Order statistics of whole tables and of groups of any size: no window holds a table, or a large group, in one task.

Counts of distinct values are range-partitioned by (group, value); each range is summed by itself, the sums of the ranges
before it (or after it) are carried into it. A range is a partition of Spark's own range partitioning, written down with
its number, so that both passes see the same ranges. Carried sums are one row for each range and group: for a whole table
as many rows as there are ranges, which pass the driver; for groups a window over those rows.

Quantiles first select the range of values that must hold them, by a sketch of known error, and order only what lies there.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.shared import written

#: Rank error of the sketch that brackets a quantile, as a share of its group; smaller groups are not bracketed.
SKETCH_ERROR = 1e-3
LEAST_BRACKETED = 8000
SO_FAR = Window.unboundedPreceding, Window.currentRow


def cut_by_range(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df as a table, with `part`: numbers of ranges that rise with (keys, order); equal values share a range."""
    return written(df.repartitionByRange(*keys, order).withColumn("part", F.spark_partition_id()))


def carried(cut: DataFrame, keys: list[str], own: Column, name: str, total: str | None, fold: Callable, backward: bool = False) -> DataFrame:
    """part, keys, name: `own` of the ranges of a group before each one (after it, if backward), folded; null if there is
    none. total: name of the fold over all of them. fold: F.sum, F.min or F.max."""
    sums = cut.groupBy("part", *keys).agg(own.alias("__own"))
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.desc("part") if backward else F.asc("part"))
        out = sums.withColumn(name, fold("__own").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        out = out.withColumn(total, fold("__own").over(Window.partitionBy(*keys))) if total else out
        return out.drop("__own")
    rows = sorted(((r.part, r["__own"]) for r in sums.collect()), reverse=backward)  # a row for each range
    step = lambda a, b: b if a is None else a if b is None else {F.sum: add, F.min: min, F.max: max}[fold](a, b)
    folded = list(accumulate((x for _, x in rows), step))
    kind = sums.schema["__own"].dataType.simpleString()
    data = [(part, before, folded[-1]) for (part, _), before in zip(rows, [None, *folded])]
    out = cut.sparkSession.createDataFrame(data, f"part int, {name} {kind}, {total or '__total'} {kind}")
    return F.broadcast(out if total else out.drop("__total"))


def _same(keys: list[str], left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column, list[str]]:
    """right under other names, the condition that the keys of both are the same (nulls too), and those names."""
    names = [f"__right{i}" for i in range(len(keys))]
    right = right.withColumnsRenamed(dict(zip(keys, names)))
    on = F.lit(True)
    for a, b in zip(keys, names):
        on = on & left[a].eqNullSafe(right[b])
    return right, on, names


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet."""
    right, on, names = _same(keys, left, right)
    return left.join(right, on, how).drop(*names)


def running_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value (distinct, not null), n (its rows), upto (rows of the group up to it), total (rows of the group), part."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    cut = cut_by_range(counts, keys, value)
    inside = cut.withColumn("__inside", F.sum("n").over(Window.partitionBy("part", *keys).orderBy(value).rowsBetween(*SO_FAR)))
    out = join_same(inside, carried(cut, keys, F.sum("n"), "__before", "total", F.sum), ["part", *keys])
    return out.withColumn("upto", F.col("__inside") + F.coalesce("__before", F.lit(0))).drop("__inside", "__before")


def with_ranks(df: DataFrame, value: str, names: dict[str, str], keys: list[str] | None = None, descending: bool = False) -> DataFrame:
    """df with ranks of value within keys; null values have none. names: what to call `average` (ties share their mean
    rank), `least` (ties share the first), `most` (the last), `dense` is not among them; and `count`, the number of values."""
    keys = keys or []
    ranks = running_counts(df.select(*keys, value), keys, value)
    upto = F.col("total") - F.col("upto") + F.col("n") if descending else F.col("upto")
    kinds = {"average": upto - (F.col("n") - 1) / 2, "least": upto - F.col("n") + 1, "most": upto, "count": F.col("total")}
    ranks = ranks.select(*keys, value, *(kinds[k].alias(name) for k, name in names.items()))
    return join_same(df, ranks, [*keys, value], "left")


def with_row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the number (from 1) of each row in an order of the whole table: columns, those with - before descending.
    The order should be total."""
    columns = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    cut = written(df.repartitionByRange(*columns).withColumn("part", F.spark_partition_id()))
    inside = cut.withColumn("__inside", F.row_number().over(Window.partitionBy("part").orderBy(*columns)).cast("long"))
    out = inside.join(carried(cut, [], F.count("*"), "__before", None, F.sum), "part")
    return out.withColumn(name, F.col("__inside") + F.coalesce("__before", F.lit(0))).drop("part", "__inside", "__before")


def adjusted_p_values(df: DataFrame, p: str, keys: list[str], name: str) -> DataFrame:
    """Benjamini-Hochberg: the least of p * values / rank over this and all greater p-values of the family, 1 at most;
    null p-values stay out. Minima are carried backwards from range to range."""
    ranks = running_counts(df.select(*keys, p), keys, p).withColumn("__scaled", F.col(p) * F.col("total") / F.col("upto"))
    ranks = written(ranks.select("part", *keys, p, "__scaled"))
    back = Window.partitionBy("part", *keys).orderBy(F.desc(p)).rowsBetween(*SO_FAR)
    inside = ranks.withColumn("__inside", F.min("__scaled").over(back))
    least = join_same(inside, carried(ranks, keys, F.min("__scaled"), "__after", None, F.min, backward=True), ["part", *keys])
    least = least.select(*keys, p, F.least(F.lit(1.0), "__inside", "__after").alias(name))
    return join_same(df, least, [*keys, p], "left")


def _brackets(rows: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """keys, total, i, fraction, k (rank of the lower of two order statistics), low, high (values between which both
    are; null: no bound) for each probability."""
    ends = [min(1.0, max(0.0, p + side * 2 * SKETCH_ERROR)) for p in probabilities for side in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(F.count("x").alias("total"), F.percentile_approx("x", ends, int(1 / SKETCH_ERROR)).alias("ends"))
    place = [(F.col("total") - 1) * F.lit(p) for p in probabilities]
    wide = F.col("total") >= LEAST_BRACKETED
    bound = lambda j, p, open_at: F.when(wide & F.lit(p != open_at), F.col("ends")[j])
    targets = [
        F.struct(F.lit(i).alias("i"), (h - F.floor(h)).alias("fraction"), (F.floor(h) + 1).alias("k"), bound(2 * i, ends[2 * i], 0.0).alias("low"), bound(2 * i + 1, ends[2 * i + 1], 1.0).alias("high"))
        for i, h in enumerate(place)
    ]
    return written(sketch.select(*keys, "total", F.inline(F.array(*targets))))


#: Groups whose brackets are sent to every task; with more of them they are joined by shuffle.
BROADCAST_GROUPS = 20_000


def quantiles(df: DataFrame, keys: list[str], column: str, probabilities: dict[str, float]) -> DataFrame:
    """keys and a column for each probability: exact quantiles with linear interpolation between order statistics, of the
    values that are not null (null where a group has none)."""
    rows = df.select(*keys, F.col(column).cast("double").alias("x"))
    names = list(probabilities)
    brackets = _brackets(rows, keys, list(probabilities.values()))
    at = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = brackets.groupBy(*keys).agg(*(at(i, c).alias(f"__{c}{i}") for i in range(len(names)) for c in ("low", "high")))
    few = wide.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    inside = join_same(rows.where("x IS NOT NULL"), F.broadcast(wide) if few else wide, keys)
    # a value is counted as it is where some bracket holds it; below a bracket only their number matters
    low, high = ([F.col(f"__{c}{i}") for i in range(len(names))] for c in ("low", "high"))
    within = [F.when((a.isNull() | (F.col("x") >= a)) & (b.isNull() | (F.col("x") <= b)), F.lit(i)) for i, (a, b) in enumerate(zip(low, high))]
    below = inside.groupBy(*keys).agg(*(F.count_if(F.col("x") < a).alias(f"__below{i}") for i, a in enumerate(low)))
    held = inside.where(F.coalesce(*within).isNotNull()).select(*keys, "x", F.explode(F.array_compact(F.array(*within))).alias("__i")).select(*keys, "__i", "x")
    counts = running_counts(held, [*keys, "__i"], "x")
    targets = join_same(brackets, below, keys, "left").withColumn("__below", F.coalesce(F.element_at(F.array(*(F.col(f"__below{i}") for i in range(len(names)))), F.col("i") + 1), F.lit(0)))
    targets = targets.select(*keys, F.col("i").alias("__i"), "fraction", (F.col("k") - F.col("__below")).alias("k"))
    found = join_same(counts.select(*keys, "__i", "x", "n", "upto"), F.broadcast(targets) if few else targets, [*keys, "__i"])
    holds = lambda k: (k > F.col("upto") - F.col("n")) & (k <= F.col("upto"))
    found = found.where(holds(F.col("k")) | holds(F.col("k") + 1))
    a, b = F.max(F.when(holds(F.col("k")), F.col("x"))), F.max(F.when(holds(F.col("k") + 1), F.col("x")))
    value = F.when(F.max("fraction") == 0, a).otherwise(a + (b - a) * F.max("fraction"))
    values = found.groupBy(*keys, "__i").agg(value.alias("__q"))
    one = lambda i, name: F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(name)
    values = values.groupBy(*keys).agg(*(one(i, name) for i, name in enumerate(names)))
    return join_same(wide.select(*keys), values, keys, "left") if keys else values
