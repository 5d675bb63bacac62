"""Rows in file order: a stable order of the whole input, runs of a key in it, and joins that only move forward.

An order is one column (a struct where it takes several). Rows are range-partitioned by it and written down; what a range
needs from those before it (the last key, numbers of runs, the furthest match) is one value for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.operators.ranges import SO_FAR, carried, cut_by_range
from rankflow.shared import written


def with_file_order(df: DataFrame, name: str = "file_order") -> DataFrame:
    """df, read from files, with the place of each row: file, first byte of its split, row of the split. Rows of a split
    are read in order by one task, so this does not depend on how splits are dealt to tasks. To be applied to the scan
    itself, before anything else."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias(name))


def _previous(cut: DataFrame, order: str, key: str) -> DataFrame:
    """part, first, before: whether a range is the first of all, and the last key of the range before it."""
    ends = cut.groupBy("part").agg(F.max_by(F.struct(F.col(key).alias("k")), order).alias("last"))
    rows = sorted(((r.part, r.last.k) for r in ends.collect()), key=lambda x: x[0])  # a row for each range
    data = [(part, i == 0, rows[i - 1][1] if i else None) for i, (part, _) in enumerate(rows)]
    kind = cut.schema[key].dataType.simpleString()
    return F.broadcast(cut.sparkSession.createDataFrame(data, f"part int, __first boolean, __before {kind}"))


def with_runs(df: DataFrame, order: str, key: str, name: str = "run") -> DataFrame:
    """df with the number (from 1) of the run that a row is in: rows one after another in order with the same key (nulls
    are the same). A key that comes back later begins another run."""
    cut = cut_by_range(df, [], order)
    rows = cut.join(_previous(cut, order, key), "part")
    w = Window.partitionBy("part").orderBy(order)
    before = F.when(F.row_number().over(w) == 1, F.col("__before")).otherwise(F.lag(key).over(w))
    begins = ~F.col(key).eqNullSafe(before) | (F.col("__first") & (F.row_number().over(w) == 1))
    marked = rows.withColumn("__begins", begins.cast("long")).drop("__first", "__before")
    inside = marked.withColumn("__inside", F.sum("__begins").over(w.rowsBetween(*SO_FAR)))
    out = inside.join(carried(marked, [], F.sum("__begins"), "__runs", None, F.sum), "part")
    return out.withColumn(name, F.col("__inside") + F.coalesce("__runs", F.lit(0))).drop("part", "__begins", "__inside", "__runs")


def run_groups(df: DataFrame, order: str, key: str, aggregates: list[Column]) -> DataFrame:
    """run, key, aggregates: one row for each run."""
    return with_runs(df, order, key).groupBy("run", key).agg(*aggregates)


def _forward(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, int | None]:
    """run, place of each run of left (run, key): the first place of its key on the right (place, key) after the place of
    the run before; and the first run that finds none. Runs begin at the first place of their key; those that do not come
    after all earlier ones move on, until nothing moves."""
    first = right.groupBy(key).agg(F.min("place").alias("place"))
    matched = written(left.join(first, key, "left").select("run", key, "place"))
    stopped = None
    while True:
        lost = matched.where("place IS NULL").agg(F.min("run")).first()[0]
        stopped = stopped if lost is None else lost  # runs from a lost one on are gone, so a later one is earlier
        own = matched if lost is None else matched.where(F.col("run") < lost)
        cut = cut_by_range(own, [], "run")
        inside = F.max("place").over(Window.partitionBy("part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
        furthest = cut.withColumn("__inside", inside).join(carried(cut, [], F.max("place"), "__before", None, F.max), "part")
        furthest = furthest.withColumn("__after", F.greatest("__inside", "__before")).drop("part", "__inside", "__before")
        behind = written(furthest.where("place <= __after").select("run", key, "__after"))
        if behind.isEmpty():
            return own.select("run", "place"), stopped
        on = (behind[key] == right[key]) & (right["place"] > behind["__after"])
        moved = behind.join(right, on, "left").groupBy(behind["run"], behind[key]).agg(F.min("place").alias("place"))
        matched = written(own.join(behind.select("run"), "run", "left_anti").unionByName(moved))


def merge_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str, absent: str = "fail") -> DataFrame:
    """Inner join of the runs of a key on the left with runs of the key on the right, by a cursor that only moves forward:
    a run takes the next run of its key behind what the run before took. absent: `fail` raises an error for a run that
    finds none, because its key is missing or the cursor is past it; `stop` gives what was joined before that run, since the
    cursor has then used up the right side. Columns of the right come after those of the left, without the key."""
    a, b = written(with_runs(left, left_order, key, "__run")), written(with_runs(right, right_order, key, "__place"))
    runs = lambda df, number, name: df.where(F.col(key).isNotNull()).select(F.col(number).alias(name), key).distinct()
    wanted = a.select(F.col("__run").alias("run"), key).distinct()
    found, lost = _forward(wanted, runs(b, "__place", "place"), key)
    if lost is not None and absent == "fail":
        missing = wanted.where(F.col("run") == lost).first()[key]
        raise ValueError(f"no row for {key} = {missing} after the rows joined before it")
    found = found.withColumnsRenamed({"run": "__run", "place": "__place"})
    taken = b.drop(key, right_order) if right_order in left.columns else b.drop(key)
    return a.join(found, "__run").join(taken, "__place").drop("__run", "__place")
