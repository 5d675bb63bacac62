"""Sequence operators: ranks, standardised values, streaks, baselines and state along ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.operators.ranges import quantiles, with_ranks


def average_rank(df: DataFrame, value: str, name: str, count: str) -> DataFrame:
    """name: rank of value, ties by their mean, null values without one; count: number of values (null where value is)."""
    return with_ranks(df, value, {"average": name, "count": count})


def row_mean(values: list[Column]) -> Column:
    """Mean of the values that are not null; null if none is."""
    total = sum((F.coalesce(x.cast("double"), F.lit(0.0)) for x in values), F.lit(0.0))
    return F.try_divide(total, sum((x.isNotNull().cast("int") for x in values), F.lit(0)).cast("double"))


def standardised(df: DataFrame, column: str, name: str, winsor: float | None = None, least: int = 5) -> DataFrame:
    """z-score over the whole table; null where the deviation is 0 or missing. winsor: values are first clipped to that
    quantile and its complement, if there are at least `least` values."""
    x = F.col(column)
    if winsor is not None:
        ends = quantiles(df, [], column, {"__lo": winsor, "__hi": 1 - winsor}).join(df.agg(F.count(column).alias("__n")))
        df = df.join(F.broadcast(ends))  # one row
        x = F.when(F.col("__n") >= least, F.least(F.greatest(x, F.col("__lo")), F.col("__hi"))).otherwise(x)
        x = F.when(F.col(column).isNotNull(), x)
    df = df.withColumn("__x", x)
    moments = df.agg(F.avg("__x").alias("__mean"), F.stddev_samp("__x").alias("__sd"))
    out = df.join(F.broadcast(moments)).withColumn(name, F.try_divide(F.col("__x") - F.col("__mean"), F.col("__sd")))  # one row
    return out.drop("__x", "__mean", "__sd", "__lo", "__hi", "__n")


def z_scores(df: DataFrame, columns: list[str], winsor: float | None = None, least: int = 5) -> dict[str, Column]:
    """The z-score of each column over the whole table, as an expression: null where the deviation is 0 or missing. Means
    and deviations of all columns come from one aggregate, quantiles (see `standardised`) from one more."""
    x = {c: F.col(c).cast("double") for c in columns}
    if winsor is not None:
        long = df.select(*(v.alias(c) for c, v in x.items())).unpivot([], columns, "column", "value")
        ends = quantiles(long, ["column"], "value", {"low": winsor, "high": 1 - winsor})
        ends = ends.join(long.groupBy("column").agg(F.count("value").alias("n")), "column").collect()  # a row for each column
        for row in ends:
            if row.n >= least:
                x[row["column"]] = F.when(F.col(row["column"]).isNotNull(), F.least(F.greatest(x[row["column"]], F.lit(row.low)), F.lit(row.high)))
    moments = df.agg(*(f(v).alias(f"{c}_{n}") for c, v in x.items() for n, f in (("mean", F.avg), ("sd", F.stddev_samp)))).first()
    return {c: (v - F.lit(moments[f"{c}_mean"])) / F.lit(moments[f"{c}_sd"]) if moments[f"{c}_sd"] else F.lit(None).cast("double") for c, v in x.items()}


def centred(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.join(F.broadcast(df.agg(F.avg(column).alias("__mean")))).withColumn(name, F.col(column) - F.col("__mean")).drop("__mean")  # one row


def lagged(df: DataFrame, keys: list[str], order: str, columns: list[str], prefix: str = "prev_", adjacent: bool = True) -> DataFrame:
    """Previous row's columns; adjacent: only if its order value is one less."""
    w = Window.partitionBy(*keys).orderBy(order)
    valid = F.lag(order).over(w) == F.col(order) - 1 if adjacent else F.lit(True)
    return df.withColumns({f"{prefix}{c}": F.when(valid, F.lag(c).over(w)) for c in columns})


def exclusive_sum(keys: list[str], order: list[str | Column], column: str | Column) -> Column:
    """Sum over the rows before this one; 0 on the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def ordinal(keys: list[str | Column], order: list[str | Column]) -> Column:
    """Number of rows before this one."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")


def streak(df: DataFrame, keys: list[str], order: str, state: Column, name: str) -> DataFrame:
    """Rows so far, this one included, that the state has been true without a break; 0 where it is not."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__s", F.coalesce(state, F.lit(False)))
    df = df.withColumn("__run", F.sum((~F.col("__s")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = F.sum(F.col("__s").cast("long")).over(Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.when(F.col("__s"), inside).otherwise(F.lit(0).cast("long"))).drop("__s", "__run")


def baseline(keys: list[str], order: str, column: str, first: int) -> Column:
    """Mean of column over the rows of a group with order up to first."""
    return F.avg(F.when(F.col(order) <= first, F.col(column))).over(Window.partitionBy(*keys))


def last_known(keys: list[str], order: str, value: Column, before: bool = False) -> Column:
    """Last value that is not null up to this row, or up to the one before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    return F.last(value, ignorenulls=True).over(w)


def event_time(df: DataFrame, keys: list[str], order: str, crossed: Column, low: int, high: int) -> DataFrame:
    """event_k: rows after the first crossed one, in order (negative before); rows outside low..high and groups without a
    crossing are dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__i", F.row_number().over(w).cast("long"))
    first = F.min(F.when(crossed, F.col("__i"))).over(Window.partitionBy(*keys))
    return df.withColumn("event_k", F.col("__i") - first).where(F.col("event_k").between(low, high)).drop("__i")
