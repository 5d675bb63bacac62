"""The first k rows of every group, by value and then by text, without sorting a group.

Radix select: a histogram of the high bits of the values of each group finds the bucket that holds the k-th; the next
bits are looked at inside that bucket only, until it is small or its values are all equal. Equal values are told apart
by the UTF-8 bytes of their texts in the same way: first the bytes that all of them share are skipped (what the least
and the greatest share), then a histogram of the next bytes is taken. What stands before the edge found, and the few
rows of its bucket, are ranked at last. Histograms are aggregates with partial sums, so a group that holds a third of
all rows is counted by all tasks; at most `slack` rows of a group besides the first k meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.common import written

#: Bits of a value, and bytes of a text, that a histogram looks at.
DIGIT_BITS, DIGIT_BYTES = 16, 2
#: A bucket of at most so many rows is ranked as it is.
SLACK = 2000
#: Groups whose edges are sent to every task; with more of them they are joined by shuffle.
BROADCAST_GROUPS = 20_000


def by_group(rows: DataFrame, of_groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of a table of one row a group: sent to all tasks if it has few rows, else joined by
    shuffle, where adaptive execution splits what a hot group holds."""
    few = of_groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(of_groups) if few else of_groups, keys)


def _bucket(hist: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """keys, digit, n, need: the bucket that holds a group's need-th row, and how many of its rows are still wanted."""
    so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hist = hist.withColumn("so_far", so_far).where((F.col("so_far") >= F.col("need")) & (F.col("so_far") - F.col("n") < F.col("need")))
    return hist.withColumn("need", F.col("need") - (F.col("so_far") - F.col("n"))).drop("so_far")


def _shared_bytes(a: Column, b: Column) -> Column:
    """Number of leading bytes that two binaries share."""
    least = F.least(F.octet_length(a), F.octet_length(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), least), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), True)
    return F.when(least == 0, 0).when(differs == 0, least).otherwise(differs - 1).cast("int")


def top_k(df: DataFrame, keys: list[str], value: str, text: str, k: int, slack: int = SLACK) -> DataFrame:
    """df's rows with `rank` (int, from 1) of the first k of each group: value (a long of 0 or more) descending, then text
    ascending by UTF-8 bytes. Keys are not null and texts differ within a group; df is a table, since it is read once for
    each histogram. Ties that share long beginnings take more histograms; none is cut."""
    none = F.lit(None).cast("binary").alias("upto"), F.lit(False).alias("whole")
    total = written(df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(value).alias("highest")))
    edge = written(total.select(*keys, F.lit(0).cast("long").alias("low"), F.when(F.col("n") > k, k).cast("long").alias("need"), "n", *none))
    bits = max(0, (total.agg(F.max("highest")).first()[0] or 0).bit_length() - DIGIT_BITS)
    width = 63  # bits of a bucket: all that a value has, at first

    def unsettled() -> DataFrame:
        return edge.where(F.col("need").isNotNull() & (F.col("n") > slack))

    def settle(found: DataFrame) -> DataFrame:
        return written(edge.join(unsettled().select(*keys), keys, "left_anti").unionByName(found))

    while width and not unsettled().isEmpty():
        inside = by_group(df, unsettled().select(*keys, "low", "need"), keys).where(F.shiftright(value, width) == F.shiftright("low", width))
        digit = F.shiftright(F.col(value) - F.col("low"), bits)
        found = _bucket(inside.groupBy(*keys, "low", "need", digit.alias("digit")).agg(F.count("*").alias("n")), keys, F.desc("digit"))
        edge = settle(found.select(*keys, (F.col("low") + F.shiftleft("digit", bits)).alias("low"), "need", "n", *none))
        width, bits = bits, max(0, bits - DIGIT_BITS)
    raw = F.encode(F.col(text), "utf-8")
    begin = F.substring(raw, F.lit(1), F.octet_length("upto"))
    while not unsettled().isEmpty():
        ties = by_group(df, unsettled().drop("n", "whole"), keys).where((F.col(value) == F.col("low")) & (F.col("upto").isNull() | (begin == F.col("upto"))))
        ends = ties.groupBy(*keys).agg(F.min(raw).alias("a"), F.max(raw).alias("b"))
        shared = by_group(ends.select(*keys, _shared_bytes(F.col("a"), F.col("b")).alias("shared")), unsettled().drop("n", "whole"), keys)
        ties = by_group(df, written(shared), keys).where((F.col(value) == F.col("low")) & (F.col("upto").isNull() | (begin == F.col("upto"))))
        digit = F.substring(raw, F.lit(1), F.col("shared") + DIGIT_BYTES)
        found = _bucket(ties.groupBy(*keys, "low", "need", "shared", digit.alias("digit")).agg(F.count("*").alias("n")), keys, F.asc("digit"))
        edge = settle(found.select(*keys, "low", "need", "n", F.col("digit").alias("upto"), (F.octet_length("digit") < F.col("shared") + DIGIT_BYTES).alias("whole")))
    before = F.col("upto").isNull() | F.when(F.col("whole"), raw <= F.col("upto")).otherwise(begin <= F.col("upto"))
    near = by_group(df, edge.drop("need", "n"), keys).where((F.col(value) > F.col("low")) | ((F.col(value) == F.col("low")) & before)).drop("low", "upto", "whole")
    order = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(text))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
