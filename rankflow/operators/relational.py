"""Relational operators with the reference's order and null rules made explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part: sorts and aggregates of some columns over them take some hundred MB of a task.
PART_ROWS = 200_000


def in_parts(df: DataFrame, rows: int, keys: list[str], part_rows: int | None = None) -> DataFrame:
    """df, of so many rows, in parts of about part_rows rows (PART_ROWS, unless given), hash-partitioned by keys: what follows on these keys (joins,
    windows, aggregates) uses these parts, so that a task's memory does not grow with the table. Left to themselves,
    shuffles have a set number of partitions, and those are merged up to a size in bytes that sorted rows exceed many
    times. Tables so small that the cores' equal shares are no larger are left as they are."""
    session = df.sparkSession
    n = -(-rows // (part_rows or PART_ROWS))
    if n <= session.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(n, int(session.conf.get("spark.sql.shuffle.partitions"))), *keys)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key: the first in order (a total one, so that the result does not depend on partitions)."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) for c in order])


def join_dimension(facts: DataFrame, dimension: DataFrame, key: str, dimension_key: str, columns: list[str]) -> DataFrame:
    """Left join of many to one. A dimension with a key twice fails the job instead of multiplying rows."""
    n = F.count("*")
    one = dimension.groupBy(F.col(dimension_key).alias("__key")).agg(
        *(F.first(c).alias(c) for c in columns), F.when(n > 1, F.raise_error(F.concat(F.lit("key twice: "), F.first(dimension_key).cast("string"))).cast("int")).alias("__twice")
    )
    return facts.join(one, facts[key] == one["__key"], "left").where("__twice IS NULL").drop("__key", "__twice")


def union_fill(frames: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows by column name, missing columns null, with the name of the frame they come from."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(source, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def dense_panel(observed: DataFrame, left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Every pair of the distinct rows of two key tables, with observed's value or 0. The pairs are the result asked for;
    the keys themselves are what is observed against them."""
    keys = [*left.columns, *right.columns]
    return left.distinct().crossJoin(right.distinct()).join(observed, keys, "left").fillna(0, subset=[value])


def prefix_matches(left: DataFrame, right: DataFrame, left_text: str, right_text: str, on: list[str], least: int = 3) -> DataFrame:
    """Distinct pairs of texts, equal in on, one of whose words is a prefix of at least so many letters of a word of the
    other side: the prefixes of each side's words, up to the whole word, are joined with the other side's words. Each text
    enters once, so that rows that repeat it do not multiply the pairs."""

    def words(df: DataFrame, column: str, name: str) -> DataFrame:
        own = F.filter(F.split(F.lower(name), r"[^a-z]+"), lambda w: F.length(w) >= least)
        texts = df.select(*on, F.col(column).alias(name)).distinct()
        return texts.select(*on, name, F.explode(F.array_distinct(own)).alias("w"))

    def prefixes(word: DataFrame, name: str) -> DataFrame:
        ends = F.sequence(F.lit(least), F.length("w"))
        return word.select(*on, name, F.explode(F.transform(ends, lambda k: F.substring("w", 1, k))).alias("w"))

    a, b = words(left, left_text, "left_text"), words(right, right_text, "right_text")
    pairs = [x.join(y, [*on, "w"]).select(*on, "left_text", "right_text") for x, y in ((prefixes(a, "left_text"), b), (a, prefixes(b, "right_text")))]
    return pairs[0].unionByName(pairs[1]).distinct()


def band_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_value: str, right_value: str, width: float) -> DataFrame:
    """Pairs of rows with equal keys (left and right names) whose values differ by at most width: values fall into buckets
    of that width, a left row meets the rows of its own bucket and of both neighbours by equality, and the difference is
    tested then. Work follows the pairs of neighbouring buckets, not those of a key."""
    bucket = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(width)))
    near = left.where(F.col(left_value).isNotNull()).withColumn("__bucket", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: bucket(left_value) + k)))
    own = right.where(F.col(right_value).isNotNull()).withColumn("__own", bucket(right_value))
    met = F.col("__bucket") == F.col("__own")
    for a, b in on:
        met = met & (left[a] == right[b])
    return near.join(own, met & (F.abs(F.col(left_value) - F.col(right_value)) <= width)).drop("__bucket", "__own")


def fill_blanks(main: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge of two tables of one row for each key: main's values, blanks filled from other, new keys added."""
    blank = lambda c: F.when(F.trim(c) == "", None).otherwise(F.col(c))
    theirs = other.select(F.col(key), *(blank(c).alias(f"__{c}") for c in columns))
    out = main.join(theirs, key, "full_outer")
    return out.withColumns({c: F.coalesce(blank(c), f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Upsert that adds: counts of old and new rows by key."""
    return old.unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def replace_latest(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """Upsert that replaces: the values of the highest version of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), version).alias("__v")).select(*keys, "__v.*")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules broken: an empty result is a valid table."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where("size(broken) > 0")


def stacked_summaries(df: DataFrame, dimensions: list[str], aggregates: list[Column]) -> DataFrame:
    """One summary for each value of each dimension: dimension, value, aggregates; one pass (grouping sets)."""
    sets = [[F.col(c)] for c in dimensions]
    grouped = df.groupingSets(sets, *dimensions).agg(*aggregates, *(F.grouping(c).alias(f"__{c}") for c in dimensions))
    name = F.coalesce(*(F.when(F.col(f"__{c}") == 0, F.lit(c)) for c in dimensions))
    value = F.coalesce(*(F.when(F.col(f"__{c}") == 0, F.col(c).cast("string")) for c in dimensions))
    return grouped.withColumn("dimension", name).withColumn("value", value).drop(*dimensions, *(f"__{c}" for c in dimensions))


