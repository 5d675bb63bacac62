"""Entity resolution: matching people across name lists by variants, tiers and supporting evidence.

Candidates come from equality joins on exploded keys, never from comparing all pairs. Results are one row for each left
entity; ties are left unresolved with their number, not broken by chance.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from rankflow.functions.scalar import flag
from rankflow.operators.ranges import carried, cut_by_range


def blank_to_null(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.trim(x) != "", x)


def upsert_requests(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each case-folded key: for every column the first value that is not blank."""
    first = lambda c: F.min_by(c, F.when(blank_to_null(c).isNotNull(), F.col(order)))
    return df.groupBy(F.lower(F.trim(key)).alias(key)).agg(*(first(c).alias(c) for c in columns))


def match_by_forms(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_forms: Column, right_forms: Column, on: list[str] | None = None) -> DataFrame:
    """left_id, right_id and the forms they share (variants exploded on both sides and joined by equality)."""
    on = on or []
    a = left.select(left_id, *on, F.explode(F.array_distinct(left_forms)).alias("form"))
    b = right.select(right_id, *on, F.explode(F.array_distinct(right_forms)).alias("form"))
    return a.join(b, [*on, "form"]).groupBy(left_id, right_id).agg(F.sort_array(F.collect_set("form")).alias("shared"))  # forms of one pair


def match_in_tiers(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, Column, Column]]) -> DataFrame:
    """Every left entity's matches of its best tier (name, left key, right key): earlier tiers win. A null key matches
    nothing."""
    out = None
    for number, (name, a, b) in enumerate(tiers):
        own = left.select(left_id, a.alias("k")).join(right.select(right_id, b.alias("k")), "k").select(left_id, right_id, F.lit(number).alias("__tier"), F.lit(name).alias("tier"))
        out = own if out is None else out.unionByName(own)
    best = F.min("__tier").over(Window.partitionBy(left_id))
    return out.withColumn("__best", best).where(F.col("__tier") == F.col("__best")).drop("__tier", "__best").distinct()


def resolve_unique(candidates: DataFrame, left_id: str, payload: str, preferred: Column) -> DataFrame:
    """left_id, value, status: the payload if all candidates agree, else if those preferred agree, else null with
    `ambiguous:n` of its n different values."""
    chosen = candidates.withColumn("__p", F.when(preferred, F.col(payload)))
    n, m = F.count_distinct(payload), F.count_distinct("__p")
    status = F.when(n == 1, F.lit("unique")).when(m == 1, F.lit("preferred")).when(n == 0, F.lit("empty")).otherwise(F.concat(F.lit("ambiguous:"), n.cast("string")))
    return chosen.groupBy(left_id).agg(F.when(n == 1, F.min(payload)).when(m == 1, F.min("__p")).alias("value"), status.alias("status"))


def match_strength(a: Column, b: Column) -> Column:
    """Of two folded names: 3 equal, 2 one begins with the other as whole words, 1 first and last words agree, else 0."""
    starts = F.startswith(F.concat(a, F.lit(" ")), F.concat(b, F.lit(" "))) | F.startswith(F.concat(b, F.lit(" ")), F.concat(a, F.lit(" ")))
    first, last = (lambda x: F.element_at(F.split(x, " "), 1)), (lambda x: F.element_at(F.split(x, " "), -1))
    ends = (first(a) == first(b)) & (last(a) == last(b))
    return F.when(a == b, 3).when(starts, 2).when(ends, 1).otherwise(0).cast("long")


def select_with_margin(candidates: DataFrame, left_id: str, right_id: str, score: str, tie: str, strong: float, weak: float) -> DataFrame:
    """Best candidate of each entity by score, then tie (both falling), with its margin over the runner-up and a label:
    `only`, `clear` (margin of strong at least), `likely` (weak at least), else `unsure` and no candidate."""
    w = Window.partitionBy(left_id).orderBy(F.desc(score), F.desc(tie), right_id)
    ranked = candidates.withColumn("__k", F.row_number().over(w)).where("__k <= 2")
    out = ranked.groupBy(left_id).agg(F.max(F.when(F.col("__k") == 1, F.col(right_id))).alias("chosen"), (F.max(F.when(F.col("__k") == 1, F.col(tie))) - F.max(F.when(F.col("__k") == 2, F.col(tie)))).alias("margin"), F.count("*").alias("__n"))
    label = F.when(F.col("__n") == 1, "only").when(F.col("margin") >= strong, "clear").when(F.col("margin") >= weak, "likely").otherwise("unsure")
    return out.withColumn("confidence", label).withColumn("chosen", F.when(F.col("confidence") != "unsure", F.col("chosen"))).drop("__n")


def _last_double(holds: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """The greatest double for which holds is true, for each of n elements, found by halves; holds is true up to some
    double and false beyond it (-inf if it is never true)."""

    def double(at: np.ndarray) -> np.ndarray:  # whole numbers in the order of the doubles
        return np.where(at >= 0, at, at ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64)

    top = np.array([np.inf]).view(np.int64)[0]
    low, high = np.full(n, -top - 1), np.full(n, top)
    while (low < high).any():
        middle = (low | high) - ((low ^ high) >> 1)  # half of the sum, rounded up
        true = holds(double(middle))
        low, high = np.where(true, middle, low), np.where(true, high, np.maximum(middle - 1, low))
    return double(low)


def _last_below(value: Column, width: float, inside: bool) -> Column:
    """The greatest double x with x - value <= width (inside) or x - value < -width, by the very subtraction of doubles."""

    @arrow_udf("double")
    def last(column: pa.Array) -> pa.Array:
        own = column.to_numpy(zero_copy_only=False)
        holds = (lambda x: x - own <= width) if inside else (lambda x: x - own < -width)
        with np.errstate(all="ignore"):
            return pa.array(_last_double(holds, len(own)), mask=np.array(column.is_null()))

    return last(value)


def leading_in_bands(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: tuple[str, str], left_value: str, right_value: str, width: float, evidence: Column) -> DataFrame:
    """left_id, left_value, right_id, right_value, evidence: of all pairs with equal keys (on: left and right name), those
    that can be among the two best of a left row when the score depends on evidence (a condition on right's row) and on
    whether the values differ by at most width, and ties go to the greater right value, then the lesser right_id (a whole
    number). These are the two greatest right values above the band, inside it and below it, with and without evidence:
    twelve at most for a left row, found by one order of right's values and the bands' ends, never by pairing. left_id is
    a key of left; null values are below every band, NaN above."""
    keys, value = ["__key", "__kind"], F.col(left_value)
    wide = lambda x: x.cast("double")
    here = right.where(F.col(on[1]).isNotNull()).select(
        F.col(on[1]).alias("__key"), flag(evidence).alias("__kind"), F.struct(wide(F.col(right_value)).alias("v"), (-F.col(right_id)).alias("id"), F.lit(0).alias("end")).alias("__at"),
        F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), F.lit(None).cast("double").alias(left_value), F.lit(None).cast("string").alias("__band"),
    )
    end = lambda name, at: F.struct(F.lit(name).alias("__band"), at.alias("v"))
    ends = left.where(F.col(on[0]).isNotNull()).select(F.col(on[0]).alias("__key"), left_id, wide(value).alias(left_value)).select(
        "*", _last_below(value, width, True).alias("__inside"), _last_below(value, width, False).alias("__below")
    )
    ends = ends.select("__key", left_id, left_value, F.inline(F.array(end("above", F.lit(float("nan"))), end("inside", F.col("__inside")), end("below", F.col("__below")))))
    ends = ends.withColumn("__kind", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    ends = ends.withColumn("__at", F.struct(F.col("v"), F.lit(2**63 - 1).alias("id"), F.lit(1).alias("end"))).drop("v")
    cut = cut_by_range(here.unionByName(ends), keys, "__at").withColumn("__own", F.when(F.col("__band").isNull(), F.col("__at")))
    before = Window.partitionBy("part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)

    def greatest_before(rows: DataFrame, column: str, name: str) -> DataFrame:
        earlier = carried(rows, keys, F.max(column), "__earlier", None, F.max)
        return rows.withColumn(name, F.max(column).over(before)).join(earlier, ["part", *keys]).withColumn(name, F.coalesce(name, "__earlier")).drop("__earlier")

    first = greatest_before(cut, "__own", "__next").withColumn("__two", F.when(F.col("__own").isNotNull(), F.struct(F.col("__own").alias("a"), F.col("__next").alias("b"))))
    found = greatest_before(first, "__two", "__found").where("__band IS NOT NULL")
    pairs = found.select(left_id, left_value, "__band", (F.col("__kind") == 1).alias("evidence"), F.explode(F.array("__found.a", "__found.b")).alias("__r")).where("__r IS NOT NULL")
    gap = F.col("__r.v") - F.col(left_value)
    band = F.when(F.coalesce(F.abs(gap) <= width, F.lit(False)), "inside").when(F.coalesce(gap < -width, F.lit(False)) | F.col("__r.v").isNull(), "below").otherwise("above")
    return pairs.where(band == F.col("__band")).select(left_id, left_value, (-F.col("__r.id")).alias(right_id), F.col("__r.v").alias(right_value), "evidence")


def support_score(evidence: list[tuple[Column, int]]) -> Column:
    """Sum of the weights of the conditions that hold; unknown ones count nothing."""
    return sum((F.when(c, F.lit(w)).otherwise(0) for c, w in evidence), F.lit(0)).cast("long")


def user_name_match(user_words: Column, name_words: Column) -> Column:
    """`all` if every word of the name is one of the user's, `surname` if its last word is and the user's words hold the
    initial of its first, else null."""
    words = F.filter(name_words, lambda x: x != "")
    whole = F.forall(words, lambda x: F.array_contains(user_words, x)) & (F.size(words) > 1)
    last = F.array_contains(user_words, F.element_at(words, -1))
    initial = F.exists(user_words, lambda x: F.startswith(x, F.substring(F.element_at(words, 1), 1, 1)) & (x != F.element_at(words, -1)))
    return F.when(whole, "all").when(last & initial, "surname")


def cascade(sources: list[tuple[str, Column, str]], unknown: str = "unknown") -> Column:
    """struct<value, source, confidence> of the first source (name, value, confidence) with a value."""
    field = lambda v, s, c: F.struct(v.cast("string").alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence"))
    return F.coalesce(*(F.when(v.isNotNull(), field(v, s, c)) for s, v, c in sources), field(F.lit(unknown), "none", "none"))


def modal_value(df: DataFrame, key: str, value: str, strength: Column) -> DataFrame:
    """Most frequent value of each key; on ties the one of the greatest strength, then the least value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__n"), F.max(strength).alias("__s"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("__n"), -F.col("__s"), value)).alias(value))


def lookup_first(df: DataFrame, key: str, order: str, columns: list[str], per_field: bool) -> DataFrame:
    """A lookup table: the first row of each key, or, per field, the first value that is not blank."""
    if per_field:
        return df.groupBy(key).agg(*(F.min_by(c, F.when(blank_to_null(F.col(c).cast("string")).isNotNull(), F.col(order))).alias(c) for c in columns))
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("__r")).select(key, "__r.*")
