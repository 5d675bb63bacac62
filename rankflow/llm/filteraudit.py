"""Interaction of filters: what each filter removes, for every order in which the filters may be applied.

Which filters a text fails is a mask of five bits. A table of 32 masks by 120 orders holds the step at which a mask is
removed first. Inside tasks (mapInArrow) rows index that table and `np.bincount` adds up removals by part, order, step
and label; the tasks' partial arrays are summed by Spark.

Before that, rows are counted by text hash, part, labels and mask, with partial sums: a text that a third of all rows
share is a few rows then. The identical-text filter needs the least doc_id of a text hash, found by a window over those
counts. Texts never move, only their SHA-256.

Cases: a null text is an empty one and identical to empty ones; a null part is the empty string; a null doc_id is less
than all others; rows of equal doc_id are not identical to a *smaller* one, so all of them count as first; of repeated
rows of labels any that says 1 counts, a missing or null label says nothing; an empty table has no parts and no rows;
all other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: FILTER_AT[order, step]: bit number of the filter applied there.
FILTER_AT = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
#: FIRST_FAILURE[mask, order]: step at which a mask is removed, STEPS if never.
FIRST_FAILURE = np.array([[next((s for s, f in enumerate(own) if mask >> f & 1), STEPS) for own in FILTER_AT] for mask in range(1 << STEPS)])

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
PARTIAL = f"part string, filter_order string, step int, {', '.join(f'{m} long' for m in MEASURES)}"
#: Parts whose partial arrays a task holds at once.
PARTS_HELD = 256


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: A few words, B repetitive, C capitals, D markup characters."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        F.length(F.translate(text, "[#$%&*|]", "")) < F.length(text),
    ]
    return sum((F.when(fail, 1 << bit).otherwise(0) for bit, fail in enumerate(fails)), F.lit(0))


def labelled_masks(docs: DataFrame, labels: DataFrame, part: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """part, mask, good, toxic, n: numbers of documents."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(whole).alias("mask"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("hash"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    told = labels.groupBy(F.col("doc_id").alias("__doc")).agg(flag("quality"), flag("toxic"))
    rows = rows.join(told, F.col("doc") == F.col("__doc"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    keys = ["hash", "part", "quality", "toxic", "mask"]
    by_doc = rows.groupBy("doc", *keys).agg(F.count("*").alias("n"))  # more than one only where a row is repeated
    by_text = by_doc.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.struct("doc", "n")).alias("first"))
    least = F.min("first.doc").over(Window.partitionBy("hash"))  # parts times labels: few rows for a hash
    null_first = F.max(F.col("first.doc").isNull()).over(Window.partitionBy("hash"))
    is_first = F.when(null_first, F.col("first.doc").isNull()).otherwise(F.col("first.doc") == least)
    split = by_text.withColumn("firsts", F.when(is_first, F.col("first.n")).otherwise(F.lit(0)))
    same = 1 << FILTERS.index("E")
    return split.select(
        "part", F.col("quality").alias("good"), "toxic",
        F.inline(F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + same).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))),
    ).where("n > 0").select("part", "mask", "good", "toxic", "n")


def _measures(counts: np.ndarray) -> list[np.ndarray]:
    """MEASURES by order and step, from counts[order, step or never, good, toxic] and the numbers of each mask."""
    by_label, by_mask = counts
    removed = by_label.sum(axis=(2, 3))
    kept = removed[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    masks = np.arange(1 << STEPS)
    fails = np.array([by_mask[masks >> f & 1 == 1].sum() for f in range(STEPS)])
    only = np.array([by_mask[1 << f] for f in range(STEPS)])
    removed = removed[:, :STEPS]
    whole = np.zeros(STEPS, np.int64)
    np.add.at(whole, FILTER_AT, removed)
    return [kept, removed, fails[FILTER_AT] - removed, only[FILTER_AT], by_label[:, :STEPS, 1].sum(axis=2), by_label[:, :STEPS, :, 1].sum(axis=2), whole[FILTER_AT]]


def _partial_rows(held: dict) -> pa.RecordBatch:
    cells = len(ORDERS) * STEPS
    columns = [np.concatenate([m.ravel() for m in own]) for own in zip(*(_measures(c) for c in held.values()))]
    names = ["part", "filter_order", "step"]
    places = [
        pa.array([part for part in held for _ in range(cells)], pa.string()),
        pa.array([order for order in ORDERS for _ in range(STEPS)] * len(held), pa.string()),
        pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS) * len(held))),
    ]
    return pa.RecordBatch.from_arrays([*places, *(pa.array(c.astype(np.int64)) for c in columns)], names=[*names, *MEASURES])


def _removals(batches):
    """Partial measures of a task's rows of part, mask, good, toxic, n. Sums of doubles are exact below 2**53."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    shape = (len(ORDERS), STEPS + 1, 2, 2)
    orders = np.arange(len(ORDERS)) * (STEPS + 1)
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        which = parts.indices.to_numpy()
        mask, good, toxic, n = (batch.column(c).to_numpy() for c in ("mask", "good", "toxic", "n"))
        for i, part in enumerate(parts.dictionary.to_pylist()):
            own = which == i
            m, weight = mask[own], n[own].astype(float)
            cells = (orders + FIRST_FAILURE[m]) * 4 + (2 * good[own] + toxic[own])[:, None]
            by_label = np.bincount(cells.ravel(), np.repeat(weight, len(ORDERS)), minlength=int(np.prod(shape))).astype(np.int64).reshape(shape)
            by_mask = np.bincount(m, weight, minlength=1 << STEPS).astype(np.int64)
            old = held.get(part)
            held[part] = (by_label, by_mask) if old is None else (old[0] + by_label, old[1] + by_mask)
            if len(held) >= PARTS_HELD:
                yield _partial_rows(held)
                held = {}
    if held:
        yield _partial_rows(held)


def audit(docs: DataFrame, labels: DataFrame, part: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each
    part, each of the 120 orders and each of its five steps."""
    partial = labelled_masks(docs, labels, part, text, doc_id).mapInArrow(_removals, PARTIAL)
    return partial.groupBy("part", "filter_order", "step").agg(*(F.sum(m).alias(m) for m in MEASURES))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
  100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, min(w.doc_id) OVER (PARTITION BY t) < w.doc_id AS e FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
m AS (SELECT part, good, toxic, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v),
o AS (SELECT a.v || b.v || c.v || d.v || e.v AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT part, filter_order, step, good, toxic, n, fails[substr(filter_order, step, 1)] AS here,
    len(list_filter(range(1, step), lambda i: fails[substr(filter_order, i, 1)])) > 0 AS before,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda v: fails[v])) AS failed
  FROM m, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS v,
  sum(CASE WHEN NOT here AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND NOT before THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN here AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN here AND NOT before THEN n * good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT before THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, v) AS BIGINT) AS shapley FROM r
"""
