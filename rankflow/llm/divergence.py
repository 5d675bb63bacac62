"""How far the words of each source of a language stand from its other sources and from the language as a whole.

A language keeps the terms of at least three of its documents. A group (a source of a language, or all of it) gives a
kept term p = 1 + floor(10**9 * (count + 1) / (N + V)), and f = floor((p - q)**2 / q) is how far p stands from q.

The tasks count terms of their own documents (mapInArrow), Spark sums them. Two sources are compared without writing
down the V terms that each lacks: their sum of f is V times f of two zero counts (the baseline), plus corrections for the
terms that either has, from the number of terms of each count, plus corrections for those that both have. The latter are
summed inside tasks, a row of sources for each term, so no pairs of a term are ever rows. The greatest f of a source's
terms against the language are found by radix select (`radix.top_k`).

Cases: null texts, languages and sources are empty strings; a row is a document, so repeated rows count each; sources
without a kept term stand in `pair` with the baseline, and with 0 where a language keeps nothing; a language of one source
has no pairs; ties rank by the item's UTF-8 bytes; an empty table has no rows; other columns are ignored. Counts may go up
to 9 * 10**15; beyond, sums raise an error.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm import radix
from rankflow.llm.common import pruned_batches, written

#: A term, among UTF-8 bytes of which A-Z are lower-cased: letters of ASCII and all that is beyond it.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms that a task holds at once; pairs of sources compared at once, and held.
TERMS_HELD, PAIRS_AT_ONCE, PAIRS_HELD = 300_000, 1 << 18, 200_000
LEAST_DOCUMENTS = 3
SCALE_BY, SCALE_STEPS = 1000, 3  # 10**9


def _count_terms(batches):
    """lang, source, term, n, documents of the rows of a task, in parts that fit its memory."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        groups = [(lang, source, len(n)) for (lang, source), (n, _) in held.items()]
        terms = [t for n, _ in held.values() for t in n]
        columns = [
            pa.array([x for lang, _, size in groups for x in [lang] * size], pa.string()),
            pa.array([x for _, source, size in groups for x in [source] * size], pa.string()),
            pa.array(terms, pa.binary()).cast(pa.string()),
            pa.array([c for n, _ in held.values() for c in n.values()], pa.int64()),
            pa.array([docs[t] for n, docs in held.values() for t in n], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "documents"])

    size = 0
    for batch, texts in pruned_batches(batches, "text"):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts.cast(pa.binary())):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            found = TERM.findall(text.as_py().lower())
            n.update(found)
            docs.update(set(found))
            size += len(n)
            if size > TERMS_HELD:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def scaled(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / total), three digits at a time, so that no product leaves a long."""
    rest, p = count + 1, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        p = p * SCALE_BY + _div(rest * SCALE_BY, total)
        rest = rest * SCALE_BY % total
    return 1 + p


def far(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, n (in all of lang), cells (source, n of each source that has it): a table of the terms kept."""
    counts = docs.mapInArrow(_count_terms, "lang string, source string, term string, n long, documents long")
    cells = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    terms = cells.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("cells"))  # a row for each source
    return written(terms.where(F.col("documents") >= least).drop("documents"))


def group_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, total (N + V), lang_total, v, p0 (p of a count of 0): one row for each group that occurs."""
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    own = terms.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("v").alias("v"), (zero("own_n") + zero("v")).alias("total"), (zero("lang_n") + zero("v")).alias("lang_total"))
    return written(groups.withColumn("p0", F.when(F.col("v") > 0, scaled(F.lit(0).cast("long"), F.col("total")))))


def _both_have(batches):
    """lang, source, item, value: partial sums of what the terms that both sources have add to the corrections made for
    each of the two alone. Rows: lang, cells of source, p, p0."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.int64())], names=["lang", "source", "item", "value"])

    for batch in batches:
        lists, langs = batch.column("cells"), batch.column("lang").dictionary_encode()
        cells, sizes = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
        sources = cells.field("source").dictionary_encode()
        p, p0 = (cells.field(c).to_numpy().astype(np.int64) for c in ("p", "p0"))
        source, lang = sources.indices.to_numpy().astype(np.int64), np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
        first, width = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)  # of each cell's row
        names, all_langs, many = sources.dictionary.to_pylist(), langs.dictionary.to_pylist(), len(sources.dictionary)
        ends = np.cumsum(width)
        start = 0
        while start < len(width):  # cells whose pairs fit in memory, one at least
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
            w = width[start:stop]
            a = np.repeat(np.arange(start, stop), w)
            b = np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[start:stop], w)
            a, b = a[a != b], b[a != b]
            f = lambda x, y: (x - y) * (x - y) // y
            value = f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b])
            pairs, at = np.unique((lang[a] * many + source[a]) * many + source[b], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, value)
            for pair, x in zip(pairs.tolist(), sums.tolist()):
                held[all_langs[pair // many // many], names[pair // many % many], names[pair % many]] += x
            start = stop
            if len(held) > PAIRS_HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: all other sources of each source's language, farthest first."""
    own = groups.select("lang", "source", "v", "total", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = own.join(other, "lang").where("source <> item")  # the pairs are the result
    base = base.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * far(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))

    counts = terms.select("lang", F.inline("cells")).groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    counts = radix.by_group(counts, own, ["lang", "source"]).withColumn("p", scaled(F.col("n"), F.col("total")))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    alone = counts.join(other, "lang").where("source <> item")
    alone = alone.select("lang", F.inline(F.array(
        F.struct("source", "item", (F.col("terms") * (far(p, q0) - far(p0, q0))).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * (far(q0, p) - far(q0, p0))).alias("value")),
    )))

    cells = radix.by_group(terms.select("lang", "term", F.inline("cells")), own, ["lang", "source"])
    rows = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", scaled(F.col("n"), F.col("total")).alias("p"), "p0")).alias("cells"))
    both = rows.where(F.size("cells") > 1).select("lang", "cells").mapInArrow(_both_have, "lang string, source string, item string, value long")

    total = base.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.withColumn("rank", F.row_number().over(order))


def source_terms(terms: DataFrame, groups: DataFrame, k: int, slack: int = radix.SLACK) -> DataFrame:
    """lang, source, item, value, rank: the k terms of each source that stand highest above their share of the language."""
    cells = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.inline("cells"))
    cells = radix.by_group(cells, groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    cells = cells.select("lang", "source", "item", scaled(F.col("n"), F.col("total")).alias("p"), scaled(F.col("lang_n"), F.col("lang_total")).alias("q")).where("p > q")
    values = written(cells.select("lang", "source", "item", far(F.col("p"), F.col("q")).alias("value")))
    return radix.top_k(values, ["lang", "source"], "value", "item", k, slack)


def audit_sources(df: DataFrame, k: int = 200, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    filled = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = df.select(filled(text, "text"), filled(lang, "lang"), filled(source, "source"))
    terms = kept_terms(docs, least)
    groups = group_totals(docs, terms)
    parts = {"pair": source_pairs(terms, groups), "term": source_terms(terms, groups, k)}
    both = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in parts.items()]
    return both[0].unionByName(both[1])


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 3),
c AS (SELECT t.lang, t.source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v, coalesce(any_value(s.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS HUGEINT) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT kept.lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 1)) // (l.n + l.v) AS HUGEINT) AS q FROM kept JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pairs.value, 0) AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u) WHERE part = 'pair' OR rank <= 200
"""
