"""Line deduplication by overlapping windows of three lines.

Lines are what stands between line feeds. Every three consecutive lines of a document are a window, known by its
128-bit hash. A window's first place is the one of the smallest doc_id (then text hash, then line); at every later place
its three lines are covered, and covered lines go, merged into one list for each document. Windows are judged on the
input. The lines left are joined by line feeds again.

Counting is a Spark aggregation with partial sums, so a window that a third of all documents share costs one row for
each task; the join that brings first places back to the windows is one that Spark splits when a key is hot.

Cases: null texts stay null and have no lines; an empty text has one line, which is empty; documents of under three
lines have no window and stay as they are; rows with equal doc_id and text are one document and get the same result;
equal doc_ids with different texts count as different documents; a null doc_id comes before all others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

LINES = 3


def _windows(docs: DataFrame, lines: int) -> DataFrame:
    """hash, doc, key, line (from 0) of every window."""
    split = docs.select("doc", "key", F.split("text", "\n").alias("lines")).where(F.size("lines") >= lines)
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (lines - 1)),
        lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, lines), "\n").cast("binary"))),
    )
    return split.select("doc", "key", F.posexplode(hashes).alias("line", "hash"))


def repeated_starts(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lines: int = LINES) -> DataFrame:
    """doc, key (of its text), starts: first lines of the windows that begin earlier elsewhere."""
    docs = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("text is not null")
    docs = docs.withColumn("key", F.xxhash64("text"))
    windows = _windows(docs, lines)
    place = F.struct("doc", "key", "line")
    first = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).select("hash", "first")
    later = windows.join(first, "hash").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc", "key").agg(F.collect_set("line").alias("starts"))


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lines: int = LINES) -> DataFrame:
    """df with kept_text, n_lines and n_removed (long)."""
    starts = repeated_starts(df, text, doc_id, lines)
    starts = starts.select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("starts").alias("__starts"))
    on = F.col(doc_id).eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__key"))

    @arrow_udf("struct<text:string,n_lines:long,n_removed:long>")
    def kept(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for x, own in zip(texts.to_pylist(), places.to_pylist()):
            if x is None or not own:
                out.append((x, 0 if x is None else x.count("\n") + 1, 0))
                continue
            covered = {i + k for i in own for k in range(lines)}
            all_lines = x.split("\n")
            out.append(("\n".join(line for i, line in enumerate(all_lines) if i not in covered), len(all_lines), len(covered)))
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
            names=["text", "n_lines", "n_removed"],
        )

    out = df.join(starts, on, "left").withColumn("__kept", kept(F.col(text), F.col("__starts")))
    out = out.drop("__doc", "__key", "__starts")
    out = out.withColumn("kept_text", F.col("__kept.text")).withColumn("n_lines", F.col("__kept.n_lines"))
    return out.withColumn("n_removed", F.col("__kept.n_removed")).drop("__kept")


ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS win
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (VALUES (0), (1), (2)) AS v(j)),
k AS (SELECT l.doc_id, string_agg(u.line, chr(10) ORDER BY u.i) AS text, count(*) AS n
      FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM l) u
      JOIN l ON l.doc_id = u.doc_id LEFT JOIN x ON x.doc_id = u.doc_id AND x.i = u.i WHERE x.i IS NULL GROUP BY l.doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(l.lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l.lines), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN k ON k.doc_id = l.doc_id
"""
