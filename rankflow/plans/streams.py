"""Queries of the streaming operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.plans.fixtures import table
from rankflow.shared import shared_dir
from rankflow.streaming import incremental as I

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


@query("SELECT user_id FROM events GROUP BY 1")
def ss01_unseen_ids(spark, d):
    """SS01 to SS03: each user once, however often they come."""
    stream = I.read_stream(spark, f"{d}/events.parquet").select("user_id")
    return I.process_unseen(stream, "user_id", shared_dir(spark), lambda df: df)


@query("SELECT date_trunc('hour', ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def ss04_hourly_windows(spark, d):
    """Extension: tumbling windows over event time with a watermark."""
    stream = I.read_stream(spark, f"{d}/events.parquet", "ts").select("ts", "event_type")
    return I.counted_windows(stream, "ts", ["event_type"], "1 hour", None, "2 hours", shared_dir(spark)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT MIN(ts) AS start, user_id, COUNT(*) AS n FROM s GROUP BY user_id, k""")
def ss05_sessions(spark, d):
    """Extension: session windows."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.sessions(events, "ts", "user_id", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))
