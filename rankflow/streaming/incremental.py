"""Incremental processing with Structured Streaming: each id once, whole batches again after a failure, and windows.

The reference polls a growing file for ids it has not seen; here a file stream does, with its progress in a checkpoint.
Windows over event time are an extension."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.sources.sinks import VersionedTable


def read_stream(spark: SparkSession, path: str, time: str | None = None) -> DataFrame:
    """A stream of Parquet files under path (a folder, or one file), with the time column as a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    stream = stream.parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    return stream.withColumn(time, F.col(time).cast("timestamp")) if time else stream


def process_unseen(stream: DataFrame, key: str, path: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ids not in the table at path yet, transformed and added to it, in micro-batches until the input is read.
    A batch that failed runs again as a whole: its rows are found by batch number and written once."""
    spark = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(f"{path}/data").where(F.col("batch") != number).select(key), key, "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        transform(fresh).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/data").drop("batch")


def process_growing(games: DataFrame, key: Column, path: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One poll of files that grow: complete games (sources.files.read_complete_pgn) whose id is not in the table at path
    yet are transformed and committed to it as a new version; games still half-written come with a later poll, once. Ids
    that repeat in the input count once, games without one not at all. The table keeps the id as `game_id`."""
    table = VersionedTable(games.sparkSession, path)
    fresh = games.withColumn("game_id", key).where("game_id IS NOT NULL AND game_id <> ''").dropDuplicates(["game_id"])
    if table.version() is not None:
        fresh = fresh.join(table.read().select("game_id"), "game_id", "left_anti")
    table.append(transform(fresh))
    return table.read()


def counted_windows(stream: DataFrame, time: str, keys: list[str], width: str, slide: str | None, late: str, path: str) -> DataFrame:
    """start, keys, n of tumbling (or sliding) windows; the state of windows later than the watermark is dropped."""
    windows = F.window(time, width, slide) if slide else F.window(time, width)
    counts = stream.withWatermark(time, late).groupBy(windows.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
    where = f"{path}/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    updates = stream.sparkSession.read.parquet(f"{where}/out")
    return updates.groupBy("start", *keys).agg(F.max_by("n", "batch").alias("n"))  # the last update of each window


def sessions(df: DataFrame, time: str, key: str, gap: str) -> DataFrame:
    """start, key, n of sessions: runs of rows with no pause of the gap (batch or stream)."""
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
