"""Shared pieces of the training-data operators.

Column rule of every operator here: a column that an operator adds replaces an input column of the same name
(names compare without case, as in Spark SQL); all other columns pass through unchanged.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of anything but blank and the five ASCII white-space controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared spark.checkpoint.dir (set here only where the session has none)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    return f"{root}/rankflow-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage, and survives the loss of executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of this session have BATCH_ROWS rows, unless it was given a number of its own: a batch, its
    results and their copies are held at once, outside the heap, by every task and by its Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))


def same_name(df: DataFrame, name: str) -> list[str]:
    return [c for c in df.columns if c.lower() == name.lower()]


def pruned_batches(batches, column: str, rows: int = 512):
    """Arrow batches of at most `rows` rows, so that a task's memory follows the text of a few hundred documents."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, part.column(column)


#: Longest key that a Memo remembers.
LONGEST_KEY = 64


_held: dict = {}


def held(key, make):
    """make(), remembered in this Python worker until it is asked for something else: a worker that Spark uses again for
    another operator doesn't keep what the one before had remembered."""
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


class Memo(dict):
    """compute(key) remembered for about 2 * size keys of at most LONGEST_KEY characters: a full generation becomes the
    old one, and what is used again moves to the new one."""

    def __init__(self, compute, size: int = 200_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > LONGEST_KEY:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
