"""Sinks: text with fixed columns and numbers, replacing writes, run summaries."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def number_text(name: str):
    """Six decimals without trailing zeros; NaN, infinities and null are blank."""
    x = F.col(name)
    trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""), r"\.$", "")
    return F.when(x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")), "").when(trimmed == "-0", "0").otherwise(trimmed).alias(name)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    cells = [number_text(c) if dict(df.dtypes)[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    df.select(*cells).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


class VersionedTable:
    """A table of Parquet files that is never absent or half-written: data folders are written first and never changed; a
    manifest names the folders of a version, and the version that counts is the highest that has a manifest. A manifest
    is one file of one row, which Spark moves to its place when it is whole, so that move is the commit.
    Readers of an older version keep their files. Two writers of one version: the second fails, as the
    manifest's folder exists by then."""

    MANIFEST = "version long, folders array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest/*")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def version(self) -> int | None:
        manifests = self._manifests()
        return None if manifests is None else manifests.agg(F.max("version")).first()[0]

    def folders(self, version: int | None = None) -> list[str]:
        """Data folders of a version (the latest, unless given)."""
        version = self.version() if version is None else version
        manifests = self._manifests()
        rows = [] if manifests is None else manifests.where(F.col("version") == version).collect()
        if not rows:
            raise ValueError(f"no version {version} of {self.path}")
        return list(rows[0].folders)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{x}" for x in self.folders(version)))

    def _commit(self, folders: list[str], version: int) -> int:
        row = self.spark.createDataFrame([(version, folders)], self.MANIFEST)
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/{version}")
        return version

    def _write(self, df: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def replace(self, df: DataFrame) -> int:
        """df in place of what the table holds; df may read the table. Returns the new version."""
        before = self.version()
        return self._commit([self._write(df)], 0 if before is None else before + 1)

    def append(self, df: DataFrame) -> int:
        """df as another shard; nothing that is there is read or moved."""
        before = self.version()
        return self._commit([*([] if before is None else self.folders(before)), self._write(df)], 0 if before is None else before + 1)

    def compact(self, files: int | None = None) -> int:
        """All shards combined into one folder of so many files (what adaptive execution chooses, unless given)."""
        rows = self.read()
        return self.replace(rows.repartition(files) if files else rows.hint("rebalance"))


def replace_table(df: DataFrame, path: str) -> None:
    """df as the next version of the table at path, which df may read."""
    VersionedTable(df.sparkSession, path).replace(df)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, nested arrays and structs as they are, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def rewrite_columns(df: DataFrame, new: dict, after: str) -> DataFrame:
    """new columns in place of old ones of the same name, all standing after an anchor column."""
    rest = [c for c in df.columns if c not in new]
    at = rest.index(after) + 1
    return df.withColumns(new).select(*rest[:at], *new, *rest[at:])


def write_with_summary(df: DataFrame, path: str, parameters: dict) -> str:
    """Write, and return counts of rows and of blank cells with the parameters as JSON, counted while writing."""
    seen = Observation("summary")
    df.observe(seen, F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns)).write.mode("overwrite").parquet(path)
    return json.dumps({"parameters": parameters, **seen.get}, sort_keys=True)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """A small result as Markdown."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in cells) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows)])
