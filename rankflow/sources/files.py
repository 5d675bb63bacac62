"""Sources: checked CSV, game records (PGN), rating lists (XML), checkpoints. All are read by Spark, from any store."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType


def _typed(name: str, kind: DataType) -> Column:
    """A CSV cell as a value of any type: arrays, maps and structs are read as JSON; what is no such value is null."""
    cell = F.trim(F.col(f"`{name}`"))
    return (F.from_json(cell, kind) if isinstance(kind, (ArrayType, MapType, StructType)) else cell.try_cast(kind)).alias(name)


def read_csv(spark: SparkSession, path: str | list[str], schema: str, required: list[str] | None = None, **options) -> DataFrame:
    """CSV with a header, one file or a set of them. Columns come by name, whatever their order in each file: files of one
    header are one scan, and the scans are united by name. A column that a file lacks is null there; one of `required` (all
    of the schema's, unless given) is an error that tells what is missing, and where. `source_file` tells where a row is
    from. schema: names and types, such as `id long, price decimal(10,2), tags array<string>`."""
    fields = StructType.fromDDL(schema).fields
    needed = required if required is not None else [f.name for f in fields]
    out = None
    for header, files in headers_of(spark, path, **options).items():
        missing = sorted(set(needed) - set(header))
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)} in {files[0]}")
        raw = spark.read.options(**{**options, "header": True, "inferSchema": False}).schema(StructType([StructField(c, StringType()) for c in header])).csv(files)
        cells = [_typed(f.name, f.dataType) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        rows = raw.select(*cells, F.col("_metadata.file_path").alias("source_file"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no file with a header in {path}")
    return out


def headers_of(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"', encoding: str = "utf-8", **_) -> dict[tuple[str, ...], list[str]]:
    """The files of each distinct header, in order of their names. A file's header is its first line: the one of the least
    place, found by an aggregate over the lines of the first split, so that files are read by tasks, not by the driver."""
    lines = spark.read.options(encoding=encoding).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "row").alias("header"))
    out: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(first.collect(), key=lambda r: r.file_path):  # a row for each file, as the driver's list of files has
        names = next(csv.reader([row.header.removeprefix("\ufeff")], delimiter=sep, quotechar=quote), [])
        out.setdefault(tuple(name.strip() or f"_c{i}" for i, name in enumerate(names)), []).append(row.file_path)
    return out


def drop_index_column(df: DataFrame) -> DataFrame:
    """Without the first column, if it is an index that was written without a name."""
    first = df.columns[0]
    return df.drop(first) if first.startswith("Unnamed:") or first in ("", "_c0") else df


def separator_of(spark: SparkSession, path: str, candidates: str = ",;\t") -> str:
    """The candidate that occurs most often in the header line (the first of equals)."""
    row = spark.read.text(path).limit(1).collect()
    header = row[0].value if row else ""
    return max(candidates, key=header.count)


def decimal_comma(x: str | Column) -> Column:
    """1.234,5 as a double."""
    x = F.col(x) if isinstance(x, str) else x
    return F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def read_pgn(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """headers (map), movetext, source_file of each game. A game begins at its `[Event "` header, with or without an
    empty line before it; a game of which no movetext has come yet has an empty one."""
    text = spark.read.option("lineSep", '[Event "').text(path).select("value", F.col("_metadata.file_path").alias("source_file")).where(F.trim("value") != "")
    return _games(text)


def _games(text: DataFrame) -> DataFrame:
    """headers, movetext, source_file of texts that follow `[Event "`."""
    whole = F.concat(F.lit('[Event "'), F.replace("value", F.lit("\r"), F.lit("")))
    tag = r'(?m)^\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]\s*$'
    pair = lambda k: F.regexp_extract_all(whole, F.lit(tag), F.lit(k))
    entries = F.arrays_zip(pair(1).alias("key"), pair(2).alias("value"))
    first = F.filter(entries, lambda x, i: F.array_position(pair(1), x.key) == i + 1)  # of repeated keys, the first
    headers = F.map_from_entries(first)
    movetext = F.trim(F.regexp_replace(F.regexp_replace(whole, tag, ""), r"\s+", " "))
    return text.select(headers.alias("headers"), movetext.alias("movetext"), "source_file")


def read_complete_pgn(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Like read_pgn, of files that are still written: a game counts once its movetext is followed by a blank line, or
    another game by then. What stands after that at the end of a file is left for the next read."""
    text = spark.read.option("lineSep", '[Event "').text(path)
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    text = text.select("value", F.col("_metadata.file_path").alias("source_file"), place.alias("place")).where(F.trim("value") != "")
    ended = F.replace("value", F.lit("\r"), F.lit("")).rlike(r"(?s)^[^\n]*\n(?:\[[^\n]*\n)*\n+[^\s\[].*\n[ \t]*\n\s*$")
    last = text.groupBy("source_file").agg(F.max("place").alias("place"))
    open_tails = text.where(~ended).join(last, ["source_file", "place"], "left_semi").select("source_file", "place")  # one a file at most
    complete = text.join(open_tails, ["source_file", "place"], "left_anti")
    return _games(complete.select("value", "source_file"))


def read_rating_list(spark: SparkSession, path: str) -> DataFrame:
    """Players of an XML rating list, one element each; numbers as longs, blanks as null."""
    names = ["fideid", "name", "country", "sex", "title", "w_title"]
    numbers = ["rating", "rapid_rating", "blitz_rating", "birthday"]
    rows = spark.read.format("xml").option("rowTag", "player").schema(", ".join(f"{c} string" for c in names + numbers)).load(path)
    return rows.select(*(F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in names), *(F.trim(c).try_cast("long").alias(c) for c in numbers))


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """One JSON object a line; of a key's lines the first in the order of the text stays."""
    raw = spark.read.text(path).select("value", F.from_json("value", schema).alias("row")).where("row IS NOT NULL")
    if key is None:
        return raw.select("row.*")
    return raw.groupBy(F.col(f"row.{key}").alias("__key")).agg(F.min_by("row", "value").alias("row")).select("row.*")


def newest_checkpoints(spark: SparkSession, pattern: str) -> DataFrame:
    """worker, path: of files named worker_N_checkpoint_M.csv or .parquet the one of the highest M, CSV on ties."""
    files = spark.read.format("binaryFile").load(pattern).select("path")  # names only: the content column is pruned
    part = lambda k: F.regexp_extract("path", r"worker_(\d+)_checkpoint_(\d+)\.(csv|parquet)$", k)
    named = files.select("path", part(1).try_cast("long").alias("worker"), part(2).try_cast("long").alias("number"), (part(3) == "csv").alias("is_csv")).where("worker IS NOT NULL")
    return named.groupBy("worker").agg(F.max_by("path", F.struct("number", "is_csv")).alias("path"))
