"""Queries of sources and sinks: files that Spark writes from the test tables are read back, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.functions import scalar as S
from rankflow.plans.fixtures import table
from rankflow.shared import shared_dir
from rankflow.sources import files, sinks
from rankflow.streaming import incremental

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query("SELECT o_orderkey, ROUND(o_totalprice, 2)::DECIMAL(12, 2) AS o_totalprice, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 3 = 2 THEN [o_orderstatus, o_orderpriority] END AS tags FROM orders")
def sc17_union_by_name(spark, d):
    """CSV files of three headers, whose columns stand in other orders or are missing, as one table by name."""
    orders, path = table(spark, d, "orders"), shared_dir(spark)
    price = F.round("o_totalprice", 2).cast("decimal(12,2)").alias("o_totalprice")
    tags = F.to_json(F.array("o_orderstatus", "o_orderpriority")).alias("tags")
    for k, columns in enumerate([["o_orderkey", "o_custkey", price], [price, "o_orderkey"], [tags, "o_custkey", price, "o_orderkey"]]):
        orders.where(F.col("o_orderkey") % 3 == k).select(*columns).write.option("header", True).option("escape", '"').csv(f"{path}/{k}")
    schema = "o_orderkey long, o_totalprice decimal(12,2), o_custkey long, tags array<string>"
    return files.read_csv(spark, f"{path}/*", schema, required=["o_orderkey", "o_totalprice"], escape='"').drop("source_file")


@query("SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts, COUNT(*) AS n FROM lineitem GROUP BY 1")
def sk06_json_lines(spark, d):
    """Nested arrays written as JSON lines and read back."""
    path = shared_dir(spark)
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"), F.count("*").alias("n"))  # an order's lines
    sinks.write_json_lines(rows.select("l_orderkey", F.transform("lines", lambda x: F.array(x.l_linenumber, x.l_partkey)).alias("tokens"), "n"), path)
    back = files.read_json_lines(spark, path, "l_orderkey long, tokens array<array<long>>, n long")
    return back.select("l_orderkey", F.transform("tokens", lambda x: x[1]).alias("parts"), "n")


@query("SELECT o_orderkey, o_orderstatus, 4::BIGINT AS n_versions, 1::BIGINT AS n_folders FROM orders")
def sk08_shards(spark, d):
    """SK02 and SK08: shards appended to a table, then one folder in place of them; older versions stay readable."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    kept = sinks.VersionedTable(spark, shared_dir(spark))
    for k in range(3):
        kept.append(orders.where(F.col("o_orderkey") % 3 == k))
    last = kept.compact()
    return kept.read().select("*", F.lit(last + 1).cast("long").alias("n_versions"), F.lit(len(kept.folders())).cast("long").alias("n_folders"))


GAMES_SQL = "SELECT o_orderkey AS game_id, COUNT(*) AS n_moves FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


def _growing(spark, d, path, open_ended: bool):
    """A PGN file for each priority, of its orders in order; the last game of each is half-written, if open_ended."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    games = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderpriority", "n")
    last = games.groupBy(F.col("o_orderpriority").alias("__p")).agg(F.max("o_orderkey").alias("__last"))
    games = games.join(last, F.col("o_orderpriority") == F.col("__p"))
    moves = F.array_join(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.concat(i.cast("string"), F.lit(". e4"))), " ")
    head = F.concat(F.lit('[Event "order"]\n[Site "https://x.org/game/live/'), F.col("o_orderkey").cast("string"), F.lit('"]\n\n'))
    half = F.lit(open_ended) & (F.col("o_orderkey") == F.col("__last"))
    text = F.when(half & (F.col("o_orderkey") % 2 == 0), head).when(half, F.concat(head, F.lit("1. e"))).otherwise(F.concat(head, moves, F.lit(" *\n")))
    shards = games.select(F.crc32(F.col("o_orderpriority").cast("binary")).alias("shard"), "o_orderkey", text.alias("value")).repartition("shard").sortWithinPartitions("shard", "o_orderkey")
    shards.select("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)


@query(f"WITH g AS ({GAMES_SQL}) SELECT game_id, n_moves, (game_id IN (SELECT MAX(o_orderkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderpriority))::BIGINT + 1 AS poll FROM g")
def ss02_incomplete_tails(spark, d):
    """Two polls of growing game files: what is half-written at the first counts at the second, once."""
    path, out = shared_dir(spark), shared_dir(spark)
    for poll, open_ended in ((1, True), (2, False)):
        _growing(spark, d, f"{path}/{poll}", open_ended)
        games = files.read_complete_pgn(spark, f"{path}/{poll}")
        count = lambda df, p=poll: df.select("game_id", F.size(S.bare_moves("movetext")).cast("long").alias("n_moves"), F.lit(p).cast("long").alias("poll"))
        done = incremental.process_growing(games, S.game_number(F.col("headers")["Site"]), out, count)
    return done.withColumn("game_id", F.col("game_id").cast("long"))
