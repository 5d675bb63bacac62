"""Competition-shaped views of the test tables, as DataFrames and as the same views in SQL (for the twins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankflow.operators import swiss
from rankflow.operators.relational import in_parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game per row: users who have a k-th event on the same day, paired in the order of their ids."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts", F.to_date("ts").alias("tournament"))
    rounds = events.withColumn("round", F.row_number().over(Window.partitionBy("user_id", "tournament").orderBy("ts", "event_id")))
    seats = Window.partitionBy("tournament", "round").orderBy("user_id")
    seated = rounds.select(
        "tournament", F.col("round").cast("long").alias("round"), F.col("user_id").alias("white"), F.lead("user_id").over(seats).alias("black"),
        F.col("value").alias("white_value"), F.lead("value").over(seats).alias("black_value"), F.row_number().over(seats).alias("k"),
    )
    gap = F.col("white_value") - F.col("black_value")
    half = F.when(F.abs(gap) <= 5, 1).when(gap > 0, 2).otherwise(0)
    return seated.where("k % 2 = 1 AND black IS NOT NULL").withColumn("white_half", half.cast("long")).drop("k")


def rating(player: str):
    return 1500 + (F.col(player) * 37) % 900


def player_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = pairings(spark, sf_dir).withColumns({"white_rating": rating("white"), "black_rating": rating("black")})
    rows = swiss.two_sided(games, ["tournament", "round"], "white", "black", "white_half", 2, {"accuracy": ("white_value", "black_value"), "rating": ("white_rating", "black_rating")})
    return rows.drop("opp_accuracy").withColumn("post", F.when(F.col("tournament") >= F.lit("2024-01-16").cast("date"), 1).otherwise(0).cast("long"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One move per row: an order's lines in order, with evaluations and clocks that run through the game. The parts of
    games have a bounded number of rows, and all that follows by game stays in them."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"]
    lines = in_parts(lines.select(*columns), lines.count(), ["l_orderkey"])  # a count reads the files' footers
    own = Window.partitionBy("game_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    base = lines.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("game_id"), "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("o_custkey") % 75).alias("white"), (75 + F.col("o_orderkey") % 75).alias("black"),
        F.when(F.col("o_orderdate") >= F.lit("1998-09-01").cast("timestamp_ntz"), 1).otherwise(0).cast("long").alias("post"),
        (60 - F.floor("l_extendedprice") % 300).alias("gain"), F.floor("l_quantity").alias("time_spent"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long").alias("is_capture"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).cast("long").alias("gives_check"),
    )
    base = base.withColumn("ply", F.row_number().over(own).cast("long")).withColumn("is_white_move", F.col("ply") % 2)
    game = Window.partitionBy("game_id").orderBy("ply")
    side = Window.partitionBy("game_id", "is_white_move").orderBy("ply")
    gain = F.when(F.col("is_white_move") == 1, F.col("gain")).otherwise(-F.col("gain"))
    base = base.withColumn("signed", gain)
    so_far = Window.unboundedPreceding, Window.currentRow
    base = base.withColumn("eval_after_white", F.sum("signed").over(game.rowsBetween(*so_far))).withColumns({"used": F.sum("time_spent").over(side.rowsBetween(*so_far)), "own_no": F.row_number().over(side).cast("long")})
    clock = F.greatest(F.lit(0), F.when(F.col("post") == 1, 70 - F.col("used")).otherwise(40 + F.col("own_no") - F.col("used")))
    return base.select(
        "game_id", "ply", F.floor((F.col("ply") + 1) / 2).alias("fullmove"), "is_white_move", "white", "black", "post", "is_capture", "gives_check", "time_spent",
        F.when(F.col("is_white_move") == 1, F.col("white")).otherwise(F.col("black")).alias("mover"),
        (F.col("eval_after_white") - F.col("signed")).alias("eval_before_white"), "eval_after_white",
        F.greatest(F.lit(0).cast("long"), -F.col("gain")).alias("cp_loss"), clock.cast("long").alias("time_after"),
    )


PAIRINGS_SQL = """
ev AS (SELECT event_id, user_id, value, CAST(ts AS DATE) AS tournament,
  ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS round FROM events),
seat AS (SELECT ev.*, ROW_NUMBER() OVER (PARTITION BY tournament, round ORDER BY user_id) AS k FROM ev),
pairings AS (SELECT a.tournament, a.round, a.user_id AS white, b.user_id AS black, a.value AS white_value, b.value AS black_value,
  CAST(CASE WHEN ABS(a.value - b.value) <= 5 THEN 1 WHEN a.value > b.value THEN 2 ELSE 0 END AS BIGINT) AS white_half
  FROM seat a JOIN seat b ON a.tournament = b.tournament AND a.round = b.round AND a.k % 2 = 1 AND b.k = a.k + 1)"""

PLAYER_GAME_SQL = (
    PAIRINGS_SQL
    + """,
player_game AS (
  SELECT tournament, round, white AS player, black AS opponent, CAST(1 AS BIGINT) AS is_white, white_half AS half, white_value AS accuracy,
    1500 + (white * 37) % 900 AS rating, 1500 + (black * 37) % 900 AS opp_rating,
    CAST(CASE WHEN tournament >= DATE '2024-01-16' THEN 1 ELSE 0 END AS BIGINT) AS post FROM pairings
  UNION ALL
  SELECT tournament, round, black, white, 0, 2 - white_half, black_value, 1500 + (black * 37) % 900, 1500 + (white * 37) % 900,
    CASE WHEN tournament >= DATE '2024-01-16' THEN 1 ELSE 0 END FROM pairings)"""
)

MOVES_SQL = """
m AS (SELECT l.l_orderkey AS game_id, ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey) AS ply,
  o.o_custkey % 75 AS white, 75 + o.o_orderkey % 75 AS black,
  CASE WHEN o.o_orderdate >= TIMESTAMP '1998-09-01 00:00:00' THEN 1 ELSE 0 END AS post,
  60 - CAST(FLOOR(l.l_extendedprice) AS BIGINT) % 300 AS gain, CAST(FLOOR(l.l_quantity) AS BIGINT) AS time_spent,
  CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS is_capture, CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS gives_check
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
me AS (SELECT m.*, ply % 2 AS is_white_move, CAST(FLOOR((ply + 1) / 2) AS BIGINT) AS fullmove,
  SUM(CASE WHEN ply % 2 = 1 THEN gain ELSE -gain END) OVER (PARTITION BY game_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eval_after_white,
  SUM(time_spent) OVER (PARTITION BY game_id, ply % 2 ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used,
  ROW_NUMBER() OVER (PARTITION BY game_id, ply % 2 ORDER BY ply) AS own_no FROM m),
moves AS (SELECT game_id, ply, fullmove, is_white_move, white, black, CAST(post AS BIGINT) AS post, CAST(is_capture AS BIGINT) AS is_capture,
  CAST(gives_check AS BIGINT) AS gives_check, time_spent, CASE WHEN is_white_move = 1 THEN white ELSE black END AS mover,
  CAST(eval_after_white - CASE WHEN is_white_move = 1 THEN gain ELSE -gain END AS BIGINT) AS eval_before_white,
  CAST(eval_after_white AS BIGINT) AS eval_after_white, GREATEST(0, -gain) AS cp_loss,
  CAST(GREATEST(0, CASE WHEN post = 1 THEN 70 - used ELSE 40 + own_no - used END) AS BIGINT) AS time_after FROM me)"""
