"""Position explorer: move statistics, top games and continuations by position, and the lookup that serves them.

Built offline as tables sorted by position_key, so that a lookup reads few row groups; a lookup is a filter and a top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def move_stats(moves: DataFrame) -> DataFrame:
    """Counts of each move at each position: games, ratings, results. The move's name is that of the last game."""
    return moves.groupBy("position_key", "move").agg(
        F.max_by("move_name", "game_id").alias("move_name"), F.count("*").alias("n"), F.sum("rating").alias("rating_sum"), F.count("rating").alias("rating_n"),
        F.count_if(F.col("white_half") == 2).alias("white_wins"), F.count_if(F.col("white_half") == 1).alias("draws"), F.count_if(F.col("white_half") == 0).alias("black_wins"),
    )


def top_games(moves: DataFrame, k: int = 5, first_ply: int = 2) -> DataFrame:
    """The k games of each position with the highest ratings (mean, then highest, then game and ply, all falling); a game
    counts once, at its first visit."""
    visits = moves.where(F.col("ply") >= first_ply).groupBy("position_key", "game_id").agg(F.min_by(F.struct("ply", "mean_rating", "max_rating"), "ply").alias("v"))
    rows = visits.select("position_key", "game_id", "v.*")
    order = Window.partitionBy("position_key").orderBy(*map(F.desc, ("mean_rating", "max_rating", "game_id", "ply")))
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def continuations(top: DataFrame, moves: DataFrame, length: int = 5) -> DataFrame:
    """The next moves of each top game, as text; games without moves after the position have an empty one."""
    games = moves.join(top.select("game_id").distinct(), "game_id", "left_semi").groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("ply", "move_name"))).alias("m"))  # one game's moves
    names = F.transform("m", lambda x: x.move_name)
    after = F.slice(names, F.col("ply").cast("int") + 1, F.lit(length))
    return top.join(games, "game_id", "left").withColumn("continuation", F.coalesce(F.array_join(after, " "), F.lit(""))).drop("m")


def top_moves(stats: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent moves of each position, with shares of results and the mean rating."""
    order = Window.partitionBy("position_key").orderBy(F.desc("n"), "move_name", "move")
    rows = stats.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)
    share = lambda c: F.round(100 * F.col(c) / F.col("n"), 1).alias(c.replace("wins", "share").replace("draws", "draw_share"))
    return rows.select("position_key", "place", "move", "move_name", "n", share("white_wins"), share("draws"), share("black_wins"), F.round(F.try_divide("rating_sum", "rating_n"), 1).alias("mean_rating"))


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Written sorted by position, so that row-group statistics serve lookups."""
    for name, df in tables.items():
        df.repartitionByRange("position_key").sortWithinPartitions("position_key").write.mode("overwrite").parquet(f"{path}/{name}")


def query_position(spark, path: str, position_key: str) -> dict:
    """What is known about one position: totals, moves and games (as many as were kept)."""
    at = F.col("position_key") == position_key
    read = lambda name: [r.asDict() for r in spark.read.parquet(f"{path}/{name}").where(at).orderBy("place").collect()]
    moves = read("moves")
    return {"position_key": position_key, "total": sum(m["n"] for m in moves), "moves": moves, "games": read("games")}
