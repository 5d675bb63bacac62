"""Swiss-tournament operators: scores, tie-breaks, ranks and standing flags by window functions.

Points are integers (half points), so equality and order are exact. Tie-breaks use the opponents' scores at the end of
the event, also before it ended. Columns are named by parameters; results are added to the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT, ROUND, PLAYER, OPPONENT, POINTS = "tournament", "round", "player", "opponent", "half"
#: Standing at the start of a round, by rank: the last of the prizes and of the bubble.
PRIZES, BUBBLE = 6, 15


def two_sided(games: DataFrame, keys: list[str], white: str, black: str, points: str, total: int, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Two rows for each game, one for each side: keys, player, opponent, is_white, half, and for each of pairs (name:
    white's column, black's column) name and opp_name. One pass over the games, without a union."""

    def side(own: int) -> Column:
        names = (white, black) if own == 0 else (black, white)
        score = F.col(points) if own == 0 else F.lit(total) - F.col(points)
        both = [F.col(p[side]).alias(name) for n, p in pairs.items() for name, side in ((n, own), (f"opp_{n}", 1 - own))]
        return F.struct(*keys, F.col(names[0]).alias(PLAYER), F.col(names[1]).alias(OPPONENT), F.lit(1 - own).cast("long").alias("is_white"), score.cast("long").alias(POINTS), *both)

    return games.select(F.inline(F.array(side(0), side(1))))


def running_score(df: DataFrame, points: str = POINTS) -> DataFrame:
    """score_before and score_after of each round."""
    past = Window.partitionBy(EVENT, PLAYER).orderBy(ROUND).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.sum(points).over(past)
    return df.withColumn("score_after", after).withColumn("score_before", F.col("score_after") - F.col(points))


def final_scores(df: DataFrame) -> DataFrame:
    """event, player, final_score: the score after the last round (the highest, if that round has several rows)."""
    return df.groupBy(EVENT, PLAYER).agg(F.max_by("score_after", F.struct(ROUND, "score_after")).alias("final_score"))


def missing_opponents(df: DataFrame) -> DataFrame:
    """Rows whose opponent has no row in the event."""
    known = df.select(EVENT, F.col(PLAYER).alias(OPPONENT)).distinct()
    return df.where(F.col(OPPONENT).isNotNull()).join(known, [EVENT, OPPONENT], "left_anti")


def tiebreaks(df: DataFrame, policy: str = "zero", ordinal: list[str] | None = None) -> DataFrame:
    """Buchholz, Buchholz cut 1 and Sonneborn-Berger, before and after each round, from score_before/score_after.

    policy: a missing opponent counts zero (`zero`) or fails the job (`error`). If a player has several rows in a round,
    all get values, but only the first (by ordinal, else by opponent) enters later rounds."""
    finals = final_scores(df).select(EVENT, F.col(PLAYER).alias(OPPONENT), F.col("final_score").alias("opp_final"))
    rows = df.join(finals, [EVENT, OPPONENT], "left")
    if policy == "error":
        absent = F.col(OPPONENT).isNotNull() & F.col("opp_final").isNull()
        rows = rows.withColumn("opp_final", F.when(absent, F.raise_error(F.concat(F.lit("no row of opponent "), F.col(OPPONENT).cast("string"))).cast("long")).otherwise(F.col("opp_final")))
    same_round = Window.partitionBy(EVENT, PLAYER, ROUND).orderBy(*(ordinal or [OPPONENT]))
    rows = rows.withColumn("opp_final", F.coalesce("opp_final", F.lit(0).cast("long"))).withColumn("__first", F.row_number().over(same_round) == 1)
    past = Window.partitionBy(EVENT, PLAYER).orderBy(ROUND).rangeBetween(Window.unboundedPreceding, -1)
    entered = lambda x: F.when(F.col("__first"), x)
    product = F.col("opp_final") * F.col(POINTS)
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    rows = rows.withColumns(
        {
            "buchholz": zero(F.sum(entered(F.col("opp_final"))).over(past)),
            "sonneborn": zero(F.sum(entered(product)).over(past)),
            "__n": F.count(entered(F.col("opp_final"))).over(past),
            "__least": F.min(entered(F.col("opp_final"))).over(past),
        }
    )
    cut = lambda total, least, n: F.when(n >= 2, total - least).otherwise(0).cast("long")
    rows = rows.withColumns({"buchholz_after": F.col("buchholz") + F.col("opp_final"), "sonneborn_after": F.col("sonneborn") + product})
    rows = rows.withColumn("cut1", cut(F.col("buchholz"), F.col("__least"), F.col("__n")))
    rows = rows.withColumn("cut1_after", cut(F.col("buchholz_after"), F.least("__least", "opp_final"), F.col("__n") + 1))
    return rows.drop("__first", "__n", "__least")


def ranks(df: DataFrame, score: str, cut1: str, buchholz: str, sonneborn: str, name: str) -> DataFrame:
    """Competition rank within event and round by the four keys, all falling: equal keys share a rank, the next skips.
    A player with several rows counts once, with the highest keys."""
    keys = F.struct(*(F.col(c).alias(n) for n, c in (("a", score), ("b", cut1), ("c", buchholz), ("d", sonneborn))))
    field, own = Window.partitionBy(EVENT, ROUND), Window.partitionBy(EVENT, ROUND, PLAYER)
    rows = df.where(F.col(EVENT).isNotNull() & F.col(ROUND).isNotNull() & F.col(PLAYER).isNotNull()).withColumn("__keys", keys)
    rows = rows.withColumns({"__best": F.max("__keys").over(own), "__once": (F.row_number().over(own.orderBy("__keys")) == 1).cast("long")})
    # Players with these keys or higher ones, less those with these keys, and one.
    ahead = F.sum("__once").over(field.orderBy(F.desc("__best"))) - F.sum("__once").over(Window.partitionBy(EVENT, ROUND, "__best"))
    return rows.withColumn(name, ahead + 1).drop("__keys", "__best", "__once")


def status_flags(df: DataFrame, rank: str = "rank") -> DataFrame:
    flag = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    r = F.col(rank)
    return df.withColumns({"leader": flag(r == 1), "in_prizes": flag(r <= PRIZES), "bubble": flag((r > PRIZES) & (r <= BUBBLE)), "eliminated": flag(r > BUBBLE)})


def opponent_state(df: DataFrame, columns: list[str], prefix: str = "opp_", how: str = "left") -> DataFrame:
    """The opponent's values of columns in the same event and round, as prefix + column; one row for each opponent."""
    other = df.groupBy(EVENT, ROUND, F.col(PLAYER).alias(OPPONENT)).agg(*(F.max(c).alias(f"{prefix}{c}") for c in columns))
    return df.join(other, [EVENT, ROUND, OPPONENT], how)


def standings(df: DataFrame) -> DataFrame:
    """The whole chain: scores, tie-breaks, ranks before and after each round, flags of both sides."""
    rows = tiebreaks(running_score(df))
    rows = ranks(rows, "score_before", "cut1", "buchholz", "sonneborn", "rank")
    rows = ranks(rows, "score_after", "cut1_after", "buchholz_after", "sonneborn_after", "rank_after")
    return opponent_state(status_flags(rows), ["leader", "in_prizes", "bubble", "eliminated"], "against_")


def rank_quality(df: DataFrame, rank: str = "rank", after: str = "rank_after") -> DataFrame:
    """rank_pct = (rank - 1) / (n - 1) of the field (0 if alone), quality = 1 - rank_pct, improvement = rank - after."""
    n = F.count("*").over(Window.partitionBy(EVENT, ROUND))
    pct = F.when(n > 1, (F.col(rank) - 1) / (n - 1)).otherwise(F.lit(0.0))
    return df.withColumn("rank_pct", pct).withColumn("quality", 1 - F.col("rank_pct")).withColumn("improvement", F.col(rank) - F.col(after))


def final_ranks(finals: DataFrame) -> DataFrame:
    """Average and least rank of the final score within the event, winner and in_prizes flags."""
    order = Window.partitionBy(EVENT).orderBy(F.desc("final_score"))
    ties = Window.partitionBy(EVENT, "final_score")
    out = finals.withColumn("final_rank", F.rank().over(order).cast("long"))
    out = out.withColumn("average_rank", F.col("final_rank") + (F.count("*").over(ties) - 1) / 2)
    return out.withColumns({"winner": (F.col("final_rank") == 1).cast("long"), "in_prizes": (F.col("final_rank") <= PRIZES).cast("long")})


def could_win(df: DataFrame, margin: int = 2, score: str = "score_before") -> DataFrame:
    """could_win: within margin (half points) of the best score of the round."""
    return df.withColumn("could_win", (F.max(score).over(Window.partitionBy(EVENT, ROUND)) - F.col(score) <= margin).cast("long"))


def prize_distance(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Distance of the rank to the last rank in the prizes, and its bracket."""
    edge = F.max(F.when(F.col(rank) <= PRIZES, F.col(rank))).over(Window.partitionBy(EVENT, ROUND))
    d = F.col("prize_distance")
    bracket = F.when(d <= -3, "well inside").when(d <= 0, "inside").when(d <= 3, "just outside").when(d <= 9, "near").when(d <= 20, "far").otherwise("out")
    return df.withColumn("prize_distance", F.col(rank) - edge).withColumn("prize_bracket", bracket)


def kth_score(df: DataFrame, k: int, score: str = "score_after") -> DataFrame:
    """event, threshold: the k-th highest score of the last round (null with fewer players)."""
    last = df.withColumn("__last", F.max(ROUND).over(Window.partitionBy(EVENT))).where(F.col(ROUND) == F.col("__last"))
    place = F.row_number().over(Window.partitionBy(EVENT).orderBy(F.desc(score)))
    return last.withColumn("__place", place).groupBy(EVENT).agg(F.max(F.when(F.col("__place") == k, F.col(score))).alias("threshold"))


def merge_panels(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two panels of the same columns, the first panel's row for each key."""
    if first.columns != second.columns:
        raise ValueError(f"columns differ: {first.columns} and {second.columns}")
    both = first.withColumn("__from", F.lit(0)).unionByName(second.withColumn("__from", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy("__from", *[c for c in first.columns if c not in keys])
    return both.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__from", "__k")


def game_id(event: str = EVENT, round_: str = ROUND, a: str = PLAYER, b: str = OPPONENT) -> Column:
    """An id that both sides of a game share."""
    return F.concat_ws("~", F.col(event).cast("string"), F.col(round_).cast("string"), F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
