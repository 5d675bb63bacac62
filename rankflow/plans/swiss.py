"""Queries of the tournament operators (SW, and the joins of opponents) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.operators import swiss
from rankflow.plans.fixtures import PAIRINGS_SQL, PLAYER_GAME_SQL, pairings, player_game, table

KEY = ["tournament", "round", "player"]

SCORES_SQL = (
    PLAYER_GAME_SQL
    + """,
sc AS (SELECT *, CAST(SUM(half) OVER (PARTITION BY tournament, player ORDER BY round) AS BIGINT) AS score_after FROM player_game),
scores AS (SELECT *, score_after - half AS score_before FROM sc),
finals AS (SELECT tournament, player, arg_max(score_after, round) AS final_score FROM scores GROUP BY ALL)"""
)

TIEBREAKS_SQL = (
    SCORES_SQL
    + """,
tb0 AS (SELECT s.*, coalesce(f.final_score, 0) AS opp_final FROM scores s LEFT JOIN finals f ON f.tournament = s.tournament AND f.player = s.opponent),
tb1 AS (SELECT *, CAST(coalesce(SUM(opp_final) OVER w, 0) AS BIGINT) AS buchholz, CAST(coalesce(SUM(opp_final * half) OVER w, 0) AS BIGINT) AS sonneborn,
  COUNT(*) OVER w AS n, MIN(opp_final) OVER w AS least FROM tb0
  WINDOW w AS (PARTITION BY tournament, player ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tiebreaks AS (SELECT *, buchholz + opp_final AS buchholz_after, sonneborn + opp_final * half AS sonneborn_after,
  CASE WHEN n >= 2 THEN buchholz - least ELSE 0 END AS cut1,
  CASE WHEN n >= 1 THEN buchholz + opp_final - least(least, opp_final) ELSE 0 END AS cut1_after FROM tb1)"""
).replace("least(least, opp_final)", "CASE WHEN least < opp_final THEN least ELSE opp_final END")

RANKS_SQL = (
    TIEBREAKS_SQL
    + """,
ranked AS (SELECT *, RANK() OVER (PARTITION BY tournament, round ORDER BY score_before DESC, cut1 DESC, buchholz DESC, sonneborn DESC) AS rank,
  RANK() OVER (PARTITION BY tournament, round ORDER BY score_after DESC, cut1_after DESC, buchholz_after DESC, sonneborn_after DESC) AS rank_after FROM tiebreaks),
flagged AS (SELECT *, CAST(rank = 1 AS BIGINT) AS leader, CAST(rank <= 6 AS BIGINT) AS in_prizes, CAST(rank BETWEEN 7 AND 15 AS BIGINT) AS bubble,
  CAST(rank > 15 AS BIGINT) AS eliminated FROM ranked)"""
)


def scored(spark, d):
    return swiss.running_score(player_game(spark, d))


def sw01_two_sided(spark, d):
    return player_game(spark, d)


def sw02_running_score(spark, d):
    return scored(spark, d).select(*KEY, "half", "score_before", "score_after")


def sw03_final_scores(spark, d):
    return swiss.final_scores(scored(spark, d))


def tied(spark, d):
    return swiss.tiebreaks(scored(spark, d))


def sw04_buchholz(spark, d):
    return tied(spark, d).select(*KEY, "buchholz", "buchholz_after")


def sw05_cut1(spark, d):
    return tied(spark, d).select(*KEY, "cut1", "cut1_after")


def sw06_sonneborn(spark, d):
    return tied(spark, d).select(*KEY, "sonneborn", "sonneborn_after")


def sw07_missing_opponents(spark, d):
    """The panel of white players only: black opponents have no row of their own in many events."""
    return swiss.missing_opponents(player_game(spark, d).where("is_white = 1")).select(*KEY, "opponent")


def sw08_same_round_rows(spark, d):
    """The panel with each first-round row of players below 20 twice, the second against opponent 0."""
    rows = scored(spark, d)
    twice = rows.unionByName(rows.where("round = 1 AND player < 20 AND opponent <> 0").withColumn("opponent", F.lit(0).cast("long")))
    return swiss.tiebreaks(twice, ordinal=["score_after", "opponent"]).groupBy(*KEY).agg(F.count("*").alias("n_rows"), F.max("buchholz").alias("buchholz"), F.sum("buchholz_after").alias("sum_after"))


def standings(spark, d):
    return swiss.standings(player_game(spark, d))


def sw09_ranks(spark, d):
    return standings(spark, d).select(*KEY, "rank", "rank_after")


def sw10_best_row(spark, d):
    rows = tied(spark, d)
    twice = rows.unionByName(rows.where("player % 7 = 0").withColumn("score_before", F.greatest(F.lit(0), F.col("score_before") - 1).cast("long")))
    return swiss.ranks(twice, "score_before", "cut1", "buchholz", "sonneborn", "rank").select(*KEY, "rank").distinct()


FLAGS = ["leader", "in_prizes", "bubble", "eliminated"]


def sw11_status_flags(spark, d):
    return standings(spark, d).select(*KEY, *FLAGS)


def sw12_opponent_flags(spark, d):
    return standings(spark, d).select(*KEY, *(f"against_{c}" for c in FLAGS))


def sw_standings(spark, d):
    return standings(spark, d).select(
        *KEY, "opponent", "score_before", "score_after", "buchholz", "cut1", "sonneborn", "buchholz_after", "cut1_after", "sonneborn_after", "rank", "rank_after", *FLAGS, *(f"against_{c}" for c in FLAGS)
    )


def sw13_rank_quality(spark, d):
    out = swiss.rank_quality(standings(spark, d))
    return out.select(*KEY, F.round("rank_pct", 6).alias("rank_pct"), F.round("quality", 6).alias("quality"), "improvement")


def sw14_final_ranks(spark, d):
    return swiss.final_ranks(swiss.final_scores(scored(spark, d)))


def sw15_could_win(spark, d):
    return swiss.could_win(scored(spark, d)).select(*KEY, "could_win")


def sw16_prize_distance(spark, d):
    return swiss.prize_distance(standings(spark, d)).select(*KEY, "prize_distance", "prize_bracket")


def sw17_kth_score(spark, d):
    return swiss.kth_score(scored(spark, d), 10)


def sw18_merge_panels(spark, d):
    rows = player_game(spark, d)
    first, second = rows.where("post = 0 OR round = 1"), rows.where("post = 1").withColumn("accuracy", F.lit(0.0))
    return swiss.merge_panels(first, second, KEY).select(*KEY, "accuracy")


def sw19_game_id(spark, d):
    return player_game(spark, d).select(*KEY, swiss.game_id().alias("game_id"))


def jn04_opponent_left(spark, d):
    return swiss.opponent_state(scored(spark, d).where("is_white = 1 OR round > 2"), ["score_before"]).select(*KEY, "opp_score_before")


def jn05_opponent_inner(spark, d):
    return swiss.opponent_state(scored(spark, d), ["accuracy"], how="inner").select(*KEY, F.round(F.col("accuracy") - F.col("opp_accuracy"), 6).alias("accuracy_gap"))


def jn06_opponent_violations(spark, d):
    rows = player_game(spark, d).where("is_white = 1")
    known = rows.select("tournament", "round", F.col("player").alias("opponent"))
    return rows.join(known, ["tournament", "round", "opponent"], "left_anti").groupBy("tournament").agg(F.count("*").alias("n_missing"))


def jn07_pairing_lookup(spark, d):
    """Each player's colour and opponent by (event, round), with the number of different opponents: over 1 is a collision."""
    games = pairings(spark, d)
    seats = games.select("tournament", "round", F.inline(F.array(F.struct(F.col("white").alias("player"), F.col("black").alias("opponent"), F.lit("white").alias("colour")), F.struct(F.col("black").alias("player"), F.col("white").alias("opponent"), F.lit("black").alias("colour")))))
    return seats.groupBy(*KEY, "colour").agg(F.count_distinct("opponent").alias("n_opponents"), F.min("opponent").alias("opponent"))


def jn08_id_bridge(spark, d):
    """Player rows to game ids by a composite key; of several ids the lowest."""
    from rankflow.operators.relational import keep_first

    rows, games = player_game(spark, d), pairings(spark, d)
    ids = games.select("tournament", "round", F.col("white").alias("player"), F.col("black").alias("opponent"), (F.col("white") * 1000 + F.col("black")).alias("bridge_id"))
    ids = keep_first(ids.unionByName(ids.withColumn("bridge_id", F.col("bridge_id") + 500_000)), [*KEY, "opponent"], ["bridge_id"])
    return rows.join(ids, [*KEY, "opponent"], "left").select(*KEY, "bridge_id")


def jn01_checked_dimension(spark, d):
    """Orders with their customer's segment of nations: the dimension may have one row for each key."""
    from rankflow.operators.relational import join_dimension

    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    return join_dimension(orders, customers, "o_custkey", "c_custkey", ["c_nationkey"]).select("o_orderkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))


def _q(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


ORACLE = {
    "sw01_two_sided": _q(PLAYER_GAME_SQL, "SELECT * FROM player_game"),
    "sw02_running_score": _q(SCORES_SQL, "SELECT tournament, round, player, half, score_before, score_after FROM scores"),
    "sw03_final_scores": _q(SCORES_SQL, "SELECT * FROM finals"),
    "sw04_buchholz": _q(TIEBREAKS_SQL, "SELECT tournament, round, player, buchholz, buchholz_after FROM tiebreaks"),
    "sw05_cut1": _q(TIEBREAKS_SQL, "SELECT tournament, round, player, cut1, cut1_after FROM tiebreaks"),
    "sw06_sonneborn": _q(TIEBREAKS_SQL, "SELECT tournament, round, player, sonneborn, sonneborn_after FROM tiebreaks"),
    "sw07_missing_opponents": _q(PLAYER_GAME_SQL, "SELECT tournament, round, player, opponent FROM player_game p WHERE is_white = 1 AND NOT EXISTS (SELECT 1 FROM player_game q WHERE q.is_white = 1 AND q.tournament = p.tournament AND q.player = p.opponent)"),
    "sw08_same_round_rows": _q(
        SCORES_SQL
        + """,
tw AS (SELECT * FROM scores UNION ALL SELECT * REPLACE (CAST(0 AS BIGINT) AS opponent) FROM scores WHERE round = 1 AND player < 20 AND opponent <> 0),
tf AS (SELECT tournament, player, MAX(score_after) AS final_score FROM tw t WHERE round = (SELECT MAX(round) FROM tw u WHERE u.tournament = t.tournament AND u.player = t.player) GROUP BY ALL),
to1 AS (SELECT t.*, coalesce(f.final_score, 0) AS opp_final, ROW_NUMBER() OVER (PARTITION BY t.tournament, t.player, t.round ORDER BY t.score_after, t.opponent) AS k
  FROM tw t LEFT JOIN tf f ON f.tournament = t.tournament AND f.player = t.opponent),
tb AS (SELECT a.tournament, a.round, a.player, a.opponent, a.opp_final, CAST(coalesce((SELECT SUM(b.opp_final) FROM to1 b WHERE b.k = 1 AND b.tournament = a.tournament AND b.player = a.player AND b.round < a.round), 0) AS BIGINT) AS buchholz FROM to1 a)""",
        "SELECT tournament, round, player, COUNT(*) AS n_rows, MAX(buchholz) AS buchholz, CAST(SUM(buchholz + opp_final) AS BIGINT) AS sum_after FROM tb GROUP BY ALL",
    ),
    "sw09_ranks": _q(RANKS_SQL, "SELECT tournament, round, player, rank, rank_after FROM ranked"),
    "sw10_best_row": _q(RANKS_SQL, "SELECT tournament, round, player, rank FROM ranked"),
    "sw11_status_flags": _q(RANKS_SQL, "SELECT tournament, round, player, leader, in_prizes, bubble, eliminated FROM flagged"),
    "sw12_opponent_flags": _q(RANKS_SQL, "SELECT a.tournament, a.round, a.player, b.leader AS against_leader, b.in_prizes AS against_in_prizes, b.bubble AS against_bubble, b.eliminated AS against_eliminated FROM flagged a LEFT JOIN flagged b ON a.tournament = b.tournament AND a.round = b.round AND a.opponent = b.player"),
    "sw_standings": _q(
        RANKS_SQL,
        "SELECT a.tournament, a.round, a.player, a.opponent, a.score_before, a.score_after, a.buchholz, a.cut1, a.sonneborn, a.buchholz_after, a.cut1_after, a.sonneborn_after, a.rank, a.rank_after, a.leader, a.in_prizes, a.bubble, a.eliminated, b.leader AS against_leader, b.in_prizes AS against_in_prizes, b.bubble AS against_bubble, b.eliminated AS against_eliminated FROM flagged a LEFT JOIN flagged b ON a.tournament = b.tournament AND a.round = b.round AND a.opponent = b.player",
    ),
    "sw13_rank_quality": _q(RANKS_SQL, "SELECT tournament, round, player, ROUND(p, 6) AS rank_pct, ROUND(1 - p, 6) AS quality, rank - rank_after AS improvement FROM (SELECT *, CASE WHEN COUNT(*) OVER w > 1 THEN (rank - 1) / (COUNT(*) OVER w - 1) ELSE 0.0 END AS p FROM ranked WINDOW w AS (PARTITION BY tournament, round))"),
    "sw14_final_ranks": _q(SCORES_SQL, "SELECT tournament, player, final_score, r AS final_rank, r + (COUNT(*) OVER (PARTITION BY tournament, final_score) - 1) / 2 AS average_rank, CAST(r = 1 AS BIGINT) AS winner, CAST(r <= 6 AS BIGINT) AS in_prizes FROM (SELECT *, RANK() OVER (PARTITION BY tournament ORDER BY final_score DESC) AS r FROM finals)"),
    "sw15_could_win": _q(SCORES_SQL, "SELECT tournament, round, player, CAST(MAX(score_before) OVER (PARTITION BY tournament, round) - score_before <= 2 AS BIGINT) AS could_win FROM scores"),
    "sw16_prize_distance": _q(RANKS_SQL, "SELECT tournament, round, player, d AS prize_distance, CASE WHEN d <= -3 THEN 'well inside' WHEN d <= 0 THEN 'inside' WHEN d <= 3 THEN 'just outside' WHEN d <= 9 THEN 'near' WHEN d <= 20 THEN 'far' ELSE 'out' END AS prize_bracket FROM (SELECT *, rank - MAX(CASE WHEN rank <= 6 THEN rank END) OVER (PARTITION BY tournament, round) AS d FROM ranked)"),
    "sw17_kth_score": _q(SCORES_SQL, "SELECT tournament, MAX(CASE WHEN k = 10 THEN score_after END) AS threshold FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tournament ORDER BY score_after DESC) AS k FROM scores s WHERE round = (SELECT MAX(round) FROM scores t WHERE t.tournament = s.tournament)) GROUP BY tournament"),
    "sw18_merge_panels": _q(PLAYER_GAME_SQL, "SELECT tournament, round, player, CASE WHEN post = 0 OR round = 1 THEN accuracy ELSE 0.0 END AS accuracy FROM player_game"),
    "sw19_game_id": _q(PLAYER_GAME_SQL, "SELECT tournament, round, player, tournament || '~' || round || '~' || least(player, opponent) || '~' || greatest(player, opponent) AS game_id FROM player_game"),
    "jn04_opponent_left": _q(SCORES_SQL + ", p AS (SELECT * FROM scores WHERE is_white = 1 OR round > 2)", "SELECT a.tournament, a.round, a.player, b.score_before AS opp_score_before FROM p a LEFT JOIN p b ON a.tournament = b.tournament AND a.round = b.round AND a.opponent = b.player"),
    "jn05_opponent_inner": _q(SCORES_SQL, "SELECT a.tournament, a.round, a.player, ROUND(a.accuracy - b.accuracy, 6) AS accuracy_gap FROM scores a JOIN scores b ON a.tournament = b.tournament AND a.round = b.round AND a.opponent = b.player"),
    "jn06_opponent_violations": _q(PAIRINGS_SQL, "SELECT tournament, COUNT(*) AS n_missing FROM pairings GROUP BY ALL"),
    "jn07_pairing_lookup": _q(PLAYER_GAME_SQL, "SELECT tournament, round, player, CASE WHEN is_white = 1 THEN 'white' ELSE 'black' END AS colour, COUNT(DISTINCT opponent) AS n_opponents, MIN(opponent) AS opponent FROM player_game GROUP BY ALL"),
    "jn08_id_bridge": _q(PLAYER_GAME_SQL, "SELECT tournament, round, player, CASE WHEN is_white = 1 THEN player * 1000 + opponent END AS bridge_id FROM player_game"),
    "jn01_checked_dimension": "SELECT o_orderkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
}

QUERIES = {name: globals()[name] for name in ORACLE}
