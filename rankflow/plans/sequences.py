"""Queries of the window, move and clock operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankflow.functions import scalar as S
from rankflow.operators import accumulate as A
from rankflow.operators import moves as M
from rankflow.operators import windows as W
from rankflow.operators.ranges import with_ranks
from rankflow.plans.fixtures import MOVES_SQL, moves, player_game
from rankflow.plans.relational import r6
from rankflow.plans.swiss import KEY, RANKS_SQL, SCORES_SQL, scored, standings

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


CLOCK_SQL = MOVES_SQL + """,
clocked AS (SELECT *, coalesce(LAG(time_after) OVER (PARTITION BY game_id, is_white_move ORDER BY ply), CASE WHEN post = 1 THEN 70 ELSE 40 END) AS time_before FROM moves)"""


def clocked(spark, d):
    return moves(spark, d).withColumn("time_before", M.clock_before(F.when(F.col("post") == 1, 70).otherwise(40)))


@query(f"WITH {SCORES_SQL} SELECT tournament, round, player, CASE WHEN LAG(round) OVER w = round - 1 THEN LAG(half) OVER w END AS prev_half, CASE WHEN LAG(round) OVER w = round - 1 THEN LAG(opponent) OVER w END AS prev_opponent FROM scores WHERE opponent % 5 <> 0 WINDOW w AS (PARTITION BY tournament, player ORDER BY round)")
def wn01_lag(spark, d):
    """WN01 and WN02: the previous round's columns, if it is the round before."""
    return W.lagged(player_game(spark, d).where("opponent % 5 <> 0"), ["tournament", "player"], "round", ["half", "opponent"]).select(*KEY, "prev_half", "prev_opponent")


@query(f"WITH {SCORES_SQL} SELECT tournament, round, player, CAST(coalesce(SUM(half) OVER (PARTITION BY player ORDER BY tournament, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS career_half, ROW_NUMBER() OVER (PARTITION BY player ORDER BY tournament, round) - 1 AS experience, ROW_NUMBER() OVER (PARTITION BY least(player, opponent), greatest(player, opponent), is_white ORDER BY tournament, round, player) - 1 AS meetings FROM scores")
def wn03_running(spark, d):
    """WN03 and WN04: sums and numbers of earlier rows."""
    pair = [F.least("player", "opponent"), F.greatest("player", "opponent"), F.col("is_white")]
    return player_game(spark, d).select(*KEY, W.exclusive_sum(["player"], ["tournament", "round"], "half").alias("career_half"), W.ordinal(["player"], ["tournament", "round"]).alias("experience"), W.ordinal(pair, ["tournament", "round", "player"]).alias("meetings"))


@query(f"""WITH {SCORES_SQL}, s AS (SELECT *, CASE WHEN half = 2 THEN 1 ELSE 0 END AS won FROM scores),
 r AS (SELECT *, SUM(1 - won) OVER (PARTITION BY tournament, player ORDER BY round) AS run FROM s)
 SELECT tournament, round, player, CASE WHEN won = 1 THEN CAST(SUM(won) OVER (PARTITION BY tournament, player, run ORDER BY round) AS BIGINT) ELSE 0 END AS streak FROM r""")
def wn05_streak(spark, d):
    return W.streak(player_game(spark, d), ["tournament", "player"], "round", F.col("half") == 2, "streak").select(*KEY, "streak")


@query("SELECT c_custkey, r + (COUNT(*) OVER (PARTITION BY v) - 1) / 2 AS average_rank, r AS least_rank, COUNT(*) OVER () AS n FROM (SELECT c_custkey, v, RANK() OVER (ORDER BY v) AS r FROM (SELECT c_custkey, floor(c_acctbal / 100) AS v FROM customer))")
def wn06_ranks(spark, d):
    from rankflow.plans.fixtures import table

    rows = table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 100).alias("v"))
    ranked = with_ranks(rows, "v", {"average": "average_rank", "least": "least_rank", "count": "n"})
    return ranked.select("c_custkey", "average_rank", "least_rank", "n")


@query(f"WITH {SCORES_SQL} SELECT tournament, round, player, COUNT(*) OVER (PARTITION BY tournament, round) AS field, MAX(round) OVER (PARTITION BY tournament) AS n_rounds, ROUND(SUM(accuracy) OVER (PARTITION BY tournament, round), 2) AS field_accuracy FROM scores")
def wn07_group_broadcast(spark, d):
    field, event = Window.partitionBy("tournament", "round"), Window.partitionBy("tournament")
    return player_game(spark, d).select(*KEY, F.count("*").over(field).alias("field"), F.max("round").over(event).alias("n_rounds"), F.round(F.sum("accuracy").over(field), 2).alias("field_accuracy"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer),
 w AS (SELECT c_custkey, c_acctbal, greatest(lo, least(hi, c_acctbal)) AS x FROM customer, q)
 SELECT c_custkey, ROUND((c_acctbal - AVG(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z, ROUND((x - AVG(x) OVER ()) / stddev_samp(x) OVER (), 6) AS z_winsor, ROUND(c_acctbal - AVG(c_acctbal) OVER (), 4) AS centred FROM w""")
def wn08_standardised(spark, d):
    from rankflow.plans.fixtures import table

    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    out = W.centred(W.standardised(W.standardised(rows, "c_acctbal", "z"), "c_acctbal", "z_winsor", winsor=0.01), "c_acctbal", "centred")
    return out.select("c_custkey", r6("z", "z"), r6("z_winsor", "z_winsor"), F.round("centred", 4).alias("centred"))


@query(f"WITH {SCORES_SQL} SELECT tournament, round, player, CAST(coalesce(LAG(is_white) OVER w = is_white, false) AS BIGINT) AS same_colour, ROUND(accuracy - AVG(CASE WHEN round <= 2 THEN accuracy END) OVER (PARTITION BY tournament, player), 6) AS over_baseline FROM scores WINDOW w AS (PARTITION BY tournament, player ORDER BY round)")
def wn09_colour_and_baseline(spark, d):
    """WN09 and WN10: colour as in the round before; accuracy over the mean of the first rounds."""
    own = Window.partitionBy("tournament", "player").orderBy("round")
    return player_game(spark, d).select(*KEY, S.flag(F.lag("is_white").over(own) == F.col("is_white")).alias("same_colour"), r6(F.col("accuracy") - W.baseline(["tournament", "player"], "round", "accuracy", 2), "over_baseline"))


@query(f"WITH {RANKS_SQL} SELECT tournament, player, MAX(CASE WHEN round = 2 THEN rank_after END) AS rank_2, MAX(CASE WHEN round = 3 THEN rank_after END) AS rank_3, MAX(CASE WHEN round = 2 THEN score_after END) AS score_2, MAX(score_after) - MAX(CASE WHEN round = 2 THEN score_after END) AS later_points FROM ranked GROUP BY 1, 2")
def wn11_early_state(spark, d):
    at = lambda c, r: F.max(F.when(F.col("round") == r, F.col(c)))
    return standings(spark, d).groupBy("tournament", "player").agg(at("rank_after", 2).alias("rank_2"), at("rank_after", 3).alias("rank_3"), at("score_after", 2).alias("score_2"), (F.max("score_after") - at("score_after", 2)).alias("later_points"))


@query(f"""WITH {MOVES_SQL}, f AS (SELECT * FROM moves WHERE time_spent % 7 <> 0)
 SELECT game_id, ply, CASE WHEN LAG(is_white_move) OVER w <> is_white_move THEN LAG(time_spent) OVER w END AS opp_time, CASE WHEN LEAD(is_white_move) OVER w <> is_white_move THEN LEAD(cp_loss) OVER w END AS answer_loss FROM f WINDOW w AS (PARTITION BY game_id ORDER BY ply)""")
def wn12_rhythm(spark, d):
    """WN12 to WN14: neighbouring moves of the other side, after moves without a clock are dropped."""
    rows = moves(spark, d).withColumn("time_spent", F.when(F.col("time_spent") % 7 != 0, F.col("time_spent")))
    return M.rhythm(rows).select("game_id", "ply", "opp_time", "answer_loss")


@query(f"WITH {CLOCK_SQL} SELECT game_id, ply, CAST(time_before AS BIGINT) AS time_before FROM clocked")
def wn15_clock_before(spark, d):
    return clocked(spark, d).select("game_id", "ply", F.col("time_before").cast("long").alias("time_before"))


@query(f"WITH {MOVES_SQL} SELECT game_id, ply, last_value(CASE WHEN is_white_move = 1 THEN time_after END IGNORE NULLS) OVER w AS white_clock, last_value(CASE WHEN is_white_move = 0 THEN time_after END IGNORE NULLS) OVER w AS black_clock FROM moves WINDOW w AS (PARTITION BY game_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def wn16_last_known(spark, d):
    side = lambda w: F.when(F.col("is_white_move") == w, F.col("time_after"))
    return moves(spark, d).select("game_id", "ply", W.last_known(["game_id"], "ply", side(1)).alias("white_clock"), W.last_known(["game_id"], "ply", side(0)).alias("black_clock"))


@query(f"""WITH {CLOCK_SQL}, i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, is_white_move ORDER BY ply) AS i FROM clocked),
 f AS (SELECT *, i - MIN(CASE WHEN time_before <= 20 THEN i END) OVER (PARTITION BY game_id, is_white_move) AS event_k FROM i)
 SELECT game_id, ply, event_k FROM f WHERE event_k BETWEEN -2 AND 3""")
def wn17_event_time(spark, d):
    return W.event_time(clocked(spark, d), ["game_id", "is_white_move"], "ply", F.col("time_before") <= 20, -2, 3).select("game_id", "ply", "event_k")


@query(f"""WITH {CLOCK_SQL}, i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, is_white_move ORDER BY ply) AS i FROM clocked),
 f AS (SELECT *, i - MIN(CASE WHEN time_before <= 20 THEN i END) OVER (PARTITION BY game_id, is_white_move) AS k FROM i)
 SELECT game_id, is_white_move, ROUND(AVG(CASE WHEN k BETWEEN -5 AND -1 THEN cp_loss END), 6) AS loss_before, ROUND(AVG(CASE WHEN k BETWEEN 0 AND 4 THEN cp_loss END), 6) AS loss_after, CAST(MAX(CASE WHEN k > 0 AND time_before > 20 THEN 1 ELSE 0 END) AS BIGINT) AS recovered FROM f WHERE k IS NOT NULL GROUP BY 1, 2""")
def wn18_around_low_clock(spark, d):
    """WN18 and MV12."""
    out = M.around_first_low(clocked(spark, d), 20)
    return out.select("game_id", "is_white_move", r6("loss_before", "loss_before"), r6("loss_after", "loss_after"), "recovered")


SIDES_SQL = """s AS (SELECT game_id, ply, fullmove, is_white_move, coalesce(cp_loss, 0)::DOUBLE AS loss, side, CASE WHEN side = 1 THEN v ELSE -v END AS e, side = is_white_move AS own
  FROM (SELECT *, CASE WHEN (game_id + ply) % 13 <> 0 THEN greatest(-300, least(300, eval_after_white)) END AS v FROM moves), (VALUES (0), (1)) x(side)),
 w AS (SELECT *, SUM(own::INT) OVER (PARTITION BY game_id, side ORDER BY ply) AS n, MIN(CASE WHEN e >= 90 THEN ply END) OVER p AS win, MIN(CASE WHEN e <= -90 THEN ply END) OVER p AS lost FROM s WINDOW p AS (PARTITION BY game_id, side)),
 x AS (SELECT *, MIN(CASE WHEN own AND loss >= 200 THEN n END) OVER (PARTITION BY game_id, side) AS failed FROM w)"""
NEXT = "FILTER (WHERE own AND n > failed AND n <= failed + 2)"


@query(f"""WITH {MOVES_SQL}, {SIDES_SQL}, o AS (SELECT game_id, CAST(side AS BIGINT) AS is_white_move, COUNT(*) AS position_count, COUNT(*) FILTER (WHERE own) AS own_move_count, MAX(e) AS max_eval_player_cp, MIN(e) AS min_eval_player_cp,
  arg_max(e, ply) AS final_eval_player_cp, MIN(win) AS first_plus2_ply, MIN(lost) AS first_minus2_ply, MAX(e) FILTER (WHERE ply >= win) AS max_after_plus2_cp, MIN(e) FILTER (WHERE ply >= win) AS min_after_plus2_cp,
  arg_max(e, ply) FILTER (WHERE ply >= win) AS final_after_plus2_cp, MAX(e) FILTER (WHERE ply >= win) - MIN(e) FILTER (WHERE ply >= win) AS advantage_loss_after_plus2_cp,
  bool_or(e < 0) FILTER (WHERE ply >= win)::BIGINT AS dropped_below_equal_after_plus2, bool_or(e < 40) FILTER (WHERE ply >= win)::BIGINT AS dropped_below_plus1_after_plus2, MAX(ply) - MIN(win) AS conversion_speed_plies,
  MAX(e) FILTER (WHERE ply >= lost) AS best_after_minus2_cp, arg_max(e, ply) FILTER (WHERE ply >= lost) AS final_after_minus2_cp, bool_or(e >= -40) FILTER (WHERE ply >= lost)::BIGINT AS recovered_to_equal_after_minus2,
  bool_or(e >= 40) FILTER (WHERE ply >= lost)::BIGINT AS recovered_to_plus1_after_minus2, MAX(e) FILTER (WHERE ply >= lost) - MAX(e) FILTER (WHERE ply = lost) AS defensive_recovery_after_minus2_cp,
  MIN(ply) FILTER (WHERE own AND n = failed) AS first_blunder_ply_dynamic, MIN(fullmove) FILTER (WHERE own AND n = failed) AS first_blunder_move_dynamic, MIN(fullmove) FILTER (WHERE own AND loss >= 100) AS first_mistake_move_dynamic,
  bool_or(loss >= 200) {NEXT}::BIGINT AS cascade_blunder_next5, bool_or(loss >= 100) {NEXT}::BIGINT AS cascade_mistake_next5, AVG(loss) {NEXT} AS mean_cp_loss_next5_after_blunder, MAX(loss) {NEXT} AS max_cp_loss_next5_after_blunder,
  MAX(e) FILTER (WHERE own AND n = failed) AS eval_after_first_blunder_cp, MAX(e) {NEXT} AS best_eval_next5_after_blunder_cp, MIN(e) {NEXT} AS worst_eval_next5_after_blunder_cp FROM x GROUP BY 1, 2)
 SELECT *, (best_eval_next5_after_blunder_cp >= -40)::BIGINT AS recovered_to_equal_next5_after_blunder, eval_after_first_blunder_cp - worst_eval_next5_after_blunder_cp AS additional_eval_drop_next5_after_blunder_cp FROM o WHERE own_move_count > 0""")
def mv21_dynamics(spark, d):
    """MV21, WN19 and WN20: all 33 features, at edges that these short games reach."""
    rows = moves(spark, d).withColumn("eval_after_white", F.when((F.col("game_id") + F.col("ply")) % 13 != 0, F.col("eval_after_white")))
    out = A.dynamics(rows, edge=90, equal=40, cap=300, following=2)
    return out.select(*(F.col(c).cast("long").alias(c) if c.endswith("_cp") and not c.startswith(("mean", "max_cp")) else F.col(c) for c in out.columns))


PHASE_BOUNDS = {"opening_1_10": "fullmove <= 1", "early_middlegame_11_20": "fullmove = 2", "late_middlegame_21_35": "fullmove = 3", "endgame_36_plus": "fullmove > 3"}
_mean = lambda x, where, name: f"ROUND(AVG({x}) FILTER (WHERE {where}), 6) AS {name}"
_share = lambda x, where, name: f"ROUND(AVG(({x})::INT) FILTER (WHERE {where}), 6) AS {name}"
CLOCKS_SQL = ", ".join([
    "COUNT(*) AS n_moves, MAX(ply) AS max_ply, ROUND(AVG(c), 6) AS mean_cp_loss_cap, SUM(c)::DOUBLE AS total_cp_loss_cap, SUM(s)::BIGINT AS total_time_spent, ROUND(AVG(s), 6) AS mean_time_spent, ROUND(stddev_pop(s), 6) AS sd_time_spent, MAX(s) AS max_time_spent",
    "ROUND(AVG(b), 6) AS mean_time_before, ROUND(AVG(a), 6) AS mean_time_after, MIN(b) AS min_time_before, MIN(a) AS min_time_after, arg_max(a, ply) AS final_time_after",
    *(_share(f"cp_loss >= {t}", "true", f"{n}_rate") for n, t in (("blunder", 200), ("mistake", 100), ("inaccuracy", 50))), *(f"arg_max(a, ply) FILTER (WHERE fullmove = {k}) AS time_after_move_{k}" for k in (1, 2, 3)),
    *(_share(f"{c} <= {t}", "true", f"low_{n}_{t}_share") for c, n in (("b", "before"), ("a", "after")) for t in (5, 10, 30)), *(f"coalesce(MIN(ply) FILTER (WHERE a <= {t}), 0) AS first_low_after_{t}_ply" for t in (10, 30)),
    _share("s <= 1", "true", "fast_moves_le_1s_share"), *(_share(f"s >= {t}", "true", f"think_moves_ge_{t}s_share") for t in (10, 20, 30)),
    _mean("c", "b <= 10", "mean_cp_low_before_10"), _mean("c", "b > 10", "mean_cp_nonlow_before_10"), _share("cp_loss >= 200", "b <= 10", "blunder_rate_low_before_10"), _share("cp_loss >= 200", "b > 10", "blunder_rate_nonlow_before_10"),
    "ROUND(AVG(coalesce(abs(eb) <= 100, false)::INT), 6) AS critical_share", _mean("s", "abs(eb) <= 100", "mean_time_critical"), _mean("c", "abs(eb) <= 100", "mean_cp_critical"), _share("cp_loss >= 200", "abs(eb) <= 100", "blunder_rate_critical"),
    _share("b <= 10", "abs(eb) <= 100", "critical_low_before_10_share"),
    *(f"COUNT(*) FILTER (WHERE {w} AND {x}) > 0 AS {n}" for n, w, x in (("reached_winning_position", "ea >= 200", "true"), ("reached_losing_position", "ea <= -200", "true"), ("converted_winning_position", "ea >= 200", "r = 1"), ("escaped_losing_position", "ea <= -200", "r >= 0.5"))),
    *(f"coalesce(MIN(ply) FILTER (WHERE {w}), 0) AS first_{n}_ply, arg_min(a, ply) FILTER (WHERE {w}) AS first_{n}_time_after, coalesce(arg_min((a <= 10)::BIGINT, ply) FILTER (WHERE {w}), 0) AS first_{n}_low_after_10" for n, w in (("winning", "ea >= 200"), ("losing", "ea <= -200"))),
    "coalesce(MIN(ply) FILTER (WHERE cp_loss >= 200), 0) AS first_blunder_ply, coalesce(arg_min((b <= 10)::BIGINT, ply) FILTER (WHERE cp_loss >= 200), 0) AS first_blunder_low_before_10",
    _mean("c", "ply > final_ply - 2", "last10_mean_cp"), _mean("s", "ply > final_ply - 2", "last10_mean_time_spent"), _share("b <= 10", "ply > final_ply - 2", "last10_low_before_10_share"), _share("cp_loss >= 200", "ply > final_ply - 2", "last10_blunder_rate"),
    *(f"COUNT(*) FILTER (WHERE {w}) AS {p}_moves, " + ", ".join([_mean("s", w, f"{p}_mean_time_spent"), _mean("c", w, f"{p}_mean_cp"), _share("b <= 10", w, f"{p}_low_before_10_share"), _share("cp_loss >= 200", w, f"{p}_blunder_rate")]) for p, w in PHASE_BOUNDS.items()),
]).replace(") > 0 AS", ")::BIGINT > 0 AS")


@query(f"""WITH {CLOCK_SQL}, r AS (SELECT game_id, is_white_move, ply, fullmove, cp_loss, least(cp_loss, 250) AS c, time_before AS b, time_after AS a, time_spent AS s, MAX(ply) OVER (PARTITION BY game_id) AS final_ply,
  CASE WHEN is_white_move = 1 THEN eval_before_white ELSE -eval_before_white END AS eb, CASE WHEN (game_id + ply) % 13 = 0 THEN NULL WHEN is_white_move = 1 THEN eval_after_white ELSE -eval_after_white END AS ea,
  CASE WHEN is_white_move = 1 THEN game_id % 3 / 2 ELSE 1 - game_id % 3 / 2 END AS r FROM clocked)
 SELECT game_id, is_white_move, {CLOCKS_SQL} FROM r WHERE (game_id + ply) % 11 <> 0 GROUP BY 1, 2""")
def ag16_player_game_clocks(spark, d):
    """The wide accumulator: 56 features of a side's game and five of each of four phases, one aggregation."""
    mark = F.col("game_id") + F.col("ply")
    score = F.col("game_id") % 3 / 2
    rows = clocked(spark, d).withColumns({
        "time_spent": F.when(mark % 11 != 0, F.col("time_spent")), "eval_before": M.mover_view("eval_before_white"), "eval_after": F.when(mark % 13 != 0, M.mover_view("eval_after_white")),
        "result": F.when(F.col("is_white_move") == 1, score).otherwise(1 - score),
    })
    out = A.player_game_clocks(rows, A.clock_features(250.0, (1, 2, 3), 2, (1, 2, 3)))
    yes = ("reached", "converted", "escaped")
    kinds = dict(out.dtypes)
    return out.select(*((F.col(c) == 1).alias(c) if c.startswith(yes) else r6(c, c) if kinds[c] == "double" else F.col(c) for c in out.columns))


@query(f"WITH {MOVES_SQL} SELECT game_id, ply, GREATEST(0, CASE WHEN is_white_move = 1 THEN eval_before_white - eval_after_white ELSE eval_after_white - eval_before_white END) AS loss FROM moves")
def mv01_centipawn_loss(spark, d):
    return moves(spark, d).select("game_id", "ply", M.centipawn_loss("eval_before_white", "eval_after_white").alias("loss"))


@query(f"WITH {MOVES_SQL} SELECT game_id, ply, abs(eval_before_white) // 10 * 3 AS evaluation FROM moves")
def mv02_evaluate_once(spark, d):
    """Each distinct position, here an evaluation step, is evaluated once and joined back."""
    rows = moves(spark, d).withColumn("position", F.floor(F.abs("eval_before_white") / 10))
    return M.evaluate_positions(rows, lambda p: p.withColumn("evaluation", F.col("position") * 3)).select("game_id", "ply", "evaluation")


@query(f"WITH {CLOCK_SQL} SELECT game_id, ply, CAST(GREATEST(0.0, time_before + 1 - time_after) AS DOUBLE) AS spent FROM clocked")
def mv04_time_spent(spark, d):
    return clocked(spark, d).select("game_id", "ply", M.time_spent(F.col("time_before"), F.lit(1), F.col("time_after")).cast("double").alias("spent"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 180.0 WHEN o_orderkey % 3 = 1 THEN 600.0 WHEN o_orderdate >= TIMESTAMP '1996-09-02' THEN 300.0 ELSE 180.0 END::DOUBLE AS base,
 CASE WHEN o_orderkey % 3 = 0 THEN 2.0 WHEN o_orderkey % 3 = 1 THEN 0.0 WHEN o_orderdate >= TIMESTAMP '1996-09-02' THEN 0.0 ELSE 1.0 END::DOUBLE AS increment,
 CASE WHEN o_orderstatus = 'P' THEN NULL WHEN (o_orderstatus = 'F') = (o_orderkey % 2 = 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS result FROM orders""")
def mv05_time_control(spark, d):
    """MV05 and MV06: time control by text, else by date; a side's result from the game's."""
    from rankflow.plans.fixtures import table

    text = F.when(F.col("o_orderkey") % 3 == 0, "180+2").when(F.col("o_orderkey") % 3 == 1, "600").otherwise("-")
    control = M.time_control(text, F.to_date("o_orderdate"), "1996-09-02")
    result = F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "O", "0-1").otherwise("*")
    return table(spark, d, "orders").select("o_orderkey", control.base.alias("base"), control.increment.alias("increment"), M.player_result(result, S.flag(F.col("o_orderkey") % 2 == 0)).alias("result"))


@query(f"WITH {CLOCK_SQL} SELECT game_id, is_white_move, COUNT(time_before) AS n_clock, " + ", ".join(f"ROUND(AVG((time_before <= {t})::INT), 6) AS before_le{t}, ROUND(AVG((time_after <= {t})::INT), 6) AS after_le{t}, MIN(CASE WHEN time_before <= {t} THEN ply END) AS first_le{t}" for t in (5, 10, 30)) + " FROM clocked GROUP BY 1, 2")
def mv07_low_clock(spark, d):
    out = M.low_clock_exposure(clocked(spark, d))
    return out.select(*(r6(c, c) if "_le" in c and not c.startswith("first") else c for c in out.columns))


@query(f"""WITH {CLOCK_SQL}, x AS (SELECT *, ply > MAX(ply) OVER (PARTITION BY game_id) - 2 AS last FROM clocked)
 SELECT game_id, is_white_move, ROUND(AVG(CASE WHEN time_before <= 20 THEN cp_loss END), 6) AS low_loss, ROUND(AVG(CASE WHEN NOT time_before <= 20 THEN cp_loss END), 6) AS other_loss,
 ROUND(AVG(CASE WHEN time_before <= 20 AND abs(eval_before_white) <= 100 THEN cp_loss END), 6) AS critical_low_loss, ROUND(AVG(CASE WHEN last THEN cp_loss END), 6) AS last_loss, COUNT(*) FILTER (WHERE time_before <= 20 AND cp_loss >= 200) AS low_blunders FROM x GROUP BY 1, 2""")
def mv08_quality_by_clock(spark, d):
    out = M.quality_by_clock(clocked(spark, d), 20, 2)
    return out.select(*(r6(c, c) if c.endswith("loss") else c for c in out.columns))


@query(f"""WITH {MOVES_SQL}, l AS (SELECT *, MAX(ply) OVER (PARTITION BY game_id) AS n FROM moves),
 own AS (SELECT game_id, is_white_move, MAX(((CASE WHEN is_white_move = 1 THEN 1 ELSE -1 END) * eval_after_white >= 200)::BIGINT) AS w, MAX(((CASE WHEN is_white_move = 1 THEN 1 ELSE -1 END) * eval_after_white <= -200)::BIGINT) AS l FROM l GROUP BY 1, 2),
 g AS (SELECT game_id, MAX(eval_after_white) AS hi, MIN(eval_after_white) AS lo FROM l GROUP BY 1), b AS (SELECT game_id, MAX(eval_after_white) AS hi, MIN(eval_after_white) AS lo FROM l WHERE ply <= n - 2 GROUP BY 1)
 SELECT 'own' AS kind, game_id, is_white_move, w AS reached_win, l AS reached_loss FROM own
 UNION ALL SELECT 'any', game_id, s, (CASE WHEN s = 1 THEN hi >= 200 ELSE lo <= -200 END)::BIGINT, (CASE WHEN s = 1 THEN lo <= -200 ELSE hi >= 200 END)::BIGINT FROM g, (VALUES (0), (1)) v(s)
 UNION ALL SELECT 'buffered', game_id, s, (CASE WHEN s = 1 THEN hi >= 200 ELSE lo <= -200 END)::BIGINT, (CASE WHEN s = 1 THEN lo <= -200 ELSE hi >= 200 END)::BIGINT FROM b, (VALUES (0), (1)) v(s)""")
def mv09_conversion(spark, d):
    rows, out = moves(spark, d), None
    for kind in ("own", "any", "buffered"):
        part = M.conversion(rows, kind, buffer=2).select(F.lit(kind).alias("kind"), "game_id", "is_white_move", "reached_win", "reached_loss")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {MOVES_SQL}, b AS (SELECT game_id, fullmove, MAX(CASE WHEN is_white_move = 1 THEN time_after END) AS w, MAX(CASE WHEN is_white_move = 0 THEN time_after END) AS b, MAX(CASE WHEN is_white_move = 0 THEN eval_after_white END) AS e FROM moves WHERE fullmove IN (1, 2, 3) GROUP BY 1, 2)
 SELECT game_id, fullmove, s::BIGINT AS is_white_move, CASE WHEN s = 1 THEN w ELSE b END AS own_clock, CASE WHEN s = 1 THEN b ELSE w END AS opp_clock, CASE WHEN s = 1 THEN e ELSE -e END AS evaluation FROM b, (VALUES (0), (1)) v(s) WHERE w IS NOT NULL AND b IS NOT NULL AND e IS NOT NULL""")
def mv10_snapshots(spark, d):
    return M.snapshots(moves(spark, d), [1, 2, 3])


@query(f"WITH {CLOCK_SQL} SELECT post, is_white_move, ROUND(AVG((time_after > time_before + 0.05)::INT), 6) AS gain_share FROM clocked GROUP BY 1, 2")
def mv11_clock_gain(spark, d):
    return clocked(spark, d).groupBy("post", "is_white_move").agg(r6(F.avg((F.col("time_after") > F.col("time_before") + 0.05).cast("int")), "gain_share"))


THINK_SQL = "CASE WHEN time_spent <= 1 THEN 'le1' WHEN time_spent <= 3 THEN 'le3' WHEN time_spent <= 5 THEN 'le5' WHEN time_spent <= 10 THEN 'le10' WHEN time_spent <= 20 THEN 'le20' ELSE 'gt20' END"


@query(f"WITH {MOVES_SQL} SELECT mover, post, {THINK_SQL} AS think, COUNT(*) AS n_moves, ROUND(AVG(cp_loss), 6) AS mean_loss, ROUND(AVG((cp_loss >= 200)::INT), 6) AS blunder_rate FROM moves GROUP BY 1, 2, 3")
def mv13_cells(spark, d):
    """MV13, MV14 and AG15: cells of many keys; partial sums combine before the shuffle."""
    out = M.cells(moves(spark, d), ["mover", "post", S.thinking_bin("time_spent").alias("think")])
    return out.select("mover", "post", "think", "n_moves", r6("mean_loss", "mean_loss"), r6("blunder_rate", "blunder_rate"))


@query(f"WITH {MOVES_SQL} SELECT game_id, arg_max(eval_after_white, ply) AS eval_after_white, arg_max(time_after, ply) AS time_after FROM moves WHERE ply <= 4 GROUP BY 1")
def mv16_state_at(spark, d):
    return M.state_at(moves(spark, d), 4, ["eval_after_white", "time_after"])


BOARD_SQL = MOVES_SQL + """, board AS (SELECT *, least(cp_loss, 250) AS c, time_spent AS legal, 14 + (game_id + ply) % 19 AS pieces, 10 + ply AS material, (eval_before_white / 100)::DOUBLE AS balance, game_id % 3 AS book,
  CASE WHEN is_white_move = 1 THEN eval_before_white ELSE -eval_before_white END AS eb, CASE WHEN is_white_move = 1 THEN eval_after_white ELSE -eval_after_white END AS ea FROM moves),
 hard AS (SELECT *, legal >= 25 AND pieces >= 18 AND abs(eb) <= 200 AS hard, book > 0 AND fullmove > book AND fullmove <= book + 2 AS after_book FROM board)"""


def _complexity(spark, d):
    """Boards made of a move's columns: time spent stands for legal moves."""
    rows = moves(spark, d).withColumns({
        "eval_before": M.mover_view("eval_before_white"), "eval_after": M.mover_view("eval_after_white"), "legal_moves": F.col("time_spent"), "pieces": 14 + (F.col("game_id") + F.col("ply")) % 19,
        "material": 10 + F.col("ply"), "balance": F.col("eval_before_white") / 100, "book_exit": F.col("game_id") % 3,
    })
    return A.complexity(rows, A.complexity_features(legal=25, edge=200, after_book=2, cap=250.0))


COMPLEX_SQL = ", ".join([
    "COUNT(*) AS move_count, AVG(legal) AS mean_legal_moves, AVG((legal >= 25)::INT) AS high_legal_share, AVG(pieces) AS mean_pieces_remaining, AVG(material) AS mean_total_material, AVG(abs(balance)) AS mean_abs_material_balance, AVG(abs(ea - eb)) AS mean_eval_volatility",
    "AVG(c) FILTER (WHERE legal >= 25) AS high_legal_cp_loss, AVG(c) FILTER (WHERE legal < 25) AS low_legal_cp_loss, AVG(hard::INT) AS complex_share, AVG(c) FILTER (WHERE hard) AS complex_cp_loss, AVG(c) FILTER (WHERE NOT hard) AS quiet_cp_loss",
    "AVG((cp_loss >= 200)::INT) FILTER (WHERE hard) AS complex_blunder_rate, COUNT(*) FILTER (WHERE after_book) AS post_book_moves, AVG(c) FILTER (WHERE after_book) AS post_book_cp_loss",
    "AVG(c) FILTER (WHERE legal >= 25) - AVG(c) FILTER (WHERE legal < 25) AS high_minus_low_legal_cp_loss, AVG(c) FILTER (WHERE hard) - AVG(c) FILTER (WHERE NOT hard) AS complex_minus_quiet_cp_loss",
])
COMPLEX = "mean_legal_moves high_legal_share mean_pieces_remaining mean_total_material mean_abs_material_balance mean_eval_volatility high_legal_cp_loss low_legal_cp_loss complex_share complex_cp_loss quiet_cp_loss complex_blunder_rate post_book_cp_loss high_minus_low_legal_cp_loss complex_minus_quiet_cp_loss".split()


@query(f"WITH {BOARD_SQL}, f AS (SELECT game_id, is_white_move, {COMPLEX_SQL} FROM hard GROUP BY 1, 2) SELECT game_id, is_white_move, move_count, post_book_moves, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in COMPLEX) + " FROM f")
def mv18_complexity(spark, d):
    """MV18 and MV19: play in complex and in quiet positions, and in the moves after the book."""
    return _complexity(spark, d).select("game_id", "is_white_move", "move_count", "post_book_moves", *(r6(c, c) for c in COMPLEX))


@query(f"""WITH {MOVES_SQL}, p AS (SELECT *, CASE WHEN fullmove <= 1 THEN 0 WHEN fullmove <= 2 THEN 1 ELSE 2 END AS phase FROM moves),
 e AS (SELECT game_id, is_white_move, MAX(phase) AS last, MIN(CASE WHEN cp_loss >= 200 THEN phase END) AS failed FROM p GROUP BY 1, 2)
 SELECT game_id, is_white_move, CAST(v.phase AS BIGINT) AS phase, CAST(coalesce(v.phase = failed, false) AS BIGINT) AS event FROM e, (VALUES (0), (1), (2)) v(phase) WHERE v.phase <= last AND v.phase <= coalesce(failed, last)""")
def mv20_hazard(spark, d):
    return M.hazard_rows(moves(spark, d), [1, 2])


_z = lambda c: f"({c} - AVG({c}) OVER ()) / stddev_samp({c}) OVER ()"


@query(f"WITH {BOARD_SQL}, f AS (SELECT game_id, is_white_move, {COMPLEX_SQL} FROM hard GROUP BY 1, 2) SELECT game_id, is_white_move, ROUND({_z('mean_legal_moves')} + {_z('mean_pieces_remaining')} + {_z('mean_eval_volatility')} - {_z('mean_abs_material_balance')}, 5) AS complexity FROM f")
def mv22_complexity_index(spark, d):
    """All four z-terms."""
    return A.complexity_index(_complexity(spark, d)).select("game_id", "is_white_move", F.round("complexity_index", 5).alias("complexity"))


@query(f"WITH {MOVES_SQL} SELECT game_id, mover, list_slice(list([is_capture, gives_check, cp_loss] ORDER BY ply), 1, 3) AS tokens FROM moves GROUP BY 1, 2 HAVING COUNT(*) >= 2")
def ml05_sequences(spark, d):
    """ML05, TK07 and AR01: a mover's first tokens, from games that are long enough."""
    return M.sequences(moves(spark, d), ["is_capture", "gives_check", "cp_loss"], 2, 3)


#: A board of each line: squares by a number made of the line's columns, a third of them empty.
SQUARES = "PNBRQKpnbrqk111111"


@query(f"""WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ply FROM lineitem),
 s AS (SELECT l_orderkey, ply, (l_partkey + sq * l_suppkey) % 18 AS c FROM (SELECT *, unnest(range(64)) AS sq FROM l)),
 f AS (SELECT l_orderkey, ply, COUNT(*) FILTER (WHERE c < 12) AS pieces, SUM(CASE WHEN c < 6 THEN [1, 3, 3, 5, 9, 0][c + 1] ELSE 0 END)::BIGINT AS white_material, SUM(CASE WHEN c BETWEEN 6 AND 11 THEN [1, 3, 3, 5, 9, 0][c - 5] ELSE 0 END)::BIGINT AS black_material,
  COUNT(*) FILTER (WHERE c IN (4, 10)) AS queens FROM s GROUP BY 1, 2),
 k AS (SELECT l_orderkey, ply, array_to_string(list_transform(range(8), lambda r: array_to_string(list_transform(range(8), lambda x: substr('{SQUARES}', CAST((l_partkey + (8 * r + x) * l_suppkey) % 18 + 1 AS INTEGER), 1)), '')), '/') || ' w KQ e3' AS position_key FROM l)
 SELECT l_orderkey, ply, pieces, white_material, black_material, white_material - black_material AS balance, queens, CAST(queens = 0 OR pieces <= 22 AS BIGINT) AS simplified, position_key,
  coalesce(greatest(0, lag(pieces) OVER (PARTITION BY l_orderkey ORDER BY ply) - pieces), 0) AS piece_drop FROM f JOIN k USING (l_orderkey, ply)""")
def mv15_board_features(spark, d):
    """MV15 and ST10 over a board for each line, and the pieces that fell since the line before."""
    from rankflow.plans.fixtures import table

    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    square = lambda i: F.substring(F.lit(SQUARES), ((F.col("l_partkey") + i * F.col("l_suppkey")) % 18 + 1).cast("int"), F.lit(1))
    rank = lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: square(8 * r + x)), "")
    fen = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), rank), "/"), F.lit(" w KQ e3 0 "), F.col("l_linenumber").cast("string"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(own).cast("long").alias("ply"), fen.alias("fen"))
    out = rows.select("l_orderkey", "ply", M.board_features(F.col("fen")).alias("b"), S.position_key("fen").alias("position_key")).select("l_orderkey", "ply", "b.*", "position_key")
    out = out.withColumns({c: F.col(c).cast("long") for c in ("white_material", "black_material", "balance")})
    return M.with_piece_drop(out, ["l_orderkey"], "ply")

