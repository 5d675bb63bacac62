"""Declared accumulators on hand-made games: missing clocks, first crossings, what follows a blunder, ties and nulls."""

import os
import re

import pytest
from pyspark.sql import functions as F

from rankflow.operators import accumulate as A
from rankflow.operators import relational as R
from rankflow.plans import analysis, fixtures

MOVES = "game_id long, ply long, fullmove long, is_white_move long, cp_loss double, eval_before double, eval_after double, time_before double, time_after double, time_spent double, result double"


def test_clock_features_of_a_game(spark):
    rows = [
        (1, 1, 1, 1, 10.0, 0.0, -10.0, 60.0, 55.0, 5.0, 1.0), (1, 2, 1, 0, None, 10.0, 250.0, None, 50.0, 5.0, 0.0), (1, 3, 2, 1, 1500.0, 90.0, 210.0, 9.0, 8.0, 1.0, 1.0),
        (1, 5, 3, 1, 150.0, None, None, 4.0, 31.0, 20.0, 1.0), (1, 40, 20, 0, 0.0, 0.0, 0.0, 5.0, None, 1.0, 0.0), (2, 1, 1, 1, 0.0, 0.0, 0.0, 5.0, 4.0, 1.0, None),
    ]
    got = {(r.game_id, r.is_white_move): r for r in A.player_game_clocks(spark.createDataFrame(rows, MOVES)).collect()}
    assert set(got) == {(1, 1), (2, 1)}  # black has no move with a whole clock
    r = got[1, 1]
    assert (r.n_moves, r.max_ply, r.total_cp_loss_cap, r.blunder_rate, r.mistake_rate) == (3, 5, 1160.0, 1 / 3, 2 / 3)
    assert (r.final_time_after, r.time_after_move_10, r.min_time_after, r.first_low_after_10_ply, r.first_low_after_30_ply) == (31.0, None, 8.0, 3, 3)
    assert (r.critical_share, r.mean_cp_critical, r.reached_winning_position, r.first_winning_ply, r.first_winning_low_after_10, r.converted_winning_position) == (2 / 3, 505.0, 1, 3, 1, 1)
    assert (r.reached_losing_position, r.first_losing_ply, r.first_losing_time_after, r.escaped_losing_position) == (0, 0, None, 0)
    assert (r.first_blunder_ply, r.first_blunder_low_before_10, r.last10_mean_cp, r.opening_1_10_moves, r.endgame_36_plus_moves, r.endgame_36_plus_mean_cp) == (3, 1, None, 3, 0, None)
    assert (got[2, 1].converted_winning_position, got[2, 1].sd_time_spent, got[2, 1].last10_mean_cp) == (0, 0.0, 0.0)
    assert len(got[2, 1]) == 2 + 56 + 20 and len(A.clock_features()) == len(got[2, 1]) - 2


def test_dynamics_of_a_game(spark):
    evals = [0, 250, None, 90, -10, -300, -200, 150, 6000]
    losses = [0, 0, 120, 0, 300, None, 250, 0, 0]
    rows = [(1, i + 1, i // 2 + 1, (i + 1) % 2, None if loss is None else float(loss), None if e is None else float(e)) for i, (e, loss) in enumerate(zip(evals, losses))]
    df = spark.createDataFrame(rows, "game_id long, ply long, fullmove long, is_white_move long, cp_loss double, eval_after_white double")
    white, black = sorted(A.dynamics(df).collect(), key=lambda r: -r.is_white_move)
    assert (white.position_count, white.own_move_count, white.max_eval_player_cp, white.min_eval_player_cp, white.final_eval_player_cp) == (9, 5, 5000.0, -300.0, 5000.0)
    assert (white.first_plus2_ply, white.first_minus2_ply, white.max_after_plus2_cp, white.advantage_loss_after_plus2_cp, white.conversion_speed_plies) == (2, 6, 5000.0, 5300.0, 7)
    assert (white.dropped_below_equal_after_plus2, white.best_after_minus2_cp, white.recovered_to_plus1_after_minus2, white.defensive_recovery_after_minus2_cp) == (1, 5000.0, 1, 5300.0)
    assert (white.first_mistake_move_dynamic, white.first_blunder_ply_dynamic, white.first_blunder_move_dynamic, white.cascade_blunder_next5, white.max_cp_loss_next5_after_blunder) == (2, 5, 3, 1, 250.0)
    assert (white.eval_after_first_blunder_cp, white.best_eval_next5_after_blunder_cp, white.additional_eval_drop_next5_after_blunder_cp, white.recovered_to_equal_next5_after_blunder) == (-10.0, 5000.0, 190.0, 1)
    assert (black.first_plus2_ply, black.first_minus2_ply, black.first_blunder_ply_dynamic, black.cascade_blunder_next5, black.recovered_to_equal_next5_after_blunder) == (6, 2, None, None, None)
    assert len(white) == 33 and A.dynamics(df, keep=df.where("ply = 1")).count() == 1 and A.dynamics(df.where("ply = 1")).count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_parts_of_games_have_bounded_rows(spark, monkeypatch):
    """The rows of a part of moves do not grow with the table, and what follows by game stays in these parts."""
    monkeypatch.setattr(R, "PART_ROWS", 300)
    rows = fixtures.moves(spark, "/root/testdata/sf0.001")
    parts = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(parts) == 20 and max(r.n for r in parts) < 600 and sum(r.n for r in parts) == 6000
    assert A.dynamics(rows).rdd.getNumPartitions() == 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
@pytest.mark.parametrize("name", ["tk04_top_moves", "tk07_continuations", "tk03_top_games", "ml02_player_features"])
def test_queries_of_moves_use_the_parts(spark, monkeypatch, name):
    """Every reading of the lines goes into parts of bounded rows, and the result is that of the table in one part."""
    query, d = analysis.QUERIES[name], "/root/testdata/sf0.001"
    whole = query(spark, d).collect()
    monkeypatch.setattr(R, "PART_ROWS", 300)
    df = query(spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == plan.count(", 20), REPARTITION_BY_NUM") > 0
    assert sorted(df.collect(), key=str) == sorted(whole, key=str)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_player_features_meet_by_game(spark, monkeypatch):
    """What is known of a game's sides joins in the parts of games: no shuffle of all sides into a set number of tasks."""
    monkeypatch.setattr(R, "PART_ROWS", 300)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = analysis.QUERIES["ml02_player_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ", 20), REPARTITION_BY_NUM" in plan
    assert not re.search(r"hashpartitioning\([^)]*(game_id|is_white_move)#", plan)


def test_states_of_both_sides_of_a_game(spark):
    """First blunders, won and lost positions by side; a side without known moves has none, a game without moves no row."""
    rows = [
        (1, 1, 1, 1, "a", 0, 0, 250), (1, 2, 1, 0, "b", 300, -250, -300), (1, 3, 2, 1, "a", 250, 300, 50), (1, 4, 2, 0, "b", None, -50, -60),
        (2, 1, 1, 1, "a", 0, 0, -200), (2, 2, 1, 0, "b", None, None, None), (2, 3, 2, 1, "a", 0, 0, 0),
    ]
    moves = spark.createDataFrame(rows, "game_id long, ply long, fullmove long, is_white_move long, mover string, cp_loss long, eval_before long, eval_after long").withColumns({"is_capture": F.lit(0), "gives_check": F.lit(0)})
    sides = spark.createDataFrame([(1, 1, "a", 1.0), (1, 0, "b", 0.0), (2, 1, "a", 0.5), (2, 0, "b", 0.5), (3, 1, "a", 1.0)], "game_id long, is_white_move long, player string, result double")
    got = {r.player: r for r in A.player_style(moves, sides, opening=0, end=0, long_game=4, phases=(1, 2), last=2).collect()}
    a, b = got["a"], got["b"]
    assert (a.prechange_games, a.avg_game_length_ply, a.long_game_share, a.no_blunder_game_rate, a.first_blunder_move_mean) == (2, 3.5, 0.5, 0.5, 2.0)
    assert (a.winning_position_games, a.conversion_rate_from_plus_2, a.losing_position_games, a.escape_rate_from_minus_2) == (1, 1.0, 1, 1.0)
    assert (b.prechange_games, b.no_blunder_game_rate, b.first_blunder_move_mean, b.winning_position_games, b.conversion_rate_from_plus_2) == (2, 0.5, 1.0, 0, None)
    assert (b.losing_position_games, b.escape_rate_from_minus_2) == (1, 0.0)
