"""One-pass accumulators: many conditional aggregates of a player's moves in a game, declared as a list.

A feature is a fold of a value over the rows that meet a condition. All features of a list become one aggregation over one
exchange by game; what a row must know of its whole game comes from windows over the same exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.scalar import bins, clip, flag
from rankflow.operators.ranges import quantiles
from rankflow.operators.windows import z_scores

SIDE = ["game_id", "is_white_move"]


@dataclass(frozen=True)
class Feature:
    """name: column; fold: `count`, `sum`, `mean`, `share` (mean of a condition), `min`, `max`, `population_sd`, `sample_sd` (0 of one value), `any`,
    `first` or `last` (by ply); value; where: rows that count (all, unless given); missing: instead of null."""

    name: str
    fold: str
    value: Column | None = None
    where: Column | None = None
    missing: object = None

    def column(self, order: Column) -> Column:
        met = F.lit(True) if self.where is None else F.coalesce(self.where, F.lit(False))
        value = F.when(met, F.lit(1) if self.value is None else self.value)
        out = {
            "count": lambda: F.count_if(met & F.coalesce(self.value, F.lit(False)) if self.value is not None else met),
            "sum": lambda: F.sum(value),
            "mean": lambda: F.avg(value),
            "share": lambda: F.avg(F.when(met, F.coalesce(self.value, F.lit(False)).cast("int"))),
            "min": lambda: F.min(value),
            "max": lambda: F.max(value),
            "population_sd": lambda: F.stddev_pop(value),
            "sample_sd": lambda: F.coalesce(F.stddev_samp(value), F.when(F.count(value) > 0, 0.0)),
            "any": lambda: F.max(flag(met)),
            "first": lambda: F.min_by(self.value, F.when(met, order)),
            "last": lambda: F.max_by(self.value, F.when(met, order)),
        }[self.fold]()
        return (out if self.missing is None else F.coalesce(out, F.lit(self.missing))).alias(self.name)


def accumulate(df: DataFrame, keys: list[str], order: str, features: list[Feature]) -> DataFrame:
    return df.groupBy(*keys).agg(*(f.column(F.col(order)) for f in features))


#: Names of phases, up to the 10th, 20th and 35th full move and after.
PHASES = ["opening_1_10", "early_middlegame_11_20", "late_middlegame_21_35", "endgame_36_plus"]


def clock_features(cap: float = 1000.0, edges: tuple[int, ...] = (10, 20, 35), last: int = 10, at: tuple[int, ...] = (10, 20, 30)) -> list[Feature]:
    """A side's clock and quality features of a game, and five of each phase. Rows: ply, fullmove, cp_loss (null: 0),
    eval_before and eval_after (the mover's view), time_before, time_after, time_spent, result (of the side), final_ply (of
    the game)."""
    ply, loss = F.col("ply"), F.coalesce(F.col("cp_loss").cast("double"), F.lit(0.0))
    capped, blunder = F.least(loss, F.lit(cap)), loss >= 200
    before, after, spent = F.col("time_before"), F.col("time_after"), F.col("time_spent")
    low, critical = before <= 10, F.abs("eval_before") <= 100
    winning, losing, ending = F.col("eval_after") >= 200, F.col("eval_after") <= -200, ply > F.col("final_ply") - last
    out = [
        Feature("n_moves", "count"), Feature("max_ply", "max", ply), Feature("mean_cp_loss_cap", "mean", capped), Feature("total_cp_loss_cap", "sum", capped),
        Feature("blunder_rate", "share", blunder), Feature("mistake_rate", "share", loss >= 100), Feature("inaccuracy_rate", "share", loss >= 50),
        Feature("total_time_spent", "sum", spent), Feature("mean_time_spent", "mean", spent), Feature("sd_time_spent", "population_sd", spent), Feature("max_time_spent", "max", spent),
        Feature("mean_time_before", "mean", before), Feature("mean_time_after", "mean", after), Feature("min_time_before", "min", before), Feature("min_time_after", "min", after),
        Feature("final_time_after", "last", after), *(Feature(f"time_after_move_{k}", "last", after, F.col("fullmove") == k) for k in at),
        *(Feature(f"low_{side}_{t}_share", "share", c <= t) for side, c in (("before", before), ("after", after)) for t in (5, 10, 30)),
        *(Feature(f"first_low_after_{t}_ply", "min", ply, after <= t, 0) for t in (10, 30)),
        Feature("fast_moves_le_1s_share", "share", spent <= 1), *(Feature(f"think_moves_ge_{t}s_share", "share", spent >= t) for t in (10, 20, 30)),
        Feature("mean_cp_low_before_10", "mean", capped, low), Feature("mean_cp_nonlow_before_10", "mean", capped, ~low),
        Feature("blunder_rate_low_before_10", "share", blunder, low), Feature("blunder_rate_nonlow_before_10", "share", blunder, ~low),
        Feature("critical_share", "share", critical), Feature("mean_time_critical", "mean", spent, critical), Feature("mean_cp_critical", "mean", capped, critical),
        Feature("blunder_rate_critical", "share", blunder, critical), Feature("critical_low_before_10_share", "share", low, critical),
        Feature("reached_winning_position", "any", where=winning), Feature("reached_losing_position", "any", where=losing),
        Feature("first_winning_ply", "min", ply, winning, 0), Feature("first_losing_ply", "min", ply, losing, 0),
        Feature("first_winning_time_after", "first", after, winning), Feature("first_losing_time_after", "first", after, losing),
        Feature("first_winning_low_after_10", "first", flag(after <= 10), winning, 0), Feature("first_losing_low_after_10", "first", flag(after <= 10), losing, 0),
        Feature("converted_winning_position", "any", where=winning & (F.col("result") == 1)), Feature("escaped_losing_position", "any", where=losing & (F.col("result") >= 0.5)),
        Feature("first_blunder_ply", "min", ply, blunder, 0), Feature("first_blunder_low_before_10", "first", flag(low), blunder, 0),
        Feature("last10_mean_cp", "mean", capped, ending), Feature("last10_mean_time_spent", "mean", spent, ending),
        Feature("last10_low_before_10_share", "share", low, ending), Feature("last10_blunder_rate", "share", blunder, ending),
    ]
    number = bins("fullmove", list(edges), PHASES)
    for name in PHASES:
        own = number == name
        out += [
            Feature(f"{name}_moves", "count", where=own), Feature(f"{name}_mean_time_spent", "mean", spent, own), Feature(f"{name}_mean_cp", "mean", capped, own),
            Feature(f"{name}_low_before_10_share", "share", low, own), Feature(f"{name}_blunder_rate", "share", blunder, own),
        ]
    return out


def player_game_clocks(moves: DataFrame, features: list[Feature] | None = None) -> DataFrame:
    """One row for each game and side: game_id, is_white_move and the features. Rows without a full clock count for the
    game's last ply only; a side all of whose rows are such has no row."""
    moves = moves.withColumn("final_ply", F.max("ply").over(Window.partitionBy("game_id")))
    return accumulate(moves.where("time_before IS NOT NULL AND time_after IS NOT NULL AND time_spent IS NOT NULL"), SIDE, "ply", features or clock_features())


def dynamics(moves: DataFrame, edge: float = 200, equal: float = 100, cap: float = 5000, following: int = 5, keep: DataFrame | None = None) -> DataFrame:
    """One row for each game and side with a move of its own: how its evaluation goes through the game, after the first
    +edge and the first -edge from its view, and in the own moves that follow its first blunder. keep: game_id and
    is_white_move of the rows wanted.

    The state of a row is where it stands to the first crossings: two windows over one sort by game, side and ply. Moves
    that are partitioned by game are not shuffled again."""
    rows = moves.select("game_id", "ply", "fullmove", "is_white_move", F.coalesce(F.col("cp_loss").cast("double"), F.lit(0.0)).alias("loss"), clip("eval_after_white", -cap, cap).cast("double").alias("white"))
    sides = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    sides = sides.withColumns({"e": F.when(F.col("side") == 1, F.col("white")).otherwise(-F.col("white")), "own": F.col("side") == F.col("is_white_move")})
    all_rows = Window.partitionBy("game_id", "side")
    sides = sides.withColumn("n", F.sum(F.col("own").cast("long")).over(all_rows.orderBy("ply").rowsBetween(Window.unboundedPreceding, 0)))
    e, ply, loss, own, n = (F.col(c) for c in ("e", "ply", "loss", "own", "n"))
    first = {"win": F.when(e >= edge, ply), "lost": F.when(e <= -edge, ply), "failed": F.when(own & (loss >= 200), n)}
    sides = sides.withColumns({name: F.min(x).over(all_rows) for name, x in first.items()})
    won, lost, next_moves = ply >= F.col("win"), ply >= F.col("lost"), own & (n > F.col("failed")) & (n <= F.col("failed") + following)
    of = lambda fold, value, where: fold(F.when(where, value))
    known = e.isNotNull()
    out = sides.groupBy("game_id", "side").agg(
        F.count("*").alias("position_count"), F.count_if(own).alias("own_move_count"), F.max(e).alias("max_eval_player_cp"), F.min(e).alias("min_eval_player_cp"),
        F.max_by(e, F.when(known, ply)).alias("final_eval_player_cp"), F.min("win").alias("first_plus2_ply"), F.min("lost").alias("first_minus2_ply"),
        of(F.max, e, won).alias("max_after_plus2_cp"), of(F.min, e, won).alias("min_after_plus2_cp"), F.max_by(e, F.when(won & known, ply)).alias("final_after_plus2_cp"),
        (of(F.max, e, won) - of(F.min, e, won)).alias("advantage_loss_after_plus2_cp"), of(F.max, flag(e < 0), won & known).alias("dropped_below_equal_after_plus2"),
        of(F.max, flag(e < equal), won & known).alias("dropped_below_plus1_after_plus2"), (F.max(ply) - F.min("win")).alias("conversion_speed_plies"),
        of(F.max, e, lost).alias("best_after_minus2_cp"), F.max_by(e, F.when(lost & known, ply)).alias("final_after_minus2_cp"),
        of(F.max, flag(e >= -equal), lost & known).alias("recovered_to_equal_after_minus2"), of(F.max, flag(e >= equal), lost & known).alias("recovered_to_plus1_after_minus2"),
        (of(F.max, e, lost) - of(F.max, e, ply == F.col("lost"))).alias("defensive_recovery_after_minus2_cp"),
        of(F.min, ply, own & (n == F.col("failed"))).alias("first_blunder_ply_dynamic"), of(F.min, F.col("fullmove"), own & (n == F.col("failed"))).alias("first_blunder_move_dynamic"),
        F.min_by("fullmove", F.when(own & (loss >= 100), ply)).alias("first_mistake_move_dynamic"),
        of(F.max, flag(loss >= 200), next_moves).alias("cascade_blunder_next5"), of(F.max, flag(loss >= 100), next_moves).alias("cascade_mistake_next5"),
        of(F.avg, loss, next_moves).alias("mean_cp_loss_next5_after_blunder"), of(F.max, loss, next_moves).alias("max_cp_loss_next5_after_blunder"),
        of(F.max, e, own & (n == F.col("failed"))).alias("eval_after_first_blunder_cp"), of(F.max, e, next_moves).alias("best_eval_next5_after_blunder_cp"),
        of(F.min, e, next_moves).alias("worst_eval_next5_after_blunder_cp"),
    )
    out = out.where("own_move_count > 0").withColumn("recovered_to_equal_next5_after_blunder", flag(F.col("best_eval_next5_after_blunder_cp") >= -equal))
    out = out.withColumn("recovered_to_equal_next5_after_blunder", F.when(F.col("best_eval_next5_after_blunder_cp").isNotNull(), F.col("recovered_to_equal_next5_after_blunder")))
    out = out.withColumn("additional_eval_drop_next5_after_blunder_cp", F.when(F.col("worst_eval_next5_after_blunder_cp").isNotNull(), F.col("eval_after_first_blunder_cp") - F.col("worst_eval_next5_after_blunder_cp")))
    out = out.withColumn("side", F.col("side").cast("long")).withColumnRenamed("side", "is_white_move")
    return out if keep is None else out.join(keep.select("game_id", "is_white_move").distinct(), SIDE, "left_semi")


def style_features(opening: int = 10, end: int = 10, cap: float = 1000.0, phases: tuple[int, int] = (10, 35), last: int = 20) -> list[Feature]:
    """A player's moves after the opening and before a game's last plies. Rows: fullmove, ply, final_ply, cp_loss,
    eval_before, eval_after (the mover's view), is_capture, gives_check, answer (the loss of the other side's next move)."""
    loss, move = F.col("cp_loss").cast("double"), F.col("fullmove")
    capped, inner = F.least(loss, F.lit(cap)), (move > opening) & (F.col("ply") <= F.col("final_ply") - end)
    phase_of = [("opening", move <= phases[0]), ("middlegame", (move > phases[0]) & (move <= phases[1])), ("endgame", move > phases[1])]
    return [
        Feature("style_move_count", "count", where=inner), Feature("capture_rate", "share", F.col("is_capture") == 1, inner), Feature("check_rate", "share", F.col("gives_check") == 1, inner),
        *(Feature(f"own_{n}_rate", "share", loss >= t, inner) for n, t in (("blunder", 200), ("mistake", 100), ("inaccuracy", 50))), Feature("low_cp_loss_rate", "share", loss < 50, inner),
        Feature("mean_cp_loss", "mean", capped, inner), Feature("sd_cp_loss", "sample_sd", capped, inner),
        *(Feature(f"{n}_cp_loss", "mean", capped, inner & own) for n, own in phase_of), Feature("last10_cp_loss", "mean", capped, inner & (F.col("ply") > F.col("final_ply") - last)),
        *(Feature(f"opponent_next_{n}_rate", "share", F.col("answer") >= t, F.col("answer").isNotNull()) for n, t in (("blunder", 200), ("mistake", 100))),
        Feature("eval_swing_rate", "share", F.abs(F.col("eval_after") - F.col("eval_before")) >= 200, inner),
    ]


def player_style(moves: DataFrame, sides: DataFrame, opening: int = 10, end: int = 10, long_game: int = 80, least_games: int = 1, phases: tuple[int, int] = (10, 35), last: int = 20, edge: float = 200) -> DataFrame:
    """The 30 style features of each player with so many games. moves: game_id, ply, fullmove, is_white_move, mover,
    cp_loss, eval_before, eval_after, is_capture, gives_check; sides: game_id, is_white_move, player, result (1, 0.5, 0 or
    null). First blunders, and won and lost positions, are looked for from the first move on; the latter end before a
    game's last plies, like the moves that rates are taken of."""
    game, in_order = Window.partitionBy("game_id"), Window.partitionBy("game_id").orderBy("ply")
    whole, known = moves.withColumn("final_ply", F.max("ply").over(game)), F.expr("cp_loss IS NOT NULL AND eval_before IS NOT NULL AND eval_after IS NOT NULL")
    rows = whole.where(known)
    rows = rows.withColumn("answer", F.when(F.lead("is_white_move").over(in_order) != F.col("is_white_move"), F.lead("cp_loss").over(in_order)))
    features = style_features(opening, end, phases=phases, last=last)
    of_moves = accumulate(rows, ["mover"], "ply", features).where("style_move_count > 0")
    inner = rows.where((F.col("fullmove") > opening) & (F.col("ply") <= F.col("final_ply") - end))
    high = quantiles(inner.withColumn("__loss", F.least(F.col("cp_loss").cast("double"), F.lit(1000.0))), ["mover"], "__loss", {"p90_cp_loss": 0.9})
    before_end = F.col("ply") <= F.col("final_ply") - end
    # both sides' states are one row of the game, so that they meet sides by game alone, where moves are already together
    own = {k: known & (F.col("is_white_move") == k) for k in (0, 1)}
    states = accumulate(whole, ["game_id"], "ply", [Feature("plies", "max", F.col("ply")), *(f for k, of_side in own.items() for f in (
        Feature(f"first_blunder_{k}", "first", F.col("fullmove"), of_side & (F.col("cp_loss") >= 200)), Feature(f"won_{k}", "any", where=of_side & before_end & (F.col("eval_after") >= edge)), Feature(f"lost_{k}", "any", where=of_side & before_end & (F.col("eval_after") <= -edge)),
    ))])
    of_side = lambda c: F.when(F.col("is_white_move") == 1, F.col(f"{c}_1")).when(F.col("is_white_move") == 0, F.col(f"{c}_0")).alias(c)
    games = sides.join(states, "game_id").select("player", "result", "plies", *map(of_side, ("first_blunder", "won", "lost")))
    result, share = F.col("result"), lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("int"))
    of_games = games.groupBy("player").agg(
        F.count("*").alias("prechange_games"), F.avg("plies").alias("avg_game_length_ply"), share(F.col("plies") >= long_game).alias("long_game_share"), share(result == 0.5).alias("draw_rate"),
        share(result != 0.5).alias("decisive_game_rate"), (F.coalesce(F.sum(result), F.lit(0.0)) / F.count("*")).alias("prechange_result_mean"), share(F.col("first_blunder").isNull()).alias("no_blunder_game_rate"),
        F.avg("first_blunder").alias("first_blunder_move_mean"), F.avg(F.when(F.col("won") == 1, F.coalesce(result == 1, F.lit(False)).cast("int"))).alias("conversion_rate_from_plus_2"), F.count_if(F.col("won") == 1).alias("winning_position_games"),
        F.avg(F.when(F.col("lost") == 1, F.coalesce(result > 0, F.lit(False)).cast("int"))).alias("escape_rate_from_minus_2"), F.count_if(F.col("lost") == 1).alias("losing_position_games"),
    )
    out = of_games.where(F.col("prechange_games") >= least_games).join(of_moves.withColumnRenamed("mover", "player"), "player").join(high.withColumnRenamed("mover", "player"), "player", "left")
    return out.select(*PLAYER_STYLE)


#: The columns of player_style.
PLAYER_STYLE = [
    "player", "prechange_games", "style_move_count", "avg_game_length_ply", "long_game_share", "draw_rate", "decisive_game_rate", "prechange_result_mean", "capture_rate", "check_rate",
    "own_blunder_rate", "own_mistake_rate", "own_inaccuracy_rate", "low_cp_loss_rate", "mean_cp_loss", "sd_cp_loss", "p90_cp_loss", "opening_cp_loss", "middlegame_cp_loss", "endgame_cp_loss", "last10_cp_loss",
    "no_blunder_game_rate", "first_blunder_move_mean", "conversion_rate_from_plus_2", "winning_position_games", "escape_rate_from_minus_2", "losing_position_games", "opponent_next_blunder_rate",
    "opponent_next_mistake_rate", "eval_swing_rate",
]


def complexity_features(legal: int = 35, pieces: int = 18, edge: float = 300, after_book: int = 10, cap: float = 1000.0) -> list[Feature]:
    """How a side plays complex positions and the moves after the book. Rows: fullmove, ply, cp_loss, eval_before,
    eval_after, legal_moves, pieces, material, balance (of the position before the move), book_exit (full move, 0: none)."""
    loss, before = F.coalesce(F.col("cp_loss").cast("double"), F.lit(0.0)), F.coalesce("eval_before", F.lit(0))
    capped, many = F.least(loss, F.lit(cap)), F.col("legal_moves") >= legal
    hard = many & (F.col("pieces") >= pieces) & (F.abs(before) <= edge)
    after = (F.col("book_exit") > 0) & (F.col("fullmove") > F.col("book_exit")) & (F.col("fullmove") <= F.col("book_exit") + after_book)
    return [
        Feature("move_count", "count"), Feature("mean_legal_moves", "mean", F.col("legal_moves")), Feature("high_legal_share", "share", many), Feature("mean_pieces_remaining", "mean", F.col("pieces")),
        Feature("mean_total_material", "mean", F.col("material")), Feature("mean_abs_material_balance", "mean", F.abs("balance")), Feature("mean_eval_volatility", "mean", F.abs(F.coalesce("eval_after", before) - before)),
        Feature("high_legal_cp_loss", "mean", capped, many), Feature("low_legal_cp_loss", "mean", capped, ~many), Feature("complex_share", "share", hard), Feature("complex_cp_loss", "mean", capped, hard),
        Feature("quiet_cp_loss", "mean", capped, ~hard), Feature("complex_blunder_rate", "share", loss >= 200, hard), Feature("post_book_moves", "count", where=after), Feature("post_book_cp_loss", "mean", capped, after),
    ]


def complexity(moves: DataFrame, features: list[Feature] | None = None) -> DataFrame:
    """One row for each game and side: complexity_features and the differences of high and low, and of complex and quiet."""
    out = accumulate(moves, SIDE, "ply", features or complexity_features())
    return out.withColumns({"high_minus_low_legal_cp_loss": F.col("high_legal_cp_loss") - F.col("low_legal_cp_loss"), "complex_minus_quiet_cp_loss": F.col("complex_cp_loss") - F.col("quiet_cp_loss")})


def complexity_index(df: DataFrame, winsor: float | None = None) -> DataFrame:
    """df with complexity_index: z-scores of legal moves, pieces and volatility, less that of the material's imbalance
    (null where one of them is)."""
    parts = {"mean_legal_moves": 1, "mean_pieces_remaining": 1, "mean_eval_volatility": 1, "mean_abs_material_balance": -1}
    z = z_scores(df, list(parts), winsor)
    return df.withColumn("complexity_index", sum((z[c] * sign for c, sign in parts.items()), F.lit(0.0)))
