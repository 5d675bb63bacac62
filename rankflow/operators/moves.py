"""Move, clock and conversion features of ordered games.

A move has game_id, ply, is_white_move, mover, evaluations from white's view and clock times. Evaluations of the mover
are white's, negated for black. Missing values are null; tests of null are false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.scalar import clip, clocks_seconds, flag

SIDE = ["game_id", "is_white_move"]


def in_game():
    return Window.partitionBy("game_id").orderBy("ply")


def own_moves():
    return Window.partitionBy(*SIDE).orderBy("ply")


def mover_view(white: str | Column) -> Column:
    white = F.col(white) if isinstance(white, str) else white
    return F.when(F.col("is_white_move") == 1, white).otherwise(-white)


def centipawn_loss(before: str, after: str) -> Column:
    """Loss of a move from the mover's view, 0 at least; null if an evaluation is missing."""
    loss = mover_view(F.col(before)) - mover_view(F.col(after))
    return F.when(loss.isNotNull(), F.greatest(F.lit(0), loss))


def evaluate_positions(moves: DataFrame, evaluate, key: str = "position") -> DataFrame:
    """moves with `evaluation`: each distinct position is evaluated once, by evaluate (a function of the DataFrame of
    distinct positions that adds the column), and joined back."""
    return moves.join(evaluate(moves.select(key).distinct()), key, "left")


def clock_before(base: Column) -> Column:
    """The mover's clock before the move: what the own last move left, else base."""
    return F.coalesce(F.lag("time_after").over(own_moves()), base)


def time_spent(before: Column, increment: Column, after: Column) -> Column:
    return F.greatest(F.lit(0.0), before + increment - after)


def clocks_of(movetext: Column) -> Column:
    """Array of the clock comments of a movetext, in seconds."""
    return clocks_seconds(F.regexp_extract_all(movetext, F.lit(r"\[%clk\s+([0-9:.]+)\]"), F.lit(1)))


def time_control(text: Column, date: Column, cutoff: str = "2025-09-02") -> Column:
    """struct<base, increment> in seconds of `base+inc` or `base`; else by date: 300+0 from the cutoff on, 180+1 before."""
    base, inc = (F.regexp_extract(text, r"^\s*(\d+)(?:\+(\d+))?\s*$", k).try_cast("double") for k in (1, 2))
    late = F.coalesce(date >= F.lit(cutoff).cast("date"), F.lit(False))
    return F.when(base.isNotNull(), F.struct(base.alias("base"), F.coalesce(inc, F.lit(0.0)).alias("increment"))).otherwise(
        F.struct(F.when(late, 300.0).otherwise(180.0).alias("base"), F.when(late, 0.0).otherwise(1.0).alias("increment"))
    )


def player_result(result: Column, is_white: Column) -> Column:
    """1, 0.5 or 0 from a game's result as text, by colour; null for unfinished games."""
    white = F.when(result == "1-0", 1.0).when(result == "0-1", 0.0).when(result.isin("1/2-1/2", "0.5-0.5"), 0.5)
    return F.when(is_white == 1, white).otherwise(1 - white)


def low_clock_exposure(moves: DataFrame, thresholds=(5, 10, 30)) -> DataFrame:
    """For each game and side: share of moves begun and ended at or under each threshold, and the first such ply."""
    share = lambda c, t: F.avg(F.when(F.col(c) <= t, 1.0).when(F.col(c).isNotNull(), 0.0))
    aggregates = [x for t in thresholds for x in (share("time_before", t).alias(f"before_le{t}"), share("time_after", t).alias(f"after_le{t}"), F.min(F.when(F.col("time_before") <= t, F.col("ply"))).alias(f"first_le{t}"))]
    return moves.groupBy(*SIDE).agg(F.count("time_before").alias("n_clock"), *aggregates)


def quality_by_clock(moves: DataFrame, threshold: int = 10, last: int = 10) -> DataFrame:
    """Mean loss under and over a clock threshold, of critical moves under it, of the last plies; blunders under it."""
    moves = moves.withColumn("__last", F.max("ply").over(Window.partitionBy("game_id")) - last)
    low = F.coalesce(F.col("time_before") <= threshold, F.lit(False))
    critical = F.coalesce(F.abs("eval_before_white") <= 100, F.lit(False))
    loss = F.col("cp_loss")
    return moves.groupBy(*SIDE).agg(
        F.avg(F.when(low, loss)).alias("low_loss"), F.avg(F.when(~low, loss)).alias("other_loss"), F.avg(F.when(low & critical, loss)).alias("critical_low_loss"),
        F.avg(F.when(F.col("ply") > F.col("__last"), loss)).alias("last_loss"), F.count_if(low & (loss >= 200)).alias("low_blunders"),
    )


def conversion(moves: DataFrame, kind: str, edge: int = 200, buffer: int = 10, cap: int = 5000) -> DataFrame:
    """For each game and side: reached_win, reached_loss (1 if the evaluation, from the side's view, ever reached edge or
    -edge). kind, the three definitions in use: `own` takes the evaluation after own moves only; `any` after every move;
    `buffered` after every move up to `buffer` plies before the end."""
    rows = moves.withColumn("__eval", clip("eval_after_white", -cap, cap))
    if kind == "buffered":
        rows = rows.withColumn("__end", F.max("ply").over(Window.partitionBy("game_id"))).where(F.col("ply") <= F.col("__end") - buffer)
    if kind == "own":
        view = mover_view("__eval")
        return rows.groupBy(*SIDE).agg(F.max(flag(view >= edge)).alias("reached_win"), F.max(flag(view <= -edge)).alias("reached_loss"))
    both = rows.groupBy("game_id").agg(F.max("__eval").alias("__hi"), F.min("__eval").alias("__lo"))
    side = lambda w, hi, lo: F.struct(F.lit(w).cast("long").alias("is_white_move"), flag(hi).alias("reached_win"), flag(lo).alias("reached_loss"))
    hi, lo = F.col("__hi"), F.col("__lo")
    return both.select("game_id", F.inline(F.array(side(1, hi >= edge, lo <= -edge), side(0, lo <= -edge, hi >= edge))))


def snapshots(moves: DataFrame, at: list[int]) -> DataFrame:
    """At the given full moves, for games with both sides' moves there: clocks of both and the evaluation after black's
    move, as two mirrored rows."""
    side = lambda c, w: F.max(F.when(F.col("is_white_move") == w, F.col(c)))
    both = moves.where(F.col("fullmove").isin(at)).groupBy("game_id", "fullmove").agg(side("time_after", 1).alias("w"), side("time_after", 0).alias("b"), side("eval_after_white", 0).alias("e"))
    row = lambda k, own, opp, e: F.struct(F.lit(k).cast("long").alias("is_white_move"), F.col(own).alias("own_clock"), F.col(opp).alias("opp_clock"), e.alias("evaluation"))
    return both.where("w IS NOT NULL AND b IS NOT NULL AND e IS NOT NULL").select("game_id", "fullmove", F.inline(F.array(row(1, "w", "b", F.col("e")), row(0, "b", "w", -F.col("e")))))


def around_first_low(moves: DataFrame, threshold: int, before: int = 5, after: int = 5) -> DataFrame:
    """Mean loss of a side's moves before and from its first move begun at or under a clock threshold, and whether the
    clock was ever over it again."""
    index = F.row_number().over(own_moves())
    rows = moves.where("time_before IS NOT NULL").withColumn("__i", index)
    first = F.min(F.when(F.col("time_before") <= threshold, F.col("__i"))).over(Window.partitionBy(*SIDE))
    rows = rows.withColumn("__k", F.col("__i") - first).where("__k IS NOT NULL")
    k, loss = F.col("__k"), F.col("cp_loss")
    return rows.groupBy(*SIDE).agg(
        F.avg(F.when(k.between(-before, -1), loss)).alias("loss_before"), F.avg(F.when(k.between(0, after - 1), loss)).alias("loss_after"),
        F.max(flag((k > 0) & (F.col("time_before") > threshold))).alias("recovered"),
    )


def cells(moves: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Counts, mean loss and blunder rate by keys."""
    return moves.groupBy(*keys).agg(F.count("*").alias("n_moves"), F.avg("cp_loss").alias("mean_loss"), F.avg(flag(F.col("cp_loss") >= 200)).alias("blunder_rate"))


def rhythm(moves: DataFrame) -> DataFrame:
    """Adjacent moves of both sides, formed after moves without a clock are dropped: the other side's last thinking time
    and the loss of its answer; null where the neighbouring row is of the same side."""
    rows = moves.where("time_spent IS NOT NULL")
    before, after = F.lag("is_white_move").over(in_game()) != F.col("is_white_move"), F.lead("is_white_move").over(in_game()) != F.col("is_white_move")
    return rows.withColumn("opp_time", F.when(before, F.lag("time_spent").over(in_game()))).withColumn("answer_loss", F.when(after, F.lead("cp_loss").over(in_game())))


def state_at(moves: DataFrame, ply: int, columns: list[str]) -> DataFrame:
    """The columns of the last row of each game at or before a ply."""
    return moves.where(F.col("ply") <= ply).groupBy("game_id").agg(F.max_by(F.struct(*columns), "ply").alias("__s")).select("game_id", "__s.*")


def hazard_rows(moves: DataFrame, edges: list[int], loss: int = 200) -> DataFrame:
    """Rows of a discrete-time hazard model: a side and phase it reached (full moves up to edges, then on) without a
    blunder before; event: its first blunder falls in the phase."""
    phase = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        phase = F.when(F.col("fullmove") <= edges[k], F.lit(k)).otherwise(phase)
    rows = moves.withColumn("__phase", phase)
    ends = rows.groupBy(*SIDE).agg(F.max("__phase").alias("__last"), F.min(F.when(F.col("cp_loss") >= loss, F.col("__phase"))).alias("__failed"))
    at_risk = F.sequence(F.lit(0), F.least(F.col("__last"), F.coalesce("__failed", F.col("__last"))))
    return ends.select(*SIDE, F.explode(at_risk).alias("phase"), "__failed").select(*SIDE, F.col("phase").cast("long").alias("phase"), flag(F.col("phase") == F.col("__failed")).alias("event"))


def sequences(moves: DataFrame, fields: list[str], least: int, most: int) -> DataFrame:
    """For each game and mover, with at least `least` moves: the fields of its first `most` moves, in order of ply."""
    items = F.array_sort(F.collect_list(F.struct("ply", F.array(*(F.col(c).cast("long") for c in fields)).alias("token"))))
    out = moves.groupBy("game_id", "mover").agg(items.alias("__items")).where(F.size("__items") >= least)  # a game's moves are few
    return out.select("game_id", "mover", F.slice(F.transform("__items", lambda x: x.token), 1, most).alias("tokens"))


#: Material worth of pieces.
WORTH = {"p": 1, "n": 3, "b": 3, "r": 5, "q": 9}


def board_features(fen: Column) -> Column:
    """struct<pieces, white_material, black_material, balance, queens, simplified> of a FEN's placement field."""
    placement = F.substring_index(fen, " ", 1)
    count = lambda c: (F.length(placement) - F.length(F.replace(placement, F.lit(c), F.lit("")))).cast("long")
    white = sum((count(c.upper()) * w for c, w in WORTH.items()), F.lit(0))
    black = sum((count(c) * w for c, w in WORTH.items()), F.lit(0))
    pieces = F.length(F.regexp_replace(placement, r"[^A-Za-z]", "")).cast("long")
    queens = count("Q") + count("q")
    return F.struct(pieces.alias("pieces"), white.alias("white_material"), black.alias("black_material"), (white - black).alias("balance"), queens.alias("queens"), flag((queens == 0) | (pieces <= 22)).alias("simplified"))


def with_piece_drop(positions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """positions with piece_drop: pieces fewer than in the position before (0 in the first, and where none fell)."""
    before = F.lag("pieces").over(Window.partitionBy(*keys).orderBy(order))
    return positions.withColumn("piece_drop", F.coalesce(F.greatest(before - F.col("pieces"), F.lit(0)), F.lit(0)).cast("long"))


def opening_of(url: Column) -> Column:
    """struct<name, depth> of an opening's URL: words of the last part up to `...`, and the highest move number in it."""
    slug = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    name = F.trim(F.replace(F.regexp_replace(F.regexp_replace(slug, r"\.\.\..*$", ""), r"-\d+\..*$", ""), F.lit("-"), F.lit(" ")))
    numbers = F.transform(F.regexp_extract_all(slug, F.lit(r"(\d{1,2})\."), F.lit(1)), lambda x: x.cast("long"))
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.array_max(numbers).alias("depth"))
