"""Queries of the statistics, style and explorer operators, and their SQL twins where SQL has a form."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.operators import accumulate as A, explorer, formula, moves as M, stats, style
from rankflow.operators.ranges import quantiles
from rankflow.plans.fixtures import MOVES_SQL, PLAYER_GAME_SQL, moves, player_game, table
from rankflow.plans.relational import r6
from rankflow.shared import written

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _result(spark, model):
    return stats.as_table(spark, model).select("term", r6("estimate", "estimate"), "n")


@query(f"""WITH {PLAYER_GAME_SQL}, d AS (SELECT half - AVG(half) OVER (PARTITION BY player) AS y, (rating - opp_rating) / 100 - AVG((rating - opp_rating) / 100) OVER (PARTITION BY player) AS x FROM player_game)
 SELECT 'gap100' AS term, ROUND(SUM(x * y) / SUM(x * x), 6) AS estimate, COUNT(*) AS n FROM d""")
def rg01_absorbed_regression(spark, d):
    """RG01 and RG03: one absorbed effect, errors clustered by player (columns t and p are in the operator's table)."""
    rows = player_game(spark, d).withColumn("gap100", (F.col("rating") - F.col("opp_rating")) / 100)
    return _result(spark, stats.regress(rows, "half", ["gap100"], ["player"], ["player"]))


@query(f"""WITH {PLAYER_GAME_SQL}, w AS (SELECT *, round AS w, (rating - opp_rating) / 100 AS g FROM player_game),
 d AS (SELECT w, half - SUM(w * half) OVER p / SUM(w) OVER p AS y, g - SUM(w * g) OVER p / SUM(w) OVER p AS x FROM w WINDOW p AS (PARTITION BY player))
 SELECT 'gap100' AS term, ROUND(SUM(w * x * y) / SUM(w * x * x), 6) AS estimate, COUNT(*) AS n FROM d""")
def rg04_weighted_regression(spark, d):
    rows = player_game(spark, d).withColumn("gap100", (F.col("rating") - F.col("opp_rating")) / 100)
    return _result(spark, stats.regress(rows, "half", ["gap100"], ["player"], ["player"], weight="round"))


@query()
def rg02_interactions_two_way(spark, d):
    """RG02, RG03 and RG05: interactions, two absorbed effects, errors clustered two ways; post alone is collinear."""
    rows = player_game(spark, d).withColumn("gap100", (F.col("rating") - F.col("opp_rating")) / 100)
    rows, terms = stats.interactions(rows, ["post", "gap100"])
    return stats.as_table(spark, stats.regress(rows, "half", terms, ["player", "tournament"], ["player", "tournament"]))


@query(f"WITH {PLAYER_GAME_SQL}, m AS (SELECT date_diff('day', DATE '2024-01-16', tournament) // 7 AS k, AVG(half) AS m FROM player_game GROUP BY 1) SELECT 'week=' || k AS term, ROUND(m - (SELECT m FROM m WHERE k = -1), 6) AS estimate FROM m WHERE k <> -1")
def rg12_event_study(spark, d):
    """An effect for each week but the one before; without other terms these are differences of means."""
    rows = player_game(spark, d).withColumn("week", (F.datediff("tournament", F.lit("2024-01-16").cast("date")) / 7).cast("int"))
    levels = sorted(r.week for r in rows.select("week").distinct().collect())  # weeks
    rows, terms = stats.dummies(rows, "week", levels, -1)
    table_ = stats.as_table(spark, stats.regress(rows, "half", terms, vcov="hetero"))
    return table_.where("term <> '(constant)'").select("term", r6("estimate", "estimate"))


@query("""WITH p AS (SELECT c_custkey, c_mktsegment, (1 + abs(c_acctbal)) / 20011 AS p FROM customer), r AS (SELECT *, RANK() OVER (PARTITION BY c_mktsegment ORDER BY p) + COUNT(*) OVER (PARTITION BY c_mktsegment, p) - 1 AS r, COUNT(*) OVER (PARTITION BY c_mktsegment) AS n FROM p)
 SELECT c_custkey, ROUND(least(1, MIN(p * n / r) OVER (PARTITION BY c_mktsegment ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r""")
def rg10_benjamini_hochberg(spark, d):
    rows = table(spark, d, "customer").withColumn("p", (1 + F.abs("c_acctbal")) / 20011)
    return stats.benjamini_hochberg(rows, "p", ["c_mktsegment"]).select("c_custkey", r6("q", "q"))


@query(f"""WITH {PLAYER_GAME_SQL}, c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-01-27', INTERVAL 2 DAY)) AS DATE) AS cutoff)
 SELECT cutoff, COUNT(*) FILTER (WHERE tournament < cutoff) AS n_before, COUNT(*) FILTER (WHERE tournament >= cutoff) AS n_after, ROUND(AVG(accuracy) FILTER (WHERE tournament >= cutoff) - AVG(accuracy) FILTER (WHERE tournament < cutoff), 6) AS effect FROM player_game, c GROUP BY 1""")
def rg11_placebo_grid(spark, d):
    grid = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-05").cast("date"), F.lit("2024-01-27").cast("date"), F.expr("interval 2 days"))).alias("cutoff"))
    return stats.placebo_grid(player_game(spark, d), "tournament", "accuracy", grid).withColumn("effect", F.round("effect", 6))


@query(f"""WITH {PLAYER_GAME_SQL}, c AS (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-01-27', INTERVAL 2 DAY)) AS DATE) AS cutoff),
 e AS (SELECT cutoff, AVG(accuracy) FILTER (WHERE tournament >= cutoff) - AVG(accuracy) FILTER (WHERE tournament < cutoff) AS effect FROM player_game, c GROUP BY 1)
 SELECT ROUND((COUNT(*) FILTER (WHERE abs(effect) >= 0.5) + 1) / (COUNT(*) + 1), 6) AS p, ROUND(quantile_cont(effect, 0.5), 6) AS median_effect FROM e""")
def rg11_empirical_p(spark, d):
    grid = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-05").cast("date"), F.lit("2024-01-27").cast("date"), F.expr("interval 2 days"))).alias("cutoff"))
    effects = stats.placebo_grid(player_game(spark, d), "tournament", "accuracy", grid)
    return effects.agg(r6(stats.empirical_p(effects, "effect", 0.5), "p"), r6(F.percentile("effect", F.lit(0.5)), "median_effect"))


@query("""WITH m AS (SELECT event_type AS g, AVG(value) AS m, var_samp(value) AS v, COUNT(*) AS n FROM events GROUP BY 1)
 SELECT a.g AS a, b.g AS b, ROUND(a.m - b.m, 6) AS difference, ROUND((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, ROUND(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS degrees FROM m a JOIN m b ON a.g < b.g""")
def rg14_welch(spark, d):
    return stats.welch(table(spark, d, "events"), "event_type", "value").select("a", "b", r6("difference", "difference"), r6("t", "t"), F.round("degrees", 4).alias("degrees"))


@query("SELECT event_type, ROUND(0.5 * stddev_samp(value), 6) AS per_sd, ROUND(0.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) AS per_iqr FROM events GROUP BY 1")
def rg15_effect_translation(spark, d):
    events = table(spark, d, "events")
    ends = quantiles(events, ["event_type"], "value", {"q25": 0.25, "q75": 0.75})
    return events.groupBy("event_type").agg(r6(0.5 * F.stddev_samp("value"), "per_sd")).join(ends, "event_type").select("event_type", "per_sd", r6(0.5 * (F.col("q75") - F.col("q25")), "per_iqr"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.5) AS q, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, COUNT(*) AS n FROM events),
 h AS (SELECT q, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS h FROM q), f AS (SELECT q, h, (SELECT AVG(exp(-pow((value - q) / h, 2) / 2) / sqrt(2 * pi()) / h) FROM events) AS f FROM h)
 SELECT event_id, ROUND(q + (0.5 - CASE WHEN value <= q THEN 1 ELSE 0 END) / f, 5) AS rif FROM events, f""")
def rg08_rif(spark, d):
    return stats.rif(table(spark, d, "events"), "value", 0.5, "rif").select("event_id", F.round("rif", 5).alias("rif"))


@query()
def rg06_inverse_propensity(spark, d):
    rows = player_game(spark, d).withColumn("x", (F.col("rating") - 1900) / 100)
    out = stats.inverse_propensity(rows, "post", ["x", "round"])
    return out.select("tournament", "round", "player", r6("propensity", "propensity"), r6("weight", "weight"))


@query()
def rg07_calibration(spark, d):
    rows = player_game(spark, d).where("post = 1").withColumn("x", (F.col("rating") - 1900) / 1000)
    return stats.calibrate(rows, ["x"], [0.05]).select("tournament", "round", "player", r6("weight", "weight"))


@query()
def rg16_specification_grid(spark, d):
    rows = player_game(spark, d).withColumn("gap100", (F.col("rating") - F.col("opp_rating")) / 100)
    grid = stats.specification_grid(rows, "half", {"all": "true", "late": "post = 1"}, {"player": ["player"], "day": ["tournament"]}, {"none": [], "colour": ["is_white"]}, ["gap100"], ["player"])
    return spark.createDataFrame(grid, "sample string, effects string, controls string, term string, estimate double, se double, p double, n long, error string")


def _event_days(spark, d):
    rows = player_game(spark, d).withColumns({"gap100": (F.col("rating") - F.col("opp_rating")) / 100, "late": (F.col("round") > 2).cast("long")})
    return rows.withColumn("day", F.datediff("tournament", F.lit("2024-01-16").cast("date")).cast("long"))


@query()
def rg13_pretrends(spark, d):
    """Linear tests on the days before the event, for two outcomes and two variables; absorbed players and tournaments."""
    rows = formula.pretrends(_event_days(spark, d), ["half", "accuracy"], ["gap100", "is_white"], "day", "late", ["player", "tournament"], ["player"])
    return spark.createDataFrame(rows, formula.RESULT)


@query()
def rg20_horse_race(spark, d):
    """Interactions of one treatment with several variables in one model; the treatment's terms are kept by name."""
    rows = formula.horse_race(_event_days(spark, d), ["half", "accuracy"], "post", ["gap100", "is_white", "late"], "gap100 + is_white + factor(round)", ["player", "tournament"], ["player"])
    return spark.createDataFrame(rows, formula.RESULT)


@query()
def rg21_result_index(spark, d):
    """A results table written and read back, and the one row of it that a rule picks; none or several are an error."""
    table_ = written(rg20_horse_race(spark, d))
    one = stats.pick_one(table_, (F.col("outcome") == "half") & (F.col("variable") == "gap100"))
    return spark.createDataFrame([(one.outcome, one.variable, one.estimate, one.n)], "outcome string, variable string, estimate double, n long")


@query()
def rg09_contrast(spark, d):
    """RG09, RG17 and RG19: a contrast and a ratio of two terms, and how many players' effects are positive."""
    rows = player_game(spark, d).withColumn("gap100", (F.col("rating") - F.col("opp_rating")) / 100)
    model = stats.regress(rows, "half", ["gap100", "is_white"], ["player"], ["player"])
    estimate, se, p = stats.contrast(model, {"gap100": 1.0, "is_white": -1.0})
    effects = stats.fixed_effects(rows, "half", model, "player")
    return effects.agg(F.count_if(F.col("fixed_effect") > 0).alias("n_positive")).select("n_positive", F.lit(estimate).alias("difference"), F.lit(se).alias("se"), F.lit(p).alias("p"), F.lit(stats.ratio(model, "is_white", "gap100")).alias("ratio"))


@query("SELECT o_orderstatus AS status, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, COUNT(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high FROM orders GROUP BY 1")
def rg18_wide(spark, d):
    wide = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).count()
    return wide.select("status", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("2-HIGH", F.lit(0)).alias("high"))


@query(f"WITH {PLAYER_GAME_SQL} SELECT player, COUNT(*) AS n, COUNT(*) FILTER (WHERE post = 0) AS n_before, COUNT(*) FILTER (WHERE post = 1) AS n_after FROM player_game GROUP BY 1 HAVING n >= 60 AND n_before > 0 AND n_after > 0")
def ml01_eligible(spark, d):
    return style.eligible(player_game(spark, d), "player", "post", 60)


def _features(spark, d):
    """Style features of movers, at edges that these short games reach; a game's result is its number's."""
    rows = moves(spark, d).withColumns({"eval_before": M.mover_view("eval_before_white"), "eval_after": M.mover_view("eval_after_white")})
    half = F.col("game_id") % 3 / 2
    side = lambda k, player, result: F.struct(F.lit(k).cast("long").alias("is_white_move"), F.col(player).alias("player"), result.alias("result"))
    sides = rows.groupBy("game_id", "white", "black").agg(F.count("*").alias("n")).select("game_id", F.inline(F.array(side(1, "white", half), side(0, "black", 1 - half))))
    return A.player_style(rows, sides, opening=1, end=1, long_game=5, phases=(1, 2), last=3)


_rate = lambda c, w, n: f"AVG(({c})::INT) FILTER (WHERE {w}) AS {n}"
INNER = "fullmove > 1 AND ply <= n - 1"
FEATURES_SQL = f"""{MOVES_SQL}, i AS (SELECT *, MAX(ply) OVER (PARTITION BY game_id) AS n, CASE WHEN is_white_move = 1 THEN eval_before_white ELSE -eval_before_white END AS eb, CASE WHEN is_white_move = 1 THEN eval_after_white ELSE -eval_after_white END AS ea,
  LEAD(cp_loss) OVER (PARTITION BY game_id ORDER BY ply) AS answer FROM moves),
 rates AS (SELECT mover AS player, COUNT(*) FILTER (WHERE {INNER}) AS style_move_count, {", ".join(_rate(c, INNER, x + "_rate") for c, x in (("is_capture = 1", "capture"), ("gives_check = 1", "check"), ("cp_loss >= 200", "own_blunder"), ("cp_loss >= 100", "own_mistake"), ("cp_loss >= 50", "own_inaccuracy"), ("cp_loss < 50", "low_cp_loss"), ("abs(ea - eb) >= 200", "eval_swing")))},
  AVG(cp_loss) FILTER (WHERE {INNER}) AS mean_cp_loss, coalesce(stddev_samp(cp_loss) FILTER (WHERE {INNER}), 0) AS sd_cp_loss, quantile_cont(cp_loss, 0.9) FILTER (WHERE {INNER}) AS p90_cp_loss,
  AVG(cp_loss) FILTER (WHERE {INNER} AND fullmove <= 1) AS opening_cp_loss, AVG(cp_loss) FILTER (WHERE {INNER} AND fullmove = 2) AS middlegame_cp_loss, AVG(cp_loss) FILTER (WHERE {INNER} AND fullmove > 2) AS endgame_cp_loss,
  AVG(cp_loss) FILTER (WHERE {INNER} AND ply > n - 3) AS last10_cp_loss, {_rate("answer >= 200", "answer IS NOT NULL", "opponent_next_blunder_rate")}, {_rate("answer >= 100", "answer IS NOT NULL", "opponent_next_mistake_rate")} FROM i GROUP BY 1),
 st AS (SELECT game_id, is_white_move, arg_min(fullmove, ply) FILTER (WHERE cp_loss >= 200) AS fb, bool_or(ply <= n - 1 AND ea >= 200) AS won, bool_or(ply <= n - 1 AND ea <= -200) AS lost FROM i GROUP BY 1, 2),
 s AS (SELECT game_id, MAX(ply) AS plies, 1 AS is_white_move, white AS player, game_id % 3 / 2 AS result FROM moves GROUP BY game_id, white UNION ALL SELECT game_id, MAX(ply), 0, black, 1 - game_id % 3 / 2 FROM moves GROUP BY game_id, black),
 g AS (SELECT player, COUNT(*) AS prechange_games, AVG(plies) AS avg_game_length_ply, AVG((plies >= 5)::INT) AS long_game_share, AVG((result = 0.5)::INT) AS draw_rate, AVG((result <> 0.5)::INT) AS decisive_game_rate, AVG(result) AS prechange_result_mean,
  AVG((fb IS NULL)::INT) AS no_blunder_game_rate, AVG(fb) AS first_blunder_move_mean, AVG((result = 1)::INT) FILTER (WHERE won) AS conversion_rate_from_plus_2, COUNT(*) FILTER (WHERE won) AS winning_position_games,
  AVG((result > 0)::INT) FILTER (WHERE lost) AS escape_rate_from_minus_2, COUNT(*) FILTER (WHERE lost) AS losing_position_games FROM s LEFT JOIN st USING (game_id, is_white_move) GROUP BY 1),
 features AS (SELECT * FROM g JOIN rates USING (player) WHERE style_move_count > 0)"""
COUNTS = ["prechange_games", "style_move_count", "winning_position_games", "losing_position_games"]
RATES = [c for c in A.PLAYER_STYLE[1:] if c not in COUNTS]


@query(f"WITH {FEATURES_SQL} SELECT player, {', '.join(COUNTS)}, " + ", ".join(f"ROUND({c}, 5) AS {c}" for c in RATES) + " FROM features")
def ml02_player_features(spark, d):
    """All 30."""
    return _features(spark, d).select("player", *COUNTS, *(F.round(c, 5).alias(c) for c in RATES))


_z = lambda c, sign=1: f"{sign} * ({c} - AVG({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)"
_index = lambda parts: "(" + " + ".join(f"coalesce({_z(c, s)}, 0)" for c, s in parts.items()) + ") / nullif(" + " + ".join(f"({_z(c)} IS NOT NULL)::INT" for c in parts) + ", 0)"
_quartile = lambda c: f"ceil((RANK() OVER (ORDER BY ROUND({c}, 9)) + (COUNT(*) OVER (PARTITION BY ROUND({c}, 9)) - 1) / 2) / COUNT({c}) OVER () * 4)"


@query(f"""WITH {FEATURES_SQL}, x AS (SELECT player, {_index(style.CLEAN)} AS clean, {_index(style.CHAOS)} AS chaos, {_index(style.SELF_RISK)} AS risk FROM features),
 q AS (SELECT *, {_quartile("clean")} AS cq, {_quartile("chaos")} AS hq, {_quartile("chaos - risk")} AS pq FROM (SELECT * FROM x))
 SELECT player, ROUND(clean, 5) AS clean, ROUND(chaos, 5) AS chaos, ROUND(chaos - risk, 5) AS practical, ROUND({_z("(chaos - risk)")}, 5) AS practical_z, cq::BIGINT AS clean_quartile, hq::BIGINT AS chaos_quartile, pq::BIGINT AS practical_quartile,
  CASE WHEN cq = 4 AND hq = 4 THEN 'sharp_clean' WHEN hq = 4 THEN 'chaos_creator' WHEN cq = 4 THEN 'clean_technician' WHEN cq = 1 AND hq = 1 THEN 'quiet_leaky' ELSE 'middle' END AS style_archetype FROM q""")
def ml03_style_index(spark, d):
    """Indexes, quartiles and archetypes of styles."""
    out = style.style_scores(_features(spark, d), winsor=None)
    names = {"clean_style_index": "clean", "chaos_creator_index": "chaos", "practical_chaos_index": "practical", "practical_chaos_index_z": "practical_z"}
    return out.select("player", *(F.round(c, 5).alias(n) for c, n in names.items()), "clean_quartile", "chaos_quartile", F.col("practical_chaos_quartile").alias("practical_quartile"), "style_archetype")


SANS = ["e4", "Nf3", "O-O", "Bxc4", "Rd1", "Q+", "Kf1", "", "+Nf3", "?"]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [[0, 1, 6, 2, 3, 4, 5, 7, 1, 7][l_suppkey % 10 + 1], CASE WHEN l_partkey % 11 = 0 THEN 64 ELSE l_partkey % 64 END, CASE WHEN l_partkey % 11 = 0 THEN 64 ELSE l_suppkey % 64 END, (l_returnflag = 'R')::BIGINT, (l_linestatus = 'O')::BIGINT,
 CASE WHEN l_linenumber <= 4 THEN l_linenumber - 1 ELSE 4 END, CASE WHEN q < 10 THEN 0 WHEN q < 25 THEN 1 WHEN q < 50 THEN 2 WHEN q < 100 THEN 3 WHEN q < 200 THEN 4 ELSE 5 END, floor((greatest(-1000, least(1000, l_extendedprice - 30000)) + 1000) / 100), least(20, floor((q - 1) / 5))]::BIGINT[] AS token
 FROM (SELECT *, l_quantity::BIGINT AS q FROM lineitem)""")
def ml04_move_tokens(spark, d):
    """All nine fields of a move's token, of squares, names and values made of a line's columns."""
    phases = ["first", "second", "third", "fourth"]
    square = lambda c: F.concat(F.char(97 + F.col(c) % 8), (1 + F.floor(F.col(c) / 8) % 8).cast("string"))
    uci = F.when(F.col("l_partkey") % 11 == 0, "0-0").otherwise(F.concat(square("l_partkey"), square("l_suppkey")))
    san = F.element_at(F.array(*map(F.lit, SANS)), (F.col("l_suppkey") % 10 + 1).cast("int"))
    phase, quantity = F.element_at(F.array(*map(F.lit, [*phases, *["other"] * 3])), F.col("l_linenumber").cast("int")), F.col("l_quantity").cast("long")
    token = style.move_token(uci, san, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", phase, quantity, F.col("l_extendedprice") - 30000, quantity, phases)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", token.alias("token"))


@query()
def ml06_split(spark, d):
    return style.split(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.2, 13)


@query("""WITH m AS (SELECT label, i, AVG(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2)
 SELECT label, CAST(i AS BIGINT) AS i, ROUND(x / sqrt(SUM(x * x) OVER (PARTITION BY label)), 5) AS x FROM m""")
def ml08_mean_embeddings(spark, d):
    out = style.mean_embeddings(table(spark, d, "embeddings"), "label", "embedding")
    return out.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@query()
def ml09_clusters(spark, d):
    out, _ = style.cluster(table(spark, d, "embeddings"), "embedding", [3, 5])
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def ml10_components(spark, d):
    out = style.principal_components(_features(spark, d), RATES)
    return out.select("player", *(F.round(F.col("components")[k], 4).alias(f"component_{k + 1}") for k in range(2)))


@query("""WITH l AS (SELECT label, 'd' || i AS feature, embedding[i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS i)),
 w AS (SELECT feature, AVG(value) AS m, stddev_samp(value) AS sd FROM l GROUP BY 1), p AS (SELECT label, feature, AVG(value) AS mean, COUNT(*) AS n FROM l GROUP BY 1, 2)
 SELECT label, feature, ROUND(mean, 5) AS mean, n, ROUND((mean - m) / sd, 5) AS difference, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY abs((mean - m) / sd) DESC, feature) AS place FROM p JOIN w USING (feature)) WHERE place <= 3""")
def ml11_cluster_profiles(spark, d):
    wide = table(spark, d, "embeddings").select("label", *(F.col("embedding")[k].cast("double").alias(f"d{k}") for k in range(64)))
    out = style.cluster_profiles(wide, "label", [f"d{k}" for k in range(64)], 3)
    return out.select("label", "feature", F.round("mean", 5).alias("mean"), "n", F.round("difference", 5).alias("difference"), "place")


@query(f"""WITH {PLAYER_GAME_SQL}, g AS (SELECT player, AVG(half) FILTER (WHERE post = 0) AS b, AVG(half) FILTER (WHERE post = 1) AS a, COUNT(*) FILTER (WHERE post = 0) AS n_before, COUNT(*) FILTER (WHERE post = 1) AS n_after FROM player_game GROUP BY 1)
 SELECT player, ROUND(b, 6) AS before, ROUND(a, 6) AS after, n_before, n_after, ROUND(a - b, 6) AS change, ROW_NUMBER() OVER (ORDER BY a - b DESC, player) AS place FROM g WHERE n_before >= 20 AND n_after >= 20""")
def ml12_before_after(spark, d):
    out = style.before_after(player_game(spark, d), "player", "post", "half", 20)
    return out.select("player", r6("before", "before"), r6("after", "after"), "n_before", "n_after", r6("change", "change"), "place")


def _visits(spark, d):
    """Moves as an opening book has them: positions are the evaluation before, moves the time spent."""
    return moves(spark, d).select(
        (F.col("eval_before_white") % 40).cast("string").alias("position_key"), (F.col("time_spent") % 6).cast("string").alias("move"), F.concat(F.lit("m"), F.col("time_spent") % 6).alias("move_name"),
        "game_id", "ply", (1500 + F.col("mover") * 7).alias("rating"), (F.col("game_id") % 3).alias("white_half"), ((F.col("white") + F.col("black")) * 3 / 2).alias("mean_rating"), F.greatest("white", "black").alias("max_rating"),
    )


VISITS_SQL = MOVES_SQL + """, visits AS (SELECT CAST(eval_before_white % 40 AS VARCHAR) AS position_key, CAST(time_spent % 6 AS VARCHAR) AS move, 'm' || time_spent % 6 AS move_name, game_id, ply, 1500 + mover * 7 AS rating,
 game_id % 3 AS white_half, (white + black) * 3 / 2 AS mean_rating, greatest(white, black) AS max_rating FROM moves)"""


@query(f"WITH {VISITS_SQL} SELECT position_key, move, MAX(move_name) AS move_name, COUNT(*) AS n, SUM(rating)::BIGINT AS rating_sum, COUNT(*) AS rating_n, COUNT(*) FILTER (WHERE white_half = 2) AS white_wins, COUNT(*) FILTER (WHERE white_half = 1) AS draws, COUNT(*) FILTER (WHERE white_half = 0) AS black_wins FROM visits GROUP BY 1, 2")
def ex01_move_stats(spark, d):
    """The explorer's index (SK04)."""
    return explorer.move_stats(_visits(spark, d))


TOP_SQL = VISITS_SQL + """, f AS (SELECT position_key, game_id, MIN(ply) AS ply, MAX(mean_rating) AS mean_rating, MAX(max_rating) AS max_rating FROM visits WHERE ply >= 2 GROUP BY 1, 2),
 top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY position_key ORDER BY mean_rating DESC, max_rating DESC, game_id DESC, ply DESC) AS place FROM f)"""


@query(f"WITH {TOP_SQL} SELECT position_key, place, game_id, ply, mean_rating, max_rating FROM top WHERE place <= 5")
def tk03_top_games(spark, d):
    return explorer.top_games(_visits(spark, d)).select("position_key", "place", "game_id", "ply", "mean_rating", "max_rating")


@query(f"""WITH {VISITS_SQL}, s AS (SELECT position_key, move, move_name, COUNT(*) AS n, AVG(rating) AS r, 100 * COUNT(*) FILTER (WHERE white_half = 2) / COUNT(*) AS w, 100 * COUNT(*) FILTER (WHERE white_half = 1) / COUNT(*) AS d, 100 * COUNT(*) FILTER (WHERE white_half = 0) / COUNT(*) AS b FROM visits GROUP BY 1, 2, 3)
 SELECT position_key, ROW_NUMBER() OVER (PARTITION BY position_key ORDER BY n DESC, move_name, move) AS place, move, move_name, n, ROUND(w, 1) AS white_share, ROUND(d, 1) AS draw_share, ROUND(b, 1) AS black_share, ROUND(r, 1) AS mean_rating FROM s QUALIFY place <= 4""")
def tk04_top_moves(spark, d):
    """TK04, SC16 and SK12."""
    return explorer.top_moves(explorer.move_stats(_visits(spark, d)), 4)


@query(f"""WITH {TOP_SQL}, g AS (SELECT game_id, list(move_name ORDER BY ply) AS m FROM visits GROUP BY 1)
 SELECT position_key, place, game_id, array_to_string(list_slice(m, ply + 1, ply + 5), ' ') AS continuation FROM top JOIN g USING (game_id) WHERE place <= 5""")
def tk07_continuations(spark, d):
    rows = _visits(spark, d)
    return explorer.continuations(explorer.top_games(rows), rows).select("position_key", "place", "game_id", "continuation")
