"""Queries of filters, bins, joins, aggregates, top-k and set operators on the raw tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankflow.functions import scalar as S
from rankflow.operators import ordered
from rankflow.operators import relational as R
from rankflow.operators.ranges import quantiles
from rankflow.plans.fixtures import MOVES_SQL, PAIRINGS_SQL, PLAYER_GAME_SQL, moves, pairings, player_game, table

QUERIES, ORACLE = {}, {}
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(x, name):
    return F.round(x, 6).alias(name)


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def sc02_column_selection(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_quantity")


@query("SELECT 'orders' AS source, o_orderkey AS id, o_totalprice AS amount, NULL AS quantity FROM orders UNION ALL SELECT 'lines', l_orderkey, NULL, l_quantity FROM lineitem")
def sc06_union_fill(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("quantity"))
    return R.union_fill({"orders": orders, "lines": lines})


@query("SELECT o_orderkey AS game, 'TPC' AS origin FROM orders")
def pf01_rename_constant(spark, d):
    return table(spark, d, "orders").select("o_orderkey").withColumnsRenamed({"o_orderkey": "game"}).withColumn("origin", F.lit("TPC"))


@query(f"WITH {PLAYER_GAME_SQL} SELECT tournament, round, player FROM player_game WHERE player % 5 <> 0 AND round > 1 AND rating > 0 AND accuracy IS NOT NULL")
def pf02_valid_rows(spark, d):
    return player_game(spark, d).where("player % 5 <> 0 AND round > 1 AND rating > 0 AND accuracy IS NOT NULL").select("tournament", "round", "player")


@query(f"WITH {PLAYER_GAME_SQL} SELECT tournament, round, player, accuracy FROM player_game WHERE accuracy > 0 AND accuracy < 100")
def pf03_valid_accuracy(spark, d):
    return player_game(spark, d).where("accuracy > 0 AND accuracy < 100").select("tournament", "round", "player", "accuracy")


@query(f"WITH {PLAYER_GAME_SQL} SELECT tournament, round, player, 2025 - (1960 + player % 50) AS age_fixed, year(tournament) - (1960 + player % 50) AS age_event FROM player_game WHERE year(tournament) - (1960 + player % 50) BETWEEN 20 AND 60")
def pf04_age_window(spark, d):
    born = 1960 + F.col("player") % 50
    rows = player_game(spark, d).withColumns({"age_fixed": 2025 - born, "age_event": F.year("tournament") - born})
    return rows.where("age_event BETWEEN 20 AND 60").select("tournament", "round", "player", "age_fixed", "age_event")


@query("SELECT o_orderkey, CAST(o_orderdate >= TIMESTAMP '1996-09-01' AS BIGINT) AS post_first, CAST(o_orderdate >= TIMESTAMP '1996-09-02' AS BIGINT) AS post_second FROM orders")
def pf05_treatment_flag(spark, d):
    after = lambda x: S.flag(F.col("o_orderdate") >= F.lit(x).cast("timestamp_ntz"))
    return table(spark, d, "orders").select("o_orderkey", after("1996-09-01").alias("post_first"), after("1996-09-02").alias("post_second"))


@query("SELECT o_orderkey, m AS month_index, least(greatest(m, -12), 6) AS clamped FROM (SELECT o_orderkey, 12 * (year(o_orderdate) - 1996) + month(o_orderdate) - 9 AS m FROM orders)")
def pf06_month_index(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.month_index("o_orderdate", 1996, 9).cast("long").alias("month_index"), S.month_index("o_orderdate", 1996, 9, -12, 6).cast("long").alias("clamped"))


@query("""SELECT o_orderkey, CAST(12 * (year(o_orderdate) - 1996) + month(o_orderdate) - 9 - CASE WHEN day(o_orderdate) < 15 THEN 1 ELSE 0 END AS BIGINT) AS months
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-09-15'""")
def pf07_whole_months(spark, d):
    start = F.lit("1996-09-15").cast("timestamp")
    return table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1996-09-15").cast("timestamp_ntz")).select("o_orderkey", S.whole_months(start, F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))).alias("months"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-09-01' - 365 AND DATE '1996-09-01' + 365")
def pf08_near_window(spark, d):
    middle = F.lit("1996-09-01").cast("date")
    return table(spark, d, "orders").where(F.to_date("o_orderdate").between(F.date_sub(middle, 365), F.date_add(middle, 365))).select("o_orderkey")


@query(f"WITH {PLAYER_GAME_SQL} SELECT tournament, round, player, ROUND(1 / (1 + pow(10, (opp_rating - rating) / 400)), 6) AS expected, ROUND(half / 2 - 1 / (1 + pow(10, (opp_rating - rating) / 400)), 6) AS surplus FROM player_game")
def pf09_expected_score(spark, d):
    e = S.expected_score("rating", "opp_rating")
    return player_game(spark, d).select("tournament", "round", "player", r6(e, "expected"), r6(F.col("half") / 2 - e, "surplus"))


@query(f"""WITH {PLAYER_GAME_SQL} SELECT tournament, round, player, g / 100 AS gap100, abs(g) / 100 AS distance100, CAST(g > 0 AS BIGINT) AS favourite, CAST(g < 0 AS BIGINT) AS underdog, CAST(g >= 200 AS BIGINT) AS heavy
  FROM (SELECT *, rating - opp_rating AS g FROM player_game)""")
def pf10_rating_gaps(spark, d):
    g = F.col("rating") - F.col("opp_rating")
    return player_game(spark, d).select("tournament", "round", "player", (g / 100).alias("gap100"), (F.abs(g) / 100).alias("distance100"), S.flag(g > 0).alias("favourite"), S.flag(g < 0).alias("underdog"), S.flag(g >= 200).alias("heavy"))


@query(f"WITH {MOVES_SQL} SELECT game_id, ply, CASE WHEN v IS NULL THEN NULL ELSE greatest(-300, least(300, v)) END AS clipped FROM (SELECT *, CASE WHEN ply % 5 = 0 THEN NULL ELSE eval_after_white END AS v FROM moves)")
def pf11_clip(spark, d):
    return moves(spark, d).select("game_id", "ply", S.clip(F.when(F.col("ply") % 5 != 0, F.col("eval_after_white")), -300, 300).alias("clipped"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'top' WHEN o_orderstatus = 'O' THEN 'open' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'rest' END AS kind FROM orders")
def pf12_case_ladder(spark, d):
    kind = F.when(F.col("o_totalprice") > 300000, "top").when(F.col("o_orderstatus") == "O", "open").when(F.col("o_totalprice") > 100000, "middle").otherwise("rest")
    return table(spark, d, "orders").select("o_orderkey", kind.alias("kind"))


@query("WITH t AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 5) SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT * FROM t) THEN CAST(c_nationkey AS VARCHAR) ELSE 'Other' END AS nation FROM customer")
def pf13_other_group(spark, d):
    customers = table(spark, d, "customer")
    top = customers.groupBy("c_nationkey").count().orderBy(F.desc("count"), "c_nationkey").limit(5).select("c_nationkey", F.col("c_nationkey").cast("string").alias("nation"))
    return customers.join(top, "c_nationkey", "left").select("c_custkey", F.coalesce("nation", F.lit("Other")).alias("nation"))


@query(f"WITH {MOVES_SQL} SELECT game_id, ply, CAST(cp_loss >= 200 AS BIGINT) AS blunder, CAST(cp_loss >= 100 AS BIGINT) AS mistake, CAST(cp_loss >= 50 AS BIGINT) AS inaccuracy FROM moves")
def pf14_threshold_flags(spark, d):
    return moves(spark, d).select("game_id", "ply", *(S.flag(F.col("cp_loss") >= x).alias(n) for n, x in (("blunder", 200), ("mistake", 100), ("inaccuracy", 50))))


@query(f"WITH {MOVES_SQL} SELECT game_id, ply, CASE WHEN fullmove <= 1 THEN 'opening' WHEN fullmove <= 2 THEN 'early middlegame' WHEN fullmove <= 4 THEN 'late middlegame' ELSE 'endgame' END AS phase FROM moves")
def pf15_phase(spark, d):
    return moves(spark, d).select("game_id", "ply", S.phase("fullmove", [1, 2, 4]).alias("phase"))


@query(f"WITH {MOVES_SQL} SELECT game_id, ply, CAST(ply > MAX(ply) OVER (PARTITION BY game_id) - 2 AS BIGINT) AS last_two FROM moves")
def pf16_last_plies(spark, d):
    return moves(spark, d).select("game_id", "ply", S.flag(F.col("ply") > F.max("ply").over(Window.partitionBy("game_id")) - 2).alias("last_two"))


@query(f"WITH {MOVES_SQL} SELECT game_id, ply, CAST(coalesce(abs(v) <= 100, false) AS BIGINT) AS critical FROM (SELECT *, CASE WHEN ply % 4 <> 0 THEN eval_before_white END AS v FROM moves)")
def pf17_critical(spark, d):
    return moves(spark, d).select("game_id", "ply", S.flag(F.abs(F.when(F.col("ply") % 4 != 0, F.col("eval_before_white"))) <= 100).alias("critical"))


SAMPLES = {"all": "true", "large": "l_quantity > 25", "returned": "l_returnflag = 'R'", "late large": "l_quantity > 25 AND l_shipdate >= timestamp '1997-01-01'"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS sample, COUNT(*) AS n FROM lineitem WHERE {p}" for n, p in SAMPLES.items()))
def pf18_predicate_grid(spark, d):
    """Each named predicate, given as text, counted in one pass."""
    lines = table(spark, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    counts = lines.agg(*(F.count_if(F.expr(p)).alias(n) for n, p in SAMPLES.items()))
    return counts.unpivot([], list(SAMPLES), "sample", "n")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS invalid FROM events")
def pf19_coercion(spark, d):
    return table(spark, d, "events").select("event_id", S.number(F.get_json_object("props", "$.k")).alias("number"), S.number("event_type").alias("invalid"))


@query("SELECT event_id, list_filter([CASE WHEN value > 1 THEN NULL ELSE 'value over 1' END, CASE WHEN user_id % 10 <> 3 THEN NULL ELSE 'user' END], lambda x: x IS NOT NULL) AS broken FROM events WHERE NOT (value > 1 AND user_id % 10 <> 3)")
def pf20_violations(spark, d):
    return R.violations(table(spark, d, "events"), {"value over 1": F.col("value") > 1, "user": F.col("user_id") % 10 != 3}).select("event_id", "broken")


@query("SELECT o_orderkey, CAST(o_orderstatus = 'O' AS BIGINT) AS is_o, CAST(o_orderstatus = 'P' AS BIGINT) AS is_p FROM orders")
def pf21_one_hot(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *(S.flag(F.col("o_orderstatus") == x).alias(f"is_{x.lower()}") for x in ("O", "P")))


@query(f"""WITH {MOVES_SQL} SELECT game_id, ply,
  CASE WHEN time_after <= 5 THEN 'le5' WHEN time_after <= 10 THEN 'le10' WHEN time_after <= 30 THEN 'le30' WHEN time_after <= 60 THEN 'le60' WHEN time_after <= 120 THEN 'le120' ELSE 'gt120' END AS clock_bin,
  CASE WHEN time_spent <= 1 THEN 'le1' WHEN time_spent <= 3 THEN 'le3' WHEN time_spent <= 5 THEN 'le5' WHEN time_spent <= 10 THEN 'le10' WHEN time_spent <= 20 THEN 'le20' ELSE 'gt20' END AS think_bin,
  CASE WHEN time_spent <= 1 THEN 0.5 WHEN time_spent <= 3 THEN 2.0 WHEN time_spent <= 5 THEN 4.0 WHEN time_spent <= 10 THEN 7.5 WHEN time_spent <= 20 THEN 15.0 WHEN time_spent <= 40 THEN 30.0 ELSE 50.0 END::DOUBLE AS think_middle,
  CASE WHEN cp_loss <= 25 THEN 'le25' WHEN cp_loss <= 50 THEN 'le50' WHEN cp_loss <= 100 THEN 'le100' WHEN cp_loss <= 200 THEN 'le200' WHEN cp_loss <= 500 THEN 'le500' ELSE 'gt500' END AS swing_bin,
  CASE WHEN cp_loss < 10 THEN 0 WHEN cp_loss < 25 THEN 1 WHEN cp_loss < 50 THEN 2 WHEN cp_loss < 100 THEN 3 WHEN cp_loss < 200 THEN 4 ELSE 5 END::BIGINT AS loss_token,
  CAST(floor((greatest(-1000, least(1000, eval_after_white)) + 1000) / 100) AS BIGINT) AS eval_token,
  CAST(greatest(0, least(20, floor((fullmove - 1) / 5))) AS BIGINT) AS move_token FROM moves""")
def bn01_move_bins(spark, d):
    """BN01 to BN07: clock, thinking time (6 and 7 classes), evaluation swing and the three sequence tokens."""
    return moves(spark, d).select(
        "game_id", "ply", S.clock_bin("time_after").alias("clock_bin"), S.thinking_bin("time_spent").alias("think_bin"), S.thinking_bin_with_middle("time_spent").middle.alias("think_middle"),
        S.swing_bin("cp_loss").alias("swing_bin"), S.loss_token("cp_loss").alias("loss_token"), S.evaluation_token("eval_after_white").alias("eval_token"), S.move_token("fullmove").alias("move_token"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity <= 10 THEN '(0,10]' WHEN l_quantity <= 25 THEN '(10,25]' ELSE '(25,Inf)' END AS right_closed, CASE WHEN l_quantity < 10 THEN '[0,10)' WHEN l_quantity < 25 THEN '[10,25)' ELSE '[25,Inf)' END AS left_closed, least(CAST(l_quantity AS BIGINT), 10) AS capped FROM lineitem")
def bn08_cut(spark, d):
    """BN08, BN09 and BN13: right-closed, left-closed and capped bins."""
    right, left = S.bins("l_quantity", [10, 25], ["(0,10]", "(10,25]", "(25,Inf)"]), S.bins("l_quantity", [10, 25], ["[0,10)", "[10,25)", "[25,Inf)"], right=False)
    return table(spark, d, "lineitem").select(*LINE, right.alias("right_closed"), left.alias("left_closed"), F.least(F.col("l_quantity").cast("long"), F.lit(10)).alias("capped"))


@query("SELECT c_custkey, CAST(ceil((r + (COUNT(*) OVER (PARTITION BY c_acctbal) - 1) / 2) / COUNT(*) OVER () * 4) AS BIGINT) AS quartile FROM (SELECT *, RANK() OVER (ORDER BY c_acctbal) AS r FROM customer)")
def bn10_quartile(spark, d):
    from rankflow.operators.windows import average_rank

    ranked = average_rank(table(spark, d, "customer"), "c_acctbal", "r", "n")
    return ranked.select("c_custkey", F.ceil(F.col("r") / F.col("n") * 4).alias("quartile"))


@query("SELECT c_custkey, CAST(c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.75) FROM customer) AS BIGINT) AS high, CAST(c_acctbal <= (SELECT quantile_cont(c_acctbal, 0.25) FROM customer) AS BIGINT) AS low FROM customer")
def bn11_quantile_flags(spark, d):
    customers = table(spark, d, "customer")
    edges = quantiles(customers, [], "c_acctbal", {"q75": 0.75, "q25": 0.25})
    return customers.join(F.broadcast(edges)).select("c_custkey", S.flag(F.col("c_acctbal") >= F.col("q75")).alias("high"), S.flag(F.col("c_acctbal") <= F.col("q25")).alias("low"))  # one row


@query("SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 9 THEN 'early' WHEN hour(ts) < 17 THEN 'work' WHEN hour(ts) < 22 THEN 'evening' ELSE 'late' END AS convenience FROM events")
def bn12_hour_steps(spark, d):
    return table(spark, d, "events").select("event_id", S.bins(F.hour("ts"), [6, 9, 17, 22], ["night", "early", "work", "evening", "late"], right=False).alias("convenience"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn02_inner_join(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(*LINE, "o_custkey")


@query("SELECT coalesce(c_custkey, o_custkey) AS custkey, COUNT(o_orderkey) AS n_orders, CAST(MAX(CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) FULL JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def jn03_outer_joins(spark, d):
    customers, orders = table(spark, d, "customer").where("c_custkey % 3 <> 0"), table(spark, d, "orders")
    both = customers.join(orders, customers.c_custkey == orders.o_custkey, "full_outer")
    return both.groupBy(F.coalesce("c_custkey", "o_custkey").alias("custkey")).agg(F.count("o_orderkey").alias("n_orders"), F.max(S.flag(F.col("c_custkey").isNull())).alias("unknown"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def jn09_anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def jn10_semi_join(spark, d):
    keep = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(keep, "l_orderkey", "left_semi").select(*LINE)


@query(f"WITH {MOVES_SQL} SELECT game_id, ply, o_orderpriority FROM moves JOIN orders ON game_id = o_orderkey")
def jn11_merge_join(spark, d):
    """Moves in order meet orders in order; an absent order, or one behind the cursor, is an error."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("game_id"), F.col("o_orderkey").alias("line"), "o_orderpriority")
    rows = moves(spark, d).select("game_id", "ply", F.struct("game_id", "ply").alias("place"))
    return ordered.merge_join(rows, orders, "game_id", "place", "line").select("game_id", "ply", "o_orderpriority")


@query("""WITH b AS (SELECT l_orderkey AS k, COUNT(*) AS n FROM lineitem WHERE l_orderkey <= (SELECT MAX(o_orderkey) * 3 // 4 FROM orders) GROUP BY 1),
 a AS (SELECT o_orderkey AS k, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
 f AS (SELECT coalesce(MIN(k), 9223372036854775807) AS k FROM a WHERE k NOT IN (SELECT k FROM b))
 SELECT a.k AS o_orderkey, o_custkey, n FROM a JOIN b USING (k) WHERE a.k < (SELECT k FROM f)""")
def jn12_skip_tolerant_merge(spark, d):
    """Orders that have lines meet groups of lines, of which the last quarter is missing: the right side's other groups
    are skipped, and the first order that finds none ends the join."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    known = orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("place"))
    end = orders.agg(F.expr("max(o_orderkey) * 3 div 4").alias("__end"))
    groups = lines.join(F.broadcast(end), F.col("l_orderkey") <= F.col("__end")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))  # one row
    return ordered.merge_join(known, groups.withColumn("line", F.col("o_orderkey")), "o_orderkey", "place", "line", absent="stop").select("o_orderkey", "o_custkey", "n")


@query("SELECT u.user_id, y.day, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) y LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1, 2) o ON o.user_id = u.user_id AND o.day = y.day")
def jn13_dense_panel(spark, d):
    events = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    return R.dense_panel(events.groupBy("user_id", "day").agg(F.count("*").alias("n")), events.select("user_id"), events.select("day"), "n")


@query("SELECT r_name, o AS outcome, c AS control FROM region, (VALUES ('result'), ('loss')) a(o), (VALUES (0), (1)) b(c)")
def jn14_grid(spark, d):
    grid = spark.createDataFrame([("result", 0), ("result", 1), ("loss", 0), ("loss", 1)], "outcome string, control int")
    return table(spark, d, "region").select("r_name").crossJoin(grid)


@query("SELECT a.c_custkey, b.s_suppkey FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey AND abs(a.c_acctbal - b.s_acctbal) <= 10")
def jn18_rating_support(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return R.band_join(c, s, [("c_nationkey", "s_nationkey")], "c_acctbal", "s_acctbal", 10).select("c_custkey", "s_suppkey")


@query(f"WITH {MOVES_SQL} SELECT a.game_id, a.ply, b.mover AS answer FROM moves a LEFT JOIN moves b ON a.game_id = b.game_id AND b.ply = a.ply + 1")
def jn19_point_lookup(spark, d):
    rows = moves(spark, d)
    after = rows.select("game_id", (F.col("ply") - 1).alias("ply"), F.col("mover").alias("answer"))
    return rows.select("game_id", "ply").join(after, ["game_id", "ply"], "left")


@query("SELECT n_nationkey, COUNT(*) AS n FROM nation JOIN (SELECT upper(n_name) AS name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey) x ON lower(n_name) = lower(x.name) GROUP BY 1")
def jn20_folded_key(spark, d):
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    named = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.lower(F.upper("n_name")).alias("key"))
    return nation.withColumn("key", F.lower("n_name")).join(named, "key").groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS mean, ROUND(SUM(l_extendedprice), 2) AS total, MIN(l_quantity) AS low, MAX(l_quantity) AS high, ROUND(stddev_samp(l_quantity), 6) AS sd, median(l_quantity) AS middle FROM lineitem GROUP BY 1")
def ag01_group_by(spark, d):
    q = "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.avg(q), "mean"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.min(q).alias("low"), F.max(q).alias("high"), r6(F.stddev_samp(q), "sd"), F.percentile(q, F.lit(0.5)).alias("middle"))


@query(f"WITH {MOVES_SQL} SELECT mover, ROUND(AVG(cp_loss) FILTER (WHERE time_after <= 10), 6) AS low_clock_loss, COUNT(*) FILTER (WHERE is_capture = 1) AS captures, ROUND(AVG(cp_loss) FILTER (WHERE ply > 1000), 6) AS nothing FROM moves GROUP BY 1")
def ag02_conditional(spark, d):
    return moves(spark, d).groupBy("mover").agg(r6(F.avg(F.when(F.col("time_after") <= 10, F.col("cp_loss"))), "low_clock_loss"), F.count_if(F.col("is_capture") == 1).alias("captures"), r6(F.avg(F.when(F.col("ply") > 1000, F.col("cp_loss"))), "nothing"))


@query("SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT CASE WHEN l_quantity > 40 THEN l_suppkey END) AS suppliers FROM lineitem GROUP BY 1")
def ag03_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.when(F.col("l_quantity") > 40, F.col("l_suppkey"))).alias("suppliers"))


@query(f"WITH {PLAYER_GAME_SQL} SELECT player, bool_or(post = 0) AND bool_or(post = 1) AS both_periods, bool_and(accuracy > 1) AS always FROM player_game GROUP BY 1")
def ag04_any_all(spark, d):
    """AG04 and AG21: any, all, and players seen in both periods."""
    return player_game(spark, d).groupBy("player").agg((F.bool_or(F.col("post") == 0) & F.bool_or(F.col("post") == 1)).alias("both_periods"), F.bool_and(F.col("accuracy") > 1).alias("always"))


@query(f"WITH {PLAYER_GAME_SQL} SELECT tournament, player, arg_min(opponent, round) AS first_opponent, arg_max(opponent, round) AS last_opponent, arg_max(round, accuracy * 1000 - round) AS best_round FROM player_game GROUP BY 1, 2")
def ag05_first_and_argmax(spark, d):
    """AG05 and AG06: first by order, last by order, and the row of the most (the first of several)."""
    return player_game(spark, d).groupBy("tournament", "player").agg(F.min_by("opponent", "round").alias("first_opponent"), F.max_by("opponent", "round").alias("last_opponent"), F.max_by("round", F.struct("accuracy", -F.col("round"))).alias("best_round"))


@query("SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS common, arg_min(o_orderpriority, (-n, f)) AS common_first FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS n, MIN(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY 1")
def ag07_mode(spark, d):
    """Mode with ties to the alphabetically least, and to the first seen."""
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("f"))
    return counts.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("common"), F.min_by("o_orderpriority", F.struct(-F.col("n"), "f")).alias("common_first"))


@query(f"WITH {MOVES_SQL} SELECT mover, ROUND(SUM(time_spent * cp_loss) / SUM(CASE WHEN cp_loss IS NOT NULL THEN time_spent END), 6) AS weighted FROM moves GROUP BY 1")
def ag08_weighted_mean(spark, d):
    w = F.col("time_spent")
    return moves(spark, d).groupBy("mover").agg(r6(F.sum(w * F.col("cp_loss")) / F.sum(F.when(F.col("cp_loss").isNotNull(), w)), "weighted"))


@query("SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.1), 6) AS p10, ROUND(quantile_cont(l_extendedprice, 0.9), 6) AS p90, ROUND(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr FROM lineitem GROUP BY 1")
def ag09_quantiles(spark, d):
    out = quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    return out.select("l_returnflag", r6("p10", "p10"), r6("p90", "p90"), r6(F.col("p75") - F.col("p25"), "iqr"))


@query(f"WITH {MOVES_SQL} SELECT game_id, mover, ROUND(AVG(cp_loss), 6) AS mean, ROUND(coalesce(stddev_samp(cp_loss), 0), 6) AS sd, ROUND(stddev_pop(time_spent), 6) AS population_sd FROM moves GROUP BY 1, 2")
def ag10_variance(spark, d):
    """AG10 and AG11: sample deviation (0 for one row) and population deviation."""
    return moves(spark, d).groupBy("game_id", "mover").agg(r6(F.avg("cp_loss"), "mean"), r6(F.coalesce(F.stddev_samp("cp_loss"), F.lit(0.0)), "sd"), r6(F.stddev_pop("time_spent"), "population_sd"))


@query(f"WITH {MOVES_SQL} SELECT game_id, CASE WHEN COUNT(*) > 1 THEN ROUND(regr_slope(cp_loss, ply), 6) END AS slope FROM moves GROUP BY 1")
def ag12_slope(spark, d):
    return moves(spark, d).groupBy("game_id").agg(r6(F.regr_slope("cp_loss", "ply"), "slope"))


@query("SELECT l_suppkey, ROUND(SUM(p * p), 6) AS herfindahl, ROUND(-SUM(p * ln(p)), 6) AS entropy, ROUND(MAX(p), 6) AS top_share, COUNT(*) AS kinds FROM (SELECT l_suppkey, l_partkey, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY l_suppkey) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def ag13_concentration(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").count()
    p = counts.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("l_suppkey")))
    return p.groupBy("l_suppkey").agg(r6(F.sum(F.col("p") * F.col("p")), "herfindahl"), r6(-F.sum(F.col("p") * F.ln("p")), "entropy"), r6(F.max("p"), "top_share"), F.count("*").alias("kinds"))


@query(f"WITH {MOVES_SQL} SELECT game_id, MIN(CASE WHEN eval_after_white >= 200 THEN ply END) AS first_plus, MIN(CASE WHEN eval_after_white <= -200 THEN ply END) AS first_minus FROM moves GROUP BY 1")
def ag14_first_threshold(spark, d):
    return moves(spark, d).groupBy("game_id").agg(F.min(F.when(F.col("eval_after_white") >= 200, F.col("ply"))).alias("first_plus"), F.min(F.when(F.col("eval_after_white") <= -200, F.col("ply"))).alias("first_minus"))


@query("SELECT c_custkey, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0) AS row_mean FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS b, CASE WHEN c_custkey % 5 = 0 THEN 7 END AS c FROM customer)")
def ag17_row_mean(spark, d):
    from rankflow.operators.windows import row_mean

    when = lambda k, x: F.when(F.col("c_custkey") % k == 0, x)
    return table(spark, d, "customer").select("c_custkey", row_mean([when(2, F.col("c_nationkey")), when(3, F.col("c_custkey")), when(5, F.lit(7))]).alias("row_mean"))


@query("SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE NOT (o_totalprice > 1000)) AS cheap, MIN(CAST(o_orderdate AS DATE)) AS first_day, MAX(CAST(o_orderdate AS DATE)) AS last_day, COUNT(*) - COUNT(nullif(o_orderstatus, 'P')) AS missing FROM orders")
def ag18_coverage(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.count_if(~(F.col("o_totalprice") > 1000)).alias("cheap"), F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"), F.count_if(F.nullif("o_orderstatus", F.lit("P")).isNull()).alias("missing"))


@query("SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING COUNT(*) >= 10 AND AVG(c_acctbal) > 1000 ORDER BY n DESC, n_name LIMIT 8")
def ag19_frequent_top(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = joined.groupBy("n_name").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))
    return counts.where("n >= 10 AND mean > 1000").orderBy(F.desc("n"), "n_name").limit(8).drop("mean")


@query("SELECT 'status' AS dimension, o_orderstatus AS value, COUNT(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, COUNT(*) FROM orders GROUP BY 2")
def ag20_stacked_summaries(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return R.stacked_summaries(orders, ["status", "priority"], [F.count("*").alias("n")])


@query("""WITH e AS (SELECT event_type, event_id, ts, value, lag(event_type) OVER (ORDER BY ts, event_id) IS DISTINCT FROM event_type AS begins FROM events),
 r AS (SELECT *, SUM(begins::INT) OVER (ORDER BY ts, event_id) AS run FROM e)
 SELECT run::BIGINT AS run, event_type, COUNT(*) AS n, MIN(event_id) AS first_event, ROUND(SUM(value), 4) AS total FROM r GROUP BY ALL""")
def ag22_runs_of_a_key(spark, d):
    """Events in order of time: a type that comes back later is another group."""
    events = table(spark, d, "events").select("event_type", "event_id", "value", F.struct("ts", "event_id").alias("place"))
    return ordered.run_groups(events, "place", "event_type", [F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total")])


@query("SELECT event_type, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def ag24_relative_frequency(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").count()
    return counts.select("event_type", r6(F.col("count") / F.sum("count").over(Window.partitionBy()), "share"))  # one row for each type


@query("SELECT least(40, floor((l_extendedprice - lo) / (hi - lo) * 40) + 1)::BIGINT AS bin, COUNT(*) AS n FROM lineitem, (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
def ag25_histogram(spark, d):
    lines = table(spark, d, "lineitem").select("l_extendedprice")
    ends = lines.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    place = F.floor((F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 40) + 1
    return lines.join(F.broadcast(ends)).groupBy(F.least(F.lit(40), place).alias("bin")).agg(F.count("*").alias("n"))  # one row


@query(f"WITH {PLAYER_GAME_SQL}, g AS (SELECT post, round, AVG(accuracy) AS a FROM player_game GROUP BY 1, 2) SELECT post, round, ROUND(a / MAX(CASE WHEN round = 2 THEN a END) OVER (PARTITION BY post), 6) AS index FROM g")
def ag26_base_index(spark, d):
    means = player_game(spark, d).groupBy("post", "round").agg(F.avg("accuracy").alias("a"))
    return means.select("post", "round", r6(F.col("a") / F.max(F.when(F.col("round") == 2, F.col("a"))).over(Window.partitionBy("post")), "index"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25")
def tk01_global_top(spark, d):
    """TK01 and TK02: sort by several keys, top k."""
    return table(spark, d, "lineitem").select(*LINE, "l_extendedprice").orderBy(F.desc("l_extendedprice"), *LINE).limit(25)


@query("SELECT p_brand, lower(p_brand) AS folded FROM part GROUP BY ALL ORDER BY folded, p_brand")
def tk05_folded_sort(spark, d):
    return table(spark, d, "part").select("p_brand", F.lower("p_brand").alias("folded")).distinct().orderBy("folded", "p_brand")


@query(f"WITH {MOVES_SQL} SELECT m.game_id, m.ply FROM moves m WHERE game_id IN (SELECT DISTINCT game_id FROM moves ORDER BY game_id LIMIT 50)")
def tk06_limit_games(spark, d):
    rows = moves(spark, d)
    return rows.join(rows.select("game_id").distinct().orderBy("game_id").limit(50), "game_id", "left_semi").select("game_id", "ply")


@query(f"WITH {PAIRINGS_SQL} SELECT value FROM (SELECT white_value AS value FROM pairings UNION ALL SELECT black_value FROM pairings) ORDER BY value DESC LIMIT 12")
def tk08_stacked_largest(spark, d):
    stacked = pairings(spark, d).unpivot([], ["white_value", "black_value"], "side", "value")
    return stacked.select("value").orderBy(F.desc("value")).limit(12)


@query("SELECT o_custkey, MIN(o_orderkey) AS first_order, MAX(o_orderkey) AS last_order FROM orders GROUP BY 1")
def so02_keep_first_last(spark, d):
    """SO02, SO03 and WN21: the first and the last row of each key in a total order."""
    orders = table(spark, d, "orders")
    first = R.keep_first(orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    return first.join(R.keep_last(orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last_order")), "o_custkey")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def so04_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT 'both' AS side, c_custkey AS custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'no orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def so05_set_operations(spark, d):
    ids, used = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")), table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    side = lambda df, n: df.select(F.lit(n).alias("side"), "custkey")
    return side(ids.intersect(used), "both").unionByName(side(ids.subtract(used), "no orders"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS source FROM orders")
def so06_skip_completed(spark, d):
    """Ids of two files, each once, from the first file that has it."""
    orders = table(spark, d, "orders").select("o_orderkey")
    both = orders.where("o_orderkey % 2 = 0").withColumn("source", F.lit(1).cast("long")).unionByName(orders.withColumn("source", F.lit(2).cast("long")))
    return both.groupBy("o_orderkey").agg(F.min("source").alias("source"))


@query("SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def sk04_accumulate(spark, d):
    own = lambda p: table(spark, d, "orders").where(p).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    out = R.accumulate(own("o_orderkey % 3 = 0"), own("o_orderkey % 3 <> 0"), ["o_custkey"], ["n", "total"])
    return out.withColumn("total", F.round("total", 2))


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def sk05_replace_latest(spark, d):
    return R.replace_latest(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", ["o_orderstatus"])


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.a.b'), 'none') AS nested FROM events")
def js01_json(spark, d):
    """SC10, SC11 and JS01: typed fields of JSON text, missing ones with a default."""
    parsed = F.from_json("props", "k long, a struct<b: string>")
    return table(spark, d, "events").select("event_id", parsed.k.alias("k"), F.coalesce(parsed.a.b, F.lit("none")).alias("nested"))
