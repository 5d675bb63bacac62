"""Hand-made cases of the traps: ties, missing opponents, repeated rows, nulls, clocks, dates, and estimators by numpy."""

import datetime
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankflow.functions import names
from rankflow.functions import scalar as S
from rankflow.operators import moves as M
from rankflow.operators import relational as R
from rankflow.operators import resolve as E
from rankflow.operators import stats, swiss
from rankflow.operators import windows as W
from rankflow.plans import text
from rankflow.sources import files, sinks

PANEL = "tournament int, round int, player string, opponent string, half long"


def panel(spark, rows):
    return swiss.running_score(spark.createDataFrame(rows, PANEL))


#: Four players, three rounds, one draw; c and d end equal on all four keys.
SWISS = [
    (1, 1, "a", "b", 2), (1, 1, "b", "a", 0), (1, 1, "c", "d", 1), (1, 1, "d", "c", 1),
    (1, 2, "a", "c", 2), (1, 2, "c", "a", 0), (1, 2, "b", "d", 0), (1, 2, "d", "b", 2),
    (1, 3, "a", "d", 2), (1, 3, "d", "a", 0), (1, 3, "b", "c", 0), (1, 3, "c", "b", 2),
]


def test_swiss_tiebreaks_and_shared_rank(spark):
    rows = swiss.tiebreaks(panel(spark, SWISS))
    last = {r.player: r for r in rows.where("round = 3").collect()}
    assert [last[p].score_after for p in "abcd"] == [6, 0, 3, 3]
    assert [last[p].buchholz_after for p in "abcd"] == [0 + 3 + 3, 6 + 3 + 3, 3 + 6 + 0, 3 + 0 + 6]
    assert [last[p].cut1_after for p in "abcd"] == [6, 9, 9, 9]
    ranked = swiss.ranks(rows, "score_after", "cut1_after", "buchholz_after", "sonneborn_after", "rank").where("round = 3")
    assert {r.player: r["rank"] for r in ranked.collect()} == {"a": 1, "c": 2, "d": 2, "b": 4}


def test_missing_opponent_policies(spark):
    rows = panel(spark, [(1, 1, "a", "ghost", 2), (1, 2, "a", "b", 0), (1, 2, "b", "a", 2)])
    assert [r.opponent for r in swiss.missing_opponents(rows).collect()] == ["ghost"]
    zero = {(r["round"], r.player): r.buchholz_after for r in swiss.tiebreaks(rows).collect()}
    assert zero[1, "a"] == 0 and zero[2, "a"] == 2
    with pytest.raises(Exception, match="no row of opponent ghost"):
        swiss.tiebreaks(rows, "error").collect()


def test_rank_keeps_the_best_row_of_a_player(spark):
    rows = spark.createDataFrame([(1, 1, "a", 3, 0, 0, 0), (1, 1, "a", 1, 0, 0, 0), (1, 1, "b", 2, 0, 0, 0)], "tournament int, round int, player string, s long, c long, b long, n long")
    assert {(r.player, r["rank"]) for r in swiss.ranks(rows, "s", "c", "b", "n", "rank").collect()} == {("a", 1), ("b", 2)}


def test_streak_restarts_in_each_event(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 0), (1, 4, 1), (2, 1, 1), (2, 2, None)], "e int, r int, s int")
    got = W.streak(df, ["e"], "r", F.col("s") == 1, "n").orderBy("e", "r").collect()
    assert [r.n for r in got] == [1, 2, 0, 1, 1, 0]


def test_loss_is_null_where_an_evaluation_is(spark):
    df = spark.createDataFrame([(1, 30, 10), (0, 30, 10), (1, None, 5), (0, 5, None)], "is_white_move int, b int, a int")
    assert [r.x for r in df.select(M.centipawn_loss("b", "a").alias("x")).collect()] == [20, 0, None, None]


def test_conversion_definitions_differ(spark):
    rows = [(1, ply, ply % 2, (ply + 1) // 2, 250 if ply == 16 else 0) for ply in range(1, 21)]
    df = spark.createDataFrame(rows, "game_id int, ply int, is_white_move int, fullmove int, eval_after_white int")
    got = {k: {r.is_white_move: r.reached_win for r in M.conversion(df, k).collect()} for k in ("own", "any", "buffered")}
    assert got == {"own": {1: 0, 0: 0}, "any": {1: 1, 0: 0}, "buffered": {1: 0, 0: 0}}


def test_scalars(spark):
    df = spark.createDataFrame([("2024-02-14 14:00:00",), ("Feb 14, 2024, 2:00 PM",), ("Feb 14, 2024, 2:00 PM",), ("garbage",), (None,)], "t string")
    noon = datetime.datetime(2024, 2, 14, 14)
    assert [r.x for r in df.select(S.timestamp("t").cast("timestamp_ntz").alias("x")).collect()] == [noon, noon, noon, None, None]
    df = spark.createDataFrame([("3.0",), ("-2.7",), ("NaN",), ("NA",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(S.whole_number("t").alias("x")).collect()] == [3, -2, None, None, None, None]
    df = spark.createDataFrame([("1:02:03.5",), ("2:03",), ("7",), (None,)], "t string")
    assert [r.x for r in df.select(S.clock_seconds("t").alias("x")).collect()] == [3723.5, 123.0, 7.0, None]
    df = spark.createDataFrame([("Müller, José",), ("Anna Maria Lind",), (None,)], "t string")
    assert [r.x for r in df.select(S.name_forms("t").alias("x")).collect()] == [["jose muller", "j muller", "muller jose", "josemuller"], ["anna maria lind", "anna lind", "a lind", "lind anna", "annamarialind"], None]
    assert names.variants("Юрий") == ["iurii", "iuriy", "iury", "yurii", "yuriy", "yury", "юрии"] and names.unaccented("Ó Łukasz-X") == "o łukasz x"


def test_clip_and_flags_keep_nulls(spark):
    row = spark.range(1).select(S.clip(F.lit(None).cast("int"), -1, 1).alias("a"), S.flag(F.lit(None).cast("boolean")).alias("b"), S.safe_ratio(F.lit(1), F.lit(0)).alias("c"), S.phase(F.lit(None).cast("int")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (None, 0, None, None)


def test_dimension_with_a_key_twice_fails(spark):
    facts, twice = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "d int, v string")
    with pytest.raises(Exception, match="key twice: 1"):
        R.join_dimension(facts, twice, "k", "d", ["v"]).collect()


def test_ambiguous_candidates_stay_unresolved(spark):
    df = spark.createDataFrame([("a", "x", 0), ("a", "y", 0), ("b", "x", 0), ("b", "x", 1), ("c", "x", 1), ("c", "y", 0), ("d", None, 1)], "id string, v string, p int")
    got = {r.id: (r.value, r.status) for r in E.resolve_unique(df, "id", "v", F.col("p") == 1).collect()}
    assert got == {"a": (None, "ambiguous:2"), "b": ("x", "unique"), "c": ("x", "preferred"), "d": (None, "empty")}


def test_regression_equals_least_squares_with_dummies(spark):
    pick = random.Random(3)
    rows = [(i % 7, i % 5, pick.gauss(0, 1), pick.gauss(0, 1), pick.random() + 0.5) for i in range(200)]
    rows = [(a, b, x, z, w, 2 * x - z + a - 0.5 * b + pick.gauss(0, 0.3), x + z) for a, b, x, z, w in rows]
    df = spark.createDataFrame(rows, "a int, b int, x double, z double, w double, y double, both double")
    model = stats.regress(df, "y", ["x", "z", "both"], ["a", "b"], ["a"], weight="w")
    assert model["terms"] == ["x", "z"]  # both is collinear
    d = np.array(rows)
    design = np.column_stack([d[:, 2], d[:, 3], *(d[:, 0] == k for k in range(7)), *(d[:, 1] == k for k in range(1, 5))])
    root = np.sqrt(d[:, 4])
    beta = np.linalg.lstsq(design * root[:, None], d[:, 5] * root, rcond=None)[0]
    assert np.allclose(model["beta"], beta[:2], atol=1e-6)
    plain = stats.regress(df, "y", ["x"], [], ["a"])
    x = np.column_stack([np.ones(len(d)), d[:, 2]])
    b = np.linalg.lstsq(x, d[:, 5], rcond=None)[0]
    e, bread = d[:, 5] - x @ b, np.linalg.inv(x.T @ x)
    s = np.array([(x[d[:, 0] == k] * e[d[:, 0] == k][:, None]).sum(axis=0) for k in range(7)])
    v = bread @ s.T @ s @ bread * 7 / 6 * (len(d) - 1) / (len(d) - 2)
    assert np.allclose(plain["vcov"], v)
    assert stats.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7) and stats.t_p_value(0.0, 5) == pytest.approx(1.0)


def test_calibrated_weights_meet_the_target(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    out = stats.calibrate(df, ["x"], [6.0], cap=1.0).agg(F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).first()[0]
    assert out == pytest.approx(6.0)


PGN = """[Event "A"]
[White "x"]
[White "again"]

1. e4 {[%clk 0:02:59.9]} e5 1-0
[Event "B"]
[Site "https://x.org/game/live/123456789"]

1. d4 *
"""


def test_sources(spark, tmp_path):
    (tmp_path / "games.pgn").write_text(PGN)
    games = sorted(files.read_pgn(spark, str(tmp_path / "games.pgn")).collect(), key=lambda r: r.headers["Event"])
    assert [g.headers for g in games] == [{"Event": "A", "White": "x"}, {"Event": "B", "Site": "https://x.org/game/live/123456789"}]
    assert games[0].movetext.startswith("1. e4") and games[1].movetext == "1. d4 *"
    (tmp_path / "a.csv").write_text("id;v\n1; 2.5\nx;NA\n")
    path = str(tmp_path / "a.csv")
    assert files.separator_of(spark, path) == ";"
    assert [(r.id, r.v) for r in files.read_csv(spark, path, "id long, v double", sep=";").collect()] == [(1, 2.5), (None, None)]
    with pytest.raises(ValueError, match="missing columns: w"):
        files.read_csv(spark, path, "id long, w double", sep=";")
    (tmp_path / "list.xml").write_text("<list><player><fideid>7</fideid><name>Doe, J</name><rating>2500</rating><birthday></birthday></player></list>")
    row = files.read_rating_list(spark, str(tmp_path / "list.xml")).first()
    assert (row.fideid, row.name, row.rating, row.birthday) == ("7", "Doe, J", 2500, None)
    for name in ("worker_1_checkpoint_2.csv", "worker_1_checkpoint_10.parquet", "worker_1_checkpoint_10.csv", "worker_2_checkpoint_1.parquet", "other.csv"):
        (tmp_path / "cp").mkdir(exist_ok=True)
        (tmp_path / "cp" / name).write_text("x")
    newest = {r.worker: r.path.rsplit("/", 1)[1] for r in files.newest_checkpoints(spark, str(tmp_path / "cp")).collect()}
    assert newest == {1: "worker_1_checkpoint_10.csv", 2: "worker_2_checkpoint_1.parquet"}
    (tmp_path / "rows.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "b"}\nbroken\n')
    assert [(r.k, r.v) for r in files.read_json_lines(spark, str(tmp_path / "rows.jsonl"), "k long, v string", "k").where("k IS NOT NULL").collect()] == [(1, "a")]


def test_prefix_matches_of_long_words(spark):
    names = ["Kasimdzhanov R", "Kasimdzhanova R", "Kasimdzhanovic", "Nepomniachtchi", "nepomniachtchi ian", "Nepomnia", "Li Kas", "Kasimdzhan-Ali", None, ""]
    df = spark.createDataFrame([(i % 2, x) for x in names for i in range(2)], "g int, name string")
    got = {(r.g, r.left_text, r.right_text) for r in R.prefix_matches(df, df, "name", "name", ["g"]).collect()}
    words = {x: [w for w in (x or "").lower().replace("-", " ").split() if len(w) >= 3] for x in names}
    want = {(g, x, y) for g in range(2) for x in names for y in names if any(v.startswith(w) or w.startswith(v) for v in words[x] for w in words[y])}
    assert got == want and (0, "Nepomniachtchi", "nepomniachtchi ian") in got


def test_prefix_matches_of_texts_that_repeat(spark):
    """40,000 rows of one text on each side are one pair, not 1.6 billion on the way to it."""
    start = time.monotonic()
    copies = spark.range(40_000).select((F.col("id") * 0).alias("g"), F.lit("Nepomniachtchi Ian").alias("name"))
    assert [tuple(r) for r in R.prefix_matches(copies, copies, "name", "name", ["g"]).collect()] == [(0, "Nepomniachtchi Ian", "Nepomniachtchi Ian")]
    assert time.monotonic() - start < 60


def test_leading_in_bands_finds_the_two_best_of_all_pairs(spark):
    """Against all pairs: ties, null, NaN and infinite values, missing keys, values at the very ends of a band."""
    rnd = random.Random(5)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.1 + 0.2, 0.3, -0.0, 1.1, 2.1, 2.1000000000000001, 3.3000000000000003]
    value = lambda: rnd.choice(odd) if rnd.random() < 0.4 else round(rnd.uniform(-3, 4), 1)
    c = spark.createDataFrame([(i, rnd.choice([None, 1, 2, 2, 3]), value(), rnd.choice([None, "m", "m", "x"])) for i in range(160)], "c long, ck int, cv double, seg string")
    s = spark.createDataFrame([(i, rnd.choice([None, 1, 2, 3, 4]), value()) for i in range(60)], "s long, sk int, sv double")
    near, machinery = F.abs(F.col("cv") - F.col("sv")) <= 1.0, F.col("seg") == "m"
    every = s.join(c, s.sk == c.ck).select("s", "c", "cv", E.support_score([(machinery, 2), (near, 1)]).alias("score"))
    pairs = E.leading_in_bands(s, c, "s", "c", ("sk", "ck"), "sv", "cv", 1.0, machinery)
    few = pairs.select("s", "c", "cv", E.support_score([(F.col("evidence"), 2), (near, 1)]).alias("score"))
    best = lambda df: sorted(str(tuple(r)) for r in E.select_with_margin(df, "s", "c", "score", "cv", 0.5, 0.3).collect())
    assert best(few) == best(every) and len(best(every)) > 20
    most = few.groupBy("s").count().agg(F.max("count")).first()[0]
    assert most <= 12 and few.exceptAll(every).isEmpty()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, float("nan"), None), (3, -0.0000001, "c")], "k long, x double, s string")
    sinks.write_csv(df, f"{tmp_path}/out", ["k", "x", "s"])
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect())
    assert [x for x in lines if x != "k,x,s"] == ["1,0.5,a", "2,,", "3,0,c"]
    sinks.replace_table(df, f"{tmp_path}/t")
    sinks.replace_table(df.limit(1), f"{tmp_path}/t")
    kept = sinks.VersionedTable(spark, f"{tmp_path}/t")
    assert kept.read().count() == 1 and kept.read(0).count() == 3
    kept.replace(kept.read(0).union(kept.read()))  # a version made of the table itself
    kept.append(df)
    assert len(kept.folders()) == 2 and kept.compact(1) == 4 and kept.read().count() == 7 and len(kept.folders()) == 1
    half = kept._write(df)  # a writer that is lost before its commit changes nothing
    assert half and kept.version() == 4 and kept.read().count() == 7
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        kept._commit([half], 4)
    with pytest.raises(ValueError, match="no version 9"):
        kept.read(9)
    assert '"rows": 3' in sinks.write_with_summary(df, f"{tmp_path}/s", {"p": 1})
    assert sinks.rewrite_columns(df, {"s": F.lit("n")}, "k").columns == ["k", "s", "x"]
    assert sinks.markdown_table(df.limit(1)).splitlines()[2] == "| 1 | 0.5000 | a |"


def test_inverse_propensity_against_numpy(spark):
    """The logit's weights by Newton steps; rows with nulls stay and get nulls."""
    pick = np.random.default_rng(6)
    x = pick.normal(size=(300, 2)).round(6)
    y = (pick.random(300) < 1 / (1 + np.exp(-(0.3 + x @ [0.8, -0.5])))).astype(int)
    rows = [(i, int(t), float(a), float(b)) for i, (t, (a, b)) in enumerate(zip(y, x))]
    got = stats.inverse_propensity(spark.createDataFrame([*rows, (900, 1, None, 0.0), (901, None, 0.0, 0.0)], "id long, treated int, a double, b double"), "treated", ["a", "b"])
    design, beta = np.column_stack([np.ones(300), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    p = np.clip(1 / (1 + np.exp(-design @ beta)), 0.01, 0.99)
    rows = {r.id: r for r in got.collect()}
    assert [rows[i].propensity for i in range(300)] == pytest.approx(p.tolist(), abs=1e-4)
    assert [rows[i].weight for i in range(300)] == pytest.approx(np.where(y == 1, 1 / p, 1 / (1 - p)).tolist(), rel=1e-3)
    assert rows[900].propensity is None and rows[900].weight is None and rows[901].propensity is not None and rows[901].weight is None


def test_csv_set_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,10\n")
    (tmp_path / "b.csv").write_text("v,id\n20,2\n")
    (tmp_path / "c.csv").write_text('\ufeffid,"tags, all",v,p\n3,"[""x"",""y""]",30,1.255\n')
    (tmp_path / "d.csv").write_text("id\nx\n")
    rows = files.read_csv(spark, str(tmp_path), "id long, v int, p decimal(10,2), `tags, all` array<string>", required=["id"], escape='"').collect()
    got = sorted((r.source_file[-5:], r.id, r.v, None if r.p is None else str(r.p), r["tags, all"]) for r in rows)
    assert got == [("a.csv", 1, 10, None, None), ("b.csv", 2, 20, None, None), ("c.csv", 3, 30, "1.26", ["x", "y"]), ("d.csv", None, None, None, None)]
    with pytest.raises(ValueError, match="missing columns: v in .*d.csv"):
        files.read_csv(spark, str(tmp_path), "id long, v int")


def test_complete_games_only(spark, tmp_path):
    whole = PGN.rstrip("\n") + "\n\n"
    tails = {"a": "", "b": '[Event "C"]\n', "c": '[Event "C"]\n[Site "s"]\n\n', "d": '[Event "C"]\n\n1. e4 e5\n2. ', "e": '[Event "C"]\n\n1. e4 *', "f": '[Event "C"]\r\n\r\n1. e4 *\r\n\r\n', "g": '[Event "C"]\n\n1. e4\n\n[Event "D"]\n'}
    want = {"a": 2, "b": 2, "c": 2, "d": 2, "e": 2, "f": 3, "g": 3}
    for name, tail in tails.items():
        (tmp_path / f"{name}.pgn").write_bytes((whole + tail).encode())
    got = files.read_complete_pgn(spark, str(tmp_path)).groupBy("source_file").count().collect()
    assert {r.source_file[-5]: r["count"] for r in got} == want


def test_variations_of_any_depth(spark):
    deep = "1. e4 " + "(a " * 50 + "b" + " c)" * 50 + " e5 (x (y) z) 2. Nf3 {( not one} Nc6 ) Bb5 (open"
    cases = [(deep,), ("(",), ("",), (None,), ("a(b)c",)]
    got = [r.m for r in spark.createDataFrame(cases, "t string").select(S.bare_moves("t").alias("m")).collect()]
    assert got == [["e4", "e5", "Nf3", "Nc6", "Bb5"], [], [], None, ["a", "c"]]


def test_band_join(spark):
    pick = random.Random(9)
    a = [(i, pick.choice("xy"), pick.choice([None, round(pick.uniform(-50, 50), 1)])) for i in range(150)]
    b = [(i, pick.choice("xyz"), float(pick.randint(-50, 50))) for i in range(150)]
    got = R.band_join(spark.createDataFrame(a, "i int, g string, v double"), spark.createDataFrame(b, "j int, h string, w double"), [("g", "h")], "v", "w", 2.5)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, g, v in a for j, h, w in b if g == h and v is not None and abs(v - w) <= 2.5)


def test_names_fold_by_unicode_rules(spark):
    cases = {
        "Petrović Čech Kraśnicki Şahin": "petrovic cech krasnicki sahin", "Đoković, Łukasz": "đokovic łukasz", "Müller-Weiß": "muller weiss", "ÑANDÚ_x": "nandu_x", "ﬁne ½ Ⅷ": "fine 1 2 viii",
        "İstanbul": "istanbul", "Шевченко Ї": "шевченко і", "a\u00a0b\tc": "a b c", "O’Neil": "o neil", "한국": "".join(chr(c) for c in (0x1112, 0x1161, 0x11AB, 0x1100, 0x116E, 0x11A8)), "…": "", "": "", None: None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.folded("t").alias("f")).collect()
    assert {r.t: r.f for r in got} == cases


def test_readings_of_cyrillic_names(spark):
    assert {"shevchenko", "шевченко"} <= set(names.variants("Шевченко"))
    assert set(names.variants("Їжак")) >= {"izhak", "yizhak"} and set(names.variants("Є")) >= {"e", "ye"}
    assert set(names.variants("Щука")) >= {"shchuka", "schuka"} and "iu" in names.variants("Ю")
    assert {"dmitrii", "dmitriy", "dmitry"} <= set(names.variants("Дмитрий")) and {"andrei", "andrey"} <= set(names.variants("Андрей"))
    both = names.variants("Юлия Ivanova")
    assert "iuliia ivanova" in both and "yuliya ivanova" in both and both == sorted(both)
    assert names.variants("Ivanov") == ["ivanov"] and names.variants("12 -") == [] and len(names.variants("яюёйхщ " * 6)) <= 65
    got = spark.createDataFrame([("Юрий",), (None,), ("Юрий",), ("",)], "t string").select(names.name_variants("t").alias("v")).collect()
    assert [r.v for r in got] == [names.variants("Юрий"), None, names.variants("Юрий"), []]


def test_plain_text_query_keeps_references_without_semicolon(spark, tmp_path):
    """Equal to the twin where `&amp` has no semicolon; the operator alone decodes it, as HTML does."""
    pages = ["<p>und&&&amp Ist</p>", "a&amp;lt;b &lt;c&gt; &copy; d", "&ampx; &amp", "&amp;amp; &#39;x&#39; &quot;&middot;"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in text.QUERIES["st07_plain_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(text.ORACLE["st07_plain_text"]).fetchall()) and got[0] == "und&&&amp Ist"
    decoded = spark.createDataFrame([(pages[0],)], "t string").select(S.plain_text("t").alias("a"), S.plain_text(F.concat("t", F.lit("&#xe9;&eacute;&bad;")), closed=True).alias("b")).first()
    assert (decoded.a, decoded.b) == ("und&&& Ist", "und&&&amp Ist éé&bad;")


def test_text_of_pages_and_user_names(spark):
    cases = {"a&eacute;&#233;&#xe9;&amp;lt;<b>x</b><script>no</script>\u00a0&nbsp;&thinsp;y<style a>z</style >": "aééé&lt; x y", "&notin;&unknown; <>": "∉&unknown; <>", None: None, "": ""}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.plain_text("t").alias("p")).collect()
    assert {r.t: r.p for r in got} == cases
    users = {"GMJohnDoe_99chess": ["john", "doe"], "xIMSmithJr": ["smith"], "": [], "ABCDef": ["abc", "def"]}
    got = spark.createDataFrame([(k,) for k in users], "t string").select("t", S.camel_words("t").alias("w"), S.camel_words("t", []).alias("all")).collect()
    assert {r.t: r.w for r in got} == users and {r.t: r["all"] for r in got}["xIMSmithJr"] == ["im", "smith", "jr"]


def _bare(text: str) -> list[str]:
    """Moves by a stack, character by character, of texts without other marks."""
    out, depth = [], 0
    for x in text:
        depth = max(0, depth + (x == "(") - (x == ")"))
        out.append(" " if x in "()" else x if depth == 0 else "")
    return "".join(out).split()


def test_variations_at_random_and_deeper_than_one_expression(spark):
    pick = random.Random(4)
    texts = ["".join(pick.choice("(()) ab\n") for _ in range(pick.randint(0, 120))) for _ in range(300)]
    texts += [f"a {'(b ' * n}{') c' * m} d" for n in (63, 64, 65, 130, 400) for m in (n - 1, n, n + 1)] + ["(x (y) z) e " * 20_000, "(x " * 2_000 + "y"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.bare_moves("t").alias("m")).collect()
    assert {r.i: r.m for r in got} == {i: _bare(t) for i, t in enumerate(texts)}
    rows = spark.createDataFrame([("a ; {x\ny} b\nc {;} d ; (e\nf",)], "t string").select(S.bare_moves("t").alias("m")).first()
    assert rows.m == ["a", "c", "d", "f"]


def test_movetexts_are_made_after_the_shuffle(spark):
    plan = text.st11_bare_moves(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "repeat(" not in plan.split("Exchange", 1)[1]  # what comes before it
