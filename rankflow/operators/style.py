"""Playing style: player features, indexes, embeddings and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.scalar import evaluation_token, loss_token
from rankflow.functions.scalar import move_token as move_number_token
from rankflow.operators.ranges import with_row_numbers
from rankflow.operators.windows import average_rank, row_mean, standardised, z_scores
from rankflow.shared import written


def eligible(df: DataFrame, player: str, period: str, least: int) -> DataFrame:
    """Players with at least so many rows and rows in both periods (0 and 1)."""
    counts = df.groupBy(player).agg(F.count("*").alias("n"), F.count_if(F.col(period) == 0).alias("n_before"), F.count_if(F.col(period) == 1).alias("n_after"))
    return counts.where((F.col("n") >= least) & (F.col("n_before") > 0) & (F.col("n_after") > 0))


def style_index(df: DataFrame, parts: dict[str, int], name: str) -> DataFrame:
    """Mean of the z-scores of the parts, each with its sign; parts missing in a row are left out."""
    for c in parts:
        df = standardised(df, c, f"__z_{c}")
    return df.withColumn(name, row_mean([F.col(f"__z_{c}") * sign for c, sign in parts.items()])).drop(*(f"__z_{c}" for c in parts))


def quartile(df: DataFrame, column: str, name: str) -> DataFrame:
    ranked = average_rank(df, column, "__r", "__n")
    return ranked.withColumn(name, F.ceil(F.col("__r") / F.col("__n") * 4)).drop("__r", "__n")


#: The parts of the style indexes, with their signs.
CLEAN = {"no_blunder_game_rate": 1, "own_blunder_rate": -1, "own_mistake_rate": -1, "own_inaccuracy_rate": -1, "mean_cp_loss": -1, "p90_cp_loss": -1, "sd_cp_loss": -1}
CHAOS = {"eval_swing_rate": 1, "capture_rate": 1, "check_rate": 1, "opponent_next_blunder_rate": 1, "opponent_next_mistake_rate": 1, "sd_cp_loss": 1, "decisive_game_rate": 1}
SELF_RISK = {"own_blunder_rate": 1, "own_mistake_rate": 1, "p90_cp_loss": 1, "sd_cp_loss": 1}


def style_scores(df: DataFrame, winsor: float | None = 0.01) -> DataFrame:
    """df (player_style) with clean_style_index, chaos_creator_index, self_risk_index (means of the z-scores that a row has),
    practical_chaos_index (chaos less self-risk), their z-scores, quartiles, and style_archetype."""
    df = written(df)  # read for moments and for scores
    z = z_scores(df, sorted({*CLEAN, *CHAOS, *SELF_RISK}), winsor)
    index = lambda parts: row_mean([z[c] * sign for c, sign in parts.items()])
    df = written(df.withColumns({"clean_style_index": index(CLEAN), "chaos_creator_index": index(CHAOS), "self_risk_index": index(SELF_RISK)}))
    df = df.withColumn("practical_chaos_index", F.col("chaos_creator_index") - F.col("self_risk_index"))
    names = ["clean_style_index", "chaos_creator_index", "self_risk_index", "practical_chaos_index"]
    df = written(df.withColumns({f"{c}_z": x for c, x in z_scores(df, names, winsor).items()}))
    for name, column in (("clean_quartile", "clean_style_index_z"), ("chaos_quartile", "chaos_creator_index_z"), ("practical_chaos_quartile", "practical_chaos_index_z")):
        df = quartile(df, column, name)
    clean, chaos = F.col("clean_quartile"), F.col("chaos_quartile")
    archetype = F.when((clean == 4) & (chaos == 4), "sharp_clean").when((chaos == 4) & (clean < 4), "chaos_creator").when((clean == 4) & (chaos < 4), "clean_technician").when((clean == 1) & (chaos == 1), "quiet_leaky")
    return df.withColumn("style_archetype", archetype.otherwise("middle"))


#: Numbers of pieces by the first letter of a move's name (a pawn's move begins with a file), and of phases.
PIECE_CODES = {"N": 1, "B": 2, "R": 3, "Q": 4, "K": 5}
PAWN, CASTLING, UNKNOWN_PIECE, UNKNOWN_PHASE = 0, 6, 7, 4


def square_code(square: Column) -> Column:
    """a1 is 0, b1 is 1, h8 is 63; anything else is 64."""
    valid = square.rlike("^[a-h][1-8]$")
    return F.when(valid, F.ascii(square) - F.ascii(F.lit("a")) + 8 * (F.ascii(F.substring(square, 2, 1)) - F.ascii(F.lit("1")))).otherwise(64).cast("long")


def piece_code(san: Column) -> Column:
    first = F.substring(F.regexp_replace(san, r"^[+#?!]+", ""), 1, 1)
    named = F.coalesce(*(F.when(first == k, F.lit(v)) for k, v in PIECE_CODES.items()), F.when(first.rlike("[a-h]"), F.lit(PAWN)), F.lit(UNKNOWN_PIECE))
    return F.when(F.startswith(san, F.lit("O-O")), CASTLING).otherwise(named).cast("long")


def move_token(uci: Column, san: Column, is_capture: Column, gives_check: Column, phase: Column, loss: Column, evaluation: Column, fullmove: Column, phases: list[str]) -> Column:
    """The nine numbers (array<long>) of a move: piece, source and target squares, capture, check, phase (its place in
    phases), and bins of the loss, of the mover's evaluation before it, and of the full move."""
    whole = F.when(F.length(uci) >= 4, uci).otherwise("")
    place = F.array_position(F.array(*map(F.lit, phases)), phase)
    number = lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    fields = [
        piece_code(F.coalesce(san, F.lit(""))), square_code(F.substring(whole, 1, 2)), square_code(F.substring(whole, 3, 2)), number(is_capture), number(gives_check),
        F.when(place > 0, place - 1).otherwise(UNKNOWN_PHASE), loss_token(loss), evaluation_token(evaluation), move_number_token(fullmove),
    ]
    return F.array(*(F.coalesce(x, F.lit(64 if i == 1 or i == 2 else 0)).cast("long") for i, x in enumerate(fields)))


def split(df: DataFrame, player: str, item: str, share: float, seed: int) -> DataFrame:
    """part: `val` for the given share of each player's items (at least one of two or more), by a seeded hash, else
    `train`."""
    order = Window.partitionBy(player).orderBy(F.xxhash64(F.lit(seed), item), item)
    n = F.count("*").over(Window.partitionBy(player))
    held = F.when(n > 1, F.greatest(F.lit(1), F.floor(n * share))).otherwise(0)
    return df.withColumn("__k", F.row_number().over(order)).withColumn("part", F.when(F.col("__k") <= held, "val").otherwise("train")).drop("__k")


def mean_embeddings(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector of each key, scaled to length one."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    norms = parts.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("__norm"))
    scaled = parts.join(norms, key).withColumn("x", F.try_divide("x", "__norm"))
    return scaled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias(vector))  # one vector


def cluster(df: DataFrame, vector: str, ks: list[int], seed: int = 7) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """df with cluster of the k of the best silhouette; (k, inertia, silhouette) of each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>"))).cache()
    tried, best = [], None
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(rows)
        out = model.transform(rows)
        silhouette = ClusteringEvaluator(featuresCol="__v", predictionCol="cluster").evaluate(out)
        tried.append((k, float(model.summary.trainingCost), float(silhouette)))
        if best is None or silhouette > best[0]:
            best = (silhouette, out)
    return best[1].drop("__v"), tried


def principal_components(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """components (array) of the columns, medians for missing values, standardised; each component's sign makes its
    largest loading positive, the first of those that are equal but for rounding (as a share and its complement are).
    Columns without spread are left out."""
    import numpy as np
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = written(df)  # read by each of the fits below
    spread = df.agg(*(F.stddev_samp(c).alias(c) for c in columns)).first()
    columns = [c for c in columns if (spread[c] or 0) > 1e-12]
    filled = Imputer(strategy="median", inputCols=columns, outputCols=[f"__{c}" for c in columns]).fit(df).transform(df)
    rows = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__v").transform(filled)
    rows = StandardScaler(withMean=True, inputCol="__v", outputCol="__s").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="__s", outputCol="__p").fit(rows)
    loadings = model.pc.toArray()
    size = np.abs(loadings)
    signs = np.sign(loadings[(size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0), range(k)])
    out = model.transform(rows).withColumn("components", F.zip_with(vector_to_array("__p"), F.array(*(F.lit(float(s)) for s in signs)), lambda a, b: a * b))
    return out.drop("__v", "__s", "__p", *(f"__{c}" for c in columns))


def cluster_profiles(df: DataFrame, cluster_column: str, features: list[str], k: int = 8) -> DataFrame:
    """The k features in which each cluster's mean stands farthest from the whole's, in its deviations."""
    long = df.unpivot([cluster_column], features, "feature", "value")
    whole = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    means = long.groupBy(cluster_column, "feature").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    profile = means.join(F.broadcast(whole), "feature").withColumn("difference", F.try_divide(F.col("mean") - F.col("m"), F.col("sd")))  # a row for each feature
    order = Window.partitionBy(cluster_column).orderBy(F.desc(F.abs("difference")), "feature")
    return profile.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).drop("m", "sd")


def before_after(df: DataFrame, key: str, period: str, outcome: str, least: int) -> DataFrame:
    """Mean outcome before and after, and the change, ranked, of keys with enough rows in both periods."""
    part = lambda p: F.when(F.col(period) == p, F.col(outcome))
    out = df.groupBy(key).agg(F.avg(part(0)).alias("before"), F.avg(part(1)).alias("after"), F.count(part(0)).alias("n_before"), F.count(part(1)).alias("n_after"))
    out = out.where((F.col("n_before") >= least) & (F.col("n_after") >= least)).withColumn("change", F.col("after") - F.col("before"))
    return with_row_numbers(out, ["-change", key], "place")
