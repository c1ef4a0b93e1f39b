"""Latent states: assignment to centres, run metrics, scores, alignment, stability, selection."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import RUN
from .segments import SEGMENT


def features(edges: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """keys with the array `values`, edges in the order (i, j)."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("i", "j", value))), lambda c: c[value])
    return edges.groupBy(*keys).agg(cells.alias("values"))


def distances(centres: list[list[float]], values: str = "values"):
    one = [F.aggregate(F.zip_with(values, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) for c in centres]
    return F.array(*one)


def assigned(rows: DataFrame, centres: list[list[float]]) -> DataFrame:
    """rows with state (nearest centre, the lowest on a tie) and its squared distance d2."""
    rows = rows.withColumn("_d", distances(centres))
    return rows.withColumns({"state": (F.array_position("_d", F.array_min("_d")) - 1).cast("int"), "d2": F.array_min("_d")}).drop("_d")


def occupancy(labels: DataFrame, n_states: int) -> DataFrame:
    """(run, state, n, occupancy), every state of the grid."""
    grid = labels.groupBy(*RUN).agg(F.count("*").alias("total")).withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    count = labels.groupBy(*RUN, "state").agg(F.count("*").alias("n"))
    return grid.join(count, [*RUN, "state"], "left").select(*RUN, "state", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("occupancy"))


def dwell(labels: DataFrame, order: str = "start_frame", seconds: float = 1.0) -> DataFrame:
    """Mean length of runs of equal state inside segments: (run, state, visits, mean_dwell, mean_dwell_seconds)."""
    line = Window.partitionBy(*SEGMENT).orderBy(order)
    change = F.coalesce((F.col("state") != F.lag("state").over(line)).cast("int"), F.lit(1))
    runs = labels.withColumn("_c", change).withColumn("_r", F.sum("_c").over(line)).groupBy(*SEGMENT, "state", "_r").agg(F.count("*").alias("n"))
    out = runs.groupBy(*RUN, "state").agg(F.count("*").alias("visits"), F.avg("n").alias("mean_dwell"))
    return out.withColumn("mean_dwell_seconds", F.col("mean_dwell") * seconds)


def transitions(labels: DataFrame, n_states: int, order: str = "start_frame") -> DataFrame:
    """(run, from_state, to_state, n, probability) on the full grid; a state without departures has null."""
    line = Window.partitionBy(*SEGMENT).orderBy(order)
    moves = labels.withColumn("to_state", F.lead("state").over(line)).filter("to_state is not null").groupBy(*RUN, F.col("state").alias("from_state"), "to_state").agg(F.count("*").alias("n"))
    states = F.sequence(F.lit(0), F.lit(n_states - 1))
    grid = labels.select(*RUN).distinct().withColumn("from_state", F.explode(states)).withColumn("to_state", F.explode(states))
    full = grid.join(moves, [*RUN, "from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    leave = F.sum("n").over(Window.partitionBy(*RUN, "from_state"))
    return full.withColumn("probability", F.when(leave > 0, F.col("n") / leave))


def switch_rate(labels: DataFrame, order: str = "start_frame") -> DataFrame:
    line = Window.partitionBy(*SEGMENT).orderBy(order)
    moves = labels.withColumn("to_state", F.lead("state").over(line))
    possible, switches = F.count("to_state"), F.sum((F.col("to_state") != F.col("state")).cast("long"))
    return moves.groupBy(*RUN).agg(possible.alias("possible"), F.coalesce(switches, F.lit(0)).alias("switches"), F.when(possible > 0, F.coalesce(switches, F.lit(0)) / possible).alias("switch_rate"))


def kmeans_score(labels: DataFrame) -> DataFrame:
    """Sum and mean of squared distances of each run, samples and sequences."""
    return labels.groupBy(*RUN).agg(F.count("*").alias("n_samples"), F.countDistinct("segment_id").alias("n_sequences"), F.sum("d2").alias("total_d2"), F.avg("d2").alias("mean_d2"))


def pattern_correlations(left: list[list[float]], right: list[list[float]]) -> list[list[float]]:
    def z(v):
        m = sum(v) / len(v)
        s = (sum((x - m) ** 2 for x in v) / len(v)) ** 0.5
        return [(x - m) / s for x in v]

    return [[sum(a * b for a, b in zip(z(x), z(y))) / len(x) for y in right] for x in left]


def alignment(reference: list[list[float]], candidate: list[list[float]]) -> dict:
    """candidate_to_reference of the one-to-one match with the largest sum of correlations.

    Few states are tried in all orders, more by assignment. Ties go to the first order.
    """
    c = pattern_correlations(reference, candidate)
    k = len(candidate)
    if k <= 7:
        best = max(permutations(range(k)), key=lambda p: sum(c[p[j]][j] for j in range(k)))
    else:
        from ..functions.kernels import assignment

        best = tuple(assignment([[-c[i][j] for i in range(k)] for j in range(k)]))
    return {"candidate_to_reference": list(best), "matched": [c[best[j]][j] for j in range(k)], "correlations": c}


def relabelled(labels: DataFrame, mapping: list[int]) -> DataFrame:
    return labels.withColumn("state", F.element_at(F.array(*map(F.lit, mapping)), F.col("state") + 1))


def stability(metrics: DataFrame, keys: list[str], value: str) -> DataFrame:
    """metrics of several fits (fit_index) to mean, SD (ddof 0, null below two) and number of finite values."""
    ok = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    n = F.count(ok)
    return metrics.groupBy(*keys).agg(F.avg(ok).alias("mean"), F.when(n >= 2, F.stddev_pop(ok)).alias("sd"), n.alias("n_valid"))


def describe_topk(centres: list[list[float]], rows: DataFrame, top: int) -> DataFrame:
    """(state, feature_idx, deviation, rank): largest deviations of centres from the pooled mean, in pooled SDs; ties by feature."""
    spark = rows.sparkSession
    flat = rows.select(F.posexplode("values").alias("feature_idx", "value"))
    pooled = flat.groupBy("feature_idx").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    c = spark.createDataFrame([(k, i, float(x)) for k, v in enumerate(centres) for i, x in enumerate(v)], "state int, feature_idx int, centre double")
    dev = c.join(pooled, "feature_idx").withColumn("deviation", (F.col("centre") - F.col("m")) / F.when(F.col("sd") < 1e-12, F.lit(1.0)).otherwise(F.col("sd")))
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.abs("deviation").desc(), "feature_idx"))
    return dev.withColumn("rank", rank).filter(F.col("rank") <= top).select("state", "feature_idx", "deviation", "rank")


def subject_folds(subjects: DataFrame, n_folds: int, seed: int) -> DataFrame:
    """(subject, fold): ranked by SHA-256 of {"seed":s,"subject":"x"}, then dealt in balanced contiguous groups.

    Ranking is over distinct subjects, one row each; it uses one partition.
    """
    text = F.concat(F.lit('{"seed":' + str(seed) + ',"subject":"'), F.regexp_replace("subject", r'(["\\])', r"\\$1"), F.lit('"}'))
    ranked = subjects.select("subject").distinct().withColumn("sha", F.sha2(text, 256))
    line = Window.orderBy("sha", "subject")
    ranked = ranked.withColumns({"rank": F.row_number().over(line) - 1, "n": F.count("*").over(Window.partitionBy())})
    base, extra = F.expr(f"n div {n_folds}"), F.col("n") % n_folds
    split = extra * (base + 1)
    fold = F.when(F.col("rank") < split, F.expr(f"rank div (n div {n_folds} + 1)")).otherwise(extra + F.floor((F.col("rank") - split) / F.greatest(base, F.lit(1))))
    return ranked.select("subject", fold.cast("int").alias("fold"))


def select_state_count(scores: DataFrame, higher: bool = False) -> DataFrame:
    """scores (n_states, fold, score) to mean, SD (ddof 1), SE, rank, best and within_one_se of each n_states; one_se_choice."""
    sign = -1 if higher else 1
    rows = scores.groupBy("n_states").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.count("*").alias("n"))
    rows = rows.withColumn("se", F.col("sd") / F.sqrt("n"))
    line = Window.orderBy(F.col("mean") * sign, "n_states")
    rows = rows.withColumn("rank", F.row_number().over(line))
    first = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.first(F.col("mean") * sign + F.col("se")).over(first)
    rows = rows.withColumn("within_one_se", F.col("mean") * sign <= limit)
    choice = F.min(F.when(F.col("within_one_se"), F.col("n_states"))).over(first)
    return rows.withColumns({"best": F.col("rank") == 1, "one_se_choice": F.col("n_states") == choice}).drop("n")
