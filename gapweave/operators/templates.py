"""Reference templates, balanced quantiles, motion and matching candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subject_means(rows: DataFrame) -> DataFrame:
    """(subject, feature_idx, mean) of rows (subject, values)."""
    return rows.select("subject", F.posexplode("values").alias("feature_idx", "value")).groupBy("subject", "feature_idx").agg(F.avg("value").alias("mean"))


def feature_template(rows: DataFrame) -> DataFrame:
    """Mean of subject means: every subject counts the same."""
    return subject_means(rows).groupBy("feature_idx").agg(F.avg("mean").alias("template"), F.count("*").alias("n_subjects"))


def _pearson(flat: DataFrame, keys: list[str]) -> DataFrame:
    own = Window.partitionBy(*keys)
    c = flat.withColumns({"a": F.col("value") - F.avg("value").over(own), "b": F.col("template") - F.avg("template").over(own)})
    s = c.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return s.select(*keys, (F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("similarity"))


def pattern_similarity(rows: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    flat = rows.select(*keys, F.posexplode("values").alias("feature_idx", "value"))
    return _pearson(flat.join(template.select("feature_idx", "template"), "feature_idx"), keys)


def loo_similarity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Similarity with the template of the other subjects: (sum - own) / (n - 1)."""
    means = subject_means(rows)
    total = means.groupBy("feature_idx").agg(F.sum("mean").alias("s"), F.count("*").alias("n"))
    left = means.join(total, "feature_idx").select("subject", "feature_idx", ((F.col("s") - F.col("mean")) / (F.col("n") - 1)).alias("template"))
    flat = rows.select(*keys, F.posexplode("values").alias("feature_idx", "value"))
    return _pearson(flat.join(left, ["subject", "feature_idx"]), keys)


def balanced_quantiles(rows: DataFrame, probabilities: list[float]) -> DataFrame:
    """Quantiles of (subject, value) with weight 1 / the subject's rows, linear between (cumsum - w/2) / sum, ends clamped."""
    w = 1 / F.count("*").over(Window.partitionBy("subject"))
    line = Window.orderBy("value", "subject")
    r = rows.select("subject", "value", w.alias("w")).withColumns({"cum": F.sum("w").over(line.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(Window.partitionBy())})
    r = r.withColumn("pos", (F.col("cum") - F.col("w") / 2) / F.col("total"))
    r = r.withColumns({"npos": F.lead("pos").over(line), "nval": F.lead("value").over(line), "first": F.row_number().over(line) == 1})
    p = F.explode(F.array(*map(F.lit, probabilities))).alias("probability")
    r = r.select("*", p)
    inside = (F.col("probability") >= F.col("pos")) & (F.col("probability") < F.coalesce("npos", F.lit(2.0)))
    low = F.col("first") & (F.col("probability") < F.col("pos"))
    value = F.when(F.col("npos").isNull() | low, F.col("value")).otherwise(F.col("value") + (F.col("probability") - F.col("pos")) / (F.col("npos") - F.col("pos")) * (F.col("nval") - F.col("value")))
    return r.filter(inside | low).select("probability", value.alias("quantile"))


def window_motion(motion: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, 95th percentile, maximum and number of finite values of fd in inclusive original-frame windows."""
    frames = windows.select(*keys, "start_frame", "end_frame", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    rows = frames.join(motion, [*keys, "frame"], "left")
    fd = F.when(~F.isnan("fd"), F.col("fd"))
    return rows.groupBy(*keys, "start_frame", "end_frame").agg(F.avg(fd).alias("mean_fd"), F.percentile(fd, 0.95).alias("p95_fd"), F.max(fd).alias("max_fd"), F.count(fd).alias("n_finite"))


def match_candidates(left: DataFrame, right: DataFrame, caliper: float) -> DataFrame:
    """Pairs of one subject whose covariates differ by the caliper or less (inclusive), with the scaled cost."""
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.subject") == F.col("r.subject")) & (F.abs(F.col("l.cov") - F.col("r.cov")) <= caliper))
    return pairs.select(F.col("l.subject").alias("subject"), F.col("l.idx").alias("left_idx"), F.col("r.idx").alias("right_idx"), (F.abs(F.col("l.cov") - F.col("r.cov")) / caliper).alias("cost"))
