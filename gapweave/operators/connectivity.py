"""Pairwise connectivity: correlation windows, edge time series, derivatives, phase.

Channels of a frame are kept as an array (its length is the number of channels), so the
pairs of a frame are an explode of one row and never a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import RUN
from .segments import SEGMENT, segmented, windowed


def wide(rows: DataFrame, keys: list[str], value: str, out: str = "v") -> DataFrame:
    """One row for each key, values by channel as an array."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("roi_idx", value))), lambda c: c[value])
    return rows.groupBy(*keys).agg(cells.alias(out))


def pairs(rows: DataFrame, value: str, product: bool = True) -> DataFrame:
    """rows with i < j and vi, vj of the array value."""
    left = rows.select("*", F.posexplode(value).alias("i", "vi"))
    rest = F.slice(F.col(value), F.col("i") + 2, F.size(value))
    return left.select("*", F.posexplode(rest).alias("d", "vj")).withColumn("j", F.col("i") + F.col("d") + 1).drop("d", value)


def fisher(r: Column) -> Column:
    return F.atanh(F.least(F.greatest(r, F.lit(-0.999999)), F.lit(0.999999)))


def taper(at: Column, length: int, kind: str = "hamming") -> Column:
    if kind == "uniform":
        return F.lit(1.0)
    return F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(2 * math.pi) * at / F.lit(float(length)))


def correlations(rows: DataFrame, keys: list[str], frame: str, weight: str = "w") -> DataFrame:
    """Weighted Pearson correlation of channel pairs in each key: centred, then summed; null below the variance floor."""
    own = Window.partitionBy(*keys, "roi_idx")
    centred = rows.withColumn("c", F.col("x") - F.sum(F.col(weight) * F.col("x")).over(own) / F.sum(weight).over(own))
    flat = pairs(wide(centred, [*keys, frame, weight], "c"), "v")
    w = F.col(weight)
    sums = flat.groupBy(*keys, "i", "j").agg(F.sum(w * F.col("vi") * F.col("vj")).alias("xy"), F.sum(w * F.col("vi") * F.col("vi")).alias("xx"), F.sum(w * F.col("vj") * F.col("vj")).alias("yy"), F.sum(w).alias("sw"))
    ok = (F.col("xx") / F.col("sw") > 1e-12) & (F.col("yy") / F.col("sw") > 1e-12)
    r = F.when(ok, F.least(F.greatest(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), F.lit(-1.0)), F.lit(1.0)))
    return sums.select(*keys, "i", "j", r.alias("r"))


def static_correlation(panel: DataFrame) -> DataFrame:
    return correlations(panel.withColumn("w", F.lit(1.0)), RUN, "frame")


def window_fc(panel: DataFrame, length: int, step: int, kind: str = "hamming") -> DataFrame:
    """Fisher-z edges of each window: run, segment_id, start_frame, end_frame, i, j, z."""
    rows = windowed(panel, length, step).withColumns({"w": taper(F.col("at"), length, kind), "start_frame": F.col("frame") - F.col("at")})
    found = correlations(rows, [*SEGMENT, "start_frame"], "frame")
    return found.select(*SEGMENT, "start_frame", (F.col("start_frame") + length - 1).alias("end_frame"), "i", "j", fisher(F.col("r")).alias("z"))


def segment_standardized(panel: DataFrame) -> DataFrame:
    """z of each channel in its segment (population SD; below 1e-8 taken as 1); segments of 2 frames or more."""
    own = Window.partitionBy(*SEGMENT, "roi_idx")
    sd = F.stddev_pop("x").over(own)
    return segmented(panel, 2).withColumn("z", (F.col("x") - F.avg("x").over(own)) / F.when(sd < 1e-8, F.lit(1.0)).otherwise(sd))


def ets_edges(panel: DataFrame) -> DataFrame:
    rows = wide(segment_standardized(panel), [*SEGMENT, "frame"], "z")
    return pairs(rows, "v").select(*SEGMENT, "frame", "i", "j", (F.col("vi") * F.col("vj")).alias("product"))


def ets_rss(panel: DataFrame) -> DataFrame:
    """Root of the sum of squared edges, without making edges."""
    z2 = F.col("z") * F.col("z")
    sums = segment_standardized(panel).groupBy(*SEGMENT, "frame").agg(F.sum(z2).alias("s2"), F.sum(z2 * z2).alias("s4"))
    return sums.select(*SEGMENT, "frame", F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") * F.col("s2") - F.col("s4")) / 2)).alias("rss"))


def ets_threshold(rss: DataFrame, percentile: float = 95.0) -> DataFrame:
    return rss.agg(F.percentile("rss", percentile / 100).alias("threshold"), F.count("*").alias("n_frames"), F.countDistinct("subject").alias("n_subjects"))


def mtd_derivatives(panel: DataFrame) -> DataFrame:
    """First differences inside segments, divided by their population SD over the run after centring; frame is the first of two."""
    step = Window.partitionBy(*SEGMENT, "roi_idx").orderBy("frame")
    own = Window.partitionBy(*RUN, "roi_idx")
    diff = segmented(panel, 2).withColumns({"d": F.lead("x").over(step) - F.col("x"), "end_frame": F.lead("frame").over(step)}).filter("d is not null")
    sd = F.stddev_pop("d").over(own)
    return diff.withColumn("z", F.when(sd >= 1e-8, (F.col("d") - F.avg("d").over(own)) / sd))


def mtd_edges(panel: DataFrame) -> DataFrame:
    rows = wide(mtd_derivatives(panel), [*SEGMENT, "frame", "end_frame"], "z")
    return pairs(rows, "v").select(*SEGMENT, "frame", "end_frame", "i", "j", (F.col("vi") * F.col("vj")).alias("product"))


def cross_block(rows: DataFrame, left: list[int], right: list[int], value: str = "z") -> DataFrame:
    """Mean over left x right products: the product of the two block means."""
    if set(left) & set(right) or not left or not right:
        raise ValueError("blocks are disjoint and not empty")
    mean = lambda block: F.avg(F.when(F.col("roi_idx").isin(block), F.col(value)))
    return rows.groupBy(*SEGMENT, "frame").agg((mean(left) * mean(right)).alias("mean_product"))


def within_block(rows: DataFrame, nodes: list[int], value: str = "z") -> DataFrame:
    """Mean over the block's pairs: ((sum z)^2 - sum z^2) / (n (n - 1))."""
    n = len(set(nodes))
    if n < 2:
        raise ValueError("a block has two channels at least")
    own = rows.filter(F.col("roi_idx").isin(nodes)).groupBy(*SEGMENT, "frame").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    return own.select(*SEGMENT, "frame", ((F.col("s") * F.col("s") - F.col("s2")) / (n * (n - 1))).alias("mean_product"))


def analytic_phase(panel: DataFrame, least: int = 20) -> DataFrame:
    """Phase of the analytic signal of each centred channel in its segment, by the discrete Hilbert kernel.

    A segment's values are one array, so the kernel sum is a higher-order function: N^2
    steps for N frames of a segment, which the segment's length bounds.
    """
    own = Window.partitionBy(*SEGMENT, "roi_idx")
    rows = segmented(panel, max(3, least)).withColumn("c", F.col("x") - F.avg("x").over(own))
    series = rows.groupBy(*SEGMENT, "roi_idx").agg(F.sort_array(F.collect_list(F.struct("frame", "c"))).alias("s"))
    even = "case when k % 2 = 1 then 2D / n / tan(pi() * k / n) else 0D end"
    odd = "1D / n * (1D / tan(pi() * k / n) - cos(pi() * k) / sin(pi() * k / n))"
    kernel = f"transform(sequence(0, n - 1), k -> case when k = 0 then 0D when n % 2 = 0 then {even} else {odd} end)"
    series = series.withColumn("n", F.size("s")).withColumns({"c": F.transform("s", lambda e: e["c"]), "h": F.expr(kernel)})
    # the explode stands between the arrays and the sum, so that they are made once a segment
    each = series.select(*SEGMENT, "roi_idx", "n", "c", "h", F.posexplode("s").alias("i", "e"))
    h = F.expr("aggregate(sequence(0, n - 1), 0D, (a, m) -> a + c[m] * h[(i - m + n) % n])")
    return each.select(*SEGMENT, "roi_idx", F.col("e.frame").alias("frame"), F.atan2(h, F.col("e.c")).alias("phase"))


def phase_axis(phase: DataFrame) -> DataFrame:
    """Leading eigenvector (v, by channel) and eigenvalue of cos(phase_i - phase_j) in each frame, in closed form."""
    own = Window.partitionBy(*SEGMENT, "frame")
    c, s = F.cos("phase"), F.sin("phase")
    rows = phase.withColumns({"c": c, "s": s}).withColumns({"cc": F.sum(F.col("c") * F.col("c")).over(own), "ss": F.sum(F.col("s") * F.col("s")).over(own), "cs": F.sum(F.col("c") * F.col("s")).over(own)})
    rows = rows.withColumn("turn", F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss")) / 2)
    rows = rows.withColumn("u", F.col("c") * F.cos("turn") + F.col("s") * F.sin("turn"))
    norm, sign = F.sqrt(F.sum(F.col("u") * F.col("u")).over(own)), F.when(F.sum("u").over(own) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    diff = F.col("cc") - F.col("ss")
    value = (F.col("cc") + F.col("ss") + F.sqrt(diff * diff + 4 * F.col("cs") * F.col("cs"))) / 2
    return rows.withColumns({"v": F.col("u") / norm * sign, "eigenvalue": value}).select(*SEGMENT, "frame", "roi_idx", "v", "eigenvalue")


def phase_cross_block(phase: DataFrame, left: list[int], right: list[int]) -> DataFrame:
    mean = lambda f, block: F.avg(F.when(F.col("roi_idx").isin(block), f("phase")))
    both = mean(F.cos, left) * mean(F.cos, right) + mean(F.sin, left) * mean(F.sin, right)
    return phase.groupBy(*SEGMENT, "frame").agg(both.alias("coherence"))


def phase_within_block(phase: DataFrame, nodes: list[int]) -> DataFrame:
    n = len(set(nodes))
    own = phase.filter(F.col("roi_idx").isin(nodes)).groupBy(*SEGMENT, "frame").agg(F.sum(F.cos("phase")).alias("c"), F.sum(F.sin("phase")).alias("s"))
    return own.select(*SEGMENT, "frame", ((F.col("c") * F.col("c") + F.col("s") * F.col("s") - n) / (n * (n - 1))).alias("coherence"))
