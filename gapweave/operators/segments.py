"""Gap-bounded segments and windows inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import RUN

SEGMENT = [*RUN, "segment_id"]


def segments(frames: DataFrame) -> DataFrame:
    """(run, frame) with segment_id (counts all segments of a run from 0), pos and len."""
    line = Window.partitionBy(*RUN).orderBy("frame")
    island = frames.select(*RUN, "frame").distinct().withColumn("g", F.col("frame") - F.row_number().over(line))
    own = Window.partitionBy(*RUN, "g")
    return island.select(
        *RUN,
        "frame",
        (F.dense_rank().over(Window.partitionBy(*RUN).orderBy("g")) - 1).cast("long").alias("segment_id"),
        (F.row_number().over(own.orderBy("frame")) - 1).cast("long").alias("pos"),
        F.count("*").over(own).alias("len"),
    )


def segmented(panel: DataFrame, least: int = 1) -> DataFrame:
    """panel with its segments; shorter ones than least go, ids stay."""
    return panel.join(segments(panel).filter(F.col("len") >= least), [*RUN, "frame"])


def segment_table(frames: DataFrame, least: int = 1) -> DataFrame:
    found = segments(frames).groupBy(*SEGMENT).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n_frames"))
    return found.filter(F.col("n_frames") >= least)


def window_table(frames: DataFrame, length: int, step: int) -> DataFrame:
    """Windows of each segment: starts 0, step, ... up to len - length."""
    if length < 2 or step < 1:
        raise ValueError("length is 2 at least, step 1")
    found = segment_table(frames, length).withColumn("offset", F.explode(F.expr(f"sequence(0L, n_frames - {length}L, {step}L)")))
    return found.select(*SEGMENT, (F.col("offset") / step).cast("long").alias("window_idx"), (F.col("start_frame") + F.col("offset")).alias("start_frame"), (F.col("start_frame") + F.col("offset") + length - 1).alias("end_frame"))


def windowed(panel: DataFrame, length: int, step: int) -> DataFrame:
    """Each panel row once for each window that it is in, with start (position) and at (place in the window).

    A frame at position p belongs to starts s with s <= p < s + length, s a multiple of
    step, s <= len - length: an explode, no range join.
    """
    rows = segmented(panel, length)
    first = f"greatest(0L, cast(ceil((pos - {length - 1}) / {step}) as bigint) * {step}L)"
    last = f"(least(pos, len - {length}) div {step}) * {step}L"
    starts = F.expr(f"case when {first} <= {last} then sequence({first}, {last}, {step}L) else array() end")
    return rows.withColumn("start", F.explode(starts)).withColumn("at", F.col("pos") - F.col("start"))


def eligible_windows(frames: DataFrame, length: int) -> DataFrame:
    """(run, eligible): fixed-length windows at any start."""
    return segment_table(frames).groupBy(*RUN).agg(F.sum(F.greatest(F.lit(0), F.col("n_frames") - length + 1)).cast("long").alias("eligible"))
