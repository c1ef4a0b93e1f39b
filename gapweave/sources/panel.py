"""The panel: one row for each run (subject, session), frame and channel (roi)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = ["subject", "session"]
#: fixed values: the channels of the order panel, in order
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cells(spark: SparkSession, sf_dir: str, subjects: int = 10) -> DataFrame:
    """Monthly quantity by supplier group, line status and order priority; n lines each."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus", "l_shipdate", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    frame = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("long")
    cell = line.join(order, line["l_orderkey"] == order["o_orderkey"]).groupBy(
        (F.col("l_suppkey") % subjects).cast("string").alias("subject"), F.col("l_linestatus").alias("session"), frame.alias("frame"), F.col("o_orderpriority").alias("roi")
    )
    return cell.agg(F.sum("l_quantity").alias("x"), F.count("*").alias("n"))


def outlier_mask(cells: DataFrame, channels: int, share: float = 0.8) -> DataFrame:
    """(run, frame, outlier): a frame lacks a channel, or has fewer lines than a share of its run's mean."""
    frames = cells.groupBy(*RUN, "frame").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    mean = frames.groupBy(*RUN).agg(F.avg("n").alias("mean"))
    return frames.join(mean, RUN).select(*RUN, "frame", (~((F.col("k") == channels) & (F.col("n") >= share * F.col("mean")))).alias("outlier"))


def censored(cells: DataFrame, mask: DataFrame, channels: list[str]) -> DataFrame:
    """The panel of the frames that the mask keeps; roi_idx is the place in channels."""
    kept = mask.filter("not outlier").select(*RUN, "frame")
    index = (F.array_position(F.array(*map(F.lit, channels)), F.col("roi")) - 1).cast("int")
    return cells.join(kept, [*RUN, "frame"]).select(*RUN, "frame", index.alias("roi_idx"), "roi", "x")


def order_panel(spark: SparkSession, sf_dir: str, subjects: int = 10) -> DataFrame:
    cells = order_cells(spark, sf_dir, subjects)
    return censored(cells, outlier_mask(cells, len(PRIORITIES)), PRIORITIES)


def check_panel(panel: DataFrame) -> None:
    """Raise unless frames are unique and not negative, values finite, and every frame has every channel."""
    bad = panel.filter("frame < 0 or x is null or isnan(x) or abs(x) = double('infinity') or roi_idx is null").limit(1).count()
    if bad:
        raise ValueError("a negative frame, an unknown channel or a value that is not finite")
    if panel.groupBy(*RUN, "frame", "roi_idx").count().filter("count > 1").limit(1).count():
        raise ValueError("a frame stands twice in a run")
    counts = panel.groupBy(*RUN, "frame").count().agg(F.min("count"), F.max("count")).first()
    if counts[0] != counts[1]:
        raise ValueError("frames differ in their channels")


def check_subjects_disjoint(train: DataFrame, test: DataFrame) -> None:
    """Raise if a subject is in both."""
    if train.join(test.select("subject").distinct(), "subject", "left_semi").limit(1).count():
        raise ValueError("training and test subjects overlap")
