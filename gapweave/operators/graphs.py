"""Graphs with a fixed partition: edges (keys, i, j, w) with i < j, community of each node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def thresholded(edges: DataFrame, keys: list[str], density: float, n_nodes: int) -> DataFrame:
    """The strongest positive edges: max(1, half-even round of density times all pairs); on ties the later edge."""
    most = n_nodes * (n_nodes - 1) // 2
    target = max(1, round(density * most))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("w").desc(), F.col("i").desc(), F.col("j").desc()))
    return edges.filter("w > 0").withColumn("_r", rank).filter(F.col("_r") <= target).drop("_r")


def achieved_density(kept: DataFrame, keys: list[str], n_nodes: int) -> DataFrame:
    return kept.groupBy(*keys).agg((F.count(F.when(F.col("w") > 0, 1)) / (n_nodes * (n_nodes - 1) / 2)).alias("density"))


def _sided(kept: DataFrame, keys: list[str], partition: list[str]) -> DataFrame:
    """Each edge from both ends, with the communities of node and other."""
    both = kept.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("j").alias("other")), F.struct(F.col("j").alias("node"), F.col("i").alias("other")))).alias("e"), "w")
    name = F.array(*map(F.lit, partition))
    return both.select(*keys, "e.node", "e.other", "w", F.element_at(name, F.col("e.node") + 1).alias("own"), F.element_at(name, F.col("e.other") + 1).alias("far"))


def modularity(kept: DataFrame, keys: list[str], partition: list[str]) -> DataFrame:
    """Sum over communities of within / T - (strength / T)^2; 0 without weight."""
    own = _sided(kept, keys, partition).groupBy(*keys, "own").agg(F.sum(F.when(F.col("own") == F.col("far"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("strength"))
    total = F.sum("strength").over(Window.partitionBy(*keys))
    own = own.withColumn("t", total)
    term = F.when(F.col("t") <= 1e-12, F.lit(0.0)).otherwise(F.col("inside") / F.col("t") - F.col("strength") * F.col("strength") / (F.col("t") * F.col("t")))
    return own.groupBy(*keys).agg(F.sum(term).alias("modularity"))


def participation(kept: DataFrame, graphs: DataFrame, keys: list[str], partition: list[str]) -> DataFrame:
    """1 - sum of squared community shares of a node's strength; 0 for a node without edges. graphs: one row of keys for each graph."""
    own = _sided(kept, keys, partition).groupBy(*keys, "node", "far").agg(F.sum("w").alias("s"))
    nodes = own.groupBy(*keys, "node").agg(F.sum("s").alias("strength"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    grid = graphs.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(len(partition) - 1))))
    p = F.when(F.coalesce(F.col("strength"), F.lit(0.0)) > 0, F.least(F.greatest(1 - F.col("s2") / (F.col("strength") * F.col("strength")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return grid.join(nodes, [*keys, "node"], "left").select(*keys, "node", F.coalesce("strength", F.lit(0.0)).alias("strength"), p.alias("participation"))


def edge_summary(edges: DataFrame, keys: list[str], partition: list[str]) -> DataFrame:
    """Mean weight within and between communities, difference, segregation (null if within is about 0)."""
    name = F.array(*map(F.lit, partition))
    same = F.element_at(name, F.col("i") + 1) == F.element_at(name, F.col("j") + 1)
    rows = edges.groupBy(*keys).agg(F.avg(F.when(same, F.col("w"))).alias("within"), F.avg(F.when(~same, F.col("w"))).alias("between"))
    rows = rows.withColumn("difference", F.col("within") - F.col("between"))
    return rows.withColumn("segregation", F.when(F.abs("within") > 1e-12, F.col("difference") / F.col("within")))


def normalized_auc(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Trapezoid integral of y over x divided by the range of x."""
    line = Window.partitionBy(*keys).orderBy(x)
    step = rows.withColumn("_a", (F.lead(y).over(line) + F.col(y)) / 2 * (F.lead(x).over(line) - F.col(x)))
    return step.groupBy(*keys).agg((F.sum("_a") / (F.max(x) - F.min(x))).alias("auc"))
