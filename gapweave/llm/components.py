"""Connected components of links between long ids, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """(node, component) for each node of links (u, v); component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing
    changes: O(log^2 n) rounds, each of them aggregations and equi-joins on written
    tables, so a lost executor costs a round at most. Minima are aggregated before
    they are joined back, so the centre of a large star is never one task's window.
    rows: the number of links, if it is known.
    """
    edges = written(
        links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows
    )
    before = _digest(edges)
    for _ in range(most_rounds):
        # large star: greater neighbours of u go to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = written(
            both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
            2 * before[0],
        )
        # small star: u and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small", 2 * before[0])
        drop(large)
        drop(edges)
        edges, after = now, _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
