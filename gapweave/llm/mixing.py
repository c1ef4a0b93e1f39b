"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source takes all its documents
so many whole times as its target allows; the rest of the target is spent on documents
of chosen lengths: in proportion first, then the largest that fit, and the last stretch
by a bounded-knapsack dynamic programme over lengths and counts. Which documents of a
length are taken follows from a seeded hash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: words that the dynamic programme spends, beside the longest text's
STRETCH = 1 << 16
#: documents of one source and length beyond which they are ranked in parts of about half as many or fewer
HOT = 50_000
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: weights by code point order, null last; none above most times its size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), [s for s, _ in order], {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * size[s]]
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = float(most * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in set(full)]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length make the largest sum up to budget: a bounded subset sum by bit set."""
    pieces: list[tuple[int, int]] = []
    for k, (length, count) in enumerate(zip(lengths, counts)):
        count, step = min(count, budget // length if length else 0), 1
        while count > 0:
            take = min(step, count)
            pieces.append((k, take))
            count, step = count - take, step * 2
    full, states = (1 << (budget + 1)) - 1, [1]
    used = []
    for k, take in pieces:
        if states[-1] >> budget & 1:
            break
        states.append((states[-1] | states[-1] << lengths[k] * take) & full)
        used.append((k, take))
    best, out = states[-1].bit_length() - 1, [0] * len(lengths)
    for (k, take), before in zip(reversed(used), reversed(states[:-1])):
        if not before >> best & 1:
            out[k] += take
            best -= lengths[k] * take
    return out


def fitted(lengths: list[int], counts: list[int], target: float, most: int = 2) -> tuple[int, list[int]]:
    """Whole takings of every document, and how many of each length are taken once more."""
    total = sum(x * c for x, c in zip(lengths, counts))
    if not total:
        return 0, [0] * len(lengths)
    budget = round(target)
    whole = min(most, budget // total)
    rest = 0 if whole == most else budget - whole * total
    extra = [c * rest // total if x else 0 for x, c in zip(lengths, counts)]
    rest -= sum(x * e for x, e in zip(lengths, extra))
    by = sorted((k for k in range(len(lengths)) if lengths[k]), key=lambda k: -lengths[k])
    for k in by:
        take = min(counts[k] - extra[k], max(0, rest - STRETCH) // lengths[k])
        extra[k] += take
        rest -= take * lengths[k]
    more = knapsack([lengths[k] for k in by], [counts[k] - extra[k] for k in by], rest)
    for k, m in zip(by, more):
        extra[k] += m
    return whole, extra


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 42, source: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id",), hashed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, source, size, source_size, target (double), times (int), taken (long: size * times) of every row.

    A null text has size 0, a null source is a source of its own, last in order. Rows of
    size 0 are taken no times. Reruns agree but for rows equal in all keys, which may
    change places. The driver holds one row for each source; a task fits one source's
    distinct lengths, which the longest text bounds, not the number of rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
    rows = written(docs.select(*keys, F.col(source).alias("source"), size.alias("size")), "sizes")
    counted = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = [(r[0], int(r[1])) for r in counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()]
    wanted = targets(sizes, weights, share, float(most))
    goals = spark.createDataFrame([(s, n, float(wanted[s])) for s, n in sizes], "source string, source_size long, target double")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        whole, extra = fitted(part["size"].tolist(), part["n"].tolist(), float(part["target"].iloc[0]), most)
        return part.assign(whole=whole, extra=extra)

    aimed = counted.join(goals, counted["source"].eqNullSafe(goals["source"])).select(counted["source"], "size", "n", "source_size", "target")
    plan = written(aimed.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, whole int, extra long"), "plan")
    named = plan.withColumnsRenamed({"source": "of_source", "size": "of_size"})
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))).drop("of_source", "of_size")
    h = F.xxhash64(*hashed, F.lit(seed))
    # the salt is a prefix of the hash, so one order of the hash holds with any number of parts
    shift = F.when(F.col("n") > HOT, 63 - F.ceil(F.log2(F.col("n") / HOT))).cast("int")
    rows = rows.withColumns({"h": h, "shift": shift})
    rows = rows.withColumn("salt", F.coalesce(F.expr("shiftright(h, shift)"), F.lit(0).cast("long"))).drop("shift")
    group = ["source", "size", "salt"]
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("h", *keys))
    # only hot lengths have more than one part; the rows in the parts before are counted for those
    parts = rows.filter(F.col("n") > HOT).groupBy(*group).agg(F.count("*").alias("m"))
    parts = parts.withColumn("earlier", F.sum("m").over(Window.partitionBy("source", "size").orderBy("salt")) - F.col("m"))
    parts = parts.select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), F.col("salt").alias("of_salt"), "earlier")
    ranked = rows.withColumn("rank", rank).join(
        parts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")) & (F.col("salt") == F.col("of_salt")), "left"
    )
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + (F.col("rank") + F.coalesce("earlier", F.lit(0)) <= F.col("extra")).cast("int")).cast("int")
    return ranked.withColumn("times", times).select(*keys, "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))
