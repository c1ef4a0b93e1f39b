"""Resharding by minimum-cost flow.

Old shards supply bytes, new shards have capacities, a byte that stays costs nothing
and one that moves costs one (or what a cost matrix says). The flow between the two
small sets of shards is solved on the driver; documents, dealt to blocks by hash, are
then cut along each old shard's running byte sum where its flow changes target.

One flow of all bytes says what each old shard gives to each new one. Documents above
the median size are placed first, as large a part of each amount as they are of their
old shard; the small ones fill what is left, again at the least cost, so shard sizes
differ by about a small document and bytes moved from the fewest by about a few.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .scratch import files_of, remove, written

#: a block's running sum is one window; offsets of blocks are windows over one row a block
ROWS_A_BLOCK = 20_000
GROUP = ["old_shard", "tier", "block"]
#: bytes of rows from which a shard gets one more file
BYTES_A_FILE = 32 << 20


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Units from each supply to each capacity at the least total cost; sum(supply) <= sum(capacity).

    Successive shortest paths with potentials. Ties go to the lower index.
    """
    n, m = len(supply), len(capacity)
    source, sink, size = n + m, n + m + 1, n + m + 2
    graph: list[list[list[int]]] = [[] for _ in range(size)]

    def edge(u: int, v: int, room: int, price: int) -> None:
        graph[u].append([v, room, price, len(graph[v])])
        graph[v].append([u, 0, -price, len(graph[u]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    left, height = sum(supply), [0] * size
    while left > 0:
        far: list[float] = [float("inf")] * size
        way: list[tuple[int, int] | None] = [None] * size
        far[source], queue = 0, [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for k, (v, room, price, _) in enumerate(graph[u]):
                to = d + price + height[u] - height[v]
                if room > 0 and to < far[v]:
                    far[v], way[v] = to, (u, k)
                    heapq.heappush(queue, (to, v))
        if way[sink] is None:
            raise ValueError("the capacities hold less than the supplies")
        height = [h + min(d, far[sink]) for h, d in zip(height, far)]
        push, v = left, sink
        while v != source:
            u, k = way[v]
            push, v = min(push, graph[u][k][1]), u
        v = sink
        while v != source:
            u, k = way[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
        left -= push
    out = [[0] * m for _ in range(n)]
    for i in range(n):
        for v, _, _, back in graph[i]:
            if n <= v < n + m:
                out[i][v - n] = graph[v][back][1]
    return out


def shares(total: int, n: int) -> list[int]:
    return [total * (j + 1) // n - total * j // n for j in range(n)]


def moving_cost(old: Sequence[int], n_shards: int) -> list[list[int]]:
    return [[0 if i == j else 1 for j in range(n_shards)] for i in old]


def _dealing(rows: DataFrame, order: Sequence[str]) -> tuple[dict[str, Column], int]:
    """Columns tier and block of rows, and the number of blocks."""
    count, median = rows.agg(F.count("*"), F.percentile_approx("size", 0.5)).first()
    blocks = max(16, -(-count // ROWS_A_BLOCK))
    tier = (F.col("size") <= F.lit(median or 0)).cast("int")
    return {"tier": tier, "block": F.pmod(F.xxhash64(*order, F.lit(11)), F.lit(blocks)).cast("long")}, blocks


def _placed(rows: DataFrame, n_shards: int, order: Sequence[str], capacities: Sequence[int] | None, dealt: dict[str, Column], blocks: int) -> tuple[DataFrame | None, int]:
    """rows with tier, block, rn (place in the block's order) and shard, null for an empty table; and the number of blocks of all old shards and tiers.

    The rows of a block that go to one shard follow one another in the block's order.
    """
    spark = rows.sparkSession
    rows = written(rows.withColumns(dealt), "rows")
    line = Window.partitionBy(*GROUP).orderBy(*order, "size")
    earlier = Window.partitionBy("old_shard", "tier").orderBy("block")
    # the driver holds one row for each old shard and tier
    tiers = {(r[0], r[1]): r[2] for r in rows.groupBy("old_shard", "tier").agg(F.sum("size")).collect()}
    lines = blocks * len(tiers)
    sums = rows.groupBy(*GROUP).agg(F.sum("size").alias("bytes")).withColumn("off", F.sum("bytes").over(earlier) - F.col("bytes"))
    sums = written(sums.drop("bytes"), "blocks", lines)
    total = sum(tiers.values())
    weight = list(capacities or shares(max(total, n_shards), n_shards))
    cap = [w * total // sum(weight) for w in weight]
    for j in range(total - sum(cap)):
        cap[j % n_shards] += 1
    load = [0] * n_shards
    numbered = rows.withColumns({"rn": F.row_number().over(line), "before": F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    old = sorted({i for i, _ in tiers})
    fewest = dict(zip(old, min_cost_flow([tiers.get((i, 0), 0) + tiers.get((i, 1), 0) for i in old], cap, moving_cost(old, n_shards))))
    placed = None
    for t in (0, 1):
        old = sorted(i for i, of in tiers if of == t)
        if not old:
            continue
        supply = [tiers[i, t] for i in old]
        if t == 0:
            flow = [fewest[i] for i in old]
        else:
            room = [max(0, c - x) for c, x in zip(cap, load)]
            room[0] += max(0, sum(supply) - sum(room))
            flow = min_cost_flow(supply, room, moving_cost(old, n_shards))
        cuts = []
        for i, f, s in zip(old, flow, supply):
            to = sorted((j for j in range(n_shards) if f[j]), key=lambda j: (j != i, j))
            bound, at = [], 0
            for j in to:
                bound.append(at * s // sum(f))
                at += f[j]
            cuts.append((i, bound, to))
        cut = spark.createDataFrame(cuts, "old_shard int, bounds array<long>, targets array<int>")
        one = numbered.filter(F.col("tier") == t).join(sums, GROUP).join(cut, "old_shard")
        one = one.withColumn("shard", F.expr("element_at(targets, size(filter(bounds, b -> 2 * b <= 2 * (off + before) + size)))"))
        one = written(one.drop("off", "bounds", "targets", "before"), "placed")
        for j, x in one.groupBy("shard").agg(F.sum("size")).collect():
            load[j] += x
        placed = one if placed is None else placed.unionByName(one)
    return placed, lines


def reshard(rows: DataFrame, n_shards: int, order: Sequence[str], capacities: Sequence[int] | None = None) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard).

    rows has size (long, at least 1) and old_shard (int); order names columns that put
    rows in a definite order (rows equal in all of them may change places). capacities
    are bytes of each new shard, equal shares unless given; they are scaled to the rows'
    total. Old shard i is kept as new shard i as far as it fits. Rows are never lost: an
    empty table gives an empty one, and nulls in order are values like any other.
    """
    placed, lines = _placed(rows, n_shards, order, capacities, *_dealing(rows, order))
    if placed is None:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).filter("false")
    first = placed.groupBy("shard", *GROUP).agg(F.count("*").alias("n"), F.min("rn").alias("lowest"))
    begin = F.sum("n").over(Window.partitionBy("shard").orderBy(*GROUP)) - F.col("n")
    slots = written(first.select("shard", *GROUP, (begin - F.col("lowest")).alias("shift")), "slots", 2 * lines)
    done = placed.join(slots, ["shard", *GROUP]).withColumn("slot", (F.col("shift") + F.col("rn")).cast("long"))
    return done.drop("tier", "block", "rn", "shift")


def affected(plan: DataFrame) -> list[int]:
    """New shards whose files must be rewritten: any that gains or loses a row."""
    moved = plan.filter("old_shard <> shard")
    return sorted({r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()})


def rewrite_affected(docs: DataFrame, path: str, shards: Sequence[int]) -> None:
    """Write the partitions shard=N of docs (with shard and slot) named, and leave the others' files as they are."""
    spark = docs.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        docs.filter(F.col("shard").isin([*shards])).repartition("shard").sortWithinPartitions("slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def lay_out(docs: DataFrame, path: str, shard: Column) -> None:
    """Write docs in folders shard=N, with row_id, a long of its own for each row; nothing is shuffled."""
    rows = docs.select("*", F.monotonically_increasing_id().alias("row_id"), shard.alias("shard"))
    rows.coalesce(files_of(docs.count())).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def laid_out(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a layout of docs of this schema, with shard (int) and slot (long, gapless from 0 in each shard): a row's place in its shard's files."""
    name, number = F.col("_metadata.file_name"), F.regexp_extract("_name", r"part-(\d+)", 1).cast("long")
    rows = _files(spark, path, schema).select("*", name.alias("_name"), F.col("_metadata.row_index").alias("_row"))
    begin = F.sum("count").over(Window.partitionBy("shard").orderBy(number, "_name")) - F.col("count")
    files = rows.groupBy("shard", "_name").count().select("shard", "_name", begin.alias("_begin"))
    return rows.join(F.broadcast(files), ["shard", "_name"]).select(*schema.names, "shard", (F.col("_begin") + F.col("_row")).alias("slot"))


def _files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    fields = StructType([*schema.fields, StructField("row_id", LongType()), StructField("shard", IntegerType())])
    return spark.read.schema(fields).parquet(path)


def reshard_files(spark: SparkSession, path: str, schema: StructType, n_shards: int, size: Column, order: Sequence[Column], capacities: Sequence[int] | None = None) -> list[int]:
    """Bring the layout of docs of this schema to n_shards shards as reshard says: files of affected shards are written anew, the others' stay; the affected ones.

    size and order are made from the columns of docs, row_id comes last in the order; the plan
    is made on these alone. As the rows of a block that go to one shard follow one another, it is a
    row for each block and shard with the least key there, and tells each row its shard and file
    as it is read: texts are shuffled once, to the file that they belong to, and stand there by slot.
    """
    keys = {"size": size.cast("long")} | {f"order_{k}": c for k, c in enumerate(order)}
    docs = _files(spark, path, schema).withColumnRenamed("shard", "old_shard")
    docs = docs.select(F.struct(*schema.names).alias("row"), "old_shard", "row_id", *(c.alias(n) for n, c in keys.items()))
    line = [*list(keys)[1:], "row_id"]
    sizes = written(docs.drop("row"), "sizes")
    dealt, blocks = _dealing(sizes, line[:-1])
    placed, lines = _placed(sizes, n_shards, line, capacities, dealt, blocks)
    touched = [] if placed is None else affected(placed)
    if not touched:
        return []
    runs = placed.groupBy("shard", *GROUP).agg(F.min(F.struct(*line)).alias("least"), F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("shard").orderBy(*GROUP)) - F.col("bytes")
    runs = written(runs.withColumn("part", F.floor(before / BYTES_A_FILE).cast("int")), "runs", 2 * lines)
    # the driver holds one row for each new shard
    parts = {r[0]: r[1] for r in runs.filter(F.col("shard").isin(touched)).groupBy("shard").agg(F.max("part") + 1).collect()}
    first = dict(zip(sorted(parts), accumulate((parts[j] for j in sorted(parts)), initial=0)))
    file = F.array(*(F.lit(first.get(j)).cast("int") for j in range(n_shards)))[F.col("shard")] + F.col("part")
    runs = runs.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("least", "shard", file.alias("file")))).alias("runs"))
    rows = docs.withColumns(dealt).withColumn("key", F.struct(*line)).join(F.broadcast(runs), GROUP)
    rows = rows.withColumn("run", F.expr("element_at(filter(runs, r -> r.least <= key), -1)")).filter("run.file is not null")
    rows = rows.select("row", "row_id", "run.shard", "run.file", F.struct(*GROUP, "key").alias("key"))
    rows = rows.repartitionById(sum(parts.values()), "file").sortWithinPartitions("shard", "key").select("row.*", "row_id", "shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(path)
    for j in set(touched) - set(parts):  # a shard that has lost all rows
        remove(spark, f"{path}/shard={j}")
    return touched


def layout_by(column: Column | str, n_old: int) -> Column:
    """Old shard of a corpus that was laid out by a column's hash: a hot value makes one shard large."""
    return F.pmod(F.xxhash64(column), F.lit(n_old)).cast("int")
