"""SimHash near duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into m segments with 2m > k. If two fingerprints
differ by k bits or fewer, one segment differs by one bit at most. Each segment is
therefore indexed once for each of its bits, with that bit taken as a wildcard;
an equality join on these variants finds every linked pair, and the join's own
condition counts the differing bits and keeps a pair at its first variant only.

Copies are folded before the join: it runs over distinct fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import drop, files_of, release, tune, written
from .textcore import blobs

BITS = 64


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each run of so many words of the lower-cased (A-Z) text, repeats included."""
    w = text.lower().split()  # bytes.lower and bytes.split know ASCII only: A-Z and the six white-space bytes
    if not w:
        return []
    at = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [at(b" ".join(w), seed)]
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    starts = [0, *ends]
    return [at(joined[s : e - 1], seed) for s, e in zip(starts, ends[words - 1 :])]


#: lanes of eight counters of one byte
_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint (uint64) of each run of so many hashes: a bit is 1 if set in over half of them; 0 for none.

    A word of eight byte counters takes every eighth bit of up to 255 hashes at a time.
    """
    out = np.zeros((len(sizes), 8), np.uint8)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out.view("<u8")[:, 0]
    n = sizes[full].astype(np.int64)
    blocks = -(-n // 255)
    block_of, first_block = np.repeat(np.arange(len(n)), blocks), np.cumsum(blocks) - blocks
    starts = (np.cumsum(n) - n)[block_of] + 255 * (np.arange(blocks.sum()) - first_block[block_of])
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, starts)
        ones = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
        out[full] |= (2 * ones > n[:, None]).astype(np.uint8) << np.uint8(j)
    return out.view("<u8")[:, 0]


def fingerprint(hashes: Sequence[int]) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for none."""
    return int(fingerprints_of(np.asarray(hashes, np.uint64), np.array([len(hashes)]))[0])


def _wide(hashes: np.ndarray, sizes: np.ndarray, seeds: Sequence[int]) -> list[pa.Array]:
    """A column of fingerprints for each seed; further ones come from the same hashes, mixed with another factor."""
    out = []
    for i, s in enumerate(seeds):
        x = hashes
        if i:
            x = hashes * np.uint64(s * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
            x ^= x >> np.uint64(32)
        out.append(pa.array(fingerprints_of(x, sizes).astype(np.uint64).view(np.int64)))
    return out


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of some texts, and how many each has."""
    sizes = np.array([len(x) for x in lists], np.int64)
    return (np.concatenate([np.asarray(x, np.uint64) for x in lists]) if sizes.sum() else np.zeros(0, np.uint64)), sizes


def fingerprints(docs: DataFrame, words: int = 4, seeds: Sequence[int] = (42,), text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns keep, and fp0, fp1, ... (long, the bits of the unsigned value), one for each seed.

    Null and empty texts, and texts without a word, have the fingerprint 0. Repeated shingles count as often.
    """
    tune(docs.sparkSession)
    seeds = tuple(seeds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = _wide(*_flat([shingle_hashes(t, words, seeds[0]) for t in blobs(b.column(len(keep)))]), seeds)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[*keep, *(f"fp{i}" for i in range(len(seeds)))])

    kept = docs.select(*keep, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), *(f"fp{i} long" for i in range(len(seeds)))])
    return kept.mapInArrow(work, schema)


#: shingles of a text in the sample by which texts without a partner are told, at most
SAMPLE = 64


def sample_of(shingles: np.ndarray, similarity: float, deviations: float = 3.5) -> tuple[np.ndarray, int, int]:
    """(sample, mask, need) of a set of hashes: those that end in so many zero bits that SAMPLE remain at most.

    If another set is as similar as this, at least `need` of the sample's hashes with h & mask = 0
    are in its sample: the sets' sizes are a factor of 1 / similarity apart, so their samples are
    one bit apart at most, and mask takes that bit where it may be. Where all hashes are in,
    need is exact; else so many standard deviations below the mean.
    """
    n = len(shingles)
    level = max(0, int(np.ceil(np.log2(max(1, n) / SAMPLE))))
    sample = shingles[shingles & np.uint64((1 << level) - 1) == 0]
    deep = level + (n > similarity * SAMPLE * (1 << level))
    mask = (1 << deep) - 1
    k = int((sample & np.uint64(mask) == 0).sum())
    least = similarity * k - (deviations * np.sqrt(similarity * (1 - similarity) * k) if deep else 0)
    return sample, mask, max(0, int(np.ceil(least - 1e-9)))


def set_prints(docs: DataFrame, words: int, seeds: Sequence[int], similarity: float) -> DataFrame:
    """(doc_id, th, fp0, fp1, ..., sample, mask, need) of docs (doc_id, th, text): each shingle of a text counts once."""
    tune(docs.sparkSession)
    seeds = tuple(seeds)
    kept = docs.select("doc_id", "th", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.array(shingle_hashes(t, words, seeds[0]), np.uint64)) for t in blobs(b.column(2))]
            drawn = [sample_of(s, similarity) for s in sets]
            more = [pa.array([s.view(np.int64) for s, _, _ in drawn], pa.list_(pa.int64())), pa.array([m for _, m, _ in drawn], pa.int64()), pa.array([n for _, _, n in drawn], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *_wide(*_flat(sets), seeds), *more], names=["doc_id", "th", *(f"fp{i}" for i in range(len(seeds))), "sample", "mask", "need"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(work, ", ".join([f"doc_id {kind}, th long", *(f"fp{i} long" for i in range(len(seeds))), "sample array<long>, mask long, need long"]))


def segments(most_bits: int) -> list[tuple[int, int]]:
    """(first bit, end) of the fewest segments of which one differs by one bit at most."""
    m = most_bits // 2 + 1
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return list(zip(cuts, cuts[1:]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, most_bits: int, column: str = "fp0") -> DataFrame:
    """(u, v) for each two rows of distinct (node, column) whose fingerprints differ by most_bits or fewer.

    Nodes with equal fingerprints are linked as well. The variants are written first, so
    that both sides of the join read one exchange.
    """
    segs = segments(most_bits)
    rows = written(_segment_rows(distinct.select(*dict.fromkeys(["node", column])), column, segs), "variants")
    on = f"a.key = b.key and a.node < b.node and bit_count(a.{column} ^ b.{column}) <= {int(most_bits)} and {_first_variant(column, segs, [])}"
    out = rows.alias("a").join(rows.alias("b"), F.expr(on)).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    out._gapweave_path = rows._gapweave_path  # drop() of the links removes the variants
    return out


def simhash_components(docs: DataFrame, words: int = 4, seed: int = 42, most_bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp0 (long), component_id (the smallest doc_id reachable, itself included), class_size.

    Every row of docs gives one row. Equal fingerprints are one node of the link graph,
    so groups of copies of any size cost one row in the join. A null doc_id is kept and
    never chosen as component_id unless the component has no other.
    """
    prints = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words, (seed,)), "prints")
    nodes = written(prints.groupBy(F.col("fp0").alias("node")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    parts = connected_components(links(nodes, most_bits, "node"))
    named = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("class_size"))
    found = written(named.select("node", "component").join(ids, "component").select(F.col("node").alias("fp0"), "component_id", "class_size"), "named")
    return prints.join(found, "fp0").select("doc_id", "fp0", "component_id", "class_size")


def expected_bits(similarity: float, bits: int) -> float:
    """Differing bits, in the mean, of fingerprints of so many bits of sets with this similarity."""
    return bits * math.acos(2 * similarity / (1 + similarity)) / math.pi


def _segment_rows(nodes: DataFrame, column: str, segs: Sequence[tuple[int, int]]) -> DataFrame:
    """nodes, once for each bit of these segments of column: key (the segment without the bit, and its place)."""
    keys = []
    for lo, hi in segs:
        for p in range(lo, hi):
            mask = ((1 << hi) - (1 << lo)) & ~(1 << p)
            part = F.shiftrightunsigned(F.col(column).bitwiseAND(F.lit(_signed(mask))), lo)
            keys.append(F.shiftleft(part, 6).bitwiseOR(F.lit(p)))
    return nodes.withColumn("key", F.explode(F.array(*keys)))


def _dealt_rows(nodes: DataFrame, column: str, segs: Sequence[tuple[int, int]]) -> DataFrame:
    """The rows of _segment_rows, and part, by which they are dealt: what a half of the segment holds, and its place.

    Segments that differ by a bit in one half are equal in the other. So a node is sent twice
    a segment, by the half that stays whole, and the variants of the other half are made where
    it arrives; rows of one key have one part. Segments of 16 bits have 512 parts each, so a
    fingerprint's rows make 2048 tasks at most.
    """
    halves = [(lo, hi, a, b) for lo, hi in segs for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]

    def held(lo: int, hi: int, without: int) -> Column:
        return F.shiftrightunsigned(F.col(column).bitwiseAND(F.lit(_signed(((1 << hi) - (1 << lo)) & ~without))), lo)

    parts = [F.shiftleft(held(lo, hi, (1 << b) - (1 << a)), 6).bitwiseOR(F.lit(a)) for lo, hi, a, b in halves]
    keys = [F.array(*(F.shiftleft(held(lo, hi, 1 << p), 6).bitwiseOR(F.lit(p)) for p in range(a, b))) for lo, hi, a, b in halves]
    chosen = keys[-1]
    for (_, _, a, _), of in zip(halves[:-1], keys):
        chosen = F.when(F.col("part").bitwiseAND(F.lit(63)) == a, of).otherwise(chosen)
    return nodes.withColumn("part", F.explode(F.array(*parts))).repartition("part").withColumn("key", F.explode(chosen))


@contextmanager
def _part_suffices(spark: SparkSession) -> Iterator[None]:
    """Joins by part and key that run in here take rows as dealt by part alone, without a further exchange."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _first_variant(column: str, segs: Sequence[tuple[int, int]], earlier: Sequence[tuple[str, int, int]]) -> str:
    """Condition that a pair (a, b) meets at one key of these segments only, and in no earlier one (column, lo, hi)."""
    x, p = f"(a.{column} ^ b.{column})", "cast(a.key & 63 as int)"

    def unlike(before: Sequence[tuple[str, int, int]]) -> str:
        return "".join(f" and bit_count((a.{c} ^ b.{c}) & {_signed((1 << h) - (1 << l))}L) > 1" for c, l, h in before)

    first = []
    for i, (lo, hi) in enumerate(segs):
        same = f"({p} = {lo} and ({x} & {_signed((1 << hi) - (1 << lo))}L) = 0)"
        first.append(f"({p} >= {lo} and {p} < {hi} and ((shiftright({x}, {p}) & 1) = 1 or {same}){unlike([(column, l, h) for l, h in segs[:i]])})")
    return f"({' or '.join(first)}){unlike(earlier)}"


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, seeds: Sequence[int] = tuple(range(42, 58)), indexed: int = 7, most_bits: int = 7, slack: float = 2.5, rounds: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th, rows, component, keeper: near-duplicate classes at a shingle similarity of 0.8 or more.

    th is xxhash64 of the text; rows counts the rows of equal doc_id and th. A similarity J
    of shingle sets makes an angle of acos(2J / (1+J)) and 64 * angle / pi differing bits a
    fingerprint at most in the mean (9.7 at J = 0.8). A node is a distinct row of fingerprints.

    Nodes go on only if the share of their shingles that stand in other nodes too allows a
    similar one (sample_of). The first fingerprints (indexed) are cut into segments as for
    most_bits; two nodes with a segment that differs by a bit at most (28 of 16 bits: all but
    1e-4 of the pairs at J = 0.8) are a candidate pair if all fingerprints together (1024 bits)
    differ by at most slack standard deviations more than the mean at J (which keeps 0.994 of
    the pairs at J = 0.8 and all but a few of the nearer ones). Every candidate is then
    decided by its shingle sets.

    Stars come first: the nodes of a key meet one of them, and each node keeps its nearest, so
    that a large group of near copies is a few classes after some rounds. A pass over one
    fingerprint then joins what is a standard deviation nearer than the mean at J, so that
    the last pass, over all of them, finds few pairs that are links. Pairs are made between
    classes only. A round or pass takes the variants of one or two fingerprints, which bounds
    the disk that they take. keeper is true for one (doc_id, th) of each class, the smallest,
    a null before all. Texts without a word are one another's copies.
    """
    spark = docs.sparkSession
    cols = [f"fp{i}" for i in range(len(seeds))]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    made = written(set_prints(docs, words, seeds, similarity).withColumn("node", F.xxhash64(*cols)), "made")
    prints = written(made.groupBy("doc_id", "th").agg(F.min("node").alias("node"), F.count("*").alias("rows")), "prints", count := made.count())
    # rows of a node have equal fingerprints; their samples are equal but for sets that 1024 bits do not part
    whole = made.select("node", *cols, "sample", "mask", "need").dropDuplicates(["node"])
    whole = written(whole, "whole", count)
    drop(made)
    nodes = written(_with_shared(whole).select("node", *cols, F.col("node").alias("component")), "nodes", count)
    drop(whole)
    n_nodes = nodes.count()
    release(spark)

    def unlike(columns: Sequence[str]) -> str:
        return " + ".join(f"bit_count(a.{c} ^ b.{c})" for c in columns)

    def apart(columns: Sequence[str], slack: float = slack) -> str:
        """Two classes, and as few differing bits in these columns as the similarity allows."""
        n = BITS * len(columns)
        mean = expected_bits(similarity, n)
        return f"a.component <> b.component and {unlike(columns)} <= {int(mean + slack * math.sqrt(mean * (1 - mean / n)))}"

    ends = [F.col(f"{side}.{x}").alias(to) for side, x, to in (("a", "node", "u"), ("b", "node", "v"), ("a", "component", "cu"), ("b", "component", "cv"))]
    segs = segments(most_bits)

    def stars(nodes: DataFrame, at: int) -> DataFrame:
        """(u, v, cu, cv): of each node the nearest centre of another class, in one fingerprint's segments."""
        some = [*cols[:4], cols[at]] if at >= 4 else cols[:4]  # enough to tell a near centre
        nodes = nodes.select("node", *some, "component")
        rows = _dealt_rows(nodes, cols[at], segs)
        turn = F.lit(_signed((at + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))  # another least node each round
        least = F.min(F.struct(F.col("node").bitwiseXOR(turn).alias("turned"), "node", *some, "component")).alias("least")
        centres = rows.groupBy("part", "key").agg(least, F.count("*").alias("n")).filter("n > 1").select("part", "key", "least.*")
        on = F.expr(f"a.part = b.part and a.key = b.key and {apart(some)}")
        met = rows.alias("a").join(centres.alias("b").hint("merge"), on).select(*ends, F.expr(unlike(some)).alias("bits"))
        return met.groupBy("u").agg(F.min(F.struct("bits", "v", "cu", "cv")).alias("x")).select("u", "x.v", "x.cu", "x.cv")

    def pairs(nodes: DataFrame, columns: Sequence[int], slack: float = slack) -> DataFrame:
        """(u, v, cu, cv): pairs of nodes of different classes that meet in these fingerprints, and in none before."""
        parts = []
        for at in columns:
            rows = _dealt_rows(nodes, cols[at], segs)
            before = [(cols[c], lo, hi) for c in range(at) for lo, hi in segs]
            on = f"a.part = b.part and a.key = b.key and a.node < b.node and {apart(cols, slack)} and {_first_variant(cols[at], segs, before)}"
            parts.append(rows.alias("a").join(rows.alias("b").hint("merge"), F.expr(on)).select(*ends))
        return _all(parts)

    def joined(nodes: DataFrame, met: DataFrame) -> DataFrame:
        """nodes with the classes joined of those pairs whose shingle sets are alike."""
        alike = _alike(docs, prints, met, words, similarity, seeds[0], count)
        found = written(alike.select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "alike", 2 * n_nodes)
        release(spark)
        n_found = found.count()
        if not n_found:
            return nodes
        parts = connected_components(found, rows=n_found).select(F.col("node").alias("component"), F.col("component").alias("into"))
        out = written(nodes.join(parts, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into"), "nodes", n_nodes)
        drop(nodes)
        release(spark)
        return out

    for at in range(rounds):
        with _part_suffices(spark):
            near = written(stars(nodes, at), "stars", 8 * n_nodes)  # a node comes in 8 parts
        release(spark)
        nodes = joined(nodes, near)
    with _part_suffices(spark):
        near = written(pairs(nodes, [0], -1.0).repartition(files_of(n_nodes)), "near")
    release(spark)
    nodes = joined(nodes, near)
    met = []
    for at in range(0, indexed, 2):
        with _part_suffices(spark):
            met.append(written(pairs(nodes, range(at, min(at + 2, indexed))).repartition(files_of(n_nodes)), "met"))
        release(spark)
    nodes = joined(nodes, _all(met))
    named = prints.join(nodes.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named.select("doc_id", "th", "rows", "component"), "classes", count)
    least = named.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("least"))
    return named.join(least, "component").select("doc_id", "th", "rows", "component", F.col("least").eqNullSafe(F.struct("doc_id", "th")).alias("keeper"))


def _with_shared(whole: DataFrame) -> DataFrame:
    """Those nodes (node, sample, mask, need) of which enough shingles of the sample are in another node's sample."""
    seen = whole.select("node", "mask", F.explode("sample").alias("h"))
    shared = seen.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("h")
    often = seen.filter("h & mask = 0").select("node", "h").join(shared, "h", "left_semi").groupBy("node").agg(F.count("*").alias("often"))
    return whole.join(often, "node", "left").filter("coalesce(often, 0L) >= need and size(sample) > 0")


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _alike(docs: DataFrame, prints: DataFrame, pairs: DataFrame, words: int, similarity: float, seed: int, count: int, most_ids: int = 1_000_000, most_shingles: int = 8_000_000) -> DataFrame:
    """Those pairs (u, v, ...) whose shingle sets have the similarity or more; one text is read for each node.

    count: rows of docs. most_ids: nodes up to which their documents' ids are broadcast, so that texts are not
    shuffled. most_shingles: shingles of all these nodes up to which the sets are broadcast
    (8 bytes each); more are joined by their nodes, with the same result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.array(shingle_hashes(t, words, seed), np.uint64)).view(np.int64) for t in blobs(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    one = prints.join(needed, "node").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("one")).select("node", F.col("one.doc_id").alias("i"), F.col("one.th").alias("t"))
    one = written(one, "ones", count)
    n_ones = one.count()
    one = F.broadcast(one) if n_ones <= most_ids else one
    texts = docs.join(one, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("node", "text")
    sets = written(texts.mapInArrow(work, "node long, shingles array<long>").dropDuplicates(["node"]), "sets", 8 * n_ones)  # rows as wide as eight
    few = (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= most_shingles
    both = pairs
    for end, own in (("u", "x"), ("v", "y")):
        side = sets.select(F.col("node").alias(end), F.col("shingles").alias(own))
        both = both.join(F.broadcast(side) if few else side, end)
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select(*pairs.columns)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate class; how: as near_duplicates."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    classes = written(near_duplicates(docs, doc_id=doc_id, text=text, **how), "near")
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))
    kept = rows.join(classes.filter("not keeper").select("doc_id", "th"), same, "left_anti")
    again = classes.filter("keeper and rows > 1").select("doc_id", "th")
    if again.limit(1).count():  # repeated rows of one document: any one of them
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["i", "t"]))
    return kept.select("row.*")
