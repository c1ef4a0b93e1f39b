"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's docs. Stages keep nulls, repeated rows and further
columns as their operators say; all but the last return the columns they were given. A stage's
result is to be written before the next stage begins. The last adds shard, slot and
old_shard; columns of these names in its input are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import decontamination, mixing, quality_rules, scratch, sharding, simhash
from gapweave.llm.scratch import numbered, tune, written

_LAST: list[str] = []


def stage(f: Callable) -> Callable:
    """A stage begins when the one before is written, so its scratch tables go then."""

    @wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _LAST:
            scratch.remove(spark, path)
        scratch.release(spark)
        before = len(scratch.MADE)
        out = f(spark, docs, sf_dir)
        _LAST[:] = scratch.MADE[before:]
        return out

    return begun


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that neither the base rules nor their source's failure rate reject."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", "text")
    return quality_rules.judged(rows, ["row"]).filter("kept").select("row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates (five-word shingles, similarity about 0.8 or more)."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item to 0.8 of its five-word shingles or more."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=5, containment=0.8)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them: not at all, once or twice."""
    rows = numbered(docs, "unmixed")
    plan = mixing.mixed_documents(rows.select("row.doc_id", "row.source", "row.text", "id"), weights=(5, 2, 1), share=1.5, most=2, seed=42, keys=("doc_id", "id"))
    taken = rows.join(plan.filter("times > 0").select("id", "times"), "id")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


@stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard (0 to 15, bytes nearly equal), slot, and the shard of the layout by source before."""
    rows = numbered(docs, "unsharded")
    data = F.encode(F.coalesce("row.text", F.lit("")), "UTF-8")
    sizes = rows.select("id", F.col("row.doc_id").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("crc"), sharding.layout_by("row.source", 12).alias("old_shard"))
    plan = sharding.reshard(sizes, 16, ["doc_id", "crc", "id"]).select("id", "shard", "slot", "old_shard")
    own = [c for c in docs.columns if c not in ("shard", "slot", "old_shard")]
    return rows.join(plan, "id").select(*(F.col("row").getField(c).alias(c) for c in own), "shard", "slot", "old_shard")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: fingerprints, MinHash and the knapsack have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = written(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
