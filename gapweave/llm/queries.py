"""The queries opN_<name>: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, mixing, quality_rules, sharding, simhash, suffix_dedup, token_attribution, token_files, toxicity, url_reputation
from .scratch import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 bits or fewer, and their components."""
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), words=4, seed=42, most_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id", "class_size")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's 5-word shingles."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), words=5, containment=0.8)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 400-byte strings that begin elsewhere too."""
    found = suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "n_passage_words")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve shards laid out by source become sixteen of nearly equal bytes; rows as read from the files."""
    docs, folder = _table(spark, sf_dir, "documents"), new_path(spark, "shards")
    data, old = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), sharding.layout_by("source", 12)
    size, crc = (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    sharding.lay_out(docs, folder, old)
    sharding.reshard_files(spark, folder, docs.schema, 16, size, [F.col("doc_id"), crc])
    done = sharding.laid_out(spark, folder, docs.schema)
    return done.select("doc_id", size, crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), old.alias("old_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and the verdict with the host's (source's) failure rate."""
    found = quality_rules.judged(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    import public_tokenizers

    return token_attribution.section_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, written, indexed, looked up and read back."""
    import public_tokenizers

    docs, folder = _table(spark, sf_dir, "documents"), new_path(spark, "tokens")
    made = token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    keys = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    keys = keys.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("occurrence"))
    found = token_files.read_back(token_files.look_up(keys, folder), folder)
    return found.join(token_files.shard_starts(made), "shard").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("count").alias("n_tokens"), "ids_crc32", "shard"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, repeating; targets share 150 % of all words, none above twice its source."""
    found = mixing.mixed_documents(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2, seed=42)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, else the host's reputation."""
    found = url_reputation.judged_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash_neardup": op2_simhash_neardup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sharding": op4_sharding,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_attribution": op6_token_attribution,
    "op7_token_files": op7_token_files,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_url_reputation": op10_url_reputation,
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": quality_rules.ORACLE,
    "op10_url_reputation": url_reputation.ORACLE,
}
