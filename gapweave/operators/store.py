"""Feature store: a Parquet table by subject with a contract that must match.

features: subject, session, segment_id, start_frame, end_frame, values (array<double>).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .segments import SEGMENT


def contract(feature_keys: list[list[str]], source_contract: str, interval: float | None, dtype: str = "float64") -> dict:
    return {"feature_keys": [list(k) for k in feature_keys], "source_contract": source_contract, "sample_interval_seconds": interval, "dtype": dtype}


def contract_fingerprint(c: dict) -> str:
    return hashlib.sha256(json.dumps(c, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def create(features: DataFrame, path: str, c: dict) -> None:
    """Write a new store; a path that exists is an error."""
    spark = features.sparkSession
    spark.createDataFrame([(json.dumps(c),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/contract")
    _write(features, path, c)


def _write(features: DataFrame, path: str, c: dict) -> None:
    if features.filter(F.size("values") != len(c["feature_keys"])).limit(1).count():
        raise ValueError("rows are not as wide as the contract's keys")
    values = F.col("values").cast("array<float>" if c["dtype"] == "float32" else "array<double>")
    rows = features.withColumn("values", values)
    rows.repartition("subject").sortWithinPartitions(*SEGMENT, "start_frame").write.mode("append").partitionBy("subject").parquet(f"{path}/rows")


def open_contract(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/contract").first()[0])


def require(found: dict, wanted: dict) -> None:
    a, b = found["sample_interval_seconds"], wanted["sample_interval_seconds"]
    same = a is b or (a is not None and b is not None and abs(a - b) <= 1e-9)
    if found["feature_keys"] != wanted["feature_keys"] or found["source_contract"] != wanted["source_contract"] or not same:
        raise ValueError("the contracts differ")


def read(spark: SparkSession, path: str, subjects: list[str] | None = None) -> DataFrame:
    """Rows of the subjects named: partitions of others are not read."""
    rows = spark.read.schema("session string, segment_id long, start_frame long, end_frame long, values array<double>, subject string").parquet(f"{path}/rows")
    return rows.filter(F.col("subject").isin(subjects)) if subjects is not None else rows


def append(features: DataFrame, path: str, c: dict) -> None:
    """Add sequences; an identity that is there, or a different contract, is an error and leaves the store as it was."""
    spark = features.sparkSession
    require(open_contract(spark, path), c)
    if features.select(*SEGMENT).distinct().join(read(spark, path).select(*SEGMENT).distinct(), SEGMENT, "left_semi").limit(1).count():
        raise ValueError("a sequence is there already")
    _write(features, path, c)


def means(rows: DataFrame) -> DataFrame:
    """Mean of each feature of each run, over samples of all its segments."""
    flat = rows.select("subject", "session", F.posexplode("values").alias("feature_idx", "value"))
    return flat.groupBy("subject", "session", "feature_idx").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def data_fingerprint(rows: DataFrame, c: dict) -> str:
    """SHA-256 over the contract and a digest of each sequence, in identity order; row order and files do not count."""
    row = F.struct("start_frame", "end_frame", "values")
    digest = F.sha2(F.to_json(F.sort_array(F.collect_list(row))), 256)
    each = rows.groupBy(*SEGMENT).agg(digest.alias("d")).select(F.sha2(F.to_json(F.struct(*SEGMENT, "d")), 256).alias("d"))
    total = each.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("d"))), 256)).first()[0]
    return hashlib.sha256((contract_fingerprint(c) + total).encode()).hexdigest()
