"""Written tables in the shared folder: the way these operators cut lineage.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset
(tests, a laptop) a temporary folder of this machine is taken.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a file, and of the task that writes it, where the number of rows is known beforehand
ROWS_A_FILE = 25_000

_OWN: dict[str, str] = {}
#: paths of the tables that written() has made
MADE: list[str] = []


def tune(spark: SparkSession) -> None:
    """Arrow batches of long texts stay small, long conditions compiled; the workers can import this package."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > 8000:  # the JVM does not compile larger methods
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found:
        if app not in _OWN:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="gapweave-")
        found = _OWN[app]
    if "://" not in found and not found.startswith("file:"):
        found = "file://" + os.path.abspath(found)
    return f"{found.rstrip('/')}/gapweave-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def files_of(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_FILE))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    rows: about what the last stage of df reads, if that is known; the table then has no more
    than files_of(rows) files, so small ones cost few, and a task still a bounded number of rows.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(files_of(rows))
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gapweave_path = path
    MADE.append(path)
    return out


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(row, struct of all columns; id, a long of its own for each row), written, so that ids stay."""
    return written(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("id")), name)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more, before its own next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame | None) -> None:
    """Delete the files of a written() table that nothing reads any more."""
    path = getattr(df, "_gapweave_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI; file:/x counts as file:///x."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)
