"""Acquisitions in tab-separated files: strict discovery and loading.

An acquisition is a folder and a stem; of each atlas it has one table of time series
(`<stem>_space-S_atlas-A_stat-mean_timeseries.tsv`) and one of coverage
(`..._stat-coverage_bold.tsv`), and it has one `<stem>..._outliers.tsv`. Files are read
whole by the executors, each parsed where it lies; order in a file is the frame order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values
MISSING = {"", "n/a", "na", "nan"}
TRUTH = {"false": False, "true": True, "0": False, "1": True, "no": False, "yes": True}


def manifest(spark: SparkSession, root: str, atlases: list[str]) -> DataFrame:
    """(folder, stem, subject, session, kind, atlas, path, content) of the files of the atlases named.

    A second file of one kind and atlas, or an acquisition without one, is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tsv").load(root).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith("_stat-mean_timeseries.tsv"), "timeseries").when(name.endswith("_stat-coverage_bold.tsv"), "coverage").when(name.endswith("_outliers.tsv"), "outliers")
    rows = files.select("path", "content", name.alias("name"), kind.alias("kind"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).filter("kind is not null")
    rows = rows.withColumns({"atlas": F.regexp_extract("name", r"_atlas-([^_]+)", 1), "stem": F.regexp_replace("name", r"(_space-|_atlas-|_outliers\.tsv$).*", ""), "subject": F.regexp_extract("name", r"(sub-[^_]+)", 1), "session": F.regexp_extract("name", r"(ses-[^_]+)", 1)})
    rows = rows.filter((F.col("kind") == "outliers") | F.col("atlas").isin(atlases))
    counts = rows.groupBy("folder", "stem", "kind", F.when(F.col("kind") != "outliers", F.col("atlas")).alias("a")).count()
    if counts.filter("count > 1").limit(1).count():
        raise ValueError("an acquisition has two files of one kind")
    whole = counts.groupBy("folder", "stem").agg(F.sum("count").alias("n"))
    if whole.filter(F.col("n") != 2 * len(atlases) + 1).limit(1).count():
        raise ValueError("an acquisition lacks a file")
    return rows


def cells(content: bytes, path: str) -> list[list[str]]:
    """Header and rows of a strict table: names unique and not empty, all rows as wide."""
    lines = content.decode("utf-8-sig").splitlines()
    table = [line.split("\t") for line in lines if line]
    if not table or len(set(table[0])) < len(table[0]) or "" in table[0] or any(len(r) != len(table[0]) for r in table):
        raise ValueError(f"not a strict table: {path}")
    return table


def number(text: str) -> float:
    return float("nan") if text.strip().lower() in MISSING else float(text)


def load(spark: SparkSession, root: str, atlases: list[str], minimum_coverage: float | None = None, roi_names: list[str] | None = None) -> DataFrame:
    """Panel (subject, session, acquisition_id, frame, roi_idx, roi, x) of retained frames.

    A table has either all frames, of which those that the mask leaves are taken, or the
    retained ones only. Channels are in the order of atlases, then of the table, or those of
    roi_names in that order. A channel taken whose coverage is below the minimum, or a name
    that an acquisition has not exactly once, is an error.
    """
    rank = {a: k for k, a in enumerate(atlases)}

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                table = cells(r.content, r.path)
                if r.kind == "outliers" and len(table[0]) != 1:
                    raise ValueError(f"a mask has one column: {r.path}")
                names = table[0]
                for k, row in enumerate(table[1:]):
                    if r.kind == "outliers":
                        value = TRUTH[row[0].strip().lower()]
                        out.append((r.folder, r.stem, r.subject, r.session, r.kind, -1, k, 0, "outlier", float(value)))
                    elif r.kind == "coverage":
                        c = number(row[names.index("coverage")])
                        if not 0 <= c <= 1:
                            raise ValueError(f"a coverage outside 0 to 1: {r.path}")
                        out.append((r.folder, r.stem, r.subject, r.session, r.kind, rank[r.atlas], k, 0, row[names.index("Node")], c))
                    else:
                        out += [(r.folder, r.stem, r.subject, r.session, r.kind, rank[r.atlas], k, i, n, number(x)) for i, (n, x) in enumerate(zip(names, row))]
            yield pd.DataFrame(out, columns=["folder", "stem", "subject", "session", "kind", "atlas", "row", "col", "roi", "x"])

    schema = "folder string, stem string, subject string, session string, kind string, atlas int, row long, col int, roi string, x double"
    rows = manifest(spark, root, atlases).mapInPandas(parse, schema)
    key = ["folder", "stem"]
    from pyspark.sql import Window

    mask = rows.filter("kind = 'outliers'").select(*key, F.col("row").alias("frame"), (F.col("x") > 0).alias("outlier"))
    mask = mask.withColumns({"place": F.sum((~F.col("outlier")).cast("long")).over(Window.partitionBy(*key).orderBy("frame")) - 1, "total": F.count("*").over(Window.partitionBy(*key))})
    series = rows.filter("kind = 'timeseries'").withColumn("n", F.max("row").over(Window.partitionBy(*key, "atlas")) + 1)
    kept = mask.filter("not outlier")
    retained = kept.groupBy(*key).agg(F.count("*").alias("kept"), F.max("total").alias("total"))
    if series.join(retained, key).filter("n <> total and n <> kept").limit(1).count():
        raise ValueError("a table has neither all frames nor the retained ones")
    on = [F.col(f"s.{k}") == F.col(f"m.{k}") for k in key] + [F.col("s.row") == F.when(F.col("s.n") == F.col("m.total"), F.col("m.frame")).otherwise(F.col("m.place"))]
    panel = series.alias("s").join(kept.alias("m"), on).select("s.*", "m.frame")
    if roi_names is not None:
        if len(set(roi_names)) < len(roi_names):
            raise ValueError("a channel is named twice")
        wanted = spark.createDataFrame([(r, i) for i, r in enumerate(roi_names)], "roi string, place int")
        once = series.select(*key, "atlas", "roi").distinct().join(wanted, "roi").groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("roi").alias("d"))
        if series.select(*key).distinct().join(once.filter(F.lit(len(roi_names)) == F.col("n")).filter("n = d"), key, "left_anti").limit(1).count():
            raise ValueError("an acquisition has a named channel not at all or more than once")
        panel = panel.join(wanted, "roi")
    if minimum_coverage is not None:
        low = rows.filter("kind = 'coverage'").filter(F.col("x") < minimum_coverage).select(*key, "atlas", "roi")
        found = series.select(*key, "atlas", "roi").distinct() if roi_names is None else series.select(*key, "atlas", "roi").distinct().join(wanted.select("roi"), "roi")
        worst = found.join(low, [*key, "atlas", "roi"]).orderBy(*key, "atlas", "roi").limit(1).collect()
        if worst:
            raise ValueError(f"coverage below {minimum_coverage}: {worst[0]['roi']} of {atlases[worst[0]['atlas']]}")
    if roi_names is not None:
        return panel.select("subject", "session", F.col("stem").alias("acquisition_id"), "frame", F.col("place").alias("roi_idx"), "roi", "x")
    order = F.dense_rank().over(Window.partitionBy(*key).orderBy("atlas", "col")) - 1
    panel = panel.withColumn("order", order)
    return panel.select("subject", "session", F.col("stem").alias("acquisition_id"), "frame", F.col("order").cast("int").alias("roi_idx"), "roi", "x")
