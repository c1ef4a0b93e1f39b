"""Paired inference over endpoint rows (subject, session, endpoint, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(endpoint, subject, diff) of subjects with both conditions; two rows of one subject and condition are an error."""
    if rows.groupBy("subject", "session", "endpoint").count().filter("count > 1").limit(1).count():
        raise ValueError("more than one run of a subject and condition")
    ok = rows.filter(F.col("value").isNotNull() & F.col("session").isin(a, b))
    both = ok.groupBy("endpoint", "subject").agg(F.max(F.when(F.col("session") == a, F.col("value"))).alias("va"), F.max(F.when(F.col("session") == b, F.col("value"))).alias("vb"))
    return both.filter("va is not null and vb is not null").select("endpoint", "subject", (F.col("va") - F.col("vb")).alias("diff"))


def sign_flip_exact(diffs: DataFrame, most: int = 20) -> DataFrame:
    """(endpoint, n, estimate, p): two-sided exact sign flip of the mean, all 2^n patterns.

    Differences of an endpoint are one array of at most `most` entries; a flip is a bit pattern.
    """
    rows = diffs.groupBy("endpoint").agg(F.sort_array(F.collect_list(F.struct("subject", "diff"))).alias("s"))
    rows = rows.select("endpoint", F.transform("s", lambda e: e["diff"]).alias("d")).withColumn("n", F.size("d"))
    if rows.filter(F.col("n") > most).limit(1).count():
        raise ValueError(f"more than {most} subjects: use the Monte Carlo form")
    flips = rows.withColumn("code", F.explode(F.expr("sequence(0L, shiftleft(1L, n) - 1)")))
    total = F.expr("aggregate(sequence(0, n - 1), 0D, (a, i) -> a + d[i] * (case when shiftright(code, i) & 1 = 1 then -1D else 1D end))")
    observed = F.expr("aggregate(d, 0D, (a, x) -> a + x)")
    flips = flips.select("endpoint", "n", observed.alias("o"), total.alias("t"))
    return flips.groupBy("endpoint", "n").agg((F.max("o") / F.col("n")).alias("estimate"), F.avg((F.abs("t") >= F.abs("o") - 1e-9).cast("double")).alias("p"))


def bh(rows: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """rows with q: Benjamini-Hochberg within each family; a null p keeps a null q and is not counted."""
    tested = rows.filter(F.col(p).isNotNull())
    line = Window.partitionBy(*family).orderBy(p)
    m, rank = F.count("*").over(Window.partitionBy(*family)), F.row_number().over(line)
    tested = tested.withColumns({"_r": rank, "_a": F.least(F.lit(1.0), F.col(p) * m / rank)})
    # of equal p values the last rank has the least adjusted value, which the minimum carries to all
    q = F.min("_a").over(Window.partitionBy(*family).orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    return tested.withColumn("q", q).drop("_r", "_a").unionByName(rows.filter(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def result_families(records: DataFrame, alpha: float = 0.05) -> DataFrame:
    """records (result_id, fdr_family, p) with q and result_status."""
    status = F.when(F.col("q").isNull(), "not_testable").when(F.col("q") < alpha, "positive").otherwise("negative")
    return bh(records, ["fdr_family"]).withColumn("result_status", status)


def intercept_t(diffs: DataFrame, key: str = "endpoint") -> DataFrame:
    """(key, n, mean, t): t is null for one difference; of equal ones it is infinite with the mean's sign, and NaN if all are 0."""
    n, mean = F.count("*"), F.avg("diff")
    se = F.stddev_samp("diff") / F.sqrt(n)
    t = F.when(se == 0, mean * F.lit(float("inf"))).otherwise(mean / se)
    return diffs.groupBy(key).agg(n.alias("n"), mean.alias("mean"), t.alias("t"))


def hc3_simple(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x with HC3 standard errors, by sums: one regressor.

    Residuals and leverages need the fitted line, so rows are read twice: sums, then sandwich.
    """
    own = Window.partitionBy(*keys)
    n, mx, my = F.count("*").over(own), F.avg(x).over(own), F.avg(y).over(own)
    r = rows.withColumns({"n": n, "cx": F.col(x) - mx, "cy": F.col(y) - my, "mx": mx, "my": my})
    r = r.withColumns({"sxx": F.sum(F.col("cx") * F.col("cx")).over(own), "sxy": F.sum(F.col("cx") * F.col("cy")).over(own)})
    r = r.withColumn("slope", F.col("sxy") / F.col("sxx"))
    u = (F.col("cy") - F.col("slope") * F.col("cx")) / (1 - 1 / F.col("n") - F.col("cx") * F.col("cx") / F.col("sxx"))
    r = r.withColumn("u2", u * u)
    return r.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("slope").alias("slope"), (F.max("my") - F.max("slope") * F.max("mx")).alias("intercept"), (F.sqrt(F.sum(F.col("u2") * F.col("cx") * F.col("cx"))) / F.max("sxx")).alias("slope_se")
    )


def components(edges: DataFrame, n_nodes: int) -> DataFrame:
    """(node, component) of edges (i, j): least node, by repeated minima over neighbours; graphs are small (n_nodes is the bound of rounds)."""
    both = edges.select(F.col("i").alias("node"), F.col("j").alias("other")).unionByName(edges.select(F.col("j").alias("node"), F.col("i").alias("other"))).distinct()
    label = both.select("node").distinct().withColumn("component", F.col("node"))
    rounds = 1
    while rounds < n_nodes:
        near = both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("m"))
        label = label.join(near, "node").select("node", F.least("component", "m").alias("component"))
        rounds += 1
    return label
