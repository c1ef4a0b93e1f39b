"""Quality rules with host verdicts, in DataFrame functions only.

Each document has counts and a base verdict. Failures are summed by host, a host's
failure rate is shrunk with a beta prior fitted to all hosts by moments, and the
documents of a host whose rate is above a limit with some confidence are rejected too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: fixed values
WHITE = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 20, 30
#: a host is rejected if the lower posterior bound of its failure rate is above this
HOST_RATE, HOST_Z = 0.5, 1.645


def _paired(column: str, gap: int) -> Column:
    """Hashes of each entry with the one gap places on."""
    n = F.greatest(F.size(column) - F.lit(gap), F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text counts as empty: no words, so base_failed. Windows of 8 words are compared
    by 64-bit hashes, built from word hashes in three pairings (2, 4, 8 words).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(SOLID))
    df = docs.withColumns({
        "_w": F.filter(F.split(t, WHITE), lambda x: x != ""),
        "_lines": lines,
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
    })
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.transform("_w", lambda x: F.xxhash64(x)),
    }).drop("_w", "_lines")
    df = df.withColumn("_h", _paired("_h", 1))
    df = df.withColumn("_h", _paired("_h", 2))
    df = df.withColumn("_h", _paired("_h", 4))
    # only texts with a window found twice are sorted
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    empty = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty)).drop("_h")
    at = lambda i: F.get(F.col("_s"), i)["h"]
    same = F.filter("_s", lambda x, i: F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(same, lambda x: x["i"]))).drop("_s")
    steps = F.transform("_p", lambda x, i: F.least(F.lit(8), F.coalesce(F.get(F.col("_p"), i + 1) - x, F.lit(8))))
    df = df.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_p")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_verdicts(counts: DataFrame, rate: float = HOST_RATE, z: float = HOST_Z) -> DataFrame:
    """(host, n, failed) with posterior_rate, posterior_low and host_failed.

    The prior's mean is the overall failure rate m. Its strength s comes from the hosts'
    spread: rho = sum(n (p - m)^2 / (m (1 - m)) - 1) / sum(n - 1), s = 1 / rho - 1, with rho
    held between 1/1001 and 1/3.
    """
    total = counts.agg(F.sum("n"), F.sum("failed")).first()
    m = (total[1] or 0) / total[0] if total[0] else 0.0
    rho = 1 / 3
    if 0 < m < 1:
        p = F.col("failed") / F.col("n")
        up, down = counts.agg(F.sum(F.col("n") * (p - m) * (p - m) / (m * (1 - m)) - 1), F.sum(F.col("n") - 1)).first()
        rho = min(max(up / down, 1 / 1001), 1 / 3) if down else 1 / 3
    s = 1 / rho - 1
    a, b = F.col("failed") + F.lit(m * s), F.col("n") - F.col("failed") + F.lit((1 - m) * s)
    mean = a / (a + b)
    low = mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return counts.withColumns({"posterior_rate": mean, "posterior_low": low}).withColumn("host_failed", F.col("posterior_low") > rate)


def judged(docs: DataFrame, keys: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """keys, the counts of base_rules, base_failed, kept, posterior_rate: one row for each row of docs.

    A null host is a host of its own. Texts are read once; what follows runs over a
    written table of counts.
    """
    base = written(base_rules(docs.select(*keys, F.col(host).alias("_host"), F.col(text).alias("_text")), "_text").drop("_text"), "base")
    counts = base.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = host_verdicts(written(counts, "hosts")).select(F.col("_host").alias("_of"), "posterior_rate", "host_failed")
    out = base.join(hosts, F.col("_host").eqNullSafe(F.col("_of")), "left").drop("_of", "_host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("host_failed")


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM f GROUP BY source),
m AS (SELECT sum(failed) / sum(n) AS m FROM h),
q AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND (SELECT sum(n - 1) FROM h) > 0 THEN least(greatest((SELECT sum(n * (failed / n - m) * (failed / n - m) / (m * (1 - m)) - 1) / sum(n - 1) FROM h), 1.0::DOUBLE / 1001), 1.0::DOUBLE / 3) ELSE 1.0::DOUBLE / 3 END AS rho FROM m),
v AS (SELECT source, (failed + m * (1 / rho - 1)) AS a, (n - failed + (1 - m) * (1 / rho - 1)) AS bb FROM h, q),
k AS (SELECT source, a / (a + bb) - 1.645::DOUBLE * sqrt(a / (a + bb) * (1 - a / (a + bb)) / (a + bb + 1)) > 0.5 AS bad FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT k.bad) AS kept
FROM f JOIN k ON f.source IS NOT DISTINCT FROM k.source
"""
