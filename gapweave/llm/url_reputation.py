"""URL filters: rules first, else the host's reputation by empirical Bayes.

Labelled page outcomes are summed by host, registered domain and suffix. The suffix's
rate is shrunk towards the overall rate, the domain's towards its suffix's posterior
mean, the host's towards its domain's; each level's prior strength comes from that
level's spread. A page is blocked if the lower posterior bound of its host's bad rate
is above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: fixed values: suffixes of two labels under which names are registered
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
BAD_RATE, Z = 0.5, 1.645
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for a url without ://."""
    ok = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(ok, host).otherwise(""), F.when(ok, path).otherwise("")


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none; ties go to the first in text order.

    A rule is a host, then a path from its first slash on. For lists of some hundreds.
    """
    fits = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        one = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        out = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(one, out) if fits is None else fits.when(one, out)
    return fits


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; its port does not count."""
    labels = F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    long = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(long, two).otherwise(F.element_at(labels, -1))
    n = F.when(long, 3).otherwise(2)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."), suffix


def _shrunk(units: DataFrame, mean: Column) -> DataFrame:
    """units (n, bad, ...) with post and strength: rates shrunk towards mean, the parent's posterior."""
    units = written(units.withColumn("mu", F.least(F.greatest(mean, F.lit(1e-6)), F.lit(1 - 1e-6))), "units")
    p = F.col("bad") / F.col("n")
    up, down = units.filter("n > 0").agg(F.sum(F.col("n") * (p - F.col("mu")) * (p - F.col("mu")) / (F.col("mu") * (1 - F.col("mu"))) - 1), F.sum(F.col("n") - 1)).first()
    s = 1 / min(max(up / down, 1 / 1001), 1 / 3) - 1 if down else 2.0
    return units.withColumns({"a": F.col("bad") + F.lit(s) * F.col("mu"), "b": F.col("n") - F.col("bad") + F.lit(s) * (1 - F.col("mu"))}).withColumn("post", F.col("a") / (F.col("a") + F.col("b")))


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad) of every host, labelled or not, to (host, post, low): mean and lower bound of its bad rate."""
    domain, suffix = domain_parts(F.col("host"))
    hosts = outcomes.withColumns({"domain": domain, "suffix": suffix})
    total = hosts.agg(F.sum("n"), F.sum("bad")).first()
    m = float((total[1] or 0) / total[0]) if total[0] else 0.0
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*sums), F.lit(m)).select("suffix", F.col("post").alias("up"))
    domains = _shrunk(hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix"), F.col("up")).select("domain", F.col("post").alias("up"))
    found = _shrunk(hosts.join(domains, "domain"), F.col("up"))
    low = F.col("post") - F.lit(z) * F.sqrt(F.col("post") * (1 - F.col("post")) / (F.col("a") + F.col("b") + 1))
    return found.select("host", "n", "bad", "post", low.alias("low"))


def judged_pages(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, rate: float = BAD_RATE, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate (posterior mean), bad_low of every row of pages.

    A page's outcome is that of the document its url names: the number that ends the
    path, looked up in labels (doc_id, quality, toxic); bad is quality 0 or toxic 1, nulls
    count as neither. Null and odd urls have the empty host, a host like any other.
    """
    host, path = url_parts(F.col("url"))
    number = F.nullif(F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1), F.lit("")).try_cast("bigint")
    seen = written(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("doc", number), "pages")
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("is_bad"))
    # distinct documents of a host count once each time a page names them
    named = seen.groupBy("host", "doc").agg(F.count("*").alias("k")).join(known, "doc", "left")
    outcomes = named.groupBy("host").agg(F.sum(F.when(F.col("is_bad").isNotNull(), F.col("k")).otherwise(0)).cast("double").alias("n"), F.sum(F.col("k") * F.coalesce("is_bad", F.lit(0))).cast("double").alias("bad"))
    fame = host_reputation(written(outcomes, "outcomes"), z).select("host", "post", "low")
    fit = matched_rule(F.col("host"), F.col("path"), rules)
    out = seen.withColumn("fit", fit if fit is not None else F.lit(None).cast("struct<rule: string, verdict: string>")).join(fame, "host", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("low") > rate, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("post").alias("bad_rate"), F.col("low").alias("bad_low"))


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM p),
s AS (SELECT *, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.[a-z]+)?/?$', 1), '') AS BIGINT) AS doc FROM u),
l AS (SELECT doc_id AS doc, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS is_bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
o AS (SELECT host, count(is_bad)::DOUBLE AS n, coalesce(sum(is_bad), 0)::DOUBLE AS bad FROM s LEFT JOIN l USING (doc) GROUP BY host),
h AS (SELECT *, string_split(host, '.') AS x FROM o),
d AS (SELECT host, n, bad, array_to_string(x[greatest(len(x) - 1, 1):len(x)], '.') AS domain, x[len(x)] AS suffix FROM h),
m AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS m FROM d),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, least(greatest(any_value(m), 1e-6), 1 - 1e-6) AS mu FROM d, m GROUP BY suffix),
k1 AS (SELECT CASE WHEN sum(n - 1) <> 0 THEN 1 / least(greatest(sum(n * (bad / n - mu) * (bad / n - mu) / (mu * (1 - mu)) - 1) / sum(n - 1), 1 / 1001::DOUBLE), 1 / 3::DOUBLE) - 1 ELSE 2 END AS s FROM s1 WHERE n > 0),
s2 AS (SELECT suffix, (bad + s * mu) / (n + s) AS up FROM s1, k1),
d1 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, least(greatest(any_value(up), 1e-6), 1 - 1e-6) AS mu FROM d JOIN s2 USING (suffix) GROUP BY domain),
k2 AS (SELECT CASE WHEN sum(n - 1) <> 0 THEN 1 / least(greatest(sum(n * (bad / n - mu) * (bad / n - mu) / (mu * (1 - mu)) - 1) / sum(n - 1), 1 / 1001::DOUBLE), 1 / 3::DOUBLE) - 1 ELSE 2 END AS s FROM d1 WHERE n > 0),
d2 AS (SELECT domain, (bad + s * mu) / (n + s) AS up FROM d1, k2),
h1 AS (SELECT host, n, bad, least(greatest(up, 1e-6), 1 - 1e-6) AS mu FROM d JOIN d2 USING (domain)),
k3 AS (SELECT CASE WHEN sum(n - 1) <> 0 THEN 1 / least(greatest(sum(n * (bad / n - mu) * (bad / n - mu) / (mu * (1 - mu)) - 1) / sum(n - 1), 1 / 1001::DOUBLE), 1 / 3::DOUBLE) - 1 ELSE 2 END AS s FROM h1 WHERE n > 0),
h2 AS (SELECT host, (bad + s * mu) / (n + s) AS post, n + s AS ab FROM h1, k3),
r AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN post - 1.645::DOUBLE * sqrt(post * (1 - post) / (ab + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN h2 USING (host)
"""
