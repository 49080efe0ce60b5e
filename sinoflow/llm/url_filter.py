"""URL filtering by rules and by an empirical-Bayes reputation of hosts.

Pages that a rule decides are labelled outcomes. A host's share of good outcomes is shrunk towards its registered
domain's, that towards its suffix's, and that towards the whole table's, each through a beta prior whose strength
is estimated from the spread of the level below. Other pages pass if the lower posterior bound of their host
reaches a threshold. Only DataFrame operations run on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinoflow.llm import common

#: verdict, host, path; fixed by the contract of the query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
Z, THRESHOLD = 1.0, 0.5
#: Bounds of the estimated prior strength, and the prior of the whole table before any outcome.
STRENGTH = (1.0, 100.0)
GOOD0, BAD0 = 1.0, 1.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    has = F.coalesce(at > 0, F.lit(False))
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    fits = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        here = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fits = F.when(here, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _shrunk(level: DataFrame, key: str, parent: DataFrame, parent_key: str | None) -> DataFrame:
    """Posterior good and bad counts of each ``key``: outcomes plus a prior with the parent's mean.

    The strength of the prior is the method-of-moments estimate over the keys of one parent: within it,
    wide spread of the shares means a weak prior.
    """
    n = F.col("good") + F.col("bad")
    group = [parent_key] if parent_key else []
    spread = level.filter(n > 0).groupBy(*group).agg(
        F.sum("good").alias("g"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(n * F.pow(F.col("good") / n, 2)).alias("s2")
    )
    p, k = F.col("g") / F.col("n"), F.col("k")
    within = F.col("s2") - F.col("n") * p * p  # weighted sum of squares of the shares about their mean
    rate = F.when((k > 1) & (F.col("n") > k) & (p > 0) & (p < 1), (within / (p * (1 - p)) - (k - 1)) / (F.col("n") - k))
    strength = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.when(rate > 0, 1 / rate - 1).otherwise(STRENGTH[1])))
    spread = spread.select(*group, F.coalesce(strength, F.lit(STRENGTH[1])).alias("strength"))
    joined = level.join(parent, parent_key, "left") if parent_key else level.crossJoin(F.broadcast(parent))  # one parent row
    joined = joined.join(spread, parent_key, "left") if parent_key else joined.crossJoin(F.broadcast(spread))
    weight = F.coalesce("strength", F.lit(STRENGTH[1]))
    mean = F.col("up_a") / (F.col("up_a") + F.col("up_b"))
    keep = [c for c in level.columns if c not in ("good", "bad")]
    return joined.select(*keep, (F.col("good") + weight * mean).alias("a"), (F.col("bad") + weight * (1 - mean)).alias("b"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """Per host: posterior mean and lower bound of its share of good outcomes.

    ``outcomes`` has host and good (true, false, or null for a page without outcome, which still names its host).
    """
    good = F.col("good").cast("boolean")
    hosts = outcomes.groupBy("host").agg(
        F.count(F.when(good, 1)).cast("double").alias("good"), F.count(F.when(~good, 1)).cast("double").alias("bad")
    )
    hosts = common.materialize(hosts, "url-hosts")  # a row a host, which the levels above read again
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    total = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    world = suffixes.agg((F.coalesce(F.sum("good"), F.lit(0.0)) + GOOD0).alias("up_a"), (F.coalesce(F.sum("bad"), F.lit(0.0)) + BAD0).alias("up_b"))
    up = lambda df, key: df.select(key, F.col("a").alias("up_a"), F.col("b").alias("up_b"))
    of_suffix = up(_shrunk(suffixes, "suffix", world, None), "suffix")
    of_domain = up(_shrunk(domains, "domain", of_suffix, "suffix"), "domain")
    host = _shrunk(hosts, "host", of_domain, "domain")
    a, b = F.col("a"), F.col("b")
    mean = a / (a + b)
    return host.select("host", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"))


def verdict_table(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict; beside them the host's posterior mean and bound.

    A null url or one without ``://`` has empty host and path; it is judged like any host without outcomes.
    Repeated rows stay separate rows. Without any outcome the prior decides. An empty table gives an empty table.
    """
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    known = reputations(rows.select("host", (F.col("fit.verdict") == "allow").alias("good")))
    # one row per host on the right; a host with many pages is split by adaptive skew handling on the left
    return rows.join(known, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("bound") >= threshold, "allow").otherwise("block")).alias("verdict"),
        F.round("mean", 9).alias("host_mean"),
        F.round("bound", 9).alias("host_bound"),
    )
