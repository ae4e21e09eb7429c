"""URL filter: host and path rules first, then an empirical-Bayes host reputation. DataFrame functions only.

Defined results for odd rows: a null url or one without ``://`` has an empty host and path; its reputation is that of
the empty host. Pages without an outcome only inherit. Repeated rows count as often as they occur. An empty table gives no
rows. Urls are split whole, however long. Extra columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import cut, join_hot

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; rules are configuration, tried from the longest."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.pattern)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _concentration(level: DataFrame, rate: Column) -> Column:
    """Moment estimate of the beta-binomial strength of the groups of one level around their parent's rate, 1 to 1000."""
    n, p = F.col("n").cast("double"), F.col("good") / F.col("n")
    size, groups = F.sum("n").cast("double"), F.count(F.lit(1))
    between = (F.sum(n * (p - rate) * (p - rate)) - (groups - 1) * rate * (1 - rate)) / (size - F.sum(n * n) / size)
    share = between / (rate * (1 - rate))
    k = F.when((groups < 2) | (share <= 0.001) | share.isNull() | F.isnan(share), 1000.0).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), (1 - share) / share)))
    return F.floor(k + 0.5).cast("double")


def host_reputation(pages: DataFrame, z: float = 1.645) -> DataFrame:
    """One row a host: counts, posterior mean, its lower bound, and rows (of pages).

    pages: host and good (1, 0 or null). A suffix is shrunk towards the overall rate, a registered domain (the last two
    labels) towards its suffix, a host towards its domain; the strengths come from the spread of each level.
    """
    hosts = cut(
        pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"), F.count(F.lit(1)).alias("rows"))
        .withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)), "hosts",
    )
    seen = hosts.filter("n > 0")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    # Four scalars, whatever the input's size.
    total = seen.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = total["good"] / total["n"] if total["n"] else 0.5
    k = [level.filter("n > 0").agg(_concentration(level, F.lit(rate)).alias("k")).first()["k"] for level in (suffixes, domains, seen)] if 0 < rate < 1 else [1000.0] * 3
    shrunk = lambda k, up: (F.col("good") + F.lit(k) * up) / (F.col("n") + F.lit(k))
    suffixes = suffixes.select("suffix", shrunk(k[0], F.lit(rate)).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(k[1], F.col("suffix_mean")).alias("domain_mean"))
    m = F.col("posterior_mean")
    return (
        hosts.join(domains, "domain").withColumn("posterior_mean", shrunk(k[2], F.col("domain_mean")))
        .withColumn("posterior_bound", m - F.lit(z) * F.sqrt(m * (1 - m) / (F.col("n") + F.lit(k[2]) + 1)))
        .select("host", F.col("n").alias("host_labelled"), F.col("good").alias("host_good"), "posterior_mean", "posterior_bound", "rows")
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], min_bound: float = 0.6, z: float = 1.645) -> DataFrame:
    """Every page's host, path, rule and verdict (allow or block).

    pages: page_id, url. outcomes: page_id, good (1 or 0): what became of labelled pages. Without a rule a page is
    allowed if the lower bound of its host's posterior rate of good pages is at least min_bound.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    outcomes = outcomes.groupBy("page_id").agg(F.min("good").alias("good"))
    reputation = host_reputation(pages.join(outcomes, "page_id", "left").select("host", "good"), z)
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("posterior_bound") >= min_bound, "allow").otherwise("block")
    # A hot host, such as the empty one of null urls, is no single task's work.
    told = cut(reputation.withColumnRenamed("host", "h"), "reputation")
    pages = join_hot(pages, told, F.col("host") == F.col("h"), "rows", pages.count())
    return pages.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, judged).alias("verdict"), "host_labelled", F.round("posterior_bound", 6).alias("posterior_bound"))
