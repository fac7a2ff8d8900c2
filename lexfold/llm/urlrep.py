"""URL verdicts: rules first, else the empirical-Bayes reputation of the host, in DataFrame operations alone.

Labelled page outcomes are counted by host, registered domain and public suffix.
Each level's rate is shrunk to the level above by a beta-binomial prior whose
strength is fitted by moments: suffixes to all pages, domains to their suffix,
hosts to their domain. A host is blocked when the lower posterior bound of its
share of bad pages exceeds ``BAD_RATE``, so few labels never block a host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, materialise, small

BAD_RATE = 0.5
Z = 1.645
#: Limits of a prior's strength, in pages.
STRENGTH = (2.0, 1000.0)
#: Public suffixes of two labels; fixed values. A caller gives rules of its own, also with * for any label and ! for an exception.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")


@dataclass(frozen=True)
class Rule:
    """verdict is allow or block; pattern is host/path: that host with its subdomains, paths that start so."""

    verdict: str
    pattern: str


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds __host and __path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    df = df.withColumn("__rest", rest)
    host = F.regexp_extract("__rest", r"^[^/?#]*", 0)
    path = F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("__host", F.translate(host, ASCII_UPPER, ASCII_UPPER.lower())).withColumn("__path", path).drop("__rest")


def suffix_labels(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """How many labels of a host name are its public suffix: those of the longest rule that fits, 1 without one.

    A rule is a suffix, ``*.suffix`` (any label before it) or ``!name``, an exception: its
    suffix is what follows its first label, whatever else fits.
    """
    size = F.size(F.split(name, r"\."))
    end = lambda k: F.substring_index(name, ".", -k)
    by_size: dict[tuple[int, str], list[str]] = {}
    for rule in suffixes:
        kind = rule[0] if rule[:1] in ("*", "!") else ""
        by_size.setdefault((rule.count(".") + 1, kind), []).append(rule.removeprefix("*.").removeprefix("!"))
    fits = []
    for (k, kind), names in sorted(by_size.items(), key=lambda x: (x[0][1] != "!", -x[0][0])):
        at = end(k - 1) if kind == "*" else end(k)
        fits.append(F.when((size >= k) & at.isin(*names), k - 1 if kind == "!" else k))
    return F.coalesce(*fits, F.lit(1))


def registered(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; an address or a host that is all suffix is its own domain, without suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels, n = F.split(name, r"\."), suffix_labels(name, suffixes)
    last = lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
    alone = (F.size(labels) <= n) | name.rlike(r"^[0-9.]+$|^\[")
    return F.when(alone, name).otherwise(last(n + 1)), F.when(alone, F.lit("")).otherwise(last(n))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits, null without one; block wins a tie."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "block")):
        name, slash, start = r.pattern.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        which, verdict = F.when(fits, r.pattern).otherwise(which), F.when(fits, r.verdict).otherwise(verdict)
    return which, verdict


def _strength(level: DataFrame) -> float:
    """Prior strength by moments over a level's units (n, bad, mean): mean is the level above's rate."""
    p, m = F.col("bad") / F.col("n"), F.col("mean")
    got = level.where("n > 0").agg(F.avg((p - m) * (p - m)).alias("v"), F.avg(m * (1 - m)).alias("own"), F.avg(m * (1 - m) / F.col("n")).alias("noise")).first()
    low, high = STRENGTH
    if got["v"] is None or got["v"] <= got["noise"]:
        return high
    return min(max(got["own"] / (got["v"] - got["noise"]) - 1, low), high)


def reputations(pages: DataFrame, outcomes: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, bound) of every host of pages (__host); outcomes: (host, bad 0 or 1).

    bound is mean - z standard deviations of the host's posterior. Hosts without
    outcomes are judged by their domain's evidence, as far as that goes. Null hosts and
    outcomes count nothing; either table may be empty; other columns are ignored.
    """
    counted = outcomes.where("bad in (0, 1) and host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = pages.select(F.col("__host").alias("host")).distinct().join(counted, "host", "left")
    domain, suffix = registered(F.col("host"), suffixes)
    hosts = materialise(hosts.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"), domain.alias("domain"), suffix.alias("suffix")), "urlrep-hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    ends = domains.groupBy("suffix").agg(*sums)
    total = ends.agg(*sums).first()
    base = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    def shrunk(level: DataFrame) -> DataFrame:
        """Posteriors a, b of a level: no prior is stronger than the evidence above it, weight."""
        k = F.least(F.lit(_strength(level)), F.col("weight"))
        return level.withColumn("a", F.col("bad") + k * F.col("mean")).withColumn("b", F.col("n") - F.col("bad") + k * (1 - F.col("mean")))

    rate, weight = (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), (F.col("a") + F.col("b")).alias("weight")
    every = float(total["n"] or 0) + 1.0
    ends = shrunk(ends.withColumn("mean", F.lit(base)).withColumn("weight", F.lit(every))).select("suffix", rate, weight)
    domains = shrunk(domains.join(ends, "suffix")).select("domain", rate, weight)
    got = shrunk(hosts.join(domains, "domain"))
    a, b = F.col("a"), F.col("b")
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return got.select("host", "n", "bad", rate, (a / (a + b) - z * spread).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, bad_rate: float = BAD_RATE, z: float = Z, id_col: str = "page_id", url_col: str = "url", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    outcomes: (page_id, bad), bad 1 for a bad page; a page_id with several counts
    each, once, however many rows of pages have that id and host. Null and malformed
    urls have an empty host and path, fit no rule and are judged as one host. Very
    long urls are read whole. Repeated rows return a row each. Other columns are
    ignored, whatever their names. Either table may be empty.
    """
    df = split_url(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url")), "__url").drop("__url")
    known = df.select("page_id", F.col("__host").alias("host")).distinct().join(outcomes.select("page_id", "bad"), "page_id")
    bad = reputations(df, known, z, suffixes).where(F.col("bound") > bad_rate).select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    which, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    method = F.when(F.col("__bad"), "block").otherwise("allow")
    got = df.join(small(materialise(bad, "urlrep-bad")), "__host", "left")
    return got.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), which.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
