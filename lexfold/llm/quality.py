"""Quality rules judged by host, in DataFrame operations alone.

Documents are measured and held against rules; the rules' failures are counted
by host, a beta prior is fitted to the hosts by moments, each host's failure
rate is shrunk towards it, and the verdict on a host is joined back to its
documents. A host's few pages thus move its rate little, and many bad pages
condemn a host whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACES, materialise, small

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """A document fails by any; a host by a shrunk rate of failures over host_rate."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_word_chars: float = 2.0
    max_word_chars: float = 14.0
    max_symbols_a_word: float = 0.5
    max_dup_line_percent: int = 50
    host_rate: float = 0.5


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated three-word windows are found within the row: each window's hash,
    shifted over its place, is sorted, and neighbours of equal hash are compared
    word by word. No word leaves its document, so nothing is shuffled. A null text
    has no words; very long texts are measured whole, in one row.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    words = F.split(F.trim(F.col("__t"), F.lit(ASCII_SPACES)), r"[\x20\x09-\x0D]+")
    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(x, F.lit(ASCII_SPACES)) != "")
    df = df.select("*", F.array_remove(words, "").alias("__w"), lines.alias("__l"))
    df = df.select("*", F.size("__w").alias("__n"), F.length(F.bin(F.size("__w").cast("long"))).alias("__b"), F.length("__t").alias("__c"))
    df = df.select(
        "*",
        F.length(_without(F.col("__t"), ASCII_SPACES)).cast("long").alias("word_chars"),
        (F.col("__c") - F.length(_without(F.col("__t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.expr("case when __n < 4 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, __n - 3), i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __b) | cast(i as bigint))) end").alias("__p"),
    ).drop("__t")
    same = """shiftrightunsigned({p}, __b) = shiftrightunsigned({q}, __b)
        and __w[cast({p} & __m as int)] = __w[cast({q} & __m as int)] and __w[cast({p} & __m as int) + 1] = __w[cast({q} & __m as int) + 1]
        and __w[cast({p} & __m as int) + 2] = __w[cast({q} & __m as int) + 2]"""
    df = df.select("*", F.expr("shiftleft(1L, __b) - 1").alias("__m"))
    before, after = same.format(p="p", q="__p[k - 1]"), same.format(p="p", q="__p[k + 1]")
    df = df.select("*", F.expr(f"sort_array(transform(filter(__p, (p, k) -> (k > 0 and {before}) or (k < __n - 3 and {after})), p -> p & __m))").alias("__f"))
    covered = F.expr("aggregate(__f, named_struct('n', 0L, 'end', -3L), (a, f) -> named_struct('n', a.n + least(3L, f - a.end), 'end', f), a -> a.n)")
    return df.select(
        "doc_id",
        "host",
        F.col("__n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def flagged(stats: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """stats with base_failed, and failed: any rule."""
    n = F.col("n_words")
    base = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)
    other = (
        (F.col("word_chars") < rules.min_word_chars * n)
        | (F.col("word_chars") > rules.max_word_chars * n)
        | (F.col("n_symbols") > rules.max_symbols_a_word * n)
        | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
    )
    return stats.select("*", base.alias("base_failed"), (base | other).alias("failed"))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta fitted by moments to (n, failures) of hosts.

    The variance between hosts is what their rates vary beyond the binomial's
    own. alpha + beta stays within 1 and 10,000, so one host, hosts all alike and
    hosts without a failure have a prior too. No host: (0.5, 0.5).
    """
    rate = F.col("failures") / F.col("n")
    got = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.avg(rate).alias("m"), F.avg(rate * rate).alias("s"), F.avg(1.0 / F.col("n")).alias("i")).first()
    if not got["n"]:
        return 0.5, 0.5
    mean = min(max((got["f"] + 0.5) / (got["n"] + 1.0), 1e-6), 1 - 1e-6)
    own = mean * (1 - mean)
    between = got["s"] - got["m"] ** 2 - own * got["i"]
    strength = min(max(own / between - 1, 1.0), 1e4) if between > 0 else 1e4
    return mean * strength, (1 - mean) * strength


def host_rates(stats: DataFrame) -> DataFrame:
    """(host, n, failures, rate): rate shrunk to the prior. Documents without a host are in none."""
    hosts = stats.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    alpha, beta = prior(hosts)
    return hosts.select("*", ((F.col("failures") + alpha) / (F.col("n") + alpha + beta)).alias("rate"))


def judged(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the base measures, base_failed and kept, for every row.

    A document is kept unless it fails the base rules or its host's shrunk rate of
    failures exceeds host_rate. A null text has no words and fails; a null host has
    no verdict. Repeated rows return a row each and count each. An empty table
    returns no row. Other columns are ignored, whatever their names.
    """
    stats = materialise(flagged(measured(docs, id_col, text_col, host_col), rules), "quality-stats")
    bad = host_rates(stats).where(F.col("rate") > rules.host_rate).select("host", F.lit(True).alias("bad_host"))
    got = stats.join(small(materialise(bad, "quality-bad")), "host", "left")
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("bad_host").isNull()).alias("kept"))
