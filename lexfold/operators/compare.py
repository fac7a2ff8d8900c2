"""Annotation versions against each other, resumption, audits and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curate import dedup_last


def versions(old: DataFrame, new: DataFrame, order: str = "row_no", success: bool = True) -> DataFrame:
    """Party rows of the clauses that both versions have: clause_index, party, old_risk, new_risk.

    The last row of a clause counts in each version. A party that one version
    lacks has a null risk there.
    """

    def one(df: DataFrame, name: str) -> DataFrame:
        df = dedup_last(df.where("status = 'success'") if success else df, "clause_index", order=order)
        return df.select("clause_index", F.col("parties").alias(name))

    both = one(old, "a").join(one(new, "b"), "clause_index")
    party = F.explode(F.array_union(F.map_keys("a"), F.map_keys("b")))
    return both.withColumn("party", party).select("clause_index", "party", F.col("a")[F.col("party")]["risk"].alias("old_risk"), F.col("b")[F.col("party")]["risk"].alias("new_risk"))


def mismatches(both: DataFrame) -> DataFrame:
    """Rows whose risks differ; null differs from every risk but null."""
    return both.where(~F.col("old_risk").eqNullSafe(F.col("new_risk")))


def transitions(both: DataFrame) -> DataFrame:
    """(party, old_risk, new_risk, n) of the mismatches, a null risk read as Unknown."""
    known = lambda c: F.coalesce(c, F.lit("Unknown")).alias(c)
    return both.select("party", known("old_risk"), known("new_risk")).where("old_risk <> new_risk").groupBy("party", "old_risk", "new_risk").agg(F.count("*").alias("n"))


def transition_examples(both: DataFrame, *picks: tuple[str, str]) -> DataFrame:
    """For each (old, new) the first clause, by index, whose risk went so; none where no clause did."""
    wanted = F.lit(False)
    for old, new in picks:
        wanted = wanted | ((F.col("old_risk") == old) & (F.col("new_risk") == new))
    first = F.min(F.struct("clause_index", "party")).alias("f")
    return both.where(wanted).groupBy("old_risk", "new_risk").agg(first).select("f.clause_index", "f.party", "old_risk", "new_risk")


def transition_example(both: DataFrame, old: str, new: str) -> DataFrame:
    """The first clause, by index, whose risk went from old to new."""
    return both.where((F.col("old_risk") == old) & (F.col("new_risk") == new)).orderBy("clause_index", "party").limit(1)


def remaining(tasks: DataFrame, done: DataFrame, key: str = "clause_index") -> DataFrame:
    """Tasks without any result, whatever its status."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def repeated(rows: DataFrame, key: str, over: int = 2) -> DataFrame:
    """Rows whose key stands more than over times."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > over).select(key), key, "left_semi")


def share(n: Column, over: list[str] | None = None, digits: int = 1) -> Column:
    """Percent of the sum, overall or within columns."""
    return F.round(100 * n / F.sum(n).over(Window.partitionBy(*(over or []))), digits)


def risk_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def risk_shares(rows: DataFrame, within: str = "party", label: str = "risk") -> DataFrame:
    """(within, label, n, total, percent). Shares are joined back from totals, so no task holds a whole class."""
    n = rows.groupBy(within, label).agg(F.count("*").alias("n"))
    total = n.groupBy(within).agg(F.sum("n").alias("total"))
    return n.join(total, within).withColumn("percent", F.round(100 * F.col("n") / F.col("total"), 1))


def frequencies_of_frequencies(rows: DataFrame, key: str) -> DataFrame:
    """How many keys stand once, twice ..."""
    return rows.groupBy(key).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("keys"))


def duplicates(rows: DataFrame, key: str, over: int = 1, top: int | None = None, order: str = "row_no") -> DataFrame:
    """(key, n, first): keys that stand more than over times; the top ones by n, ties by first row."""
    got = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first")).where(F.col("n") > over)
    return got if top is None else got.orderBy(F.desc("n"), "first").limit(top)


def uniqueness(rows: DataFrame, key: str) -> DataFrame:
    """One row: total, distinct keys, and rows a key."""
    return rows.agg(F.count("*").alias("total"), F.countDistinct(key).alias("unique")).withColumn("per_key", F.round(F.col("total") / F.nullif("unique", F.lit(0)), 4))


def status_counts(annotations: DataFrame) -> DataFrame:
    return annotations.agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(~F.col("status").eqNullSafe("success")).alias("errors"))


def outcome_counts(annotations: DataFrame) -> DataFrame:
    """One row: successes, rows skipped since their context is too long, and errors of any other kind."""
    status = F.coalesce("status", F.lit(""))
    return annotations.agg(F.count_if(status == "success").alias("success"), F.count_if(status == "context_too_long").alias("skipped"), F.count_if(~status.isin("success", "context_too_long")).alias("errors"))


def risk_table(rows: DataFrame, labels: tuple[str, ...] = ("Low", "Medium", "High")) -> DataFrame:
    """A row a party, a column a label, zero-filled; other labels are counted as other."""
    known = F.when(F.col("risk").isin(*labels), F.col("risk")).otherwise("other")
    return rows.withColumn("__r", known).groupBy("party").pivot("__r", [*labels, "other"]).count().na.fill(0)


def explanation_stats(annotations: DataFrame) -> DataFrame:
    """By party: the mean length of explanations, and how many rows quote a trigger or evidence."""
    p = F.col("p")
    rows = annotations.select(F.explode("parties").alias("party", "p"))
    return rows.groupBy("party").agg(F.round(F.avg(F.length(p["explanation"])), 4).alias("mean_length"), F.count_if(p["trigger_quote"].isNotNull() | p["evidence_quote"].isNotNull()).alias("quoted"))


def totals(clauses: DataFrame) -> DataFrame:
    """Clauses and pages by file, and for all files where source_file is null."""
    by = clauses.groupBy("source_file").agg(F.count("*").alias("clauses"), F.max("page").alias("pages"))
    return by.rollup("source_file").agg(F.sum("clauses").alias("clauses"), F.sum("pages").cast("long").alias("pages"))


def rephrase_counts(rows: DataFrame, original: str = "explanation", new: str = "rephrased") -> DataFrame:
    """Copies that were rephrased, and copies that fell back to the original."""
    return rows.agg(F.count_if(~F.col(original).eqNullSafe(F.col(new))).alias("rephrased"), F.count_if(F.col(original).eqNullSafe(F.col(new))).alias("fallback"))
