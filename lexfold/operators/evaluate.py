"""Classification metrics from (y_true, y_pred) rows: everything follows from the counts of pairs, so any size is one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running


def pair_counts(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    hit = F.col("y_true").eqNullSafe(F.col("y_pred")).cast("int")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def per_label(rows: DataFrame, labels: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, precision, recall, f1, support) for each of the labels; a zero denominator gives 0."""
    pairs = pair_counts(rows, by)

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    measures = []
    for label in labels:
        t, p = F.col("y_true") == label, F.col("y_pred") == label
        measures.append(F.struct(F.lit(label).alias("label"), total(t & p).alias("tp"), total(p).alias("predicted"), total(t).alias("support")))
    df = pairs.groupBy(*by).agg(F.array(*measures).alias("m")).select(*by, F.explode("m").alias("m")).select(*by, "m.*")
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    df = df.withColumn("precision", over(F.col("tp"), F.col("predicted"))).withColumn("recall", over(F.col("tp"), F.col("support")))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return df.select(*by, "label", "precision", "recall", f1.alias("f1"), "support")


def averages(rows: DataFrame, labels: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, average, precision, recall, f1, support): macro and weighted by support."""
    per = per_label(rows, labels, by)
    macro = per.groupBy(*by).agg(F.lit("macro").alias("average"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    weighted = per.groupBy(*by).agg(F.lit("weighted").alias("average"), *((F.coalesce(F.sum(F.col(c) * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0))).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    return macro.unionByName(weighted)


def micro(rows: DataFrame, labels: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, precision, recall, f1, support) over all decisions for one of the labels."""
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    true, said = F.col("y_true").isin(*labels), F.col("y_pred").isin(*labels)
    sums = pair_counts(rows, by).groupBy(*by).agg(of(true & (F.col("y_true") == F.col("y_pred"))).alias("tp"), of(said).alias("said"), of(true).alias("support"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return sums.select(*by, over(F.col("tp"), F.col("said")).alias("precision"), over(F.col("tp"), F.col("support")).alias("recall"), over(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")


def balanced_accuracy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean recall of the classes that y_true has."""
    recall = rows.groupBy(*by, "y_true").agg(F.avg(F.col("y_true").eqNullSafe(F.col("y_pred")).cast("int")).alias("r"))
    return recall.groupBy(*by).agg(F.avg("r").alias("balanced_accuracy"))


def confusion(rows: DataFrame, labels: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, y_true, a column a label): zero-filled over all labels."""
    cell = lambda t, p: F.coalesce(F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n"))), F.lit(0))
    grid = F.array(*(F.struct(F.lit(t).alias("y_true"), *(cell(t, p).alias(p) for p in labels)) for t in labels))
    return pair_counts(rows, by).groupBy(*by).agg(grid.alias("g")).select(*by, F.explode("g").alias("g")).select(*by, "g.*")


def normalised(matrix: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """A confusion matrix by shares of its rows; empty rows stay zero."""
    total = F.greatest(reduce(lambda a, b: a + b, (F.col(c) for c in labels)), F.lit(1))
    return matrix.withColumns({c: F.col(c) / total for c in labels})


def errors(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pair_counts(rows.where("y_true <> y_pred"), by)


def flips(rows: DataFrame, by: tuple[str, ...] = (), low: str = "Low", high: str = "High") -> DataFrame:
    """(by, n, flips, rate): rows that take the lowest label for the highest or the other way."""
    flip = ((F.col("y_true") == low) & (F.col("y_pred") == high)) | ((F.col("y_true") == high) & (F.col("y_pred") == low))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(flip).alias("flips")).withColumn("rate", F.coalesce(F.col("flips") / F.nullif("n", F.lit(0)), F.lit(0.0)))


def flip_rows(rows: DataFrame, low: str = "Low", high: str = "High") -> DataFrame:
    return rows.where(((F.col("y_true") == low) & (F.col("y_pred") == high)) | ((F.col("y_true") == high) & (F.col("y_pred") == low)))


def distributions(rows: DataFrame) -> DataFrame:
    """(label, n_true, n_pred): of all labels that either has."""
    t = rows.groupBy(F.col("y_true").alias("label")).agg(F.count("*").alias("n_true"))
    p = rows.groupBy(F.col("y_pred").alias("label")).agg(F.count("*").alias("n_pred"))
    return t.join(p, "label", "full").select("label", F.coalesce("n_true", F.lit(0)).alias("n_true"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"))


def label_share(rows: DataFrame, label: str = "Medium", limit: float = 0.6) -> DataFrame:
    """The share of predictions that are one label, and whether they have collapsed to it."""
    return rows.agg(F.avg((F.col("y_pred") == label).cast("int")).alias("share")).withColumn("collapsed", F.col("share") > limit)


def with_fallback(rows: DataFrame, fallback: str = "low") -> tuple[DataFrame, DataFrame]:
    """(rows with unparsed predictions as the fallback, the unparsed rows)."""
    return rows.withColumn("y_pred", F.coalesce("y_pred", F.lit(fallback))), rows.where("y_pred is null")


def model_table(runs: dict[str, DataFrame], labels: tuple[str, ...]) -> DataFrame:
    """(model, n, accuracy, macro_f1): a row a model."""
    every = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("model"), "y_true", "y_pred") for name, df in runs.items()))
    macro = averages(every, labels, ("model",)).where("average = 'macro'").select("model", F.col("f1").alias("macro_f1"))
    return accuracy(every, ("model",)).join(macro, "model")


def exemplars(rows: DataFrame, index: str = "row_no", defaults: tuple[int, int, int, int] = (0, 1, 2, 3)) -> DataFrame:
    """One row: the first index that is correct, incorrect, High, Low; a default where none is."""
    first = lambda test, default: F.coalesce(F.min(F.when(test, F.col(index))), F.lit(default))
    hit = F.col("y_true") == F.col("y_pred")
    return rows.agg(first(hit, defaults[0]).alias("correct"), first(~hit, defaults[1]).alias("incorrect"), first(F.col("y_true") == "High", defaults[2]).alias("high"), first(F.col("y_true") == "Low", defaults[3]).alias("low"))


def running_accuracy(rows: DataFrame, by: str, order: str, every: int = 10) -> DataFrame:
    """(by, done, accuracy) after each every-th row of a run."""
    df = running(rows, by, [order], done=F.lit(1), hits=(F.col("y_true") == F.col("y_pred")).cast("int"), judged=F.col("y_true").isNotNull().cast("int") * F.col("y_pred").isNotNull().cast("int"))
    return df.where(F.col("done") % every == 0).select(by, "done", (F.col("hits") / F.nullif("judged", F.lit(0))).alias("accuracy"))
