"""Curation: filters, duplicates, samples, splits and compositions of labelled rows.

Random choices rank rows by md5 of a seed and a key, so they are the same in any
engine, at any partitioning, and on a retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import severity
from ..functions.text import clause_body, strip
from .order import placed, ranked, scanned, total

# Fixed value: label words that give an answer away.
LEAK_WORDS = r"(?iU)\b(low|medium|high)\b"
# Clause types that the data model keeps.
LICENSE_TYPES = ("License Grant", "Ip Ownership Assignment", "Non-Transferable License", "Affiliate License-Licensee", "Affiliate License-Licensor", "Irrevocable Or Perpetual License", "Unlimited/All-You-Can-Eat-License")
RELATED_TYPES = ("Exclusivity", "Anti-Assignment", "Cap On Liability", "Uncapped Liability", "Termination For Convenience", "Minimum Commitment", "Renewal Term", "Change Of Control")


def rank_key(*key: str | Column, seed: int = 42) -> Column:
    """A row's place in a random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key)))


# filters


def successful(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'success'")


def without_status(rows: DataFrame, status: str = "api_error") -> tuple[DataFrame, DataFrame]:
    """(clean, rejected): rejected have the status; a null status is clean."""
    bad = F.col("status").eqNullSafe(status)
    return rows.where(~bad), rows.where(bad)


def by_leak(rows: DataFrame, pattern: str = LEAK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(leaky, clean): leaky rows have a label word in some party's explanation."""
    leaky = F.coalesce(F.exists(F.map_values("parties"), lambda p: F.coalesce(p["explanation"].rlike(pattern), F.lit(False))), F.lit(False))
    return rows.where(leaky), rows.where(~leaky)


def any_party(rows: DataFrame, risk: str = "High") -> DataFrame:
    return rows.where(F.exists(F.map_values("parties"), lambda p: p["risk"].eqNullSafe(risk)))


def both_parties(rows: DataFrame, risk: str = "Low", first: str = "Licensor", second: str = "Licensee") -> DataFrame:
    return rows.where((F.col("parties")[first]["risk"] == risk) & (F.col("parties")[second]["risk"] == risk))


def with_body(rows: DataFrame, min_length: int = 3, text_col: str = "text") -> DataFrame:
    """Rows whose clause body is long enough; a row without markers has a body of one character, hence goes."""
    return rows.where(F.length(clause_body(F.col(text_col), F.lit("X"))) >= min_length)


def labelled(rows: DataFrame, risk_col: str = "risk") -> DataFrame:
    return rows.where(F.col(risk_col).isNotNull() & (F.col(risk_col) != ""))


def known_predictions(rows: DataFrame, col: str = "predicted") -> DataFrame:
    """Rows with a prediction other than Unknown; a missing one is unknown too."""
    return rows.where(F.lower(col) != "unknown")


def contract_rows(rows: DataFrame, types: tuple[str, ...] = LICENSE_TYPES + RELATED_TYPES, risk: str = "high", min_length: int = 30) -> DataFrame:
    """Rows of a clause table of the kept types and risk, of some length, a text once (the first by row_no)."""
    kept = rows.where(F.col("clause_type").isin(*types) & (F.lower("risk_level") == risk))
    return dedup_first(kept, "clause_text", order="row_no").where(F.length(strip(F.col("clause_text"))) >= min_length)


def lookup(rows: DataFrame, clause_index: int, party: str) -> DataFrame:
    return rows.where((F.col("clause_index") == clause_index) & (F.col("party") == party))


def without_internal(rows: DataFrame) -> DataFrame:
    """Without columns whose name starts with an underscore."""
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


# duplicates


def _one(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")


def dedup_first(rows: DataFrame, *key: str, order: str = "row_no") -> DataFrame:
    """A row a key: the first by order."""
    return _one(rows, list(key), F.col(order).asc())


def dedup_counts(rows: DataFrame, *key: str) -> DataFrame:
    """One row: rows before, rows that stay with one a key, and duplicates that go."""
    per = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kept")).withColumn("removed", F.col("total") - F.col("kept"))


def dedup_last(rows: DataFrame, *key: str, order: str = "row_no") -> DataFrame:
    """A row a key: the last by order, as a keyed dictionary keeps it."""
    return _one(rows, list(key), F.col(order).desc())


# samples: all choose within a class by rank_key


def _ranked(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    return ranked(rows, [label], rank_key(key, seed=seed), key)


def class_sizes(rows: DataFrame, label: str = "risk") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def targets(rows: DataFrame, label: str = "risk") -> DataFrame:
    """One row: the sizes of the smallest and the largest class."""
    return class_sizes(rows, label).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))


def per_class(rows: DataFrame, n: int, label: str = "risk", key: str = "row_no", seed: int = 42) -> DataFrame:
    """At most n rows a class."""
    return _ranked(rows, label, key, seed).where(F.col("__n") <= n).drop("__n")


def quotas(rows: DataFrame, n: dict[str, int], label: str = "risk", key: str = "row_no", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(held, rest): a fixed number of rows of each class, or all there are, and the others."""
    quota = F.coalesce(*(F.when(F.col(label) == k, F.lit(v)) for k, v in n.items()), F.lit(0))
    df = _ranked(rows, label, key, seed).withColumn("__held", F.col("__n") <= quota)
    return df.where("__held").drop("__n", "__held"), df.where("not __held").drop("__n", "__held")


def undersampled(rows: DataFrame, label: str = "risk", key: str = "row_no", seed: int = 42) -> DataFrame:
    """Every class at the size of the smallest."""
    n = targets(rows, label).first()["smallest"]
    return per_class(rows, n or 0, label, key, seed)


def copied_to(rows: DataFrame, n: int, label: str = "risk", key: str = "row_no", seed: int = 42) -> DataFrame:
    """Every class at n rows or its own size if larger: each row needed // size times more, one more for the first of the random order.

    Adds copy_no: 0 for the row itself.
    """
    sizes = class_sizes(rows, label).withColumnRenamed("n", "__size")
    df = _ranked(rows, label, key, seed).join(sizes, label)
    needed = F.greatest(F.lit(n) - F.col("__size"), F.lit(0))
    extra = (F.floor(needed / F.col("__size")) + F.when(F.col("__n") <= needed % F.col("__size"), 1).otherwise(0)).cast("int")
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), extra))).drop("__n", "__size")


def oversampled(rows: DataFrame, label: str = "risk", key: str = "row_no", seed: int = 42) -> DataFrame:
    """Every class at the size of the largest, by copied_to."""
    return copied_to(rows, targets(rows, label).first()["largest"] or 0, label, key, seed)


def drawn(rows: DataFrame, n: int, key: str = "row_no", seed: int = 42) -> DataFrame:
    """n draws with replacement: draw i takes the row whose place is hash(seed, i) modulo the number of rows. Adds draw from 1.

    Places come from the rows' order by key, partition by partition, so no task sorts them all.
    """
    size = rows.count()
    if not size or n <= 0:
        return rows.limit(0).withColumn("draw", F.lit(1).cast("long"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    draws = rows.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw").withColumn("__place", h % size)
    return placed(rows, key).join(draws, "__place").drop("__place")


def ratio_extra(low: int, high: int, ratio: float = 1.5) -> int:
    """How many High rows to add for Low : High = ratio; rounds half to even."""
    return max(0, round(low / ratio) - high)


def oversampled_to_ratio(rows: DataFrame, ratio: float = 1.5, label: str = "risk", key: str = "row_no", seed: int = 42) -> DataFrame:
    """rows and High rows drawn again until Low : High = ratio; draw is null for the rows themselves."""
    n = {r[label]: r["n"] for r in class_sizes(rows, label).collect()}
    extra = drawn(rows.where(F.col(label) == "High"), ratio_extra(n.get("Low", 0), n.get("High", 0), ratio), key, seed)
    return rows.withColumn("draw", F.lit(None).cast("long")).unionByName(extra)


# splits: groups stay whole


def grouped_split(rows: DataFrame, group: str, label: str = "risk", ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with split: of the groups with any High row, and of the others, max(1, bround(n * ratio)) are val, the rest train."""
    groups = rows.groupBy(group).agg(F.coalesce(F.bool_or(F.col(label) == "High"), F.lit(False)).alias("__high"))
    sizes = groups.groupBy("__high").agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(ratio)).cast("long")).alias("__val"))
    side = ranked(groups, ["__high"], rank_key(group, seed=seed), group).join(F.broadcast(sizes), "__high").select(group, F.when(F.col("__n") <= F.col("__val"), "val").otherwise("train").alias("split"))
    return rows.join(side, group)


def plain_split(rows: DataFrame, group: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with split: the first floor(n * ratio) groups of the random order are val. A null group is a group of one row."""
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("?"), rank_key(*rows.columns, seed=seed)))
    df = rows.withColumn("__g", key)
    groups = df.select("__g").distinct()
    n_val = int(groups.count() * ratio)
    val = ranked(groups, [], rank_key("__g", seed=seed), "__g").where(F.col("__n") <= n_val).select("__g", F.lit("val").alias("split"))
    return df.join(val, "__g", "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("__g")


def split_overlap(rows: DataFrame, on: str) -> DataFrame:
    """Keys that are in both train and val; a leak-free split has none."""
    return rows.where("split = 'train'").select(on).distinct().join(rows.where("split = 'val'").select(on), on, "left_semi")


# compositions


def composed(groups: DataFrame, target: int, copies: int = 3, label: str = "risk", key: str = "row_no", seed: int = 42) -> DataFrame:
    """groups with copy_no: High copies times, filled up to target by Medium, then by Low.

    Raises ValueError where High alone exceeds target or Low does not suffice.
    """
    n = {r[label]: r["n"] for r in class_sizes(groups, label).collect()}
    left = target - copies * n.get("High", 0)
    medium = min(left, n.get("Medium", 0))
    if left < 0 or left - medium > n.get("Low", 0):
        raise ValueError("the classes do not fill the target")
    once = F.lit(1)
    high = groups.where(F.col(label) == "High").withColumn("copy_no", F.explode(F.sequence(once, F.lit(copies))))
    rest, _ = quotas(groups.where(F.col(label).isin("Medium", "Low")), {"Medium": medium, "Low": left - medium}, label, key, seed)
    return high.unionByName(rest.withColumn("copy_no", once))


def rephrased_composition(groups: DataFrame, target: int, rephrase, label: str = "risk", key: str = "row_no", seed: int = 42) -> DataFrame:
    """High and one rephrased copy of each, filled up to target; rephrase maps a DataFrame to one of the same columns."""
    high = groups.where(F.col(label) == "High")
    again = rephrase(high).withColumn("copy_no", F.lit(2)).select(*groups.columns, "copy_no")
    base = composed(groups, target - high.count(), 1, label, key, seed)
    return base.unionByName(again)


def pairs(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """rows with pair_no: the first two rows are 0, the next two 1 ...; a single last row goes.

    Numbers come range by range, so no task orders all rows.
    """
    df = placed(rows, order).withColumn("pair_no", F.floor(F.col("__place") / 2)).drop("__place")
    return df.join(df.groupBy("pair_no").agg(F.count("*").alias("__n")).where("__n = 2").select("pair_no"), "pair_no", "left_semi")


def grouped(rows: DataFrame, group: str, order: str = "row_no") -> DataFrame:
    """(group, rows): each group's row numbers in order. Groups are the copies of a clause, bounded by how often it is annotated."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("rows"))


def grouped_parts(rows: DataFrame, group: str, order: str = "row_no", most: int = 10_000) -> DataFrame:
    """(group, part, rows): the same in parts of at most so many row numbers, part from 0: for groups without a bound, as an empty text's. A null group is one."""
    numbered = scanned(rows.select(group, order), group, [order], __n=total(F.lit(1)))
    parts = numbered.withColumn("part", F.floor((F.col("__n") - 1) / most)).groupBy(group, "part")
    return parts.agg(F.array_sort(F.collect_list(order)).alias("rows"))


def group_class(rows: DataFrame, group: str, label: str = "risk") -> DataFrame:
    """(group, class): the gravest risk of a group's rows."""
    worst = F.max(severity(F.col(label)))
    return rows.groupBy(group).agg(F.when(worst == 2, "High").when(worst == 1, "Medium").otherwise("Low").alias("class"))


def shuffled(rows: DataFrame, key: str = "row_no", seed: int = 42) -> DataFrame:
    return rows.orderBy(rank_key(key, seed=seed))
