"""Ranks, places, scans and medians in which no task holds a whole group.

A hash order is cut by its first digits: rows are counted a cut, and a row's rank is
that of its cut and its place within. Any other order is cut into ranges of rows,
written once so that each row stays in its range; what comes before a range is
carried to it. A scan is anything whose value for two ranges follows from its values for
each: a sum, the last value that is not null, the row before. ``windowed`` computes the
same by windows over the group, for groups that a task can hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Hex digits of a hash by which a group is cut: 4,096 parts.
DIGITS = 3
#: Numbers of an order that a chunk of a group holds.
CHUNK = 4096
_BEFORE = (Window.unboundedPreceding, -1)


def ranked(rows: DataFrame, by: list[str], rank: Column, tie: str, name: str = "__n") -> DataFrame:
    """rows with their number, from 1, in the order of (rank, tie) within by; rank is a hash in hex digits."""
    group = F.struct(*by) if by else F.lit(0)
    df = rows.withColumn("__by", group).withColumn("__rank", rank).withColumn("__cut", F.substring("__rank", 1, DIGITS))
    sizes = df.groupBy("__by", "__cut").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("__by").orderBy("__cut").rowsBetween(*_BEFORE)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__by", "__cut").orderBy("__rank", tie))
    df = df.withColumn("__in", within).join(sizes.select("__by", "__cut", before.alias("__before")), ["__by", "__cut"])
    return df.withColumn(name, F.col("__before") + F.col("__in")).select(*rows.columns, name)


def placed(rows: DataFrame, key: str) -> DataFrame:
    """rows with __place, from 0, in the order of key: ranges of the key are counted, then numbered each from its start."""
    # the lower bits are the row's place in its range
    parts = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__id", F.monotonically_increasing_id())
    parts = stored(parts, "placed").withColumn("__part", F.shiftright("__id", 33))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(*_BEFORE)), F.lit(0)).alias("__start"))
    at = F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(F.broadcast(starts), "__part").withColumn("__place", at).select(*rows.columns, "__place")


@dataclass(frozen=True)
class Scan:
    """What a row learns from its group's rows up to it. kind: sum, last (that is not null), lag or whole (the sum of all)."""

    kind: str
    value: Column
    before: bool = False

    def over(self, by: list[str], order: list[str]) -> Column:
        """By a window over columns that name the group."""
        group = Window.partitionBy(*by)
        rows = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if self.before else Window.currentRow)
        if self.kind == "sum":
            return F.coalesce(F.sum(self.value).over(rows), F.lit(0))
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(rows)
        if self.kind == "lag":
            return F.lag(self.value).over(group.orderBy(*order))
        return F.coalesce(F.sum(self.value).over(group), F.lit(0))


def total(value: Column, before: bool = False) -> Scan:
    """The sum up to the row, without it if before; nulls add nothing."""
    return Scan("sum", value, before)


def last(value: Column, before: bool = False) -> Scan:
    """The last value that is not null, up to the row or before it."""
    return Scan("last", value, before)


def lag(value: Column) -> Scan:
    """The value of the row before."""
    return Scan("lag", value)


def whole(value: Column) -> Scan:
    """The sum over the group."""
    return Scan("whole", value)


def windowed(rows: DataFrame, by: str, order: list[str], **scans: Scan) -> DataFrame:
    """rows with each scan as a column, by windows over the groups."""
    return rows.withColumns({name: scan.over([by], order) for name, scan in scans.items()})


def scanned(rows: DataFrame, by: str, order: list[str], **scans: Scan) -> DataFrame:
    """The same, range by range: a row in a group without end meets the others of its range alone.

    order tells the rows of a group apart. Null groups are one group.
    """
    df = rows.withColumns({f"__v_{name}": scan.value for name, scan in scans.items()})
    df = stored(df.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "scan").withColumn("__by", F.struct(by))
    return _carried(df, order, scans, [c for c in rows.columns if c not in scans])


def cut(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with __by and __part: the group, and chunks of CHUNK numbers of the order's first column, which is a whole number."""
    return rows.withColumns({"__by": F.struct(by), "__part": F.floor(F.col(order[0]) / CHUNK)})


def chunked(rows: DataFrame, by: str, order: list[str], of: DataFrame | None = None, **scans: Scan) -> DataFrame:
    """The same, chunk by chunk, over rows that were cut: scans that follow each other over the same rows share one shuffle.

    The sums and last values that are carried to a chunk are read from rows anew, narrow,
    so rows should be stored or cheap to make. of: a table with a row a group, whose
    columns are carried along.
    """
    df = rows.withColumns({f"__v_{name}": scan.value for name, scan in scans.items()})
    return _carried(df, order, scans, [c for c in rows.columns if c not in scans], of)


def _carried(df: DataFrame, order: list[str], scans: dict[str, Scan], keep: list[str], of: DataFrame | None = None) -> DataFrame:
    """keep and the scans' columns, from rows with their values, groups (__by) and parts (__part)."""
    at = F.struct(*order)
    per, carried = [], []
    before, group = Window.partitionBy("__by").orderBy("__part").rowsBetween(*_BEFORE), Window.partitionBy("__by")
    for name, scan in scans.items():
        v, c = F.col(f"__v_{name}"), f"__c_{name}"
        if scan.kind in ("sum", "whole"):
            per.append(F.sum(v).alias(c))
            carried.append(F.coalesce(F.sum(c).over(before if scan.kind == "sum" else group), F.lit(0)).alias(c))
        elif scan.kind == "last":
            per.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(c))
            carried.append(F.last(c, ignorenulls=True).over(before).alias(c))
        else:
            per.append(F.max_by(F.struct(v.alias("v")), at).alias(c))
            carried.append(F.last(c).over(before)["v"].alias(c))
    carry = df.groupBy("__by", "__part").agg(*per).select("__by", "__part", *carried)
    more = []
    if of is not None:
        key = of.columns[0]
        carry = carry.join(of.select(F.struct(key).alias("__by"), *of.columns[1:]), "__by", "left")
        more = of.columns[1:]
    own = {name: Scan(scan.kind, F.col(f"__v_{name}"), scan.before).over(["__by", "__part"], order) for name, scan in scans.items() if scan.kind != "whole"}
    first = F.row_number().over(Window.partitionBy("__by", "__part").orderBy(*order)) == 1
    df = df.withColumns(own | {"__first": first}).join(carry, ["__by", "__part"])
    out = []
    for name, scan in scans.items():
        here, c = F.col(name) if name in own else None, F.col(f"__c_{name}")
        out.append({"sum": lambda h, c: h + c, "last": lambda h, c: F.coalesce(h, c), "lag": lambda h, c: F.when(F.col("__first"), c).otherwise(h), "whole": lambda h, c: c}[scan.kind](here, c).alias(name))
    return df.select(*keep, *more, *out)


def running(rows: DataFrame, by: str, order: list[str], **sums: Column) -> DataFrame:
    """rows with inclusive running sums over by in an order; a sum's nulls add nothing."""
    return scanned(rows, by, order, **{name: total(value) for name, value in sums.items()})


def medians(rows: DataFrame, by: str, value: Column) -> DataFrame:
    """(by, median) of values that are not null, between the two in the middle, as percentile(0.5) has it.

    Equal values are counted first, and counts run over ranges of values.
    """
    counts = rows.select(by, value.cast("double").alias("__x")).where("__x is not null").groupBy(by, "__x").agg(F.count("*").alias("__n"))
    upto = scanned(counts, by, ["__x"], __upto=total(F.col("__n")), __all=whole(F.col("__n")))
    at = (F.col("__all") - 1) / 2
    middle = lambda k: F.min(F.when(F.col("__upto") > k, F.col("__x")))
    found = upto.groupBy(by).agg(middle(F.floor(at)).alias("__lo"), middle(F.ceil(at)).alias("__hi"))
    return found.select(by, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(0.5 * F.col("__lo") + 0.5 * F.col("__hi")).alias("median"))
