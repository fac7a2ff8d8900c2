"""What the corpus operators share: session set-up, shared storage, row identity."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BATCH_ROWS, BATCHES, bounded, shared_path  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])

#: Characters that separate words in the byte-oriented contracts: space and \t to \r.
ASCII_SPACES = "\t\n\x0b\x0c\r "
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and bound their batches.

    On a cluster the package is installed or passed by --py-files; the path added
    here serves sessions whose executors see the driver's file system.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return bounded(spark)


#: Rows of ids and counts that a written file should hold at least, and files up to which they are put together.
FILE_ROWS, FEW_FILES = 100_000, 8


def materialise(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    rows: about how many narrow rows it has at most, so that few do not make many files. They
    are dealt anew for that, since a task that reads many partitions holds the sort buffers of
    all. The table is deleted when the driver's JVM ends.
    """
    if rows is not None and rows <= FEW_FILES * FILE_ROWS:
        df = df.repartition(max(1, -(-rows // FILE_ROWS)))
    spark = bounded(df.sparkSession)
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; the folds of the contracts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def release() -> None:
    """Give a Python worker's freed memory back: workers are used again, and what they keep adds up."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


#: Characters of a very long text that a Python worker splits into words at once.
BLOCK = 1 << 20


def word_blocks(text: str, size: int = BLOCK):
    """The white-space separated words of a text, a bounded list at a time."""
    if len(text) <= size:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and not text[end].isspace() and end < at + 2 * size:
            end += 1
        yield text[at:end].split()
        at = end


#: Rows, and bytes as Spark reckons them from the stored files, up to which a lookup table is broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if it is small by size and by count. df is a stored table, or a projection or filter of one."""
    reckoned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if reckoned <= size and df.limit(rows + 1).count() <= rows else df


#: A key that holds more than one in so many rows is hot: there are fewer than HOT hot keys, whatever the table.
HOT = 1000


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", count: str = "n") -> DataFrame:
    """left joined to right by key, right's count telling the rows of left that a key has: hot keys' rows stay where they are.

    right is a stored table with a row a key. Fewer than HOT of its keys can be hot, so these are named in a filter and
    broadcast; the others are joined by shuffle, where no key brings more than one in HOT rows.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in right.where(F.col(count) * HOT > total).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key).unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))
