"""Boilerplate lines by site-relative frequency.

A line's frequency in a host is the share of the host's pages that contain it.
Pages are distinct texts, so exact copies of one page do not make its lines look
like boilerplate. Lines are counted by 64-bit hash, and a host has at most its
mean lines a page / ratio lines over the ratio: a short list that is joined to
the documents by host, so no text is shuffled while the lists are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACES, materialise, small

RATIO = 0.01
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _worded(line: Column) -> Column:
    return F.trim(line, F.lit(ASCII_SPACES)) != ""


def frequencies(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, line, pages, host_pages): distinct pages with each worded line, by hash; lines of one page left out."""
    pages = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("__t"))
    totals = materialise(pages.select("host", "h").distinct().groupBy("host").agg(F.count("*").alias("host_pages")), "linededup-pages")
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("__t")), _worded), lambda x: F.xxhash64(x)))
    counts = pages.select("host", "h", F.explode(own).alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("pages")).where("pages > 1")
    return counts.join(small(totals), "host")


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, drop), written: hashes of the lines that more than ratio of a host's pages, and min_pages of them, contain."""
    over = frequencies(docs, text_col, host_col).where((F.col("pages") >= min_pages) & (F.col("pages") > ratio * F.col("host_pages")))
    return materialise(over.groupBy("host").agg(F.collect_list("line").alias("drop")), "linededup-drop")


def stripped(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", host_col: str = "source", spare: bool = True) -> DataFrame:
    """docs with boilerplate lines cut from text, and __n_lines and __n_dropped.

    A null host is a site of its own, with the empty one. Lines without a word are
    neither counted nor dropped. A text of boilerplate lines alone is left as it
    is, as the query's SQL says, unless spare is false: it then loses them like any
    other, and only its lines without a word are left. Null texts stay null; very
    long texts are read whole; repeated rows are treated alike; an empty table
    returns no row. Other columns are passed on, whatever their names, but for the
    two counts, which replace columns of their names.
    """
    drop = small(boilerplate(docs, ratio, min_pages, text_col, host_col))
    df = docs.select(F.struct("*").alias("r"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")).join(drop, "host", "left")
    text = F.col("r")[text_col]
    lines = _lines(text)
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~_worded(x) | ~F.array_contains(F.col("drop"), F.xxhash64(x))))
    df = df.select("r", lines.alias("lines"), kept.alias("kept"))
    if spare:
        df = df.withColumn("kept", F.when(F.exists("kept", _worded), F.col("kept")).otherwise(F.col("lines")))
    dropped = F.size("lines") - F.size("kept")
    text = F.when(dropped > 0, F.array_join("kept", "\n")).otherwise(text)
    counts = {"__n_lines": F.size("lines").cast("long"), "__n_dropped": dropped.cast("long")}
    return df.select(*((text if c == text_col else F.col("r")[c]).alias(c) for c in docs.columns if c not in counts), *(v.alias(k) for k, v in counts.items()))
