"""How far sources of a language differ in their words, by deduplicated count columns.

A term is the sparse vector of its counts by source. Terms with one vector are one
column with a multiplicity: every pair of sources in it is evaluated once and
multiplied. Sources that a vector does not name share one probability, that of no
occurrence, so pairs with one such side are evaluated from counts alone: per source
and count, how many terms there are. Terms themselves are ranked one by one.

All arithmetic is in whole numbers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)) and
f = floor((p - q)^2 / (p + q)).

Words are counted within a task before they are shuffled. A term's row holds as many
counts as its language has sources; the result has the square of that.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, ship, small

MIN_DOCS = 10
TOP_TERMS = 10
#: Counts that a task holds before it passes them on, and bytes of a text that it splits at once.
HELD = 300_000
BLOCK = 1 << 20

#: A-Z to a-z, ASCII other than letters to a space: what is between spaces is a term.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, a bounded list at a time: runs of ASCII letters and of anything beyond ASCII, A-Z lower-cased."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): a term's occurrences, and documents that hold it, in a language's source."""
    ship(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = defaultdict(lambda: (Counter(), Counter()))

        def held() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
            found.clear()

        size = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, docs = found[lang, source]
                before, own = len(n), set()
                for some in terms(text):
                    n.update(some)
                    own.update(some)
                docs.update(own)
                size += len(n) - before
                if size > HELD:
                    yield from held()
                    size = 0
        yield from held()
        release()

    got = texts.mapInArrow(tally, "lang string, source string, term binary, n long, docs long")
    return got.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(found: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, vector), written: terms in at least so many documents of the language; vector: (source, n) by source. found: counts()."""
    entry = F.struct("source", "n")
    per = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("vector"))
    return materialise(per.where(F.col("docs") >= least).drop("docs"), "divergence-terms")


def _share(n: str, size: str) -> Column:
    """1 + floor(10^9 (n + 2) / size); wider numbers only where a long would not hold the product."""
    return F.expr(f"1L + if({n} < 9000000000L, (1000000000L * ({n} + 2L)) div {size}, (1000000000BD * cast({n} + 2L as decimal(19,0))) div cast({size} as decimal(19,0)))")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def groups(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, terms, size, zero, lang_size), written: V, N + 2 V, the probability of no occurrence, and N + 2 V of the language."""
    every = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    own = kept.select("lang", F.explode("vector").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("own"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("whole"))
    df = every.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["own", "terms", "whole"])
    df = df.select("lang", "source", "terms", F.expr("own + 2 * terms").alias("size"), F.expr("whole + 2 * terms").alias("lang_size"))
    zero = F.when(F.col("terms") > 0, _share("0L", "size"))
    return materialise(df.withColumn("zero", zero), "divergence-groups", every.count())


def _of(found: DataFrame, side: str) -> DataFrame:
    """groups() with its source named side, and its size and zero by it."""
    return found.select("lang", F.col("source").alias(side), F.col("size").alias(f"size_{side}"), F.col("zero").alias(f"zero_{side}"))


def pair_values(kept: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, a, b, value): every two sources of a language, a before b, and their f summed over all kept terms. found: groups()."""
    found, key = small(found), ["lang", "a", "b"]
    every = found.select("lang", F.col("source").alias("a"), "terms", F.col("zero").alias("zero_a")).join(_of(found, "b"), "lang").where("a < b")
    base = every.select(*key, F.coalesce(F.col("terms") * _gap("zero_a", "zero_b"), F.lit(0)).alias("v"))
    vectors = materialise(kept.groupBy("lang", "vector").agg(F.count("*").alias("copies")), "divergence-vectors")
    # pairs that a vector names; what the other two parts say of them is taken off again
    first = vectors.select("lang", "vector", "copies", F.posexplode("vector").alias("at", "x"))
    both = first.select("lang", "copies", F.col("x.source").alias("a"), F.col("x.n").alias("n_a"), F.explode(F.expr("slice(vector, at + 2, size(vector))")).alias("y"))
    both = both.select("lang", "copies", "a", "n_a", F.col("y.source").alias("b"), F.col("y.n").alias("n_b")).join(_of(found, "a"), ["lang", "a"]).join(_of(found, "b"), ["lang", "b"])
    both = both.withColumn("p", _share("n_a", "size_a")).withColumn("q", _share("n_b", "size_b"))
    both = both.select(*key, (F.col("copies") * (_gap("p", "q") - _gap("p", "zero_b") - _gap("zero_a", "q") + _gap("zero_a", "zero_b"))).alias("v"))
    # a source's counts against every source's probability of none
    one = vectors.select("lang", "copies", F.explode("vector").alias("x")).groupBy("lang", F.col("x.source").alias("a"), F.col("x.n").alias("n")).agg(F.sum("copies").alias("copies"))
    one = one.join(_of(found, "a"), ["lang", "a"]).withColumn("p", _share("n", "size_a")).join(_of(found, "b"), "lang").where("a <> b")
    one = one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("copies") * (_gap("p", "zero_b") - _gap("zero_a", "zero_b"))).alias("v"))
    return base.unionByName(both).unionByName(one).groupBy(*key).agg(F.sum("v").alias("value"))


def term_values(kept: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a source holds more often than its language does."""
    of = small(found.select("lang", "source", "size", "lang_size"))
    df = kept.select("lang", "term", "total", F.explode("vector").alias("e")).select("lang", "term", "total", "e.source", "e.n").join(of, ["lang", "source"])
    df = df.withColumn("p", _share("n", "size")).withColumn("q", _share("total", "lang_size")).where("p > q")
    return df.select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))


def audited(docs: DataFrame, least: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: a source's distances to the others of its language, and the terms that set it apart.

    part 'pair': item is each other source, all ranks; part 'term': item is a term,
    ranks to top. Ties rank by item. least: documents of the language that hold a term.

    Null text, language and source are empty ones, which are groups like any other; a
    group without terms has distances too, and 0 where its language has no kept term. A
    language of one source has no pair. Very long texts are read whole, in blocks;
    repeated rows count each; an empty table gives none. Of other columns only the named
    ones are read.
    """
    kept = kept_terms(counts(docs, text_col, lang_col, source_col), least)
    found = groups(docs, kept, lang_col, source_col)
    half = pair_values(kept, found)
    pairs = half.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value").select("lang", "s.source", "s.item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranks = lambda df, part: df.withColumn("part", F.lit(part)).withColumn("rank", place).select("lang", "source", "part", "item", "value", "rank")
    return ranks(pairs, "pair").unionByName(ranks(term_values(kept, found), "term").where(F.col("rank") <= top))
