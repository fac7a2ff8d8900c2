"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

The index stores a posting (document, term, position) for every document word
that some test item has, in the shared folder; a posting of the empty term holds
each document's length. Terms are 64-bit hashes, which can only add candidates:
every match is verified word by word.

Each window of an item is looked up by its ``RAREST`` terms of lowest frequency
in the index. Their lists, moved back by the terms' offsets, are intersected: a
window can occur where all of them meet on one alignment (document, item,
offset). Alignments that pass are compared with the document's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, small

WINDOW = 13
RAREST = 3
PERCENT = 5
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of 0-9, a-z and all beyond ASCII, after lower-casing A-Z; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), "")


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, w): distinct items with words; item identifies the row."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0).distinct()
    return materialise(rows.select(F.xxhash64("item_id", "w").alias("item"), "item_id", "w"), "decontam-items", 50 * benchmark.count())


def index(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, t, pos), written: postings of the tests' terms; h is the text's hash.

    A posting of the empty term stands at each document's length.
    """
    terms = tests.select(F.explode("w").alias("x")).select(F.xxhash64("x").alias("t"))
    vocabulary = materialise(terms.union(docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("t"))).distinct(), "decontam-terms", terms.count() + 1)
    every = F.concat(words(F.col(text_col)), F.array(F.lit("")))
    exploded = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.posexplode(every).alias("pos", "x"))
    return materialise(exploded.select("doc_id", "h", F.xxhash64("x").alias("t"), "pos").join(small(vocabulary), "t", "left_semi"), "decontam-index")


def _probes(tests: DataFrame, postings: DataFrame, window: int, rarest: int) -> DataFrame:
    """(item, item_id, w, wins): wins are (s, need): a window's first place and its rarest terms' places.

    Windows with a term that no document has are left out, and items without other windows.
    """
    counts = postings.groupBy("t").agg(F.count("*").alias("f"))
    places = tests.select("item", F.posexplode("w").alias("ipos", "x")).select("item", "ipos", F.xxhash64("x").alias("t"))
    known = places.join(counts, "t", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("ipos", F.coalesce("f", F.lit(0)).alias("f")))).alias("p"))
    win = F.expr(f"""filter(transform(sequence(0, greatest(0, size(p) - {window})), s -> named_struct('s', s, 'need',
        transform(slice(array_sort(transform(slice(p, s + 1, {window}), x -> named_struct('f', x.f, 'ipos', x.ipos))), 1, {rarest}), x -> x))), y -> y.need[0].f > 0)""")
    wins = known.select("item", F.transform(win, lambda y: F.struct(y["s"].alias("s"), F.transform(y["need"], lambda x: x["ipos"]).alias("need"))).alias("wins"))
    return tests.join(wins, "item").where(F.size("wins") > 0)


def alignments(postings: DataFrame, tests: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(doc_id, h, item, delta, starts): windows, by first place, whose rarest terms meet at an offset."""
    probes = materialise(_probes(tests, postings, window, rarest), "decontam-probes", 50 * tests.count())
    last = F.greatest(F.lit(0), F.size("w") - window).alias("last")
    places = probes.select("item", "w", last, F.explode(F.array_distinct(F.flatten("wins.need"))).alias("ipos")).select("item", "last", "ipos", F.xxhash64(F.element_at("w", F.col("ipos") + 1)).alias("t"))
    # a document may begin inside an item (delta < 0); it then holds the windows from place -delta on
    met = postings.join(small(places), "t").where(F.col("pos") - F.col("ipos") + F.col("last") >= 0).select("doc_id", "h", "item", (F.col("pos") - F.col("ipos")).alias("delta"), "ipos")
    seeds = met.groupBy("doc_id", "h", "item", "delta").agg(F.collect_set("ipos").alias("got"))
    wins = F.filter("wins", lambda y: (F.col("delta") + y["s"] >= 0) & (F.size(F.array_except(y["need"], F.col("got"))) == 0))
    kept = seeds.join(small(probes.select("item", "wins")), "item")
    return kept.select("doc_id", "h", "item", "delta", F.transform(wins, lambda y: y["s"]).alias("starts")).where(F.size("starts") > 0)


def matches(docs: DataFrame, postings: DataFrame, tests: DataFrame, window: int = WINDOW, rarest: int = RAREST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, item, a, b), written: verified occurrences, words a to b - 1 of the document; windows that touch are one.

    A document's alignments are places alone. They go to its words, and each takes
    the stretch of words that it is about to its item: no item's words are gathered
    in a document's row, however many of its places they fit.
    """
    found = materialise(alignments(postings, tests, window, rarest), "decontam-alignments")
    named = found.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("dh")).agg(F.collect_list(F.struct("item", "delta", "starts")).alias("c"))
    keys = small(materialise(found.select(F.col("doc_id").alias("d"), F.col("h").alias("dh")).distinct(), "decontam-found", found.count()))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("__t"))
    same = lambda x: (F.col("h") == x["dh"]) & F.col("doc_id").eqNullSafe(x["d"])
    texts = texts.join(keys, same(keys), "left_semi").dropDuplicates(["doc_id", "h"])
    read = texts.join(named, same(named)).select("doc_id", "h", words(F.col("__t")).alias("w"), F.explode("c").alias("x"))
    read = read.select("doc_id", "h", "x.*", F.array_min("x.starts").alias("s"), F.array_max("x.starts").alias("z"), "w")
    parts = read.select("doc_id", "h", "item", "delta", "starts", "s", F.expr(f"slice(w, delta + s + 1, z - s + {window})").alias("part"))
    met = parts.join(small(tests.select("item", "w")), "item").withColumn("len", F.least(F.lit(window), F.size("w")))
    # a digit for each word: whether document and item agree on it
    same_word = F.expr("array_join(zip_with(part, slice(w, s + 1, size(part)), (x, y) -> case when x <=> y then '1' else '0' end), '')")
    met = met.select("doc_id", "h", "item", "delta", "starts", "s", "len", same_word.alias("e"))
    ok = "filter(array_sort(starts), p -> substring(e, p - s + 1, len) = repeat('1', len))"
    merged = f"""aggregate({ok}, cast(array() as array<struct<a:int,b:int>>), (r, p) -> case when size(r) > 0 and r[size(r) - 1].b >= delta + p
        then concat(slice(r, 1, size(r) - 1), array(named_struct('a', r[size(r) - 1].a, 'b', delta + p + len))) else concat(r, array(named_struct('a', delta + p, 'b', delta + p + len))) end)"""
    spans = met.select("doc_id", "h", "item", F.explode(F.expr(merged)).alias("r"))
    return materialise(spans.select("doc_id", "h", "item", "r.a", "r.b"), "decontam-spans")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and h (the text's hash), for every row.

    A null or empty text has no words and is clean. An item of fewer words than
    the window is one window; one without words is none. Rows of the benchmark that
    repeat, or share an id, count once in n_items. Repeated documents return a row
    each. Very long texts and items are read whole. A null item_id takes part in n_hit and is in no id list. Either table may
    be empty; other columns are ignored, whatever their names.
    """
    tests = items(benchmark)
    postings = index(docs, tests, id_col, text_col)
    spans = matches(docs, postings, tests, window, RAREST, id_col, text_col)
    hits = spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    covered = F.expr("aggregate(spans, named_struct('n', 0, 'end', 0), (x, y) -> named_struct('n', x.n + greatest(0, y.b - greatest(y.a, x.end)), 'end', greatest(x.end, y.b)), x -> x.n)")
    hits = hits.select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), covered.cast("long").alias("n"))
    of = spans.select("doc_id", "h", "item").distinct().join(small(tests.select("item", "item_id")), "item")
    ids = of.groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("dh2")).agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    hits = hits.join(ids, (F.col("dh") == F.col("dh2")) & F.col("d").eqNullSafe(F.col("d2"))).select("d", "dh", "n", "ids")
    lengths = postings.where(F.col("t") == F.xxhash64(F.lit(""))).select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))
    got = lengths.join(hits, (F.col("h") == F.col("dh")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    n_hit, found = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return got.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * F.lit(100) >= F.col("n_words") * F.lit(percent))).alias("contaminated"),
        "h",
    )


def proximity(postings: DataFrame, tests: DataFrame, slop: int = 3, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(doc_id, h, item, delta, n): places where a window's rarest terms all stand within slop words of their alignment.

    Exact phrases are among them; n is how many windows' terms meet there. delta is
    a cell of 2 * slop + 1 offsets, each offset being read in the cells of its neighbours.
    """
    probes = _probes(tests, postings, window, rarest)
    places = probes.select("item", "w", F.explode(F.array_distinct(F.flatten("wins.need"))).alias("ipos")).select("item", "ipos", F.xxhash64(F.element_at("w", F.col("ipos") + 1)).alias("t"))
    cell = 2 * slop + 1
    met = postings.join(small(places), "t").select("doc_id", "h", "item", (F.col("pos") - F.col("ipos")).alias("delta"), "ipos")
    cells = met.select("doc_id", "h", "item", "ipos", F.explode(F.array_distinct(F.array(F.floor((F.col("delta") - slop) / cell), F.floor((F.col("delta") + slop) / cell)))).alias("cell"))
    seeds = cells.groupBy("doc_id", "h", "item", "cell").agg(F.collect_set("ipos").alias("got"))
    n = F.size(F.filter("wins", lambda y: F.size(F.array_except(y["need"], F.col("got"))) == 0))
    return seeds.join(probes.select("item", "wins"), "item").select("doc_id", "h", "item", (F.col("cell") * cell).alias("delta"), n.alias("n")).where("n > 0")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; same columns.

    A document is contaminated by report's rule, so null and empty texts stay, all rows
    of a repeated contaminated document go, and an empty table returns no row. Very
    long texts are read whole. Other columns are passed on, whatever their names.
    """
    bad = report(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct()
    bad = small(materialise(bad, "decontam-bad", docs.count()))
    return docs.join(bad, (F.xxhash64(docs["text"]) == bad["__h"]) & docs["doc_id"].eqNullSafe(bad["__d"]), "left_anti")
