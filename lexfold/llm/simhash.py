"""Near-duplicates: by SimHash fingerprints, and exactly by the similarity of shingle sets.

- ``near_duplicates``: 64 bits, a plain majority over word shingles, in a byte-position
  inverted index with count filtering. Texts link at ``MAX_BITS`` differing bits, hence
  share at least six of eight positional bytes; lists are of joint values, since that of
  a single byte would hold 1/256 of the corpus.
- ``keep_first``: texts link at a Jaccard similarity of 0.8 of their shingles, and no
  link is left out. Shingles are put in one order, rare ones first; two similar sets
  share one among the first fifth of each (prefix filter, Chaudhuri, Ganti and Kaushik
  2006; bounds by place, Xiao et al. 2008; by parity bitmaps, Sandes et al. 2020), so
  these are an index in which all similar pairs meet. The order decides what is looked
  at, not what is found.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, materialise, ship, small

SEED = 42
MAX_BITS = 2
SHARED_BYTES = 8 - MAX_BITS
#: Block pairs of the coarse index; block b is bytes 2b and 2b + 1.
BLOCK_PAIRS = list(itertools.combinations(range(4), 2))
#: Each two positions that two differing bits can lie in; the six others are a list's key.
FREE = list(itertools.combinations(range(8), 2))

WORDS, PERCENT = 5, 80
#: Shingles are counted by so many leading bits of their hash, and written in so many parts.
COUNT_BITS, COUNT_PARTS = 20, 64
#: Parity bitmap: longs a set of shingles.
LONGS = 8
#: Lists longer than that are held against so many centres first; a task then meets so many members of a list with as many others.
LONG, CENTRES, CHUNK = 16, 4, 256


# fingerprints


def _shingles(text: str | None, words: int):
    """The word shingles of a text as bytes, in order; words are split at ASCII white space after lower-casing A-Z."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return iter(())
    return map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])


def _hashes(shingles) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority of the bits of XXH64 (seed 42) over word shingles, repeats included; unsigned.

    Fewer words than ``words`` make one shingle of them all; none give 0.
    """
    shingles, counts, n = _shingles(text, words), np.zeros(64, np.int64), 0
    while len(h := _hashes(itertools.islice(shingles, 1 << 16))):
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of a text's distinct word shingles, sorted."""
    return np.unique(_hashes(_shingles(text, words)))


def parities(own: np.ndarray) -> np.ndarray:
    """A bit a place, set if an odd number of a set's shingles fall there: two sets differ in as many shingles at least as in bits."""
    odd = np.bincount((own & np.uint64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix(own: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set by rank, so many that any set of the similarity shares one with it, in order."""
    order = np.lexsort((own, ranks[(own >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
    return own[order[: len(own) + (-len(own) * percent // 100) + 1]]


def node(own: np.ndarray) -> int:
    """What stands for a set of shingles; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)) if len(own) else 0


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


# links of 64 bits


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) * (x >> 63)).cast("long")


def _met(fps: DataFrame) -> DataFrame:
    """The fingerprints that share four positional bytes, in two of four blocks, with another one."""
    keys = F.array(*(F.struct(F.lit(i).alias("pair"), F.shiftleft(_block(F.col("fp"), a), 16).bitwiseOR(_block(F.col("fp"), b)).alias("key")) for i, (a, b) in enumerate(BLOCK_PAIRS)))
    posted = fps.select(F.explode(keys).alias("k"), "fp").select("k.pair", "k.key", "fp")
    # of a list with two members the least and the greatest differ
    several = posted.groupBy("pair", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b")
    return posted.join(several.select("pair", "key"), ["pair", "key"], "left_semi").select("fp").distinct()


def shared_bytes(x: Column, y: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    d = x.bitwiseXOR(y)
    return sum(((F.shiftrightunsigned(d, 8 * i).bitwiseAND(F.lit(0xFF).cast("long")) == 0).cast("int") for i in range(1, 8)), (d.bitwiseAND(F.lit(0xFF).cast("long")) == 0).cast("int"))


def links(fps: DataFrame) -> DataFrame:
    """(x, y), x < y: links between distinct fingerprints, which join the same components as all links would; written.

    Two fingerprints within two bits share six positional bytes and meet in the list
    of these six. A list's members differ in its two free bytes alone, so it has
    65,536 members at most, however large the corpus or a group of near copies; and
    its links need no pairs: each member posts itself with none or one of the
    sixteen free bits flipped. Who meets there is within two bits of each other, and
    any two within two bits meet. A value has 17 members at most, joined by a star.
    """
    met = materialise(_met(fps), "simhash-met")
    free = [(0xFF << 8 * a) | (0xFF << 8 * b) for a, b in FREE]
    lists = F.array(*(F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(_signed(~m & (1 << 64) - 1)).alias("key")) for i, m in enumerate(free)))
    posted = met.select(F.explode(lists).alias("k"), "fp").select("k.list", "k.key", "fp")
    several = posted.groupBy("list", "key").agg(F.count("*").alias("n")).where("n > 1").select("list", "key")
    flips = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(_signed(1 << 8 * p + bit) for p in pair for bit in range(8))) for pair in FREE)), F.col("list") + 1)
    near = posted.join(several, ["list", "key"], "left_semi").select("list", "fp", F.explode(flips).alias("bit")).select("list", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("value"))
    stars = near.groupBy("list", "value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(F.array_min("fps").alias("x"), F.explode("fps").alias("y")).where("x < y")
    x, y = F.col("x"), F.col("y")
    return materialise(stars.where((shared_bytes(x, y) >= SHARED_BYTES) & (F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS)).distinct(), "simhash-links", 8 * met.count())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of undirected edges (x, y): root is the smallest node reachable.

    Alternating large-star and small-star rounds; the smallest neighbour is an
    aggregate joined back, hubs by broadcast, so a hub's neighbours never meet in one
    task. Each round is written, and rounds end when the edges no longer change.
    """
    edges = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v")
    state = (edges.count(), None)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least = materialise(least, "simhash-least", 2 * state[0])
        large = joined(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialise(near, "simhash-round", 2 * state[0])
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, first, n) with component_id, the smallest first of each component; written."""
    found = components(edges)
    if found.isEmpty():
        return nodes.withColumn("component_id", F.col("first"))
    found = materialise(found.union(found.select("root", "root")).distinct(), "simhash-components", 2 * found.count())
    firsts = found.join(nodes, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    ids = found.join(firsts, "root").select("node", "component_id")
    return materialise(nodes.join(ids, "node", "left").withColumn("component_id", F.coalesce("component_id", "first")), "simhash-named", nodes.count())


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component, as doc_id's type).

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows return a row each. A null doc_id returns a row and is never a component's
    smallest unless the component has no other id. Very long texts are read whole,
    a bounded part at a time. An empty table returns no row. Other columns of docs
    are ignored, whatever their names.
    """
    by_doc = materialise(fingerprints(docs, words, id_col, text_col).withColumnRenamed("fp", "node"), "simhash-docs")
    nodes = materialise(by_doc.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-fps", by_doc.count())
    named = _named(nodes, links(nodes.select(F.col("node").alias("fp"))))
    got = joined(by_doc, named, "node")
    return got.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


# links by similarity


def ranked(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How common shingles of docs (text) are: a class of 0 to 255 for each value of their hash's leading bits."""
    size = (1 << COUNT_BITS) // COUNT_PARTS

    def counted(batches):
        n, held, rows = np.zeros(1 << COUNT_BITS, np.int32), [], 0

        def add() -> None:
            nonlocal n, held, rows
            if held:
                n += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(n)).astype(np.int32)
            held, rows = [], 0

        for b in batches:
            for t in b["text"]:
                held.append((shingle_set(t, words) >> np.uint64(64 - COUNT_BITS)).astype(np.int32))
                rows += len(held[-1])
                if rows > 1 << 20:
                    add()
        add()
        if n.any():
            yield pd.DataFrame({"part": range(COUNT_PARTS), "n": [zlib.compress(n[i * size : (i + 1) * size].tobytes(), 1) for i in range(COUNT_PARTS)]})

    parts = docs.select("text").mapInPandas(counted, "part int, n binary").rdd.map(lambda r: (r[0], np.frombuffer(zlib.decompress(bytes(r[1])), np.int32).astype(np.int64)))
    classes = parts.reduceByKey(lambda a, b: a + b, COUNT_PARTS).mapValues(lambda n: np.minimum(255, 8 * np.log2(n + 1)).astype(np.uint8).tobytes())
    ranks = np.zeros(1 << COUNT_BITS, np.uint8)
    for part, got in classes.collect():  # 1 MB, whatever the corpus
        ranks[part * size : (part + 1) * size] = np.frombuffer(got, np.uint8)
    return ranks


def _few_bits(x: str, y: str, percent: int) -> Column:
    """Whether the bitmaps of two rows, by the aliases x and y, let their sets have the similarity."""
    bits = sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(1, LONGS)), F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))))
    return bits * (100 + percent) <= (F.col(f"{x}.size") + F.col(f"{y}.size")) * (100 - percent)


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose sets of shingles (node, s) have a Jaccard similarity of percent at least."""
    ship(pairs.sparkSession)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            out.append(shared * (100 + percent) >= (len(p) + len(q)) * percent)
        return pd.Series(out, dtype=bool)

    both = pairs.join(sets.select(F.col("node").alias("x"), F.col("s").alias("a")), "x").join(sets.select(F.col("node").alias("y"), F.col("s").alias("b")), "y")
    return both.where(alike("a", "b")).select("x", "y")


def _verified(pairs: DataFrame, bitmaps: DataFrame, sets_of, percent: int) -> DataFrame:
    met = pairs.distinct().join(bitmaps.alias("p"), F.col("x") == F.col("p.node")).join(bitmaps.alias("q"), F.col("y") == F.col("q.node"))
    pairs = materialise(met.where(_few_bits("p", "q", percent)).select("x", "y"), "simhash-pairs")
    sets = sets_of(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct())
    return materialise(similar(pairs, sets, percent), "simhash-links", pairs.count())


def _central(lists: DataFrame) -> DataFrame:
    """Pairs (x, y) of lists' (key, node, at) members with CENTRES of them, those with the fewest rarer shingles; the same ones where lists are alike.

    What no other text of a group has is rare and comes before the key, so these are nearest to what the group is copied from.
    """
    least = [F.min(F.when(F.pmod("node", F.lit(CENTRES)) == i, F.struct("at", "node")))["node"] for i in range(CENTRES)]
    centres = materialise(lists.groupBy("key").agg(F.count("*").alias("n"), F.array_compact(F.array(*least)).alias("c")), "simhash-centres", lists.count() // LONG)
    return joined(lists.select("key", "node"), centres, "key").select("node", F.explode("c").alias("c")).where("node <> c").select(F.least("node", "c").alias("x"), F.greatest("node", "c").alias("y"))


def _apart(members: DataFrame) -> DataFrame:
    """Pairs (x, y) that meet in lists of members (key, node, root, size, reach), are not yet of one root and may be similar.

    Of two such members one at least is not of its list's most frequent root. These meet
    all others, CHUNK by CHUNK, so that no task holds a list.
    """
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
    kinds = by_root.agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("most")).where("most.c < n")
    chunks = lambda c: F.ceil(c / F.lit(CHUNK)).cast("int")
    kinds = kinds.select("key", "n", F.col("most.root").alias("most"), chunks(F.col("n")).alias("all"), chunks(F.col("n") - F.col("most.c")).alias("few"))
    left = materialise(joined(members, materialise(kinds, "simhash-kinds"), "key").drop("n"), "simhash-apart")
    dealt = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.where("root <> most").withColumn("j", dealt("few", 1)).withColumn("i", copies("all")).alias("p")
    other = left.withColumn("i", dealt("all", 0)).withColumn("j", copies("few")).alias("q")
    here = (F.col("p.key") == F.col("q.key")) & (F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j"))
    new = (F.col("p.root") != F.col("q.root")) & ((F.col("q.root") == F.col("q.most")) | (F.col("p.node") < F.col("q.node")))
    near = (F.col("p.size") <= F.col("q.reach")) & (F.col("q.size") <= F.col("p.reach"))
    met = one.join(other, here & new & near)
    return met.select(F.least("p.node", "q.node").alias("x"), F.greatest("p.node", "q.node").alias("y"))


def similar_links(nodes: DataFrame, keys: DataFrame, sets_of, percent: int = PERCENT) -> DataFrame:
    """(x, y): links of nodes (node, size, b0..), with keys (node, keys), at the similarity, which join the same components as all links would; written.

    keys is a set's ``prefix``, size the number of its shingles. A list is that of one key,
    so any two similar nodes meet in the list of the first key that they share; what follows
    that key in either set bounds what they have in common, and hence the other's size
    (reach). Members of lists of more than LONG are held against some centres first: members
    that these links join need not meet again, so a large group of near copies costs a few
    rows a member. All other pairs of a list are met, but for those that sizes, places or
    bitmaps show to be unlike. sets_of gives (node, s) of some nodes (node).
    """
    bitmaps = nodes.select("node", "size", *(f"b{i}" for i in range(LONGS)))
    posted = keys.select("node", F.posexplode("keys").alias("at", "key"))
    sized = materialise(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    lists = materialise(joined(posted, sized, "key"), "simhash-lists")
    links = _verified(_central(lists.where(F.col("n") > LONG).select("key", "node", "at")), bitmaps, sets_of, percent)
    roots = components(links)
    roots = materialise(roots.union(roots.select("root", "root")).distinct(), "simhash-roots", 2 * links.count())
    reach = F.floor((F.col("size") - F.col("at")) * (100 + percent) / F.lit(percent) + F.lit(1e-9)) - F.col("size")
    members = lists.drop("n").join(nodes.select("node", "size"), "node").withColumn("reach", reach.cast("int")).drop("at")
    members = materialise(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-members")
    return materialise(links.union(_verified(_apart(members), bitmaps, sets_of, percent)), "simhash-links", lists.count())


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, component_id) of docs (doc_id, text): texts linked at a Jaccard similarity of percent over words-word shingles; written.

    Null and empty texts, which have no shingle, are one group. Rows with a null
    doc_id are left out. Repeated rows return a row each; an empty table none.
    """
    ship(docs.sparkSession)

    named = docs.select("doc_id", "text").where("doc_id is not null")
    ranks = ranked(named, words)

    @F.pandas_udf("node long, size int, bits array<long>, keys array<long>")
    def printed(texts: pd.Series) -> pd.DataFrame:
        own = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"node": [node(s) for s in own], "size": [len(s) for s in own], "bits": [parities(s) for s in own], "keys": [prefix(s, ranks, percent).view(np.int64) for s in own]})

    @F.pandas_udf("node long, s binary")
    def listed(texts: pd.Series) -> pd.DataFrame:
        own = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"node": [node(s) for s in own], "s": [s.tobytes() for s in own]})

    by_doc = materialise(named.select("doc_id", printed("text").alias("m")).select("doc_id", "m.*"), "simhash-docs")
    bits = [F.any_value(F.col("bits")[i]).alias(f"b{i}") for i in range(LONGS)]
    nodes = materialise(by_doc.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.any_value("size").alias("size"), *bits), "simhash-nodes")
    # of equal sets one posts its keys; ids of the others are few, or joined by shuffle
    several = small(materialise(nodes.where("n > 1").select("node", "first"), "simhash-several"))
    copies = small(materialise(by_doc.select("doc_id", "node").join(several, "node").where("doc_id <> first").select("doc_id", "node").distinct(), "simhash-copies"))
    keys = by_doc.join(copies, ["doc_id", "node"], "left_anti").select("node", "keys")

    def sets_of(some: DataFrame) -> DataFrame:
        some = materialise(some.join(nodes.select("node", F.col("first").alias("doc_id")), "node"), "simhash-some", nodes.count() // 4)
        texts = named.join(small(some.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", listed("text").alias("m")).select("doc_id", "m.node", "m.s")
        # sets are held against each other only where an id has rows alike
        again = small(twice)
        once = texts.join(again, "doc_id", "left_anti").union(texts.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "node"]))
        return materialise(some.join(once, ["doc_id", "node"]).select("node", "s"), "simhash-sets")

    twice = materialise(by_doc.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").distinct(), "simhash-repeated", by_doc.count() // 2)
    found = similar_links(nodes, keys, sets_of, percent)
    return materialise(joined(by_doc.select("doc_id", "node"), _named(nodes.select("node", "first", "n"), found), "node").select("doc_id", "component_id"), "simhash-groups", by_doc.count())


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their group: the smallest doc_id of each component of similar texts, once.

    Null and empty texts are one group. Rows with a null doc_id are kept, having no
    identity to compare. Of rows that repeat a doc_id the one with the smallest text
    hash stays. Very long texts are read whole. An empty table returns no row. Other
    columns are passed on, whatever their names.
    """
    found = groups(docs, words, percent)
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"))
    twice = materialise(twice, "simhash-twice", found.count() // 2)
    gone = materialise(found.groupBy("doc_id").agg(F.bool_or(F.col("component_id") == F.col("doc_id")).alias("stays")).where("not stays").select(F.col("doc_id").alias("__id")), "simhash-gone", found.count())
    gone, again = small(gone), small(twice)
    kept = docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    if twice.isEmpty():
        return kept
    # rows are compared by id only where ids repeat
    once = kept.join(again, kept["doc_id"] == again["__id"], "left_anti")
    several = kept.join(again, kept["doc_id"] == again["__id"], "left_semi")
    rows = several.select(F.struct(*(several[c] for c in docs.columns)).alias("r"))
    at = F.row_number().over(Window.partitionBy("r.doc_id").orderBy(F.xxhash64("r.text")))
    return once.unionByName(rows.withColumn("n", at).where("n = 1").select("r.*"))
