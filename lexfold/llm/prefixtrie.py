"""A trie of conversations by their first turns.

A node is a sequence of first turns. Turns become digests, and each turn of a
conversation carries the digest of the sequence up to it, a running sum of hashes that
know their place, so that no task holds a conversation for it. Equal conversations are
one path with a weight. Paths are hash-partitioned by their first turn, and a subtrie of
more than LIMIT turns by the turn after it, and so on: since every prefix has its
digest, all levels of that are found by one count. What is left of a path below its
oversized prefixes goes to its subtrie's task, which builds the trie as dictionaries of
pointers and walks it in postorder. Oversized nodes are put together from what their
subtries report: a node's sums are those of the paths through it, where each node below
counts on one path alone, that of its smallest conversation.

No task holds more than LIMIT turns. The digest of ids that end at a node is made from
chunks of them in order, one after the other, as such a digest must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import running
from .common import joined, materialise, ship, small

#: Turns that a subtrie holds at most where it is built.
LIMIT = 2_000
#: Characters of joined ids in a chunk.
CHUNK = 1 << 16
ROOT = hashlib.md5(b"0,0,0").hexdigest()
NONE = hashlib.sha256(b"").hexdigest()

NODE = "node string, parent string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, key, chars): turns by place from 0, ordered by turn, null first, then by role and key; key is a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.length(text).cast("long").alias("chars")).where("conv_id is not null")
    return running(rows, "conv_id", ["turn", "role", "key"], i=F.lit(1)).select("conv_id", (F.col("i") - 1).alias("i"), "key", "chars")


def rebuilt(turns: DataFrame, stride: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which a conversation begins with another one's turns. turns: ordered(), stored.

    Of conversation c these are the first h of c - c % stride, h = crc32(c as text) % most;
    c's own after its first h follow. conversations: (conv_id, len), also of those without turns.
    """
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.col("conv_id") - F.col("conv_id") % stride
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = convs.withColumns({"h": h, "base": base}).join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("m")), "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("m", F.lit(0)))).withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = materialise(plan.select("conv_id", "base", "h", "taken", "len", "n"), "trie-conversations")
    heads = turns.where((F.col("conv_id") % stride == 0) & (F.col("i") < most - 1)).withColumnRenamed("conv_id", "base")
    begun = plan.join(heads, "base").where("i < h").select("conv_id", "len", "i", "key", "chars")
    own = joined(turns, plan.select("conv_id", "len", "taken", "h", "n"), "conv_id").where("i >= h")
    own = own.select("conv_id", "len", (F.col("taken") + F.col("i") - F.col("h")).alias("i"), "key", "chars")
    return begun.unionByName(own), plan.select("conv_id", "len")


def prefixed(turns: DataFrame) -> DataFrame:
    """(conv_id, len, depth, node, parent, key, chars), written: each turn with the digests of the turns up to it, and before it."""
    hashes = {name: F.xxhash64(F.lit(seed), F.col("i"), F.col("key")).cast("decimal(20,0)") for name, seed in (("a", 1), ("b", 2))}
    rows = running(turns.withColumns({"h" + k: v for k, v in hashes.items()}), "conv_id", ["i"], a=F.col("ha"), b=F.col("hb"))
    digest = lambda depth, a, b: F.md5(F.concat_ws(",", depth.cast("string"), a.cast("decimal(38,0)").cast("string"), b.cast("decimal(38,0)").cast("string")).cast("binary"))
    node = digest(F.col("i") + 1, F.col("a"), F.col("b"))
    parent = digest(F.col("i"), F.col("a") - F.col("ha"), F.col("b") - F.col("hb"))
    return materialise(rows.select("conv_id", "len", (F.col("i") + 1).alias("depth"), node.alias("node"), parent.alias("parent"), "key", "chars"), "trie-turns")


class Trie:
    """Paths as dictionaries of pointers: a node's children by their turn's key."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.rows: list[list] = [[None, None, 0, None, 0, 0]]  # node, parent, depth, smallest conversation, conversations, characters

    def step(self, at: int, key: str, node: str, parent: str, depth: int, chars: int, conv: int, weight: int) -> int:
        """The node below at by a turn, on which so many more conversations lie."""
        down = self.children[at].get(key)
        if down is None:
            down = self.children[at][key] = len(self.rows)
            self.children.append({})
            self.rows.append([node, parent, depth, conv, 0, chars])
        row = self.rows[down]
        row[4] += weight
        row[3] = min(row[3], conv)
        return down

    def nodes(self) -> Iterator[tuple]:
        """Rows of NODE in postorder; what a subtrie's top hangs on is not known here."""
        for top in self.children[0].values():
            stack, leaves, saved = [(top, None, iter(self.children[top].values()))], [0], [0]
            while stack:
                at, above, below = stack[-1]
                down = next(below, None)
                if down is not None:
                    stack.append((down, self.rows[at][3], iter(self.children[down].values())))
                    leaves.append(0)
                    saved.append(0)
                    continue
                stack.pop()
                node, parent, depth, conv, n, chars = self.rows[at]
                n_leaves, sum_saved = leaves.pop() or 1, saved.pop() + (n - 1) * chars
                yield node, parent, depth, conv, above, n, len(self.children[at]), n_leaves, sum_saved
                if stack:
                    leaves[-1] += n_leaves
                    saved[-1] += sum_saved


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    trie, last, at = Trie(), None, 0
    for conv, depth, key, node, parent, chars, n in sorted(zip(*(rows[c].tolist() for c in ("conv_id", "depth", "key", "node", "parent", "chars", "n")), strict=True)):
        at = trie.step(at if conv == last else 0, key, node, parent, depth, chars, conv, n)
        last = conv
    out = pd.DataFrame(list(trie.nodes()), columns=[c.split()[0] for c in NODE.split(", ")])
    return out.astype({"parent_conv_id": "Int64"})


def ids_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): of the ids in ascending order, comma-joined. ends: (node, conv_id).

    Ids are joined range by range, in chunks; a node's chunks then pass one task in order.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, node, ids, size = TaskContext.get().partitionId(), 0, None, [], 0
        out: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_pydict(dict(zip(("node", "part", "seq", "ids"), map(list, zip(*out, strict=True)), strict=True)))
        for b in batches:
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n != node or size > CHUNK:
                    if ids:
                        out.append((node, part, seq, ",".join(ids)))
                    node, ids, size, seq = n, [], 0, seq + 1
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield flush()
                out.clear()
        if ids:
            out.append((node, part, seq, ",".join(ids)))
            yield flush()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            out = []
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    got = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(chunks, "node string, part long, seq long, ids string")
    return got.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "ids").mapInArrow(digests, "node string, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Nodes of the trie of conversations, a row each.

    turns: (conv_id, len, i, key, chars), i from 0 to len - 1; conversations: (conv_id, len),
    stored, also those without turns. conv_id of a node is its smallest member; node and
    parent are digests of the sequences; n_leaves counts nodes without children in the
    subtree, its top included; saved_tokens sums (n_convs - 1) times the characters of a
    node's last turn over it; ends_sha256 is of the ids of conversations that end there. limit: turns of a subtrie
    that one task builds.

    Without conversations there is no node, without turns the root alone.
    """
    spark = ship(turns.sparkSession)
    every = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).first()
    root = "node string, parent string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    if not every["n"]:
        return spark.createDataFrame([], root + ", ends_sha256 string")
    paths = prefixed(turns)
    ends = paths.where("depth = len").select("node", "conv_id", "len").unionByName(conversations.where("len = 0").select(F.lit(ROOT).alias("node"), "conv_id", F.col("len")))
    own = materialise(ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("len").alias("len")).drop("node"), "trie-paths")
    rows = materialise(joined(paths.drop("len"), own, "conv_id", count="len"), "trie-rows")

    # prefixes with too many turns below: all levels at once
    sizes = rows.groupBy("node").agg(F.sum(F.col("len") - F.col("depth") + 1).alias("size"), F.count("*").alias("paths"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("first"), *(F.max(c).alias(c) for c in ("parent", "depth", "chars")))
    over = materialise(sizes.where(F.col("size") > limit), "trie-oversized")
    marked = joined(rows, over.select("node", "paths", "first", "n_convs"), "node", "left", "paths").select(*rows.columns, "first", "n_convs")

    path = Window.partitionBy("conv_id").orderBy("depth")
    light = marked.where("first is null").withColumn("top", F.first("node").over(path)).select("top", "conv_id", "n", "depth", "node", "parent", "key", "chars")
    built = materialise(light.groupBy("top").applyInPandas(_built, NODE), "trie-nodes")
    tops = built.where("parent_conv_id is null")

    # oversized nodes: their own savings count on their smallest conversation's path, a subtrie's on its own's
    none = F.lit(0).cast("long")
    heavy = marked.where("first is not null").select("conv_id", "depth", "node", F.when(F.col("first") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("chars")).otherwise(none).alias("s"), none.alias("l"))
    hung = heavy.unionByName(tops.select("conv_id", "depth", F.lit(None).cast("string").alias("node"), F.col("saved_tokens").alias("s"), F.col("n_leaves").alias("l")))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hung.withColumns({"s": F.sum("s").over(below), "l": F.sum("l").over(below)}).where("node is not null").groupBy("node").agg(F.sum("s").alias("saved_tokens"), F.sum("l").alias("n_leaves"))
    hanging = over.select("parent").unionByName(tops.select("parent")).groupBy("parent").agg(F.count("*").alias("n_children"))
    upper = over.join(sums, "node").join(hanging.withColumnRenamed("parent", "node"), "node", "left").na.fill(0, ["n_children"])
    upper = materialise(upper.select("node", "parent", "depth", F.col("first").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens"), "trie-upper")
    first = upper.unionByName(tops).where("depth = 1").agg(F.count("*").alias("children"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_leaves", "saved_tokens"))).first()
    head = spark.createDataFrame([(ROOT, None, 0, every["first"], None, every["n"], first["children"], first["n_leaves"] or 1, first["saved_tokens"])], root)

    names = upper.unionByName(head).select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    hung = upper.unionByName(tops).join(small(materialise(names, "trie-parents")), "parent").withColumn("parent_conv_id", F.col("above")).drop("above")
    nodes = built.where("parent_conv_id is not null").unionByName(hung).unionByName(head)
    return nodes.join(ids_digest(ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))


def tried(conversations: DataFrame, limit: int = LIMIT, stride: int = 100, most: int = 6) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node, parent.

    conversations: conv_id, turn, role, text. Null roles and texts are empty ones; turns
    without a number come first; turns of one number are ordered by role and text's
    digest, so repeated rows are turns each. Rows without conv_id are no conversation.
    Very long texts and conversations are read whole; an empty table has no node. Of
    other columns none is read. stride, most: see rebuilt().
    """
    turns = materialise(ordered(conversations), "trie-ordered")
    nodes = trie(*rebuilt(turns, stride, most), limit)
    first = [c.split()[0] for c in NODE.split(", ")][2:]
    return nodes.select("conv_id", *(c for c in first if c != "conv_id"), "ends_sha256", "node", "parent")
