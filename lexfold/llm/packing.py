"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents. A window visits the queues in order;
queue s gains a quantum of ``N_s / n_windows`` tokens (or of its target's share)
and sends whole documents while a token of its deficit is left. What the last one
takes beyond it is owed, and what is left is carried to the next window. Before
window w a queue has thus been allowed ``N_s * w // n_windows`` tokens, whatever
happened before, so a document's window follows from its place in its queue, and
any partition can take the round up where another left it. Windows follow each
other without a gap and are cut into sequences: a document is cut at a sequence's
end alone, and the last sequence alone can be short.

Token ids are made once and written to the shared folder; places in a queue and in
the stream are sums carried forward, so no queue is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, ship, small

SEQUENCE = 1024
#: Sequences of a window for each queue, on average: some documents of each.
QUEUE_SEQUENCES = 16
#: Windows whose sizes one task sums up.
CHUNK = 4096
#: Words a worker remembers the ids of.
CACHE = 400_000
VOCABULARY = "byte_bpe_50k.json"

_loaded: dict = {}


class Encoder:
    """Token ids of a text, equal to the tokenizer file's own, remembered by word.

    Byte-level pre-tokens never cross a space or a line's end unless white space
    follows white space; where none does, a text is its words, each encoded once.
    Other texts are encoded whole, and those that hold a special token by the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast, self.runs = self._ranks(path), re.compile(r"\s\s")
        self.first, self.after = {}, {}
        self.end = np.zeros(1, self.kind).tobytes()
        self.line = self.whole("\n")

    def _ranks(self, path: str):
        """The same vocabulary in tiktoken's form, where it lies beside the file; None else."""
        import base64
        import os

        twin = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(twin):
            return None
        import public_tokenizers
        import tiktoken

        with open(twin, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        if self.fast is not None and not any(t in text for t in self.specials):
            return np.array(self.fast.encode_ordinary(text), self.kind).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """The ids and the closing 0, little-endian, 2 or 4 bytes an id."""
        if not text:
            return self.end
        if self.fast is None or any(t in text for t in self.specials) or self.runs.search(text) or text[0].isspace() or text[-1].isspace():
            return self.whole(text) + self.end
        first, after, whole, parts = self.first, self.after, self.whole, []
        if len(first) + len(after) > CACHE:
            first.clear()
            after.clear()
        for n, line in enumerate(text.split("\n")):
            if n:
                parts.append(self.line)
            words = line.split(" ")
            w = words[0]
            got = first.get(w)
            if got is None:
                got = first[w] = whole(w)
            parts.append(got)
            for w in words[1:]:
                got = after.get(w)
                if got is None:
                    got = after[w] = whole(" " + w)
                parts.append(got)
        parts.append(self.end)
        return b"".join(parts)


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, doc_id, source, n, at, ids), written: doc_id as text; at counts the tokens of the source before, in this part."""
    ship(docs.sparkSession)
    spec = [F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part, sent = encoder(path), TaskContext.get().partitionId(), {}
        for b in batches:
            ids = [own(t) for t in b["text"]]
            n, at = [len(x) // own.kind.itemsize for x in ids], []
            for s, k in zip(b["source"], n, strict=True):
                at.append(sent.get(s, 0))
                sent[s] = at[-1] + k
            yield pd.DataFrame({"part": np.full(len(ids), part, np.int64), "doc_id": b["doc_id"], "source": b["source"], "n": np.array(n, np.int64), "at": np.array(at, np.int64), "ids": ids})
        own.first.clear()
        own.after.clear()
        release()

    return materialise(docs.select(*spec).mapInPandas(encode, "part long, doc_id string, source string, n long, at long, ids binary"), "packing-ids")


def queues(stored: DataFrame, window: int, targets: dict[str, float] | None = None) -> DataFrame:
    """(source, n, windows), written: a queue's tokens, and in how many windows they are sent."""
    found = materialise(stored.groupBy("source").agg(F.sum("n").alias("n")), "packing-queues", stored.select("source").distinct().count())
    big = lambda c: F.col(c).cast("decimal(38,0)")
    if targets is None:
        every = found.agg(F.sum("n")).first()[0] or 0
        return found.withColumn("windows", F.lit(max(1, -(-every // window))).cast("long"))
    given = {s: max(1e-6, float(x)) for s, x in targets.items()}
    share = F.lit(1e-6)
    if given:
        share = F.coalesce(F.create_map(*(F.lit(x) for pair in given.items() for x in pair))[F.col("source")], share)
    shared = found.withColumn("share", share)
    total = shared.agg(F.sum("share")).first()[0] or 1.0
    quantum = F.greatest(F.lit(1.0), F.round(F.lit(window * 1e6) * F.col("share") / total)).cast("decimal(38,0)")
    return shared.select("source", "n", F.greatest(F.lit(1), F.ceil(big("n") * 10**6 / quantum)).cast("long").alias("windows"))


def placed(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n, ids, place): each document's first place in the stream. found: queues()."""
    # a part's first place in each queue
    sums = stored.groupBy("part", "source").agg(F.sum("n").alias("m"))
    most = found.agg(F.count("*").alias("queues"), F.coalesce(F.max("windows"), F.lit(0)).alias("windows")).first()
    parts = (stored.agg(F.max("part")).first()[0] or 0) + 1
    before = F.sum("m").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carry = materialise(sums.select("part", "source", F.coalesce(before, F.lit(0)).alias("before")).join(found, "source").select("part", "source", "before", F.col("n").alias("top"), "windows"), "packing-carry", parts * most["queues"])
    df = stored.join(small(carry), ["part", "source"]).withColumn("p", F.col("before") + F.col("at"))
    # the first window in which the queue is allowed a token more than it has sent
    df = df.withColumn("w", F.expr("((cast(p as decimal(19,0)) + 1) * cast(windows as decimal(18,0)) - 1) div top"))
    sent = df.groupBy("w", "source").agg(F.sum("n").alias("m"), F.min("p").alias("first"))
    sent = materialise(sent.withColumn("chunk", F.expr(f"w div {CHUNK}")), "packing-sent", (most["windows"] + 1) * most["queues"])
    ahead = lambda over, *order: F.coalesce(F.sum("m").over((Window.partitionBy(over) if over else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    windows = sent.groupBy("chunk", "w").agg(F.sum("m").alias("m"))
    chunks = windows.groupBy("chunk").agg(F.sum("m").alias("m")).select("chunk", ahead(None, "chunk").alias("a"))
    windows = windows.select("chunk", "w", ahead("chunk", "w").alias("b")).join(chunks, "chunk").select("w", "a", "b")
    starts = sent.select("w", "source", "first", ahead("w", "source").alias("c")).join(windows, "w")
    starts = materialise(starts.select("w", "source", (F.col("a") + F.col("b") + F.col("c") - F.col("first")).alias("shift")), "packing-starts", sent.count())
    return df.join(small(starts), ["w", "source"]).select("doc_id", "n", "ids", (F.col("p") + F.col("shift")).alias("place"))


def packed(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, window: int | None = None, targets: dict[str, float] | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of documents in sequences of ``sequence`` tokens, a row each.

    doc_id (of docs' type), start (ids of the document before the piece), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit), doc_tokens (ids of the
    document with the closing 0), sequence_id, offset (in the sequence, from 0
    without gap), and with_ids the ids themselves. window: tokens of a round.
    targets: shares by source; by default each source's share of all tokens, which
    all windows then hold alike. A source that runs out leaves its share to the
    others; one without a target comes at a millionth of them.

    A null or empty text is its closing 0 alone. Null sources are one queue, with the
    empty one. Very long texts are encoded whole. Repeated rows are packed each. An
    empty table returns no row. Of other columns only the named ones are read.
    """
    path = path or tokenizer_path()
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    stored = encoded(docs, path, id_col, text_col, source_col)
    if not window:
        window = sequence * QUEUE_SEQUENCES * max(1, stored.select("source").distinct().count())
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    width = 2 if _small(path) else 4

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            rows = []
            for doc_id, n, raw, place in zip(*(b[c] for c in ("doc_id", "n", "ids", "place")), strict=True):
                ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")
                n, place, done = int(n), int(place), 0
                while done < n:
                    take = min(n - done, sequence - place % sequence)
                    own = ids[done : done + take]
                    rows.append((doc_id, done, take, zlib.crc32(own.tobytes()), n, place // sequence, place % sequence, *([own.tolist()] if with_ids else ())))
                    done, place = done + take, place + take
            yield pd.DataFrame(rows, columns=names)

    ship(docs.sparkSession)
    got = placed(stored, queues(stored, window, targets)).mapInPandas(cut, schema)
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


def _small(path: str) -> bool:
    return encoder(path).kind.itemsize == 2
