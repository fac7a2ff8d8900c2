"""Token ids in files of Simple-8b words.

A word has 64 bits: the upper four are a selector, which says how many ids of how many
bits the other sixty hold; a value that sixty bits cannot hold is escaped, as two words
of selector 0 with a half each. Blocks of 1,024 ids begin with a word of their own, and
their first words' places are stored, so any block is decoded without those before it;
words of one selector are decoded at once.

A file is Parquet with a row a segment: whole documents in a row, about a million ids,
with their ids, lengths, words and block offsets. Files follow each other in ascending
order of doc_id. Spark's own writer commits them, so a task that is run twice leaves one
file, and any store that Spark writes to will do. What comes before a segment in its
file is stored with it, what comes before a file is a sum over files when it is read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded, release, ship
from .packing import tokenizer_path

#: Ids a word and bits an id, by selector; selector 0 is the escape.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.uint8)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint8)
#: The bit of an escape's word that tells the upper half.
UPPER = np.uint64(1 << 59)
BLOCK = 1024
#: Ids after which a segment ends with its document.
SEGMENT = 1 << 20
#: Pieces of text that a worker remembers the ids of, and characters of texts that it cuts at once.
CACHE, CHARS = 500_000, 8 << 20
END = 2

_SELECTOR = np.zeros(61, np.uint8)
_SELECTOR[COUNTS] = np.arange(len(COUNTS))
#: The largest count that so many ids have room for.
_FITS = np.array([max(int(c) for c in COUNTS if c <= room) for room in range(61)], np.uint8)
#: Bits of the values that most ids are.
_WIDTHS = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.uint8)


# words


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, uint8."""
    if len(values) and values.max() < len(_WIDTHS):
        return _WIDTHS[values]
    v, out = values.astype(np.uint64), np.zeros(len(values), np.uint8)
    for s in (32, 16, 8, 4, 2, 1):
        over = v >> np.uint64(s) > 0
        out[over] += np.uint8(s)
        v = np.where(over, v >> np.uint64(s), v)
    return out + (v > 0).astype(np.uint8)


def _counts(values: np.ndarray, block: int) -> np.ndarray:
    """For each place, how many ids a word takes that begins there: the most that fit and lie in its block; 0 is an escape."""
    n, width = len(values), widths(values)
    best, most = (width <= BITS[-1]).astype(np.uint8), width.copy()
    for k in range(2, 61):
        if k > n:
            break
        window = most[: n - k + 1]
        np.maximum(window, width[k - 1 :], out=window)
        s = _SELECTOR[k]
        if s:
            fits = window <= BITS[s]
            if not fits.any():
                break
            best[: n - k + 1][fits] = k
    room = np.minimum(block - np.arange(n) % block, 60)
    return np.minimum(best, _FITS[room])


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): unsigned values of up to 64 bits as words, and the place of each block's first."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    best, begins = _counts(values, block), np.zeros(n, bool)
    first = np.arange(0, n, block)
    at, stop = first, np.minimum(first + block, n)
    while len(at):  # a word of every block at a time
        begins[at] = True
        at = at + np.maximum(best[at], 1)
        more = at < stop
        if not more.all():
            at, stop = at[more], stop[more]
    start = np.flatnonzero(begins)
    count = best[start]
    place = np.cumsum(1 + (count == 0)) - 1 - (count == 0)
    words = np.zeros(len(start) + int((count == 0).sum()), np.uint64)
    for s in np.unique(_SELECTOR[count]):
        own = _SELECTOR[count] == s
        i, p = start[own], place[own]
        if not s:
            words[p] = UPPER | (values[i] >> np.uint64(32))
            words[p + 1] = values[i] & np.uint64(0xFFFFFFFF)
            continue
        w = np.full(len(i), int(s) << 60, np.uint64)
        for j in range(COUNTS[s]):
            w |= values[i + j] << np.uint64(j * int(BITS[s]))
        words[p] = w
    return words, place[np.searchsorted(start, first)].astype(np.uint32)


def decode(words: np.ndarray) -> np.ndarray:
    """The values of whole blocks' words."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    count = COUNTS[selector].astype(np.int64)
    escape = selector == 0
    upper = escape & (words & UPPER > 0)
    count[upper] = 1
    place = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s in np.unique(selector):
        if not s:
            i = np.flatnonzero(upper)
            out[place[i]] = (words[i] & np.uint64(0xFFFFFFFF)) << np.uint64(32) | words[i + 1]
            continue
        own = selector == s
        w, p, bits = words[own], place[own], int(BITS[s])
        for j in range(COUNTS[s]):
            out[p + j] = (w >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    return out


def part_of(words: np.ndarray, offsets: np.ndarray, start: int, stop: int, block: int = BLOCK) -> np.ndarray:
    """Values start to stop of a segment, from the blocks that hold them alone."""
    if start >= stop:
        return np.zeros(0, np.uint64)
    a, b = start // block, (stop - 1) // block + 1
    return decode(words[offsets[a] : offsets[b] if b < len(offsets) else None])[start - a * block : stop - a * block]


# ids


def _joined(texts: pa.LargeStringArray) -> str:
    """The texts one after the other, as they lie in memory."""
    _, offsets, data = texts.buffers()
    edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return data[int(edge[0]) : int(edge[-1])].to_pybytes().decode()


class Encoder:
    """Ids of many texts by the tokenizer file, which sees each piece once.

    A byte-level tokenizer begins a word before a single space, or line's end, between
    characters that are no white space, whatever comes before. There texts are cut. A
    piece is named by what follows its space, a line's first by its line's end and \\x01,
    a text's first by \\x01. New pieces are encoded in one go, and told apart by their
    bytes. Texts with other white space, and those of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        cut = made["pre_tokenizer"] or {}
        self.by_piece = cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True) and not made["normalizer"]
        if self.by_piece:
            self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
            self.by_piece = len(self._whole("\na")) == 2
        self.runs = re.compile(r"\s\s")
        self.known, self.used = pa.array([], pa.large_string()), 0
        self.flat, self.start, self.size, self.met = np.zeros(1 << 16, np.uint32), *(np.zeros(0, np.int64) for _ in range(3))

    def shrink(self, most: int) -> None:
        """Forgets pieces that were met least, until so many are left."""
        least = 1
        while len(self.known) > most:
            kept = np.flatnonzero(self.met > least)
            least *= 2
            size = self.size[kept]
            ends = np.cumsum(size)
            self.flat = self.flat[np.repeat(self.start[kept] - ends + size, size) + np.arange(size.sum())]
            self.known = self.known.take(pa.array(kept))
            self.start, self.size, self.met, self.used = ends - size, size, self.met[kept], len(self.flat)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, names: pa.Array) -> None:
        if not len(names):
            return
        marked = pc.match_substring(names, "\x01")
        # a text's first piece is put after a line's end, which is then left out
        texts = pc.if_else(marked, pc.replace_substring_regex(names, "^\n?\x01", "\n"), pc.binary_join_element_wise(pa.scalar(" ", names.type), names, pa.scalar("", names.type)))
        ids = self._whole(_joined(texts))
        stop = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(pc.binary_length(texts).to_numpy()), "right")
        start = np.concatenate([[0], stop[:-1]]) + pc.starts_with(names, "\x01").to_numpy(zero_copy_only=False)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.known = pa.concat_arrays([self.known, names])
        self.start, self.size = np.concatenate([self.start, start + self.used]), np.concatenate([self.size, stop - start])
        self.met = np.concatenate([self.met, np.zeros(len(names), np.int64)])
        self.used += len(ids)

    def _common(self, text: str) -> bool:
        return self.by_piece and "\x01" not in text and not (self.runs.search(text) or text[0].isspace() or text[-1].isspace() or any(t in text for t in self.specials))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32, a text each."""
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        some, size = [], 0
        for i, t in enumerate(texts):
            if t and self._common(t):
                some.append(i)
                size += len(t)
                if size > CHARS:
                    self._cut(texts, some, out)
                    some, size = [], 0
            elif t:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        self._cut(texts, some, out)
        return out

    def _cut(self, texts: list[str], some: list[int], out: list[np.ndarray]) -> None:
        if not some:
            return
        pieces = pc.split_pattern(pa.array(["\x01" + texts[i].replace("\n", " \n\x01") for i in some], pa.large_string()), " ")
        named = pieces.values.dictionary_encode()
        if len(self.known) > CACHE:
            self.shrink(CACHE // 2)
        own = pc.index_in(named.dictionary, value_set=self.known)
        self._learn(named.dictionary.filter(pc.is_null(own)))
        own = own.to_numpy(zero_copy_only=False)
        new = np.isnan(own)
        own = np.where(new, len(self.known) - new.sum() + np.cumsum(new) - 1, np.nan_to_num(own)).astype(np.int64)
        places = named.indices.to_numpy()
        self.met[own] += np.bincount(places, minlength=len(own))
        which = own[places]
        size = self.size[which]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[which] - ends + size, size) + np.arange(ends[-1])]
        edge = np.concatenate([[0], ends])[pieces.offsets.to_numpy()]
        for k, i in enumerate(some):
            out[i] = ids[edge[k] : edge[k + 1]]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


# files


def gathered(batches: Iterator[pa.RecordBatch], most: int = CHARS) -> Iterator[pa.Table]:
    """Batches put together until they have so many bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def written(docs: DataFrame, out: str, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> None:
    """Writes documents' ids, each with the closing one, to files at out, in ascending order of doc_id, null ids first.

    Documents of one id, and rows that repeat, are stored each, in the order of their
    texts' hashes; no id is dealt to one task for it. A null or empty text is its closing
    id alone. Very long texts are encoded whole. An empty table makes a folder without
    segments.
    """
    spark = ship(docs.sparkSession)
    path = path or tokenizer_path()
    kind = docs.select(id_col).schema[0].dataType
    order = ["doc_id", "__h", "__n"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("__h"), F.monotonically_increasing_id().alias("__n"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = f"part long, at long, n long, doc_ids array<{kind.simpleString()}>, lengths array<long>, words binary, offsets binary"
    arrow = to_arrow_type(kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at, n, names, ids = encoder(path), TaskContext.get().partitionId(), 0, 0, [], []

        def closed() -> pa.RecordBatch:
            words, offsets = encode(np.concatenate(ids))
            columns = [pa.array([part]), pa.array([at]), pa.array([n]), pa.array([names], pa.list_(arrow)), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([words.astype("<u8").tobytes()]), pa.array([offsets.astype("<u4").tobytes()])]
            return pa.RecordBatch.from_arrays(columns, ["part", "at", "n", "doc_ids", "lengths", "words", "offsets"])

        for b in gathered(batches):
            for name, got in zip(b.column(0).to_pylist(), own(b.column(1).to_pylist()), strict=True):
                ids.append(np.append(got, np.uint32(end)))
                names.append(name)
                n += len(ids[-1])
                if n >= segment:
                    yield closed()
                    at, n, names, ids = at + n, 0, [], []
        if ids:
            yield closed()
        own.shrink(CACHE // 2)
        release()

    bounded(spark)
    rows.mapInArrow(pack, schema).write.option("compression", "none").parquet(out)


def segments(spark: SparkSession, out: str) -> DataFrame:
    """(start, n, doc_ids, lengths, words, offsets): the files' segments; start: ids before it."""
    found = spark.read.parquet(out)
    parts = found.groupBy("part").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(parts.select("part", before.alias("before")))  # a row a file
    return found.join(first, "part").select((F.col("before") + F.col("at")).alias("start"), "n", "doc_ids", "lengths", "words", "offsets")


def documents(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), and with_ids the ids, from the files."""
    found = segments(spark, out)
    kind = found.schema["doc_ids"].dataType.elementType
    schema = f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    arrow = to_arrow_type(kind)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                start, names, lengths, words = (b.column(c)[row] for c in ("start", "doc_ids", "lengths", "words"))
                ids = decode(np.frombuffer(words.as_py(), "<u8")).astype("<u4")
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [names.values.cast(arrow), pa.array(start.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                columns += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64)))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        release()

    ship(spark)
    return found.select("start", "doc_ids", "lengths", "words").mapInArrow(unpack, schema)


def between(spark: SparkSession, out: str, start: int, stop: int) -> DataFrame:
    """(start, ids): ids start to stop of all, by segment; only segments and blocks that hold them are read and decoded."""
    found = segments(spark, out).where((F.col("start") < stop) & (F.col("start") + F.col("n") > start))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a, z = max(start - r["start"], 0), min(stop - r["start"], r["n"])
                ids = part_of(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<u4"), a, z)
                yield pa.RecordBatch.from_arrays([pa.array([r["start"] + a]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["start", "ids"])

    ship(spark)
    return found.select("start", "n", "words", "offsets").mapInArrow(take, "start long, ids array<long>")
