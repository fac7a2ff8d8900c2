"""Keys that are done, as a table part that grows by runs: hash buckets, each with Bloom filters.

A key belongs to a bucket, which is a folder of a run's, and in it to a page, whose
filter is a bitmap of the engine's size; bitmaps of several runs are merged by OR. A batch
of few keys reads the filters of the buckets that its keys fall into, and then of these
buckets the keys themselves, where a filter says that one may be there; one of many keys
would fall into all of them, and reads the keys at once.

A commit adds its keys as they are (RECENT), which is one small write; FAN of those are
made a run, and FAN runs of a level are merged into one of the next, so there are few
runs, and a key is written again as often as there are levels. A merged run has as many
folders of keys as its number asks for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Add, Log, State, frame, schema_text, written

BUCKETS = 64
#: Bitmaps a bucket; with the engine's 32,768 bits each and HASHES of them a key, 2.7 million keys pass wrongly in 1 of 100 cases.
PAGES, BITS, HASHES = 16, 32_768, 4
#: Runs of a level that are merged into one.
FAN = 8
KEYS, FILTERS, RECENT = "keys", "filters", "recent"
#: Keys a folder of a merged run, at least, while it has fewer than BUCKETS of them.
FOLDER = 1 << 17
#: Keys of a batch from which on it reads no filters: some fall into every bucket, and one that passes has its keys read.
MANY = 16 * BUCKETS


def _placed(df: DataFrame) -> DataFrame:
    """df, which has a key as text, with the key's places: bucket, page, at."""
    h = F.xxhash64("key")
    places = F.array(*(F.pmod(F.xxhash64("key", F.lit(i)), F.lit(BITS)) for i in range(HASHES)))
    return df.select("*", F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"), F.pmod(F.shiftright(h, 20), F.lit(PAGES)).cast("int").alias("page"), places.alias("at"))


def _named(keys: DataFrame, key: str) -> DataFrame:
    """(key, bucket, page, at): distinct keys that are not null, as text, and their places."""
    return _placed(keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct())


def _may_hold(df: DataFrame) -> DataFrame:
    """Rows of (at, bits) all of whose places are set."""
    return df.where("forall(at, p -> (shiftright(cast(conv(hex(substring(bits, cast(p div 8 as int) + 1, 1)), 16, 10) as int), cast(p % 8 as int)) & 1) = 1)")


def _run(log: Log, keys: DataFrame, level: int, key: str = "key", folders: int = BUCKETS) -> tuple[list[Add], dict[str, str]]:
    """A run's keys and filters, written, and their schemas."""
    named = _named(keys, key)
    add = written(named.select("key", (F.col("bucket") % folders).alias("bucket")).repartition("bucket"), log, KEYS, ("bucket",))
    stored = keys.sparkSession.read.schema("key string, bucket int").parquet(f"{log.path}/{add.path}")
    filters = _placed(stored.select("key")).select("bucket", "page", F.explode("at").alias("p")).groupBy("bucket", "page").agg(F.bitmap_construct_agg("p").alias("bits"))
    mask = written(filters.repartition("bucket"), log, FILTERS, ("bucket",))
    kinds = {KEYS: schema_text(stored), FILTERS: schema_text(filters)}
    return [Add(add.path, KEYS, {"level": level, "buckets": _buckets(log, add), "of": folders}), Add(mask.path, FILTERS, {"level": level, "buckets": _buckets(log, mask)})], kinds


def _buckets(log: Log, add: Add) -> list[int]:
    """The folders that were written, BUCKETS at most."""
    from pyarrow import fs

    names = (f.base_name for f in log.fs.get_file_info(fs.FileSelector(f"{log.root}/{add.path}")))
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def run(log: Log, keys: DataFrame, key: str) -> tuple[list[Add], dict[str, str]]:
    """A commit's keys as a run of its own, for many at once."""
    return _run(log, keys, 0, key)


def recent(log: Log, keys: DataFrame, key: str) -> tuple[list[Add], dict[str, str]]:
    """What a commit adds for its keys: these alone, until ``merged`` makes a run of several commits'."""
    df = keys.select(F.col(key).cast("string").alias("key")).where("key is not null")
    return [written(df, log, RECENT)], {RECENT: schema_text(df)}


def _inside(hit: set[int] | None):
    """The folders of a run that hold buckets, all of them where hit is None."""

    def names(a: Add) -> list[str]:
        there = a.note["buckets"]
        if hit is not None:
            of = a.note.get("of", BUCKETS)
            there = sorted(set(there) & {b % of for b in hit})
        return [f"bucket={b}" for b in there]

    return names


def found(log: Log, state: State, batch: DataFrame, key: str) -> DataFrame:
    """(key): those of the batch's keys, as text, that are done at the state."""
    return among(log, state, batch.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct())


def among(log: Log, state: State, asked: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of asked whose key (text, not null) is done at the state; n: how many there are, if that is known."""
    spark, stored = asked.sparkSession, []
    if state.of(RECENT):
        stored.append(frame(spark, log, state, RECENT))
    if state.of(KEYS):
        hit, columns = None, asked.columns
        if n is None or n < MANY:
            placed = _placed(asked)
            hit = {r["bucket"] for r in placed.select("bucket").distinct().collect()}
            filters = frame(spark, log, state, FILTERS, _inside(hit)).groupBy("bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
            # joined by shuffle: what is broadcast passes the driver, with every batch anew
            may = _may_hold(placed.join(filters.hint("merge"), ["bucket", "page"])).select(*columns, "bucket")
            hit = {r["bucket"] for r in may.select("bucket").distinct().collect()}
            if not stored:  # else a key may be among the recent ones alone
                asked = may.select(*columns)
        stored.append(frame(spark, log, state, KEYS, _inside(hit)).select("key"))
    if not stored:
        return asked.limit(0)
    return asked.join(reduce(DataFrame.unionByName, stored).hint("merge"), "key", "left_semi").select(*asked.columns)


def merged(spark: SparkSession, log: Log) -> int:
    """Makes FAN recent commits' keys a run, and merges FAN runs of a level into one of the next, as long as there are so many; how often."""
    n = 0
    while True:
        state = log.state()
        levels: dict[int, list[Add]] = {-1: state.of(RECENT)}
        for a in state.of(KEYS):
            levels.setdefault(a.note["level"], []).append(a)
        level = next((k for k in sorted(levels) if len(levels[k]) >= FAN), None)
        if level is None:
            return n
        old = [a.path for a in levels[level]]
        part = State(state.version, tuple(levels[level]), state.schemas, state.last)
        keys = frame(spark, log, part, RECENT if level < 0 else KEYS, None if level < 0 else _inside(None)).select("key")
        folders, many = 1, keys.count()
        while folders < BUCKETS and folders * FOLDER < many:
            folders *= 2
        adds, kinds = _run(log, keys, level + 1, folders=folders)
        gone = old + [a.path for a in state.of(FILTERS) if a.note["level"] == level]
        log.commit(adds, gone, kinds, base=state)
        n += 1
