"""Annotation as a stream: resumption, durable append, pacing and chat sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limiter import RateLimited
from ..sources import snapshots
from . import done, sink
from .sessions import SESSION, ordered_sessions, started  # noqa: F401
from .sink import once  # noqa: F401

#: A batch's keys while it is run, which no version of the table names.
ASKED = "asked"


def clause_stream(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 1) -> DataFrame:
    """A folder of JSONL tasks as a stream, so many files a trigger: the pace of a rate-limited model."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).json(path)


def annotate_stream(tasks: DataFrame, annotate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "clause_index", every: str | None = None, unfinished: str | None = None) -> StreamingQuery:
    """Annotates what has no result yet and appends the results to the snapshot table out (``snapshots.read``).

    A batch's results and their keys are one version of the table, under the batch's
    number and the checkpoint's name: a batch that is run again changes nothing, and a
    new checkpoint, whose numbers start anew, adds to what is there. Keys with a result
    are looked up in the index of done keys (``done``), whatever stream or run they come
    from. Where another stream commits first, results of keys that it has done meanwhile
    are left out; the model is not called again. Rows without a key are annotated each.

    unfinished: a condition for results that are none, as ``status = 'rate_limited'``.
    The others are kept, and the stream stops with RateLimited; started again it goes on
    with what is left of the batch.
    """
    log, who = snapshots.Log(out), sink.identity(checkpoint)

    def without(rows: DataFrame, state: snapshots.State) -> DataFrame:
        over = done.found(log, state, rows, key).withColumnRenamed("key", "__done")
        return rows.join(over, F.col(key).cast("string") == F.col("__done"), "left_anti")

    @contextmanager
    def left_of(batch: DataFrame, state: snapshots.State) -> Iterator[tuple[DataFrame, bool]]:
        """The batch's tasks that have no result, a row a key, and whether there are any. Its keys are read first, so that texts are read once, and shuffled where some are left out alone."""
        spark, paths = batch.sparkSession, []

        def kept(df: DataFrame) -> DataFrame:
            paths.append(snapshots.written(df, log, ASKED).path)
            return spark.read.schema(df.schema).parquet(f"{log.path}/{paths[-1]}")

        try:
            named = F.col(key).isNotNull()
            asked = kept(batch.groupBy(F.col(key).alias("own")).agg(F.count("*").alias("n")).select(F.col("own").cast("string").alias("key"), "own", "n"))
            keys, rows, nameless = asked.agg(F.count("own"), F.coalesce(F.sum(F.when(F.col("own").isNotNull(), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("own").isNull(), F.col("n"))), F.lit(0))).first()
            over, have = None, 0
            if keys and (state.of(done.RECENT) or state.of(done.KEYS)):
                over = kept(done.among(log, state, asked.select("key", "own").where("own is not null"), keys).select(F.col("own").alias("__done")))
                have = over.count()
            tasks = batch.where(named) if nameless else batch
            if have == keys:
                tasks = tasks.limit(0)
            else:
                if rows > keys:
                    tasks = tasks.dropDuplicates([key])
                if have:  # by shuffle, see done
                    tasks = tasks.join(over.hint("merge"), F.col(key) == F.col("__done"), "left_anti")
            yield tasks.unionByName(batch.where(~named)) if nameless else tasks, bool(nameless or have < keys)
        finally:
            for p in paths:
                log.fs.delete_dir(f"{log.root}/{p}")

    def run(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, log.state()
        if state.has(who, number):
            return
        add, stop = None, False
        with left_of(batch, state) as (tasks, some):
            got = annotate(tasks)
            if some:
                add = snapshots.written(got, log)
        kind = got.schema
        if add and unfinished:
            made = spark.read.schema(kind).parquet(f"{log.path}/{add.path}")
            left = F.coalesce(F.expr(unfinished), F.lit(False))
            stop = not made.where(left).isEmpty()
            if stop:
                add = snapshots.written(made.where(~left), log)
        while True:
            adds, schemas = [], {snapshots.PART: snapshots.schema_text(got)}
            if add:
                rows = spark.read.schema(kind).parquet(f"{log.path}/{add.path}")
                keys, kinds = done.recent(log, rows, key)
                adds, schemas = [add, *keys], schemas | kinds
            try:
                log.commit(adds, schemas=schemas, who=None if stop else who, number=None if stop else number, base=state, blind=False)
                break
            except snapshots.Conflict:
                state = log.state()
                if add:
                    add = snapshots.written(without(rows, state), log)
        done.merged(spark, log)
        if stop:
            raise RateLimited(f"batch {number} is not finished: the model refuses more calls")

    writer = tasks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def chat_sessions(events: DataFrame, reset: str = "upload") -> DataFrame:
    """A stream of (session_id, turn, role, content) with session_no and the number of turns before in it.

    A turn of the resetting role starts a session anew. State is two numbers a session id.
    For turns that come in order: those of one trigger are ordered here, so a task holds
    a session's turns of a trigger. ``ordered_sessions`` takes any order.
    """
    import pandas as pd

    def step(key: tuple, batches, state: GroupState):
        number, turns = state.get if state.exists else (0, 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values("turn", kind="stable").itertuples(index=False):
            if r.role == reset:
                number, turns = number + 1, 0
            else:
                rows.append((key[0], number, r.turn, r.role, r.content, turns))
                turns += 1
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SESSION.split(", ")])
        state.update((number, turns))

    return events.groupBy("session_id").applyInPandasWithState(step, SESSION, "number int, turns int", "append", GroupStateTimeout.NoTimeout)


def running_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and column, late rows dropped beyond the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"))
