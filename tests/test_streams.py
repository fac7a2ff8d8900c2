"""Snapshot tables, the exactly-once sink, the index of done keys and ordered sessions."""

import json
import os
import random
import subprocess
import sys
import threading
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexfold import schemas, streaming
from lexfold.sources import snapshots
from lexfold.sources.snapshots import Add, Conflict, Log
from lexfold.streaming import done, sessions, sink

ROOT = str(Path(__file__).resolve().parents[1])


# snapshots


def numbers(spark, *n):
    return spark.createDataFrame([(x, f"t{x}") for x in n], "n long, t string")


def values(df):
    return sorted(r["n"] for r in df.collect())


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(ValueError, match="no rows yet"):
        snapshots.read(spark, path)
    snapshots.append(numbers(spark, 1, 2), path)
    before = snapshots.read(spark, path)
    snapshots.append(numbers(spark, 3), path)
    snapshots.replaced(spark, path, lambda df: df.where("n <> 2"))
    assert values(snapshots.read(spark, path)) == [1, 3] and values(snapshots.read(spark, path, 2)) == [1, 2, 3]
    assert values(before) == [1, 2]  # what was read stays as it was
    with pytest.raises(ValueError, match="no version 9"):
        snapshots.read(spark, path, 9)
    with pytest.raises(ValueError, match="another schema"):
        snapshots.append(spark.createDataFrame([(1,)], "other int"), path)
    snapshots.overwritten(spark.createDataFrame([(7,)], "other int"), path)
    assert [r["other"] for r in snapshots.read(spark, path).collect()] == [7] and values(snapshots.read(spark, path, 1)) == [1, 2]
    assert [(r["version"], r["added"], r["removed"]) for r in snapshots.history(spark, path).orderBy("version").collect()] == [(1, 1, 0), (2, 1, 0), (3, 1, 2), (4, 1, 1)]
    assert snapshots.replaced(spark, path, lambda df: df.limit(0)).version == 5 and snapshots.read(spark, path).count() == 0


def test_a_transaction_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.append(numbers(spark, 1), path, "w", 0).version == 1
    assert snapshots.append(numbers(spark, 1), path, "w", 0) is None
    assert snapshots.append(numbers(spark, 1), path, "other", 0).version == 2
    assert values(snapshots.read(spark, path)) == [1, 1]


def test_many_writers_make_every_version_once(tmp_path):
    """Appends from many threads: each gets a version of its own, no number is skipped, states are stored on the way."""
    path, n = str(tmp_path / "t"), 60
    threads = [threading.Thread(target=lambda i=i: [Log(path).commit([Add(f"of={i}-{k}")], schemas={"data": "{}"}) for k in range(n // 6)]) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    state = Log(path).state()
    assert state.version == n and len({a.path for a in state.adds}) == n
    assert [c["version"] for c in Log(path).history()] == list(range(1, n + 1))
    assert any(x.suffix == ".state" for x in (tmp_path / "t/_log").iterdir()) and not list((tmp_path / "t/_log").glob(".*"))
    assert len(Log(path).state(37).adds) == 37


def test_two_writers_one_wins_one_makes_its_change_again(spark, tmp_path):
    path, seen = str(tmp_path / "t"), []
    snapshots.append(numbers(spark, 1), path)

    def change(df):
        seen.append(values(df))
        if len(seen) == 1:  # another writer is first
            snapshots.append(numbers(spark, 5), path)
        return df.withColumn("n", F.col("n") + 10)

    snapshots.replaced(spark, path, change)
    assert seen == [[1], [1, 5]] and values(snapshots.read(spark, path)) == [11, 15]
    state = Log(path).state()
    snapshots.append(numbers(spark, 2), path)
    with pytest.raises(Conflict):
        Log(path).commit([Add("of=x")], base=state, blind=False)
    gone = state.adds[0].path
    snapshots.overwritten(numbers(spark, 3), path)
    with pytest.raises(Conflict):
        Log(path).commit([], [gone])


def test_vacuum_keeps_what_a_version_names(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.append(numbers(spark, 1), path)
    snapshots.append(numbers(spark, 2), path)
    snapshots.replaced(spark, path, lambda df: df)
    (tmp_path / "t/of=left").mkdir()
    assert Log(path).vacuum() == 0  # all is young
    assert Log(path).vacuum(2, -1) == 1 and values(snapshots.read(spark, path, 2)) == [1, 2]
    assert Log(path).vacuum(1, -1) == 2 and values(snapshots.read(spark, path)) == [1, 2]


# the sink


def stream_of(spark, folder, schema="n long, t string"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def feed(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), tmp_path / "ck"
    for i in range(3):
        feed(src, f"{i}.json", [{"n": 10 * i + k, "t": "x"} for k in range(4)])
    streaming.once(stream_of(spark, src), out, str(ck)).awaitTermination()
    want = sorted(10 * i + k for i in range(3) for k in range(4))
    assert values(snapshots.read(spark, out)) == want and Log(out).state().version == 3
    # the driver dies after the sink's commit and before its own: the batch is run again
    for f in (ck / "commits").glob("*2*"):
        f.unlink()
    streaming.once(stream_of(spark, src), out, str(ck)).awaitTermination()
    assert values(snapshots.read(spark, out)) == want and Log(out).state().version == 3
    assert spark.read.parquet(out).count() == len(want)  # files of the second run are gone
    # a new checkpoint is another writer: its batches count anew
    feed(tmp_path / "in2", "0.json", [{"n": 99, "t": None}])
    streaming.once(stream_of(spark, tmp_path / "in2"), out, str(tmp_path / "ck2")).awaitTermination()
    assert values(snapshots.read(spark, out)) == [*want, 99]


def test_files_of_lost_tasks_are_never_read(spark, tmp_path):
    out = str(tmp_path / "out")
    kind = T.StructType([T.StructField("n", T.LongType())])
    w = sink.SnapshotWriter({"path": out, "who": "w"}, kind)
    rows = lambda *n: iter([pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])])
    lost = w.write(rows(1, 2))  # its report never arrives
    again, nothing = w.write(rows(1, 2)), w.write(iter([]))
    w.commit([again, nothing, None], 0)
    assert lost.path != again.path and values(snapshots.read(spark, out)) == [1, 2]
    w.abort([w.write(rows(5))], 1)
    assert values(snapshots.read(spark, out)) == [1, 2] and Log(out).state().version == 1


LOSES_A_TASK = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from lexfold import streaming
from lexfold.sources import snapshots
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def fails_once(batches):
    import os
    from pyspark import TaskContext
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost after its rows were handed on")

rows = spark.readStream.schema("n long").json({src!r}).mapInPandas(fails_once, "n long")
streaming.once(rows, {out!r}, {ck!r}).awaitTermination()
print("ROWS", sorted(r["n"] for r in snapshots.read(spark, {out!r}).collect()))
"""


def test_a_lost_task_is_run_again_and_counts_once(tmp_path):
    feed(tmp_path / "in", "a.json", [{"n": i} for i in range(50)])
    code = LOSES_A_TASK.format(root=ROOT, src=str(tmp_path / "in"), out=str(tmp_path / "out"), ck=str(tmp_path / "ck"))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env | {"PYTHONPATH": ROOT})
    assert f"ROWS {list(range(50))}" in said.stdout, said.stderr[-2000:]


# done keys


def test_index_reads_only_buckets_that_may_hold_a_key(spark, tmp_path):
    log = Log(str(tmp_path / "t"))
    keys = spark.range(0, 5000).select(F.col("id").alias("k"))
    adds, kinds = done.run(log, keys, "k")
    log.commit(adds, schemas=kinds)
    state = log.state()
    batch = spark.createDataFrame([(x,) for x in (3, 3, 4999, 5000, 10**9, None)], "k long")
    assert sorted(r["key"] for r in done.found(log, state, batch, "k").collect()) == ["3", "4999"]
    # one key: files of its bucket alone
    got = done.found(log, state, batch.where("k = 3"), "k")
    read = {f.split("bucket=")[1].split("/")[0] for f in got.inputFiles() if "bucket=" in f}
    assert len(read) == 1
    # keys that no filter lets pass read no keys at all
    absent = done.found(log, state, spark.range(10**6, 10**6 + 300).select(F.col("id").alias("k")), "k")
    assert absent.count() == 0
    touched = {f.split("bucket=")[1].split("/")[0] for f in absent.inputFiles() if "/_keys/" in f}
    assert len(touched) < done.BUCKETS / 2  # 300 keys fall into nearly all buckets
    assert done.found(log, snapshots.State(), batch, "k").count() == 0


def test_index_is_not_sent_through_the_driver(spark, tmp_path):
    """Filters and keys are joined by shuffle; broadcast, each batch would send them through the driver."""
    log = Log(str(tmp_path / "t"))
    adds, kinds = done.run(log, spark.range(0, 500).select(F.col("id").alias("k")), "k")
    log.commit(adds, schemas=kinds)
    got = done.found(log, log.state(), spark.createDataFrame([(3,), (600,)], "k long"), "k")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString() and [r["key"] for r in got.collect()] == ["3"]


def test_runs_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(done, "FAN", 3)
    log = Log(str(tmp_path / "t"))
    for i in range(10):
        adds, kinds = done.run(log, spark.createDataFrame([(f"k{i}",), (f"m{i}",)], "k string"), "k")
        log.commit(adds, schemas=kinds)
        done.merged(spark, log)
    state = log.state()
    assert sorted(a.note["level"] for a in state.of(done.KEYS)) == sorted(a.note["level"] for a in state.of(done.FILTERS)) == [0, 2]
    asked = spark.createDataFrame([(f"{c}{i}",) for c in "kmx" for i in range(12)], "k string")
    assert {r["key"] for r in done.found(log, state, asked, "k").collect()} == {f"{c}{i}" for c in "km" for i in range(10)}


TASKS = "clause_index int, clause_text string"


def annotate(df):
    return df.withColumn("status", F.lit("success"))


def test_a_new_checkpoint_loses_and_repeats_nothing(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    task = lambda i: {"clause_index": i, "clause_text": f"c{i}"}
    feed(src, "1.json", [task(1), task(2), task(2)])
    go = lambda ck: streaming.annotate_stream(streaming.clause_stream(spark, str(src), TASKS), annotate, out, str(tmp_path / ck)).awaitTermination()
    keys = lambda: sorted(r["clause_index"] for r in snapshots.read(spark, out).collect())
    go("a")
    time.sleep(1.1)
    feed(src, "2.json", [task(2), task(3)])
    go("b")  # both files again, by a new checkpoint
    assert keys() == [1, 2, 3]
    time.sleep(1.1)
    feed(src, "3.json", [task(4), task(1)])
    go("a")  # the old one goes on
    assert keys() == [1, 2, 3, 4]
    # the batch after the crash between the table's commit and the stream's own
    for f in (tmp_path / "a/commits").glob("*2*"):
        f.unlink()
    go("a")
    assert keys() == [1, 2, 3, 4]


def test_a_stream_that_loses_the_race_leaves_out_what_is_done(spark, tmp_path):
    src, out, called = tmp_path / "in", str(tmp_path / "out"), []
    feed(src, "1.json", [{"clause_index": i, "clause_text": "x"} for i in range(4)])
    feed(tmp_path / "in2", "1.json", [{"clause_index": i, "clause_text": "y"} for i in (2, 3, 9)])

    def slow(df):
        called.append(1)
        if len(called) == 1:  # another stream commits in between
            streaming.annotate_stream(streaming.clause_stream(spark, str(tmp_path / "in2"), TASKS), annotate, out, str(tmp_path / "ck2")).awaitTermination()
        return annotate(df)

    streaming.annotate_stream(streaming.clause_stream(spark, str(src), TASKS), slow, out, str(tmp_path / "ck1")).awaitTermination()
    assert sorted((r["clause_index"], r["clause_text"]) for r in snapshots.read(spark, out).collect()) == [(0, "x"), (1, "x"), (2, "y"), (3, "y"), (9, "y")]
    assert called == [1]


# sessions


def sessions_of(turns, reset, idle):
    """(session, turn) -> (number, turns before) of [(session, second, turn, role)]."""
    out, at = {}, {}
    for s, sec, turn, role in sorted(turns, key=lambda x: (x[0], x[1], x[2])):
        number, n, last = at.get(s, (0, 0, None))
        if last is not None and sec - last > idle:
            number, n = 0, 0
        if role == reset:
            number, n = number + 1, 0
        else:
            out[s, turn] = (number, n)
            n += 1
        at[s] = (number, n, sec)
    return out


def test_sessions_in_any_order(spark, tmp_path):
    """Turns of many triggers in any order, more than an Arrow batch of one session, ties of time, idle gaps."""
    rng = random.Random(3)
    turns = [("long", 10 * i, i, "upload" if i % 97 == 0 else "user") for i in range(900)]
    turns += [(f"s{k}", rng.randrange(0, 8000), i, rng.choice(["user", "assistant", "upload"])) for k in range(15) for i in range(20)]
    turns += [("idle", 100, 0, "upload"), ("idle", 200, 1, "user"), ("idle", 7000, 2, "user")]
    want = sessions_of(turns, "upload", 5000)
    rng.shuffle(turns)
    src = tmp_path / "in"
    schema = "session_id string, ts timestamp, turn int, role string, content string"
    for i in range(4):
        part = turns[i::4]
        feed(src, f"{i}.json", [{"session_id": s, "ts": f"2024-01-01T{sec // 3600:02d}:{sec // 60 % 60:02d}:{sec % 60:02d}Z", "turn": t, "role": r, "content": "c"} for s, sec, t, r in part])
        time.sleep(0.05)
    feed(src, "9.json", [{"session_id": "end", "ts": "2024-01-09T00:00:00Z", "turn": 0, "role": "user", "content": ""}])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = streaming.ordered_sessions(stream_of(spark, src, schema), late="1 day", idle_s=5000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        streaming.started(out, spark).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {(r["session_id"], r["turn"]): (r["session_no"], r["history"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: v for k, v in got.items() if k[0] != "end"} == want
    assert spark.conf.get(sessions.STORE[0]) != sessions.STORE[1]


def test_plain_sessions_order_a_trigger(spark, tmp_path):
    """More turns in a trigger than an Arrow batch holds."""
    turns = list(range(700))
    random.Random(1).shuffle(turns)
    feed(tmp_path / "in", "0.json", [{"session_id": "s", "turn": t, "role": "upload" if t % 50 == 0 else "user", "content": "c"} for t in turns])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        q = streaming.chat_sessions(spark.readStream.schema(schemas.CHAT_TURN).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("plain_sessions").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["turn"]: (r["session_no"], r["history"]) for r in spark.sql("select * from plain_sessions").collect()} == {t: (t // 50 + 1, t % 50 - 1) for t in turns if t % 50}
