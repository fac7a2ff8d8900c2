"""What a batch of the annotation stream reads and writes: its texts few times, its keys in one piece."""

import json

import pytest
from pyspark.sql import functions as F

from lexfold import streaming
from lexfold.sources import snapshots
from lexfold.sources.snapshots import Log
from lexfold.streaming import done

TASKS = "clause_index long, clause_text string"


def feed(folder, name, *keys):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"clause_index": k, "clause_text": "x"}) + "\n" for k in keys))


def test_texts_are_read_twice_at_most_and_done_batches_add_nothing(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        seen.add(1)
        return text

    feed(tmp_path / "in", "0.json", *range(40))

    def go(ck):
        before = seen.value
        tasks = streaming.clause_stream(spark, str(tmp_path / "in"), TASKS).withColumn("clause_text", noted.asNondeterministic()("clause_text"))
        streaming.annotate_stream(tasks, lambda df: df.withColumn("status", F.lit("success")), str(tmp_path / "out"), str(tmp_path / ck)).awaitTermination()
        return seen.value - before

    assert go("a") <= 80  # for keys, and for results
    log = Log(str(tmp_path / "out"))
    state = log.state()
    assert len(state.of(done.RECENT)) == 1 and not state.of(done.KEYS) and not state.of(done.FILTERS)
    assert go("b") <= 40  # for keys alone
    assert log.history()[-1]["add"] == [] and log.state().version == 2
    assert not list((tmp_path / "out/_asked").iterdir())
    assert sorted(r["clause_index"] for r in snapshots.read(spark, str(tmp_path / "out")).collect()) == list(range(40))


@pytest.mark.parametrize("many", [0, 10**9])
def test_recent_keys_become_runs(spark, tmp_path, monkeypatch, many):
    """Batches of copies, done keys and rows without a key, by whole runs and by filters; each key has one result."""
    monkeypatch.setattr(done, "FAN", 2)
    monkeypatch.setattr(done, "MANY", many)
    monkeypatch.setattr(done, "FOLDER", 3)
    for i in range(5):
        feed(tmp_path / "in", f"{i}.json", 2 * i, 2 * i, 2 * i + 1, 2 * i + 2, None, None)
    for ck in "ab":
        tasks = streaming.clause_stream(spark, str(tmp_path / "in"), TASKS)
        streaming.annotate_stream(tasks, lambda df: df.select("clause_index"), str(tmp_path / "out"), str(tmp_path / ck)).awaitTermination()
    got = [r["clause_index"] for r in snapshots.read(spark, str(tmp_path / "out")).collect()]
    assert sorted(k for k in got if k is not None) == list(range(11)) and got.count(None) == 20
    log = Log(str(tmp_path / "out"))
    state = log.state()
    assert len(state.of(done.RECENT)) < 2 and max(a.note["of"] for a in state.of(done.KEYS)) > 1
    asked = spark.range(20).select(F.col("id").alias("k"))
    assert sorted(int(r["key"]) for r in done.found(log, state, asked, "k").collect()) == list(range(11))
