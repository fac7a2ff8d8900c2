"""One limit for all tasks: no interval sees more calls than the budget, none is made after the stop."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexfold import streaming
from lexfold.operators import hooks
from lexfold.operators.limiter import STOPPED, Limiter, paced
from lexfold.sources import snapshots


class Clock:
    """Time that passes by sleeping alone."""

    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def limiter(path, clock, **more):
    return Limiter(str(path), clock=clock, sleep=clock.sleep, **more)


def test_timetable_and_waits(tmp_path):
    clock = Clock()
    a = limiter(tmp_path / "l", clock, budget=10, interval_s=60, wait_s=15).begin()
    assert [a.due(i) - 1000 for i in (0, 1, 10, 25)] == [0, 6, 60, 150]
    assert a.wait(2) and clock.now == 1012
    a.refused(1012.0)  # at 1012, until 1027
    b = limiter(tmp_path / "l", clock, budget=10, interval_s=60, wait_s=15).begin()  # another task sees it
    assert b.look() == 1 and not b.stopped() and b.due(2) == 1027 and b.due(3) == 1033
    b.refused(1011.0)  # was under way: the same event
    assert a.look() == 1
    assert b.wait(2) and clock.now == 1027
    b.refused(1027.0)  # the second stops all
    assert a.stopped() and b.stopped() and not a.wait(99)
    assert b.events[1]["until"] - b.events[1]["begun"] == 30  # doubled
    c = limiter(tmp_path / "m", clock, budget=1, stops=0).begin()
    for _ in range(4):
        c.refused(clock.now)
        clock.now = c.events[-1]["until"] if c.look() else clock.now
    assert not c.stopped() and c.look() == 4


def test_two_tasks_that_are_refused_at_once_make_one_event(tmp_path):
    clock = Clock()
    tasks = [limiter(tmp_path / "l", clock, budget=5).begin() for _ in range(4)]
    for t in tasks:
        t.look()
    for t in tasks:
        t.refused(clock.now)
    assert {t.look() for t in tasks} == {1}


def model(folder, refuses=None):
    """A model that notes its calls, and refuses from a call on."""

    def make():
        def answer(texts):
            Path(folder).mkdir(exist_ok=True)
            n = len(list(Path(folder).iterdir()))
            (Path(folder) / f"{time.time_ns()}").write_text(texts[0])
            if refuses is not None and n >= refuses:
                raise RuntimeError("429 rate limit reached")
            if texts[0].endswith("-bad"):
                raise RuntimeError("broken")
            return [texts[0].upper()]

        return answer

    return make


def calls(folder):
    return sorted(int(p.name) / 1e9 for p in Path(folder).iterdir())


def rows(spark, n):
    return spark.createDataFrame([(i, f"t{i}-bad" if i == 3 else f"t{i}") for i in range(n)], "k long, t string").repartition(4)


def test_no_interval_sees_more_calls_than_the_budget(spark, tmp_path):
    own = Limiter(str(tmp_path / "l"), budget=10, interval_s=2.0)
    got = {r["k"]: (r["raw_output"], r["error"]) for r in paced(rows(spark, 24), "t", "k", model(str(tmp_path / "calls")), own, tasks=4).collect()}
    assert got == {i: (None, "broken") if i == 3 else (f"T{i}", None) for i in range(24)}
    at = calls(tmp_path / "calls")
    assert len(at) == 24 and max(sum(a <= b < a + 2.0 for b in at) for a in at) <= 11  # one more by a late start
    assert at[-1] - at[0] >= 2 * 23 / 10 - 0.5


def test_no_call_after_the_second_refusal(spark, tmp_path):
    own = Limiter(str(tmp_path / "l"), budget=1000, interval_s=1.0, wait_s=1.0)
    got = {r["k"]: r["error"] for r in paced(rows(spark, 60), "t", "k", model(str(tmp_path / "calls"), refuses=20), own, tasks=4).collect()}
    second = json.loads((tmp_path / "l/event-1").read_text())["begun"]
    assert not (tmp_path / "l/event-2").exists()
    at = calls(tmp_path / "calls")
    assert all(t <= second + 0.3 for t in at)  # calls that were under way
    refused = len(at) - 20
    assert refused <= 8 and sum(e is None or e == "broken" for e in got.values()) >= 19  # a wait and a try for each of the tasks
    assert sum(e == STOPPED for e in got.values()) >= 60 - 20 - 8


def test_a_stream_stops_and_goes_on_where_it_was(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text("".join(json.dumps({"clause_index": i, "clause_text": f"c{i}"}) + "\n" for i in range(30)))

    def run(refuses, n):
        own = Limiter(str(tmp_path / f"l{n}"), budget=1000, interval_s=1.0, wait_s=0.2)
        annotate = lambda df: hooks.annotated(df, model(str(tmp_path / f"calls{n}"), refuses), limiter=own)
        tasks = streaming.clause_stream(spark, str(src), "clause_index int, clause_text string")
        return streaming.annotate_stream(tasks, annotate, out, str(tmp_path / "ck"), unfinished="status = 'rate_limited'")

    with pytest.raises(Exception, match="refuses more calls"):
        run(10, 0).awaitTermination()
    first = {r["clause_index"] for r in snapshots.read(spark, out).collect()}
    assert 5 <= len(first) <= 14
    run(None, 1).awaitTermination()
    got = snapshots.read(spark, out)
    assert sorted(r["clause_index"] for r in got.collect()) == list(range(30)) and got.where(F.col("status") == "rate_limited").isEmpty()
    assert len(calls(tmp_path / "calls1")) == 30 - len(first)
