"""One limit for all tasks that call a model: a timetable, and a breaker that stops every task.

Calls have numbers, and call i is due at ``start + i * interval / budget``, whichever
task makes it, so no interval sees more calls than the budget and no task asks another.
A refusal for the rate is an event that all tasks see: the first makes all wait, the
wait doubling with each, and moves the timetable by it; after ``stops`` of them no task
calls any more. Refusals of calls that were under way when a wait began are part of it.

Events are numbered files in a folder that tasks share (as checkpoints are), made whole
and once each, so two tasks that are refused at once make one event.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Log
from ..storage import shared_path
from .order import placed

STOPPED = "stopped: the rate limit was met again"


class RateLimited(RuntimeError):
    """The model refuses more calls; what was not called is left for another run."""


@dataclass
class Limiter:
    """budget calls in every interval_s, over all tasks. wait_s: the first wait after a refusal. stops: refusals that stop all calls; 0: none does."""

    path: str
    budget: int
    interval_s: float = 60.0
    wait_s: float = 15.0
    stops: int = 2
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        self.events: list[dict] = []
        self.start: float | None = None

    @staticmethod
    def shared(spark, budget: int, **more) -> Limiter:
        """One whose events lie in the shared folder of the session."""
        return Limiter(shared_path(spark, "limiter"), budget, **more)

    def begin(self) -> Limiter:
        """Starts the timetable; the first caller's time counts, for all."""
        log = Log(self.path)
        log.create("start", json.dumps(self.clock()).encode())
        with log.fs.open_input_stream(f"{log.root}/start") as f:
            self.start = json.loads(f.read())
        return self

    def look(self) -> int:
        """How many events there are; reads those that are new."""
        log = Log(self.path)
        while True:
            try:
                with log.fs.open_input_stream(f"{log.root}/event-{len(self.events)}") as f:
                    self.events.append(json.loads(f.read()))
            except FileNotFoundError:
                return len(self.events)

    def stopped(self) -> bool:
        return bool(self.stops) and self.look() >= self.stops

    def due(self, number: int) -> float:
        """When a call may be made: at its place in the timetable, and after all waits."""
        self.look()
        moved = sum(e["until"] - e["begun"] for e in self.events)
        return max([self.start + number * self.interval_s / self.budget + moved, *(e["until"] for e in self.events)])

    def wait(self, number: int) -> bool:
        """Waits until the call is due; false where calls have been stopped."""
        while not self.stopped():
            left = self.due(number) - self.clock()
            if left <= 0:
                return True
            self.sleep(min(left, 1.0))
        return False

    def refused(self, called: float) -> None:
        """A call that was made then was refused."""
        while True:
            n = self.look()
            if n and called < self.events[-1]["until"]:
                return  # under way when the wait began
            now = self.clock()
            if Log(self.path).create(f"event-{n}", json.dumps({"begun": now, "until": now + self.wait_s * 2**n}).encode()):
                return


def paced(rows: DataFrame, prompt: str, key: str, factory, limiter: Limiter, output: str = "raw_output", error: str = "error", tries: int = 2, tasks: int | None = None) -> DataFrame:
    """rows with a model's output for the prompt column, called one by one by the limiter's timetable; error says why there is none.

    key orders the calls. Of a call that fails for another reason than the rate there is
    one try; one that is refused is tried again after the wait, tries times in all. Rows
    that come after the stop are not called: their error is STOPPED.
    """
    import re

    from ..functions.text import RATE_LIMIT

    limited = re.compile(RATE_LIMIT).search
    numbered = placed(rows, key)
    n = tasks or rows.sparkSession.sparkContext.defaultParallelism
    # calls that follow each other are made by different tasks, so a slow one delays no other
    dealt = numbered.repartition(n, F.col("__place") % n).sortWithinPartitions("__place")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{output}` string, `{error}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, own = factory(), limiter.begin()

        def call(number: int, text: str) -> tuple[str | None, str | None]:
            for left in reversed(range(tries)):
                if not own.wait(number):
                    return None, STOPPED
                at = own.clock()
                try:
                    return model([text])[0], None
                except Exception as e:
                    said = str(e) or type(e).__name__
                    if not limited(said.lower()):
                        return None, said
                    own.refused(at)
                    if not left:
                        return None, said
            return None, STOPPED

        for b in batches:
            got = [call(int(i), t) for i, t in zip(b["__place"], b[prompt], strict=True)]
            yield b.drop(columns="__place").assign(**{output: [x for x, _ in got], error: [e for _, e in got]})

    return dealt.mapInPandas(run, schema)
