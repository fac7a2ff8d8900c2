"""Chat sessions in the order of their turns, whatever order these come in.

Turns wait in a session's state until the watermark has passed them and are then let go
in order, so a turn may come in another batch, file or trigger than the one before it.
A session that is idle for long leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SESSION = "session_id string, session_no int, turn int, role string, content string, history int"
WAITING = "ms long, turn int, role string, content string"
#: Rows of a batch that goes out.
ROWS = 5_000
#: The state store that keeps lists and timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: No time: before any turn is let go, and where none waits.
NEVER = -1


class Sessions(StatefulProcessor):
    """State: turns that wait, and (session number, turns in it, time of the last turn let go, time of the first that waits)."""

    def __init__(self, reset: str, idle_ms: int) -> None:
        self.reset, self.idle_ms = reset, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.at = handle.getValueState("at", "number int, turns int, last long, due long")

    def _at(self) -> tuple[int, int, int, int]:
        return tuple(self.at.get()) if self.at.exists() else (0, 0, NEVER, NEVER)

    def _timer(self, ms: int) -> None:
        """The only timer of the session."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.at.exists()
        number, turns, last, due = self._at()
        was = due
        for b in rows:
            if len(b):
                self.waiting.appendList([(int(m), None if pd.isna(t) else int(t), r, c) for m, t, r, c in zip(b["ms"], b["turn"], b["role"], b["content"], strict=True)])
                first = int(b["ms"].min())
                due = first if due == NEVER else min(due, first)
        if due != was:  # else the timer and all that is kept stay what they are; each call of the store costs
            self.at.update((number, turns, last, due))
            if known:
                self._timer(due)
            else:
                self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        number, turns, last, due = self._at()
        if due == NEVER:  # the session was idle
            self.at.clear()
            return
        every = sorted(self.waiting.get(), key=lambda t: (t[0], t[1] is not None, t[1] or 0))
        out, n = [], 0
        for ms, turn, role, content in every:
            if ms > now:
                break
            if last != NEVER and ms > last + self.idle_ms:
                number, turns = 0, 0
            n, last = n + 1, ms
            if role == self.reset:
                number, turns = number + 1, 0
                continue
            out.append((key[0], number, turn, role, content, turns))
            turns += 1
            if len(out) >= ROWS:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        rest = [tuple(t) for t in every[n:]]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.at.update((number, turns, last, rest[0][0] if rest else NEVER))
        self._timer(rest[0][0] if rest else last + self.idle_ms)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SESSION.split(", ")]).astype({"turn": "Int32"})

    def close(self) -> None:
        pass


def ordered_sessions(events: DataFrame, ts: str = "ts", late: str = "10 minutes", idle_s: float = 86_400, reset: str = "upload") -> DataFrame:
    """A stream of (session_id, turn, role, content) and a time, with session_no and the number of turns before in it, by (time, turn).

    A turn of the resetting role starts a session anew. A turn that comes more than late
    after one with a later time is lost, as the watermark says. Turns are let go when the
    watermark has passed them: the last ones of a stream stay until a later event comes.
    A turn more than idle_s after the one before it starts the id's numbers anew, and by
    then its state is gone.
    """
    rows = events.withWatermark(ts, late).select("session_id", ts, F.unix_millis(ts).alias("ms"), "turn", "role", "content")
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(reset, int(idle_s * 1000)), SESSION, "append", "eventTime")


def started(out: DataStreamWriter, spark) -> StreamingQuery:
    """Starts a stream with sessions' state on the store that it needs; the setting of the Spark session stays what it was."""
    name, needed = STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, needed)
    try:
        return out.start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
