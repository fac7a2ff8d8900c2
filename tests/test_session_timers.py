"""How often a session asks the state store for its timers."""

import pandas as pd

from lexfold.streaming.sessions import Sessions


class _Store:
    def __init__(self):
        self.calls, self.timers, self.rows, self.value = [], [], [], None

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.rows += rows

    def listTimers(self):
        self.calls.append("list")
        return iter(self.timers)

    def deleteTimer(self, t):
        self.calls.append("delete")
        self.timers.remove(t)

    def registerTimer(self, t):
        self.calls.append("register")
        self.timers.append(t)


def test_timers_are_touched_where_they_change():
    store, s = _Store(), Sessions("user", 1000)
    s.init(store)
    for ms, calls, timers in ((50, ["register"], [50]), (70, [], [50]), (20, ["list", "delete", "register"], [20])):
        store.calls = []
        list(s.handleInputRows(("k",), iter([pd.DataFrame({"ms": [ms], "turn": [1], "role": ["a"], "content": ["x"]})]), None))
        assert (store.calls, store.timers, store.value) == (calls, timers, (0, 0, -1, timers[0]))
    assert [r[0] for r in store.rows] == [50, 70, 20]
