"""A key's rows of one batch cost a few accesses to its state, not some each."""

from pyspark.sql import Row

from expodex.streaming.cache import Cache, Entries


class Held(dict):
    calls = 0

    def __getattribute__(self, name):
        if name in ("iterator", "getValue", "containsKey", "updateValue", "removeKey", "get_", "exists", "update_"):
            Held.calls += 1
        return super().__getattribute__(name)

    def iterator(self):
        return iter(list(self.items()))

    def getValue(self, k):
        return self[k]

    def containsKey(self, k):
        return k in self

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


class Counts:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v


class Handle:
    def __init__(self):
        self.held, self.counts, self.timers = Held(), Counts(), []

    def getMapState(self, *_):
        return self.held

    def getValueState(self, *_):
        return self.counts

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_state_is_read_and_written_once_a_batch():
    handle, cache, plain = Handle(), Cache(10, 20, 4), Entries(10, 20, 4)
    cache.init(handle)
    rows = [Row(entry=f"e{k * k % 37}", us=k * 150_000, ord=k) for k in range(3000)]
    Held.calls = 0
    got = [r for at in range(0, 3000, 500) for r in cache.handleInputRows(("k",), iter(rows[at : at + 500]), None)]
    assert [(r.hit, r.since) for r in got] == [plain.ask(r.entry, r.us) for r in rows]
    assert Held.calls < 600
    assert handle.counts.value[0] == len(handle.held)
