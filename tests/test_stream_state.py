"""Custom state lets go: sessions by timers, unmatched rows of joins by the watermark."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeloom.plans import streams
from lakeloom.plans.base import Tables
from lakeloom.streaming import events as ev

SF = "/root/testdata/sf0.001"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.set(name, before)


def kept(reports):
    return [sum(s["numRowsTotal"] for s in r["stateOperators"]) for r in reports if r.get("stateOperators")]


def test_timers_empty_the_state(spark, tmp_path, rocksdb):
    t = Tables(spark, SF)
    rows = ev.baskets(ev.stream(spark, streams._in_order(t), streams._SCHEMA, files=2, delay="1 hour"), 30 * 60_000_000, "user_id")
    sizes = kept(ev.run_once(rows, str(tmp_path / "c"), "append", lambda df, k: df.write.mode("append").parquet(str(tmp_path / "out"))))
    # at last only the row far in the future has a session
    assert max(sizes) > 20 and sizes[-1] <= 6, sizes


def test_unmatched_rows_leave_the_join(spark, tmp_path):
    t = Tables(spark, SF)
    path = streams._in_order(t)
    read = lambda kind: ev.stream(spark, path, streams._SCHEMA, files=2, delay="1 hour").filter(F.col("event_type").isin(kind, "end")).select("user_id", "ts")
    rows = ev.followed(read("view"), read("purchase"), "user_id", "1 HOUR", "full_outer")
    sizes = kept(ev.run_once(rows, str(tmp_path / "c"), "append", lambda df, k: df.write.mode("append").parquet(str(tmp_path / "out"))))
    assert max(sizes) > 3 * max(1, sizes[-1]), sizes


class _Counted:
    """States and timers of one key in memory; counts the messages that a state store would get."""

    def __init__(self):
        self.messages, self.held = 0, {}

    def __getattr__(self, name):
        kind = next((k for k in ("ValueState", "MapState", "ListState") if name == f"get{k}"), None)
        if kind is None:
            raise AttributeError(name)
        return lambda state, *schemas: _State(self, state, kind)

    def listTimers(self):
        self.messages += 1
        return iter(self.held.get("timers", []))

    def deleteTimer(self, timer):
        self.messages += 1
        self.held["timers"].remove(timer)

    def registerTimer(self, timer):
        self.messages += 1
        self.held.setdefault("timers", []).append(timer)


class _State:
    def __init__(self, store, name, kind):
        self.store, self.name, self.kind = store, name, kind

    def _sent(self):
        self.store.messages += 1
        return self.store.held

    def exists(self):
        return self.name in self._sent()

    def get(self):
        return self._sent().get(self.name, None if self.kind == "ValueState" else [])

    def update(self, x):
        self._sent()[self.name] = x

    put = update

    def iterator(self):
        return iter(list(self._sent().get(self.name, {}).items()))

    def getValue(self, k):
        return self._sent().get(self.name, {}).get(k)

    def containsKey(self, k):
        return k in self._sent().get(self.name, {})

    def updateValue(self, k, v):
        self._sent().setdefault(self.name, {})[k] = v

    def clear(self):
        self._sent().pop(self.name, None)


class _Watermark:
    def getCurrentWatermarkInMs(self):
        return 0


def test_messages_to_the_state_do_not_grow_with_events():
    found = {}
    for n in (20, 2000):
        store, baskets = _Counted(), ev._Baskets(100, 3)
        baskets.init(store)
        rows = [(1000 * (i // 5) + i % 5, "ab"[i % 2], float(i)) for i in range(n)]
        out = []
        for part in (rows[: n // 2], rows[n // 2 :]):
            out += [r for df in baskets.handleInputRows(("u",), iter([pd.DataFrame(part, columns=["us", "event_type", "value"])]), _Watermark()) for r in df.itertuples(index=False)]
        out += [r for df in baskets.handleExpiredTimer(("u",), _Watermark(), None) for r in df.itertuples(index=False)]
        found[n] = store.messages
        assert len(out) == n // 5 and [tuple(r) for r in out[:2]] == [("u", 0, 4, {"a": 3, "b": 2}, [2.0, 3.0, 4.0]), ("u", 1000, 1004, {"b": 3, "a": 2}, [7.0, 8.0, 9.0])]
        assert set(store.held) == {"timers"} and len(store.held["timers"]) == 1
    assert found[2000] == found[20] < 40, found


def test_a_key_without_closed_sessions_gives_no_frame(spark):
    """Frames cost far more than rows, so a key that closes nothing makes none."""

    class Users(list):
        def groupBy(self, key):
            return self

        def select(self, *columns):
            return self

        def withColumn(self, *column):
            return self

        def applyInPandasWithState(self, add, *rest):
            self.add = add
            return self

    users = Users()
    users.schema = {"user_id": type("f", (), {"dataType": type("t", (), {"simpleString": lambda self: "long"})()})()}
    ev.closing_sessions(users, 100, "user_id")

    class State:
        exists, hasTimedOut, held = False, False, None
        get = property(lambda self: self.held)

        def update(self, x):
            self.exists, self.held = True, x

        def setTimeoutTimestamp(self, at):
            self.at = at

        def getCurrentWatermarkMs(self):
            return 0

        def remove(self):
            self.exists, self.held = False, None

    state, frame = State(), lambda *us: iter([pd.DataFrame({"us": us})])
    assert list(users.add((7,), frame(30, 10), state)) == [] and state.held == (10, 30, 2)
    out = list(users.add((7,), frame(129, 300, 310, 900), state))
    assert [tuple(r) for df in out for r in df.itertuples(index=False)] == [(7, 10, 129, 3), (7, 300, 310, 2)] and state.held == (900, 900, 1)
    state.hasTimedOut = True
    assert [tuple(r) for df in users.add((7,), iter([]), state) for r in df.itertuples(index=False)] == [(7, 900, 900, 1)] and not state.exists
