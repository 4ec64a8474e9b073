"""Stateful streams over files that come one by one, and restarts from their checkpoints."""

import datetime as dt
import json

import pytest

from wordtide.streaming import activity as events_
from wordtide.streaming import state


def at(minutes):
    return dt.datetime(2024, 1, 1, 10, tzinfo=dt.UTC) + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Adds a file of events, runs a stream over what is new and gives the rows of that run."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    state.with_store(spark)
    source, numbers = tmp_path / "events", iter(range(100))
    source.mkdir()

    def run(rows, f, mode, **trigger):
        n, out = next(numbers), []
        made = spark.createDataFrame([(i, t, u, k, 0.0, json.dumps({"k": p})) for i, t, u, k, p in rows], events_.EVENTS)
        made.coalesce(1).write.mode("append").parquet(str(source))
        df = f(events_.events(spark, str(source)))
        query = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).trigger(**(trigger or {"availableNow": True})).start()
        assert query.awaitTermination(90), n
        assert n >= 0 and query.exception() is None
        return sorted(out, key=str)

    yield run
    if old:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_runs_end_by_finish_or_timer(spark, feed):
    f = lambda s: state.runs(s, "view", "purchase", limit_s=600, late="1 minute")
    got = feed([(1, at(0), 1, "view", 0), (2, at(1), 2, "view", 0), (3, at(2), 1, "purchase", 0), (4, at(2), 3, "purchase", 0)], f, "append")
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 120_000_000, "finished")]
    # another run of the program: the open start of user 2 comes from the checkpoint; user 4's lapses, by user 5's events
    got = feed([(5, at(8), 2, "purchase", 0), (6, at(8), 4, "view", 0)], f, "append")
    assert [(r[0], r[2], r[3]) for r in got] == [(2, 420_000_000, "finished")]
    got = feed([(7, at(30), 5, "view", 0)], f, "append") + feed([(8, at(31), 5, "view", 0), (9, at(9), 4, "purchase", 0)], f, "append")
    assert [(r[0], r[2], r[3]) for r in got] == [(4, None, "expired")]  # its finish came too late and is not paired


def test_activity_folds_over_restarts(spark, feed):
    f = lambda s: state.activity(s, k=2)
    feed([(1, at(0), 1, "view", 0), (2, at(1), 1, "click", 0), (3, at(1), 2, "view", 0)], f, "update", once=True)
    got = feed([(4, at(3), 1, "view", 0), (5, at(2), 1, "view", 0)], f, "update", once=True)
    assert got == [(1, 4, '{"click": 1, "view": 3}', "[5, 4]")]


def test_toggles_leave_no_state_behind(spark, feed):
    feed([(1, at(0), 1, "click", 7), (2, at(1), 1, "click", 8), (3, at(2), 2, "click", 7)], state.toggled, "update")
    assert feed([(4, at(3), 1, "click", 7), (5, at(4), 1, "click", 9)], state.toggled, "update") == [(1, "7", False), (1, "9", True)]
    assert feed([(6, at(5), 1, "click", 7)], state.toggled, "update") == [(1, "7", True)]
