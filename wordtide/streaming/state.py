"""Streams that keep state of their own: runs with a time limit, activity that is forgotten, saved entries.

State lives in Spark's RocksDB store, key by key, and in checkpoints; timers and times to live keep it small.  Event time rules the
runs: rows behind the watermark are late and go, and a run whose finish does not come within the limit is given up
when the watermark passes it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Runs(StatefulProcessor):
    """Pairs each finish with its user's last open start; an open start is one number of state and one timer."""

    def __init__(self, start: str, finish: str, limit_s: int) -> None:
        self.start, self.finish, self.limit_ms = start, finish, 1000 * limit_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "us long")

    def _closed(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get()[0] if self.open.exists() else None
        before, out = held, []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            at = r.ts.value // 1000
            if held is not None and at - held > 1000 * self.limit_ms:
                out.append((key[0], pd.Timestamp(held * 1000), None, "expired"))
                held = None
            if r.event_type == self.start:
                held = at
            elif r.event_type == self.finish and held is not None:
                out.append((key[0], pd.Timestamp(held * 1000), at - held, "finished"))
                held = None
        if held != before:
            self._closed()
            if held is not None:
                self.open.update((held,))
                self.handle.registerTimer(held // 1000 + self.limit_ms)
        yield pd.DataFrame(out, columns=["user_id", "started", "us", "outcome"]).astype({"us": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(key[0], pd.Timestamp(self.open.get()[0] * 1000), None, "expired")] if self.open.exists() else []
        self._closed()
        yield pd.DataFrame(out, columns=["user_id", "started", "us", "outcome"]).astype({"us": "Int64"})

    def close(self) -> None:
        pass


def runs(stream: DataFrame, start: str, finish: str, limit_s: int = 600, late: str = "1 hour") -> DataFrame:
    """user_id, started, us, outcome: ``finished`` runs with their duration, and ``expired`` ones that took over ``limit_s`` seconds."""
    asked = stream.where(F.col("event_type").isin(start, finish)).select("user_id", "event_id", "ts", "event_type").withWatermark("ts", late)
    return asked.groupBy("user_id").transformWithStateInPandas(Runs(start, finish, limit_s), "user_id long, started timestamp, us long, outcome string", "Append", "EventTime")


class Activity(StatefulProcessor):
    """Counts by event type and the last events of a user; what is not touched for ``ttl_s`` seconds is forgotten."""

    def __init__(self, k: int, ttl_s: int) -> None:
        self.k, self.ttl_ms = k, 1000 * ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "event_type string", "n long", self.ttl_ms)
        self.recent = handle.getValueState("recent", "ids string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        for kind, n in new.groupby("event_type").size().items():
            held = self.counts.getValue((kind,))[0] if self.counts.containsKey((kind,)) else 0
            self.counts.updateValue((kind,), (int(held + n),))
        seen = json.loads(self.recent.get()[0]) if self.recent.exists() else []
        seen = sorted(seen + [[t.isoformat(), int(i)] for t, i in zip(new["ts"], new["event_id"], strict=True)])[-self.k :]
        self.recent.update((json.dumps(seen),))
        counts = {k[0]: int(v[0]) for k, v in self.counts.iterator()}
        yield pd.DataFrame({"user_id": [key[0]], "events_total": [sum(counts.values())], "by_type": [json.dumps(counts, sort_keys=True)], "recent": [json.dumps([i for _, i in seen])]})

    def close(self) -> None:
        pass


def activity(stream: DataFrame, k: int = fixed.RECENT_USER, ttl_s: int = 90 * 86400) -> DataFrame:
    """user_id, events_total, by_type and recent (JSON) after each batch; for update mode.  The times to live are looked at in batches
    without data too, so a trigger of all that is available would not end."""
    asked = stream.select("user_id", "event_id", "ts", "event_type")
    return asked.groupBy("user_id").transformWithStateInPandas(Activity(k, ttl_s), "user_id long, events_total long, by_type string, recent string", "Update", "ProcessingTime")


class Toggles(StatefulProcessor):
    """A user's saved entries: an entry is state while it stands, and none once it is toggled away."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getMapState("saved", "action string", "since string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched = {}
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            if self.saved.containsKey((r.action,)):
                self.saved.removeKey((r.action,))
            else:
                self.saved.updateValue((r.action,), (r.ts.isoformat(),))
            touched[r.action] = self.saved.containsKey((r.action,))
        yield pd.DataFrame([(key[0], a, s) for a, s in touched.items()], columns=["user_id", "action", "saved"])

    def close(self) -> None:
        pass


def toggled(stream: DataFrame) -> DataFrame:
    """user_id, action, saved: whether each entry that a batch touches stands after it; for update mode."""
    asked = stream.select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").alias("action")).where("action IS NOT NULL")
    return asked.groupBy("user_id").transformWithStateInPandas(Toggles(), "user_id long, action string, saved boolean", "Update", "None")
