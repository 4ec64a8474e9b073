"""Activity counters, daily counts and ring buffers over a stream of events."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A file source of events; its checkpoint remembers which files are done."""
    return spark.readStream.schema(EVENTS).parquet(path)


def counters(stream: DataFrame) -> DataFrame:
    """user_id, event_type, n; for update or complete mode."""
    return stream.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n: a day is out once the watermark has passed it."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n")


def recent(stream: DataFrame, k: int = fixed.RECENT_USER) -> DataFrame:
    """user_id, recent (JSON of the last ``k`` event ids by time): state holds ``k`` ids for each user, no more."""

    def fold(key, frames, state: GroupState):
        held = json.loads(state.get[0]) if state.exists else []
        for pdf in frames:
            held = sorted(held + [[t.isoformat(), int(i)] for t, i in zip(pdf["ts"], pdf["event_id"], strict=True)])[-k:]
        state.update((json.dumps(held),))
        yield pd.DataFrame({"user_id": [key[0]], "recent": [json.dumps([i for _, i in held])]})

    return stream.groupBy("user_id").applyInPandasWithState(fold, "user_id long, recent string", "held string", "update", GroupStateTimeout.NoTimeout)


def toggled(stream: DataFrame) -> DataFrame:
    """user_id, action, saved: whether an entry stands after its toggles so far; for update mode."""
    out = stream.groupBy("user_id", F.get_json_object("props", "$.k").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", "action", (F.col("n") % 2 == 1).alias("saved"))


def runs(stream: DataFrame, start: str, finish: str) -> DataFrame:
    """user_id, started, us: each finish with the user's last open start before it; state holds one time for each user."""

    def fold(key, frames, state: GroupState):
        open_ = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for ts, kind in zip(rows["ts"], rows["event_type"], strict=True):
            if kind == start:
                open_ = ts.value // 1000
            elif kind == finish and open_ is not None:
                out.append((key[0], pd.Timestamp(open_ * 1000), ts.value // 1000 - open_))
                open_ = None
        state.update((open_,))
        yield pd.DataFrame(out, columns=["user_id", "started", "us"])

    asked = stream.where(F.col("event_type").isin(start, finish))
    return asked.groupBy("user_id").applyInPandasWithState(fold, "user_id long, started timestamp, us long", "open long", "update", GroupStateTimeout.NoTimeout)
