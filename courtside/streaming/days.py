"""Each player's day in a stream: points that can be taken back, and an end when nothing has come for half an hour.

Open days (begin, last row and number of rows) and their standing points are lists of state, for SHARD players each; a timer of event time stands for the
first end of an open day of theirs, and what has ended leaves the state. Where rows of two days come in one micro-batch, the later row ends the earlier day.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

QUIET = 30 * 60 * 1_000_000
DAY = "user_id long, start_us long, last_us long, n long, standing long, newest long"


def _timer(last_us: int) -> int:
    """When a day ends, in whole milliseconds, never early."""
    return -(-(last_us + QUIET) // 1000)


#: Players whose days are kept together, by their number divided by it: a call for each player costs more than its few rows.
SHARD = 64


class Days(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        long = lambda *names: StructType([StructField(n, LongType()) for n in names])
        self.handle = handle
        self.open = handle.getListState("days", long("user_id", "start_us", "last_us", "n"))
        self.points = handle.getListState("points", long("user_id", "event_id"))
        self.timer = handle.getValueState("timer", long("at"))

    def _load(self) -> tuple[dict, dict]:
        days, points = {d[0]: (d[1], d[2], d[3]) for d in self.open.get()}, {}
        for user, event_id in self.points.get():
            points.setdefault(user, []).append(event_id)
        return days, points

    def _save(self, days: dict, points: dict) -> None:
        standing = [(u, p) for u, own in points.items() for p in own]
        self.open.put([(u, *d) for u, d in days.items()]) if days else self.open.clear()
        self.points.put(standing) if standing else self.points.clear()
        old, new = self.timer.get(), min((_timer(d[1]) for d in days.values()), default=None)
        if old and old[0] != new:
            self.handle.deleteTimer(old[0])
        if new is None:
            self.timer.clear()
        elif not old or old[0] != new:
            self.handle.registerTimer(new)
            self.timer.update((new,))

    @staticmethod
    def _row(user, day: tuple[int, int, int], points: list[int] | None) -> tuple:
        return (user, *day, len(points or ()), points[-1] if points else -1)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("user_id", "start_us", "last_us", "n", "standing", "newest"), zip(*rows))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = list(rows)  # the shard's rows of one micro-batch
        event_ids, times, steps = (np.concatenate([g[c].to_numpy() for g in got]) for c in ("event_id", "us", "step"))
        users = np.concatenate([g["user_id"].to_numpy() for g in got]).tolist() if key[0] is not None else [None] * len(times)
        days, points = self._load()
        ended = []
        for i in np.lexsort((event_ids, times)).tolist():
            user, us, step = users[i], int(times[i]), steps[i]
            day = days.get(user)
            if day and us - day[1] >= QUIET:
                ended.append(self._row(user, day, points.pop(user, None)))
                day = None
            days[user] = (day[0], us, day[2] + 1) if day else (us, us, 1)
            if step > 0:
                points.setdefault(user, []).append(int(event_ids[i]))
            elif step < 0 and points.get(user):
                points[user].pop()
        self._save(days, points)
        if ended:
            yield self._frame(ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        days, points = self._load()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = [u for u, d in days.items() if _timer(d[1]) <= now]
        ended = [self._row(u, days.pop(u), points.pop(u, None)) for u in over]
        self._save(days, points)
        if ended:
            yield self._frame(ended)

    def close(self) -> None:
        pass


def days(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """A row for each day of a player that has ended: its begin and last row, its rows, and what stands of its points. events: event_id, ts, user_id, step."""
    rows = events.withWatermark("ts", delay).select("ts", "user_id", "event_id", "step", F.unix_micros("ts").alias("us"), F.floor(F.col("user_id") / SHARD).alias("shard"))
    ended = rows.groupBy("shard").transformWithStateInPandas(Days(), DAY, "append", "eventtime")
    return ended.select("user_id", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("last_us").alias("last"), "n", "standing", "newest")


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
