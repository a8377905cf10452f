"""Live updates as Structured Streaming: change detection with keyed state, deduplication, windows and sessions, and a write-once record for each key.

State is one small row a key. A micro-batch is bounded by `files`, and so are the rows of a key that a task sorts at once.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Minutes without news that end a day, and how late a row may come.
QUIET, LATE = "30 minutes", "3 days"


def event_stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """Parquet files as they are dropped, at most `files` a micro-batch; event time as a timestamp, which watermarks need."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def changes(events: DataFrame) -> DataFrame:
    """Events whose type differs from the last of their user: the last one is state, kept over restarts by the query's checkpoint: one word a user."""

    def emit(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("event_id")  # the key's rows of one micro-batch
        before = pdf["event_type"].shift(1, fill_value=last if last is not None else "\0")
        yield pdf[pdf["event_type"] != before][["event_id", "user_id", "event_type"]]
        state.update((pdf["event_type"].iloc[-1],))

    return events.select("event_id", "user_id", "event_type").groupBy("user_id").applyInPandasWithState(emit, "event_id long, user_id long, event_type string", "last string", "append", "NoTimeout")


def deduplicated(events: DataFrame, delay: str = LATE) -> DataFrame:
    """What an at-least-once source sends twice, within the time that it may be late."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def per_window(events: DataFrame, width: str = "1 day", delay: str = LATE) -> DataFrame:
    """Counts and sums of tumbling windows. On a stream a window is given once, when rows of it would be too late."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, quiet: str = QUIET, delay: str = LATE) -> DataFrame:
    """Stretches of a user's events with less than `quiet` between two: a day ends when that long nothing has come."""
    own = events.withWatermark("ts", delay).groupBy(F.session_window("ts", quiet).alias("s"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return own.select("user_id", F.col("s.start").alias("start"), "last", "n")


def first_records(events: DataFrame) -> DataFrame:
    """The first record of each user, once: that it has been given is the user's state, so a restarted query does not give it again."""

    def emit(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            for _ in batches:
                pass
            return
        first = None
        for pdf in batches:
            own = pdf.nsmallest(1, "event_id")
            first = own if first is None or own["event_id"].iloc[0] < first["event_id"].iloc[0] else first
        yield first
        state.update((True,))

    return events.select("event_id", "user_id", "event_type").groupBy("user_id").applyInPandasWithState(emit, "event_id long, user_id long, event_type string", "given boolean", "append", "NoTimeout")


def drained(stream: DataFrame, path: str, kind: str = "parquet", more: bool = False) -> DataFrame:
    """All that is there now, through an append-only file sink (parquet, or json: a line a row) in a shared folder, and read back. more: the stream goes on at once, so timers that have run out wait for its next rows and need no micro-batch of their own."""
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not more).lower())
    q = stream.writeStream.format(kind).option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).format(kind).load(f"{path}/rows")
