"""Streams that are stopped and go on: nothing is given twice, nothing is lost."""
import datetime

import pytest
from pyspark.sql import functions as F

from courtside.streaming import days, live

T0 = datetime.datetime(2024, 5, 1, 12)


def drop(spark, folder, rows):
    out = [(i, T0 + datetime.timedelta(minutes=m), u, t, 1.0, "{}") for i, m, u, t in rows]
    spark.createDataFrame(out, live.EVENTS.replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/events"


def test_changes_over_a_restart(spark, folder, tmp_path):
    drop(spark, folder, [(1, 0, 7, "a"), (2, 1, 7, "a"), (3, 2, 7, "b"), (4, 3, 8, "a")])
    run = lambda: {r.event_id for r in live.drained(live.changes(live.event_stream(spark, folder)), f"file://{tmp_path}/out").collect()}
    assert run() == {1, 3, 4}
    drop(spark, folder, [(5, 4, 7, "b"), (6, 5, 7, "a"), (7, 6, 8, "a")])
    assert run() == {1, 3, 4, 6}


def test_first_record_once(spark, folder, tmp_path):
    drop(spark, folder, [(2, 0, 7, "b"), (1, 0, 7, "a"), (3, 1, 8, "c")])
    run = lambda: sorted((r.user_id, r.event_id, r.event_type) for r in live.drained(live.first_records(live.event_stream(spark, folder)), f"file://{tmp_path}/out", "json").collect())
    assert run() == [(7, 1, "a"), (8, 3, "c")]
    drop(spark, folder, [(0, 2, 7, "z"), (9, 2, 9, "d")])
    assert run() == [(7, 1, "a"), (8, 3, "c"), (9, 9, "d")]


def test_late_rows_and_windows(spark, folder, tmp_path):
    drop(spark, folder, [(1, 0, 7, "a"), (2, 60, 7, "a"), (2, 60, 7, "a")])
    twice = live.deduplicated(live.event_stream(spark, folder)).select("event_id")
    assert sorted(r.event_id for r in live.drained(twice, f"file://{tmp_path}/once").collect()) == [1, 2]
    run = lambda f, name: live.drained(f(live.event_stream(spark, folder)), f"file://{tmp_path}/{name}").collect()
    assert run(live.per_window, "days") == [] and run(live.sessions, "ends") == []
    # news of four days later close the day and the sessions
    drop(spark, folder, [(3, 10 * 24 * 60, 8, "b")])
    run(live.per_window, "days"), run(live.sessions, "ends")
    drop(spark, folder, [(4, 10 * 24 * 60 + 1, 8, "b")])
    assert [(r.event_type, r.n) for r in run(live.per_window, "days")] == [("a", 3)]
    assert sorted((r.user_id, r.n) for r in run(live.sessions, "ends")) == [(7, 1), (7, 2)]


def test_days_over_a_restart(spark, folder, tmp_path):
    """State, lists and timers outlive a stop; a day ends once, by the timer or by the next day's first row."""
    days.use_rocksdb(spark)

    def feed(rows):
        spark.createDataFrame([(i, T0 + datetime.timedelta(minutes=m), u, s) for i, m, u, s in rows], "event_id long, ts timestamp, user_id long, step int").coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, step int").option("maxFilesPerTrigger", 1).parquet(folder)
        return sorted((r.user_id, round((r.start - T0).total_seconds() / 60), r.n, r.standing, r.newest) for r in live.drained(days.days(stream), f"file://{tmp_path}/out").collect())

    feed([(1, 0, 7, 1), (2, 1, 7, 1), (3, 2, 8, -1)])
    assert run() == []
    feed([(4, 5, 7, -1), (5, 6, 7, 1), (6, 10, 8, 1)])
    assert run() == []
    # 7 comes back after its day; 8 does not, and its timer runs out as the clock goes on
    feed([(7, 40, 7, 1)])
    feed([(8, 100, 9, 0)])
    want = [(7, 0, 4, 2, 5), (7, 40, 1, 1, 7), (8, 2, 2, 1, 6)]
    assert run() == want
    assert run() == want


def test_days_of_a_shard_end_each_by_its_own(spark, folder, tmp_path, monkeypatch):
    """Players share a state and its timer, not their days: calls go with shards, and all days that are over end in one of them."""
    days.use_rocksdb(spark)
    schema = "event_id long, ts timestamp, user_id long, step int"
    feed = lambda rows: spark.createDataFrame([(i, T0 + datetime.timedelta(minutes=m), u, s) for i, m, u, s in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    run = lambda more: sorted((r.user_id, r.n, r.standing, r.newest) for r in live.drained(days.days(spark.readStream.schema(schema).parquet(folder)), f"file://{tmp_path}/out", more=more).collect())
    feed([(u, u, u, 1) for u in range(20)] + [(100 + u, 20 + u, u, 1) for u in range(0, 20, 2)])
    assert run(True) == []
    feed([(200, 58, 3, 0), (201, 40, 100, 1)])
    assert run(False) == sorted([(u, 1, 1, u) for u in range(1, 20, 2)] + [(u, 2, 2, 100 + u) for u in (0, 2, 4, 6)])
    plan = days.days(spark.readStream.schema(schema).parquet(folder))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithStateInPySpark" in plan and "shard" in plan.split("TransformWithStateInPySpark")[1].split("Project")[1]
