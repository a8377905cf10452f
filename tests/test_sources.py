"""Raw folders: what is read, pruned and pushed down; sinks that are read again; compact logs."""
import datetime
import json
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from courtside.plans.sources import compact_log, order_documents
from courtside.sources import raw_folder
from courtside.sources.raw_folder import _Reader, read_csv, read_raw, slice_of, write_bodies, write_csv

from .conftest import SMALL

ROWS = [("north/a b=c", "2024-05-01", '{"k": 1,\n "v": "é"}'), ("north/a b=c", "2024-05-02", '{"k": 2}'), ("south", "2024-05-02", '{"k": 3}'), ("south", "2024-05-02", '{"k": 3}'), ("south", None, '{"k": 4}'), (None, "2024-05-03", None)]


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "tournament string, day string, body string").withColumn("day", F.col("day").cast("date"))
    write_bodies(rows, f"file://{tmp_path}/raw")
    return f"file://{tmp_path}/raw"


def keys(df):
    return sorted((str(r.tournament), str(r.day), r.body) for r in df.collect())


def test_all_rows(spark, folder):
    assert keys(read_raw(spark, folder)) == sorted((str(t), str(d), (b or "").replace("\n", " ")) for t, d, b in ROWS)


@pytest.mark.parametrize("rule", ["tournament = 'south'", "tournament in ('south', 'x')", "day = date '2024-05-02'", "day > date '2024-05-01'", "day >= date '2024-05-02' and day < date '2024-05-03'", "day <= date '2024-05-01'", "tournament is null", "day is null", "day is not null and body like '%3%'", "tournament <=> null", "tournament like 'no%'", "day <> date '2024-05-02'", "tournament = 'south' or day is null", "tournament = 'nobody'"])
def test_same_as_filtered_afterwards(spark, folder, rule):
    plain = spark.createDataFrame(read_raw(spark, folder).collect(), raw_folder.SCHEMA)
    assert keys(read_raw(spark, folder).where(rule)) == keys(plain.where(rule))


def test_only_asked_files_are_opened(spark, folder):
    # a file that can't be decoded stands in every other place: whoever opens it fails
    root = folder.removeprefix("file://")
    for at, _, files in os.walk(root):
        if "day=" in at and not at.endswith("tournament=south/day=2024-05-02"):
            with open(f"{at}/broken.txt.gz", "wb") as f:
                f.write(b"no gzip")
    asked = read_raw(spark, folder).where("tournament = 'south' and day = date '2024-05-02'")
    assert [r.body for r in asked.collect()] == ['{"k": 3}'] * 2
    assert asked.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="(?i)gzip|zlib|header"):
        read_raw(spark, folder).collect()


def test_partitions(folder, monkeypatch):
    reader = _Reader(folder)
    assert list(reader.pushFilters([EqualTo(("tournament",), "south"), GreaterThan(("day",), datetime.date(2024, 5, 1)), StringContains(("body",), "k"), In(("file",), ("x",))])) == [StringContains(("body",), "k"), In(("file",), ("x",))]
    assert [(p.tournament, p.day) for p in reader.partitions()] == [("south", datetime.date(2024, 5, 2))]
    assert len(_Reader(folder).partitions()) == 5
    # a day beyond SPLIT is several tasks, which hold its files once each
    root = folder.removeprefix("file://")
    for i in range(3):
        with open(f"{root}/tournament=south/day=2024-05-02/more{i}.txt", "w") as f:
            f.write("x" * 50 + "\n")
    monkeypatch.setattr(raw_folder, "SPLIT", 60)
    days = [p for p in reader.partitions()]
    assert len(days) == 4 and len({f for p in days for f in p.files}) == sum(len(p.files) for p in days) == 4


def test_batches(folder, monkeypatch):
    monkeypatch.setattr(raw_folder, "BATCH_LINES", 1)
    reader = _Reader(folder)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(ROWS)
    assert all(b.num_rows == 1 for p in reader.partitions() for b in reader.read(p))


def test_switch(spark, folder, tmp_path):
    read_raw(spark, folder).write.parquet(f"{tmp_path}/table")
    spark.conf.set("courtside.documents", "table")
    try:
        table = read_raw(spark, f"{tmp_path}/table").where("day = date '2024-05-02'")
        assert "PartitionFilters" in table._jdf.queryExecution().toString() and keys(table) == keys(read_raw(spark, folder, "folder").where("day = date '2024-05-02'"))
        with pytest.raises(ValueError):
            read_raw(spark, folder, "other")
    finally:
        spark.conf.unset("courtside.documents")


def test_slice(spark):
    d = datetime.date
    rows = spark.createDataFrame([("a", d(2024, 1, 1), "1"), ("b", d(2024, 1, 2), "2"), ("a", d(2024, 1, 3), "3"), ("a", None, "4")], "tournament string, day date, body string")
    got = lambda **how: [r.body for r in slice_of(rows, **how).collect()]
    assert got(since=d(2024, 1, 2)) == ["2", "3"] and got(until=d(2024, 1, 2)) == ["1", "2"] and got(tournaments=["a"]) == ["1", "3", "4"]
    assert got(limit=2) == ["3", "2"] and got(tournaments=[]) == [] and got() == ["1", "2", "3", "4"]


def test_empty(spark, tmp_path):
    write_bodies(order_documents(spark, SMALL).limit(0), f"file://{tmp_path}/none")
    assert read_raw(spark, f"file://{tmp_path}/none").collect() == []


def test_csv(spark, tmp_path):
    rows = [(1, 'a "b", c'), (2, ""), (3, None), (4, "two\\lines"), (4, "two\\lines")]
    write_csv(spark.createDataFrame(rows, "k int, v string").withColumn("k", F.col("k")), f"{tmp_path}/csv", ["k", "v"])
    assert sorted(map(tuple, read_csv(spark, f"{tmp_path}/csv", "k int, v string").collect()), key=str) == sorted(rows, key=str)
    with pytest.raises(Exception, match="(?i)header|column"):
        read_csv(spark, f"{tmp_path}/csv", "v string, k int").collect()


def test_compact_log(spark):
    bodies = [
        '{"log_index": 3, "log_type": 14, "server_uuid": "ABC", "date_created": {"seconds": 9, "nanos": 1}, "timeout_log": {"team_uuid": "T1"}, "challenge_log": {"team_uuid": "T2"}}',
        '{"date_created": 12, "LogData": {"a": "text", "b": {"team_uuid": "U"}, "c": {"team_uuid": "V"}}, "extra": [1, 2]}',
        '{"date_created": "1970-01-01T00:01:00Z", "timeout_log": {}, "LogData": null}', '{"date_created": "no time"}', "{}", "null", "not json", "", None]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(compact_log(F.col("b"))).collect()]
    base = {"i": 0, "t": 0, "g": 1, "s": "", "e": "", "sv": "", "n": 0}
    assert [json.loads(x) if x else None for x in got] == [base | {"i": 3, "t": 14, "sv": "abc", "ts": 9, "team": "t1"}, base | {"ts": 12, "team": "u"}, base | {"ts": 60}, base, base, None, None, None, None]


def test_plan_names_pushed_filters(spark, folder):
    asked = slice_of(read_raw(spark, folder), since=datetime.date(2024, 5, 2), tournaments=["south"])
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Filter .*tournament", plan.split("PushedFilters")[0])
    assert asked.rdd.getNumPartitions() == 1
