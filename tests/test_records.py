"""Raw documents as files: folders, envelopes, both dialects, corrupt lines, quarantine and upserts."""
import datetime
import json

import pytest

from pyspark.sql import functions as F

from courtside.operators import records
from courtside.sources.storage import load_days, newest_by_key, quarantined, read_lenient, upserted, written_with_counts


def test_bodies(spark, tmp_path):
    camel = {"matchUuid": "AbC", "matchStatus": 4, "matchCompletedType": 5, "teamOnePlayerOneUuid": "P1", "teamOnePlayerTwoUuid": "P2", "teamTwoPlayerOneUuid": "P3", "teamTwoPlayerTwoUuid": "P4", "teamOnePlayerOneName": " Ann   Lee ",
             "teamOneGameOneScore": 11, "teamTwoGameOneScore": 9, "teamOneGameTwoScore": 14, "teamTwoGameTwoScore": 11, "teamOneGameThreeScore": 9, "teamTwoGameThreeScore": 6, "scoreFormatGameOneMax": 11, "scoreFormatGame2Max": 11, "scoreFormatGameThreeMax": 11, "matchAbbreviation": "WDG"}
    snake = {records._snake(k): v for k, v in camel.items() if k != "matchAbbreviation"} | {"match_uuid": "def", "event_title": "Mens pairs, draw: second", "round_text": "Finals", "match_completed_type": 6}
    shell = {records._snake(k): v for k, v in camel.items() if "Score" not in k and "Uuid" not in k} | {"match_uuid": "shell"}
    lost = {k: v for k, v in camel.items() if k != "teamTwoPlayerTwoUuid"} | {"matchUuid": "lost"}
    files = {"t1/2024-05-01.json": {"data": camel}, "t1/deep/2024-05-02.json": [snake, shell], "t2/2024-05-03.json": {"data": [lost]}, "t2/empty.json": {"data": []}, "t2/404.json": None, "t2/bad.json": "not a document", "t2/skipped.txt": {}}
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body if isinstance(body, str) else json.dumps(body))
    bodies = records.read_bodies(spark, f"file://{tmp_path}")
    seen = {(r.parent, r.stem): r.s for r in bodies.select("parent", "stem", records.body_status(F.col("body")).alias("s")).collect()}
    assert seen == {("t1", "2024-05-01"): "rows", ("deep", "2024-05-02"): "rows", ("t2", "2024-05-03"): "rows", ("t2", "empty"): "empty", ("t2", "404"): "404", ("t2", "bad"): "404"}
    good, bad = quarantined(records.matches(bodies), F.col("reason"))
    assert {(r.match_id, r.reason) for r in bad.collect()} == {("shell", "shell"), ("lost", "lost:t2_p2")}
    games = {(r.match_id, r.game_number): r for r in records.games_of(good).collect()}
    assert {k: (g.action, g.margin) for k, g in games.items()} == {("abc", 1): ("keep", 2), ("abc", 2): ("flag", 3), ("abc", 3): ("drop", 3), ("def", 1): ("keep", 2), ("def", 2): ("keep", 3), ("def", 3): ("keep", 3)}
    first = games["abc", 1]
    assert (first.t1_p1, first.t1_p1_name, first.context, first.target, first.is_forfeit) == ("p1", "Ann Lee", "womens", 11, False)
    assert (games["def", 1].context, games["def", 1].stage, games["def", 1].is_forfeit) == ("mens", "second — Finals", True)


def test_labels(spark):
    r = spark.range(1).select(*(records.target_of(F.lit(x)) for x in ("sideout_15", "sideout_11", "rally_21")), records.format_label(F.lit(True), F.lit(21)), *(records.context_of(F.lit(None).cast("string"), F.lit(t)) for t in ("Mixed Women", "Women", "Men", "Juniors"))).first()
    assert list(r) == [15, 11, 11, "rally_21", "mixed", "womens", "mens", None]


def test_lenient_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"k": 1, "v": "one"}\n{"k": 2, "v": \nplain words\n{"k": 3}\n')
    rows, corrupt = read_lenient(spark, f"file://{tmp_path}/a", "k int, v string")
    assert sorted((r.k, r.v) for r in rows.collect()) == [(1, "one"), (3, None)] and corrupt.count() == 2
    (tmp_path / "b.csv").write_text("k,v\n1,one\n2,two,extra\nthree,3\n4,\n")
    rows, corrupt = read_lenient(spark, f"file://{tmp_path}/b.csv", "k int, v string", "csv")
    assert sorted((r.k, r.v) for r in rows.collect()) == [(1, "one"), (4, None)] and corrupt.count() == 2
    assert all(r.file.endswith("b.csv") for r in corrupt.collect())


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, at int")
    got = upserted(old, new, ["k"], [F.desc("at")])
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    # the same batch again changes nothing
    assert sorted(upserted(got, new, ["k"], [F.desc("at")]).collect()) == sorted(got.collect())
    assert newest_by_key(new, ["k"], [F.desc("at")]).count() == 2


def _day(n):
    return datetime.date(2024, 5, n)


def test_late_corrections(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    of = lambda rows: spark.createDataFrame([(_day(d), k, v) for d, k, v in rows], "d date, k int, v string")
    seen = lambda: sorted((r.d.day, r.k, r.v) for r in spark.read.parquet(path).collect())
    first = [(1, 1, "a"), (2, 2, "a"), (5, 3, "a"), (6, 4, "a")]
    assert load_days(path, of(first), "d") == 4 and seen() == first
    # day 1 is final and its correction is left out; day 3 is new to the table; days 5 and 6 are replaced as a whole
    late = [(1, 1, "b"), (3, 9, "b"), (5, 3, "b"), (6, 5, "b"), (7, 6, "b")]
    want = [(1, 1, "a"), (2, 2, "a"), (3, 9, "b"), (5, 3, "b"), (6, 5, "b"), (7, 6, "b")]
    assert load_days(path, of(late), "d") == 4 and seen() == want
    # a run that fails half way changes nothing, and one that is repeated neither
    broken = of([*late, (7, 7, "c")]).withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise("c"))
    with pytest.raises(Exception, match="lost"):
        load_days(path, broken, "d")
    assert seen() == want
    load_days(path, of([(3, 9, "x"), *late[2:]]), "d")
    assert seen() == want
    assert load_days(path, of([]), "d") == 0 and seen() == want


def test_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    assert [tuple(r) for r in written_with_counts({"t": (df, "k")}, f"file://{tmp_path}").collect()] == [("t", 3, 1)]
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 3


def test_nested_lineups(spark):
    of = lambda name, *ids, **more: dict(zip(("teamOnePlayerOneUuid", "teamOnePlayerTwoUuid", "teamTwoPlayerOneUuid", "teamTwoPlayerTwoUuid"), ids), matchAbbreviation=name, **more)
    one = {"matchupUuid": "F1", "matches": [of("WDG", "A", "B", "C", "D"), of("mxd1", "E", "F", "G", "H"), of("MD", "I", "J", "K", None), of("MXD2", "L", "M", "N", "O", isTieBreaker=True), of("WD", "P", "Q", "R", "S"), of("DB", "T", "U", "V", "W")]}
    bodies = spark.createDataFrame([(json.dumps(one),), (json.dumps({"matchupUuid": "F2", "matches": []}),), (json.dumps({"matchupUuid": "F3"}),), ("not a document",), (None,)], "body string")
    found = records.lineups(bodies)
    assert sorted((r.fixture, r.slot, r.one, r.two) for r in found.collect()) == [("f1", "MXD1", ["e", "f"], ["g", "h"]), ("f1", "WD", ["p", "q"], ["r", "s"])]
    seen = lambda who: sorted((r.slot, r.own, r.other) for r in records.turned(found.withColumn("who", F.lit(who)), "who").collect())
    assert seen("h") == [("MXD1", ["g", "h"], ["e", "f"]), ("WD", ["r", "s"], ["p", "q"])] and seen("e")[0] == ("MXD1", ["e", "f"], ["g", "h"]) and seen("z") == []
