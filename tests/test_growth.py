"""What larger tables need: nothing dear is done once a row, sorted whole or moved more often than it must."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from courtside import catalog
from courtside.operators import resampling
from courtside.plans.models import _M, mixed
from courtside.sources import tables

from .conftest import SMALL
from .oracle import same


def plan(spark, name, sf_dir=SMALL):
    return catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["upset_band", "day_summary"])
def test_races_are_not_played_for_every_game(spark, name):
    assert "aggregate(" not in plan(spark, name) and "lambda" not in plan(spark, name)


@pytest.mark.parametrize("name", ["resampled_fit", "paired_bootstrap", "permutation_null"])
def test_rows_are_not_repeated_for_each_repetition(spark, name, monkeypatch):
    from courtside.plans import fitting

    seen = []
    monkeypatch.setattr(fitting, "keyed_newton", lambda cells: seen.append(cells) or cells.selectExpr("key", "won as b0", "won as b1", "won as b2"))
    assert "sequence(" not in plan(spark, name) and "explode(" not in plan(spark, name)


def test_hashes_equal_those_of_spark(spark):
    keys, reps = np.array([0, 1, 77, 2**31 - 1, 2**31 + 5, 2**40 + 3]), np.array([0, 1, 1999])
    rows = spark.createDataFrame([(i, j, int(k), int(r)) for i, k in enumerate(keys) for j, r in enumerate(reps)], "i int, j int, k long, r long")
    want = {(r.i, r.j): r.h for r in rows.select("i", "j", mixed(F.col("k") % _M, F.col("r")).alias("h")).collect()}
    assert want == {(i, j): int(h) for i, row in enumerate(resampling.hashes(keys, reps)) for j, h in enumerate(row)}


@pytest.mark.parametrize("name", ["games_unpivot", "running_games", "standings_full", "record_lists"])
def test_more_games_are_more_parts(spark, name, monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 1000)
    assert "RepartitionByExpression [l_orderkey" in plan(spark, name)
    same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], SMALL)


def test_first_games_are_found_by_hash(spark):
    assert "min(struct(" not in plan(spark, "first_seen_index") and "named_struct(date" not in plan(spark, "first_seen_index")


def test_pools_are_sorted_in_ranges(spark):
    for name in ("elo", "elo_steps"):
        assert "RepartitionByExpression [context" in plan(spark, name) and "date#" in plan(spark, name).split("MapInPandas")[-1].split("RepartitionByExpression")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["durability", "durability_spread"])
def test_only_games_where_halves_meet_are_ranked(spark, name, monkeypatch):
    from courtside.plans import clutch

    seen, ranked = [], clutch.ranked_within
    monkeypatch.setattr(clutch, "ranked_within", lambda rows, *a: seen.append(rows) or ranked(rows, *a))
    same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], SMALL)
    every = 4 * tables.games(spark, SMALL).where("not is_forfeit").count()
    assert 0 < seen[0].count() * 10 < every


def test_documents_are_parsed_once_and_in_parts(spark, monkeypatch):
    from courtside.plans import records

    monkeypatch.setattr(records, "PART_BYTES", 1000)
    assert plan(spark, "raw_quarantine").count("Relation [") == 1
    for name in ("raw_quarantine", "raw_games", "fixture_counts", "mixed_same_gender"):
        assert "RepartitionByExpression [o_orderkey" in plan(spark, name)
    same(catalog.QUERIES["raw_quarantine"](spark, SMALL), catalog.ORACLE_SQL["raw_quarantine"], SMALL)
