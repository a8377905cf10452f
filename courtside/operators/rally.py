"""Order-dependent folds that no window can express; a group is a match, or a pool that a parameter names."""
from __future__ import annotations

from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Games of a pool in a row of arrays.
CHUNK = 10_000


def retracted(log: DataFrame) -> DataFrame:
    """(match_id, side, points, taken_back): point rows push, negative ones (k < 5) pop the side's latest. A match's log is small."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        stacks: dict[int, list[int]] = {0: [], 1: []}
        back = {0: 0, 1: 0}
        for side, k, index in pdf.sort_values("log_index")[["side", "k", "log_index"]].itertuples(index=False):
            if k >= 5:
                stacks[side].append(index)
            elif stacks[side]:
                stacks[side].pop()
                back[side] += 1
        return pd.DataFrame({"match_id": pdf["match_id"].iloc[0], "side": [0, 1], "points": [len(stacks[s]) for s in (0, 1)], "taken_back": [back[s] for s in (0, 1)]})

    points = log.where("log_type = 14").select("match_id", F.col("side").cast("int").alias("side"), F.col("k").cast("int").alias("k"), "log_index")
    return points.groupBy("match_id").applyInPandas(fold, "match_id long, side int, points long, taken_back long")


def _in_order(games: DataFrame, pool: str) -> DataFrame:
    """(pool, date, gid, a1, a2, b1, b2, y): up to CHUNK games that follow each other in their pool, as arrays; date and gid are the first one's.

    Games are sorted in ranges, so no task sorts a pool; what folds a pool sorts and holds these rows alone, of a few bytes a game.
    """
    own = games.select(pool, "date", "gid", "a1", "a2", "b1", "b2", (F.col("margin") > 0).cast("double").alias("y"))
    own = own.repartitionByRange(pool, "date", "gid").sortWithinPartitions(pool, "date", "gid")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    def chunks(batches):
        for pdf in batches:
            for _, same in pdf.groupby(pool, sort=False, dropna=False):
                for at in range(0, len(same), CHUNK):
                    part = same.iloc[at : at + CHUNK]
                    yield pd.DataFrame([{pool: part[pool].iloc[0], "date": part["date"].iloc[0], "gid": part["gid"].iloc[0]} | {c: part[c].to_numpy() for c in ("a1", "a2", "b1", "b2", "y")}])

    return own.mapInPandas(chunks, f"{pool} {kinds[pool]}, date {kinds['date']}, gid string, a1 array<long>, a2 array<long>, b1 array<long>, b2 array<long>, y array<double>")


def _games_of(row) -> zip:
    return zip(*(row[c].tolist() for c in ("a1", "a2", "b1", "b2", "y")))


def elo_by_pool(games: DataFrame, pool: str, k: float = 24.0) -> DataFrame:
    """(pool, player, rating): each game moves its four players by what its result says beyond their ratings.

    Games of a pool depend on each other in order, so a pool is folded in one task; it is read as a stream of sorted rows and only
    ratings are held, so its size is bounded by its players, not its games.
    """
    ordered = _in_order(games, pool).repartition(pool).sortWithinPartitions(pool, "date", "gid")

    def fold(batches):
        now, ratings = None, {}

        def out():
            return pd.DataFrame({pool: [now] * len(ratings), "player": list(ratings), "rating": list(ratings.values())})

        for pdf in batches:
            for _, row in pdf.iterrows():
                if row[pool] != now:
                    if ratings:
                        yield out()
                    now, ratings = row[pool], {}
                get = ratings.get
                for a1, a2, b1, b2, y in _games_of(row):
                    gap = get(a1, 0.0) + get(a2, 0.0) - get(b1, 0.0) - get(b2, 0.0)
                    step = k * (y - 1 / (1 + 10 ** (-gap / 800)))
                    for who, sign in ((a1, 1), (a2, 1), (b1, -1), (b2, -1)):
                        ratings[who] = get(who, 0.0) + sign * step
        if ratings:
            yield out()

    return ordered.mapInPandas(fold, f"{pool} string, player long, rating double")


def elo_sweep(games: DataFrame, pool: str, steps: list[float]) -> DataFrame:
    """(k, games, log_loss) for each step size, over all pools. A pool and step size is folded in one task, as elo_by_pool() is, in streamed order."""
    ks = games.sparkSession.createDataFrame([(k,) for k in steps], "k double")
    ordered = _in_order(games, pool).join(F.broadcast(ks)).repartition(pool, "k").sortWithinPartitions(pool, "k", "date", "gid")

    def fold(batches):
        now, ratings, loss, n = None, {}, 0.0, 0
        for pdf in batches:
            for _, row in pdf.iterrows():
                k = row["k"]
                if (row[pool], k) != now:
                    if n:
                        yield pd.DataFrame({"k": [now[1]], "n": [n], "loss": [loss]})
                    now, ratings, loss, n = (row[pool], k), {}, 0.0, 0
                get = ratings.get
                for a1, a2, b1, b2, y in _games_of(row):
                    chance = 1 / (1 + 10 ** (-(get(a1, 0.0) + get(a2, 0.0) - get(b1, 0.0) - get(b2, 0.0)) / 800))
                    loss -= log(max(chance if y else 1 - chance, 1e-6))
                    n += 1
                    for who, sign in ((a1, 1), (a2, 1), (b1, -1), (b2, -1)):
                        ratings[who] = get(who, 0.0) + sign * k * (y - chance)
        if n:
            yield pd.DataFrame({"k": [now[1]], "n": [n], "loss": [loss]})

    sums = ordered.mapInPandas(fold, "k double, n long, loss double").groupBy("k").agg(F.sum("n").alias("games"), F.sum("loss").alias("loss"))
    return sums.select("k", "games", (F.col("loss") / F.col("games")).alias("log_loss"))
