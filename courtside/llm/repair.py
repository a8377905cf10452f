"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's turns are to read `(s?(ua)+)?` by the first letters of their roles. Edits: Keep a turn (free), Rerole it to user or assistant (2), Delete it
(3; needed where it is blank or said before), Insert an empty turn of user or assistant (2); a truncated turn that isn't deleted costs 1 more. Of the cheapest
edits those count whose letters are least in ASCII.

What has been read is one of four states (nothing, s, u, a), and the state decides which role a Rerole or an Insert gives. An Insert belongs to the next turn's
step, so that edits of the same turns are never one the other's beginning, and a forward vector of four costs, with the order of the four states' least letters,
is all that a half has to hand on. Forward and backward vectors meet in the middle; of the cheapest crossings the least one is taken, and both halves are
repaired likewise: space grows with the turns, not with the turns times states and edits.

The upper halves are spread over Spark: turns are put in order by ranges, so a conversation of any length lies in blocks of at most BLOCK turns; each block
gives its vectors from each of the four states (summaries), a fold over a conversation's summaries chooses the states at which blocks meet (crossings), and each
block is then halved by itself (edits). Turns said before are found by the least number of their digest, so one that is said very often is no group of its own.

Null roles and texts are one space. Turns are ordered by turn (null first), then role, then the digest of the text; repeated rows stay, side by side. Rows without a
conv_id are a conversation of their own. An empty table gives no rows; other columns are ignored. SHA-256 can't be split, so the digest of one conversation is
one stream through one task, in bounded memory.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import streamed_sha256, written

BLOCK_BITS = 12
START, SYSTEM, USER, ASSISTANT = range(4)
#: Code of a turn: first letter of its role (s, u, a, another), + 4 if it has to be deleted, + 8 if it is truncated.
LETTERS, DELETED, TRUNCATED = "sua", 4, 8
_FAR = 1 << 60
_TURNED = (USER, USER, ASSISTANT, USER)  # where an Insert or Rerole leads from each state
_TAIL = (0, 2, 1, 0)  # Inserts that end a conversation from each state
_LEGAL = {(0, 1), (1, 2), (2, 1)}  # su, ua, au
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}


def _step(code: int) -> list[list[tuple[int, str] | None]]:
    """[from][to]: least cost and letters of one turn's step, with at most two Inserts before it (a third would undo the first)."""
    letter, extra = code & 3, int(code & TRUNCATED > 0)
    out = []
    for start in range(4):
        found: list[tuple[int, str] | None] = [None] * 4
        state = start
        for k in range(3):
            ways = [(state, 3, "D")]
            if not code & DELETED:
                ways.append((_TURNED[state], 2 + extra, "R"))
                if (state, letter) in _KEPT:
                    ways.append((_KEPT[state, letter], extra, "K"))
            for to, cost, edit in ways:
                new = (2 * k + cost, "I" * k + edit)
                if found[to] is None or new < found[to]:
                    found[to] = new
            state = _TURNED[state]
        out.append(found)
    return out


STEPS = [_step(code) for code in range(16)]


def forward(codes: list[int], start: int) -> tuple[list[int], list[int]]:
    """Least cost of each state after the turns, and the order of the states by their letters."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    for code in codes:
        step, best = STEPS[code], [None] * 4
        for a in range(4):
            if cost[a] < _FAR:
                for b, way in enumerate(step[a]):
                    if way:
                        new = (cost[a] + way[0], rank[a], way[1])
                        if best[b] is None or new < best[b]:
                            best[b] = new
        there = sorted((b for b in range(4) if best[b]), key=lambda b: best[b][1:])
        cost = [x[0] if x else _FAR for x in best]
        for k, b in enumerate(there):
            rank[b] = k
    return cost, rank


def backward(codes: list[int], end: int) -> list[int]:
    """Least cost from each state before the turns to `end` after them."""
    cost = [_FAR] * 4
    cost[end] = 0
    for code in reversed(codes):
        cost = [min((way[0] + cost[b] for b, way in enumerate(ways) if way and cost[b] < _FAR), default=_FAR) for ways in STEPS[code]]
    return cost


def crossing(cost: list[int], rank: list[int], rest: list[int]) -> int:
    return min(range(4), key=lambda s: (min(cost[s] + rest[s], _FAR), rank[s]))


def letters(codes: list[int], start: int, end: int) -> list[str]:
    """The letters of each turn's step, from state to state."""
    if len(codes) == 1:
        return [STEPS[codes[0]][start][end][1]]
    middle = len(codes) // 2
    meet = crossing(*forward(codes[:middle], start), backward(codes[middle:], end))
    return letters(codes[:middle], start, meet) + letters(codes[middle:], meet, end)


def crossings(blocks: list[tuple[list[int], list[int]]]) -> tuple[list[int], int, int]:
    """blocks: costs and orders from each state to each, flat. The state after each block, the cost, and the Inserts at the end."""
    vectors = [([0, _FAR, _FAR, _FAR], [0] * 4)]
    for costs, ranks in blocks:
        cost, rank = vectors[-1]
        best = [min((min(cost[a] + costs[4 * a + b], _FAR), rank[a], ranks[4 * a + b]) for a in range(4)) for b in range(4)]
        order = sorted(range(4), key=lambda b: (best[b][0] >= _FAR, best[b][1:]))
        vectors.append(([x[0] for x in best], [order.index(b) for b in range(4)]))
    ends = [crossing(*vectors[-1], [2 * n for n in _TAIL])]
    for (cost, rank), (costs, _) in zip(vectors[-2:0:-1], blocks[:0:-1]):
        ends.append(crossing(cost, rank, costs[ends[-1] :: 4]))
    return ends[::-1], vectors[-1][0][ends[0]] + 2 * _TAIL[ends[0]], _TAIL[ends[0]]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the damaged rows: by crc32(`conv_id:turn`) % 20, 0 drops a row, 1 empties its text, 2 takes its [.!?] away, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def ordered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with n, which numbers each conversation's turns in order, and each turn's first fault; written once."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    own = own.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    order = ["conv_id", "turn", "role", "said"]
    return written(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, n, fault (blank, duplicate, truncated or null) and code of each turn; no texts."""
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    own = turns.select("conv_id", "turn", "n", "said", F.coalesce(F.array_position(F.array(*map(F.lit, LETTERS)), F.substring("role", 1, 1)) - 1, F.lit(-1)).alias("letter"), (end == "").alias("blank"), F.substring(end, -1, 1).isin(*".!?").alias("whole"))
    first = own.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min("n").alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("n") > F.col("first"), "duplicate").when(~F.col("whole"), "truncated")
    code = F.when(F.col("letter") < 0, 3).otherwise(F.col("letter")) + F.when(F.col("fault").isin("blank", "duplicate"), DELETED).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    seen = own.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
    return seen.withColumn("fault", fault).select("conv_id", "turn", "n", "fault", code.cast("int").alias("code"))


def blocks_of(marked: DataFrame, bits: int) -> DataFrame:
    """conv_id, block, and the block's turns (n, code) in order; at most 2 ** bits."""
    return marked.groupBy("conv_id", F.shiftright("n", bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("n", "code"))).alias("turns"))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
        rows = []
        for codes in batch.column("codes").to_pylist():
            found = [forward(codes, start) for start in range(4)]
            illegal = sum((a & 3, b & 3) not in _LEGAL for a, b in zip(codes, codes[1:]))
            rows.append((codes[0] & 3, codes[-1] & 3, illegal, sum((c for c, _ in found), []), sum((r for _, r in found), [])))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["conv_id", "block", "first", "last", "illegal", "costs", "ranks"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come by conversation, in order: a row each, with the states where it begins and ends; cost and illegal stand at the last."""
    names = ["conv_id", "block", "start", "end", "tail", "cost", "illegal"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
    rows: list[tuple] = []
    for conv_id, own in groupby((r for batch in batches for k in range(0, batch.num_rows, 1024) for r in batch.slice(k, 1024).to_pylist()), key=lambda r: r["conv_id"]):
        own = list(own)
        ends, cost, tail = crossings([(r["costs"], r["ranks"]) for r in own])
        illegal = sum(r["illegal"] for r in own) + sum((a["last"], b["first"]) not in _LEGAL for a, b in zip(own, own[1:]))
        last = len(own) - 1
        rows += [(conv_id, r["block"], start, end, tail if k == last else 0, cost if k == last else None, illegal if k == last else None) for k, (r, start, end) in enumerate(zip(own, [START, *ends], ends))]
        if len(rows) >= 10_000:
            yield batch_of(rows)
            rows = []
    if rows:
        yield batch_of(rows)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row an edit: its turn's n, its place among that turn's, its letter, and the role that it gives."""
    for batch in batches:
        for small in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
            out: list[tuple] = []
            for r in small.to_pylist():
                state, steps = r["start"], letters(r["codes"], r["start"], r["end"])
                steps[-1] += "I" * r["tail"]
                for n, code, step in zip(r["ns"], r["codes"], steps):
                    for place, edit in enumerate(step):
                        role = None
                        if edit in "IR":
                            state = _TURNED[state]
                            role = ROLE_OF[state]
                        elif edit == "K":
                            state = _KEPT[state, code & 3]
                        out.append((r["conv_id"], n, place, edit, role))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], ["conv_id", "n", "place", "edit", "role"])


def edits(marked: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(edits: conv_id, n, place, edit, role; conversations: conv_id, cost, illegal) of marked turns, which faults() gives."""
    blocks = written(blocks_of(marked, bits).select("conv_id", "block", F.col("turns.n").alias("ns"), F.col("turns.code").alias("codes")), "blocks")
    summaries = blocks.select("conv_id", "block", "codes").mapInArrow(_summaries, "conv_id long, block long, first int, last int, illegal long, costs array<long>, ranks array<int>")
    folded = summaries.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_folded, "conv_id long, block long, start int, end int, tail int, cost long, illegal long")
    folded = written(folded, "crossings")
    # a block has one conversation or the end of one and the begin of others, so both keys are needed
    meet = folded.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "start", "end", "tail")
    whole = blocks.join(meet, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    return whole.mapInArrow(_edited, "conv_id long, n long, place int, edit string, role string"), folded.where("cost is not null").select("conv_id", "cost", "illegal")


def repaired(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """The edits with what they leave: conv_id, n, place, edit, role, text, in order of n and place; role and text are null where a turn is deleted."""
    texts = turns.select("n", F.col("role").alias("old"), "text")
    kept = F.col("edit") != "D"
    return edited.join(texts, "n").select("conv_id", "n", "place", "edit", F.when(kept, F.coalesce("role", "old")).alias("role"), F.when(F.col("edit") == "I", "").when(kept, F.col("text")).alias("text"))


def report(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """A row for each conv_id of `rows`: what is wrong in its damaged() rows and how they are repaired."""
    turns = ordered(damaged(rows))
    marked = written(faults(turns), "faults")
    edited, costs = edits(marked, bits)
    fixed = written(repaired(turns, edited), "repaired")
    names = ("blank", "duplicate", "truncated")
    by_turn = marked.groupBy("conv_id", "turn").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in names))
    counts = by_turn.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *(F.sum(f).alias(f) for f in names))
    parts = fixed.groupBy("conv_id", F.shiftright("n", bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("n", "place", "edit"))).alias("own")).select("conv_id", "block", F.array_join("own.edit", "").alias("part"))
    audit = parts.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "part")))["part"], "").alias("audit"))
    lines = fixed.where("edit <> 'D'").select("conv_id", "n", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = streamed_sha256(lines, ["conv_id"], ["n", "place"], "line", "\n").withColumnRenamed("sha256", "repaired_sha256")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = every
    for part in (counts, costs, audit, digests):
        both = both.unionByName(part, allowMissingColumns=True)
    longs = ("gaps", *names, "illegal", "cost")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return both.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))
