"""Best-fit-decreasing packing into rows of an id matrix.

The documents of a block (bounded by its tokens) are sorted by length, longest first; each goes to the open
window with the least room that holds it, found by a segment tree over the capacities. Overlong documents are
split without loss into whole windows and a rest. A result row is one row of the matrix: its ids and positions as
little-endian unsigned 16-bit numbers (positions start from 0 in each segment, padding has id `pad` and
position 0), the cumulative segment lengths, and what each segment is.

Each task packs its own input partition, block by block: no shuffle, bounded memory. Null texts count as empty
(the end id alone), very long texts are encoded in parts and split, equal rows are packed as often as they come, rows without a doc_id or
with a shared one too (null in doc_ids), an empty table gives no rows, other columns are ignored.

write_matrix() puts the rows into a folder of any file system as files of fixed-width rows (ids, positions) with their lengths, which read_matrix() gives back.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sequence_id long, length int, n_segments int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


class CapacityTree:
    """Counts of open windows by room left; finds the least room of at least `need` in log2(width) steps."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int | None:
        count, at = self.count, need + self.leaves
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Windows as lists of item numbers; sizes are 1 to width. Equal sizes keep their order."""
    tree, windows = CapacityTree(width), []
    by_room: list[list[int]] = [[] for _ in range(width + 1)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.least(sizes[i])
        if room is None:
            windows.append([i])
            at, left = len(windows) - 1, width - sizes[i]
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
            windows[at].append(i)
            left = room - sizes[i]
        if left:
            by_room[left].append(at)
            tree.add(left, 1)
    return windows


def packed_matrix(docs: DataFrame, width: int = 2048, pad: int = 0, block_tokens: int = 4_000_000, tokenizer_path: str | None = None) -> DataFrame:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .subwords import END_ID, subwords

        number, encoder = TaskContext.get().partitionId() << 33, subwords(tokenizer_path)
        block: list = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, block, held
            pieces = [(d, s, ids[s : s + width]) for d, ids in block for s in range(0, len(ids), width)]
            block, held = [], 0
            rows = []
            for window in best_fit_decreasing([len(p[2]) for p in pieces], width):
                parts = [pieces[i] for i in window]
                ids, places = np.full(width, pad, "<u2"), np.zeros(width, "<u2")
                ends = np.cumsum([0, *(len(p[2]) for p in parts)])
                for (_, _, x), a in zip(parts, ends):
                    ids[a : a + len(x)] = x
                    places[a : a + len(x)] = np.arange(len(x))
                rows.append((number, int(ends[-1]), len(parts), [p[0] for p in parts], [p[1] for p in parts], ends.tolist(), ids.tobytes(), places.tobytes()))
                number += 1
                if len(rows) == 512:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    block.append((doc_id, np.append(encoder.encode([text])[0], np.uint16(END_ID))))
                    held += len(block[-1][1])
                    if held >= block_tokens:
                        yield from flush()
        yield from flush()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(packed, SCHEMA)


_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], [c.split()[0] for c in SCHEMA.split(", ")])


def write_matrix(packed: DataFrame, path: str) -> None:
    """A matrix row a row, in order within each file; a lost task writes its file again, and the folder counts once _SUCCESS is there."""
    packed.sortWithinPartitions("sequence_id").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The rows with ids and positions as arrays, padding cut off."""
    numbers = lambda raw: F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.conv(F.hex(F.concat(F.substring(raw, 2 * i, F.lit(1)), F.substring(raw, 2 * i - 1, F.lit(1)))), 16, 10).cast("int"))
    return spark.read.schema(SCHEMA).parquet(path).withColumns({"ids": numbers("ids"), "position_ids": numbers("position_ids")})
