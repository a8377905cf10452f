"""Sum-of-squares online packing of token sequences.

Each document goes to the fill level that keeps the sum of squared counts of partly filled windows least; the
counts are kept in an array by level. Documents longer than a window give whole windows first. When a task's input ends,
or its open windows hold OPEN_IDS ids (which bounds its memory whatever the lengths), the windows stay as they were built, fullest first,
and only their gaps are closed with ids cut from the emptiest; the last of all is laid out in windows of powers of two, so that no id is lost and no
place is padded.

A task packs the rows of its own input partition, in their order: no shuffle, and memory for the open windows
only. Null texts count as empty (the end id alone); very long texts are encoded in parts and cut into windows; equal rows are packed as
often as they come, rows without a doc_id or with a shared one too; an empty table gives no rows; other columns of the input are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPEN_IDS = 4_000_000


class SumOfSquares:
    """Windows of `width`: put(piece, size) returns the pieces of a window that this fills, or None. held: ids in open windows."""

    def __init__(self, width: int):
        self.width = width
        self.counts = np.zeros(width + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(width + 1)]
        self.held = 0

    def level(self, size: int) -> int:
        """The fill level that a piece of this size goes to; 0 opens a window. Of equal changes the fullest level."""
        width, n = self.width, self.counts
        levels = np.flatnonzero(n[1 : width - size + 1]) + 1
        if len(levels):
            # a window that becomes full leaves the sum: its level's count falls and no other rises
            change = np.where(levels + size < width, 2 * n[np.minimum(levels + size, width)] + 1, 0) - 2 * n[levels] + 1
            at = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[at] <= 2 * n[size] + 1:
                return int(levels[at])
        return 0

    def put(self, piece, size: int):
        level, window = self.level(size), []
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.held -= level
        window.append(piece)
        if level + size == self.width:
            return window
        self.open[level + size].append(window)
        self.counts[level + size] += 1
        self.held += level + size
        return None

    def taken(self) -> list[tuple[int, list]]:
        """All open windows as (filled, pieces), fullest first; none stay open."""
        windows = [(level, w) for level in range(self.width, 0, -1) for w in self.open[level]]
        self.__init__(self.width)
        return windows


def _rows(window: list, number: int, out: list) -> None:
    """A piece: (doc_id, start, ids, doc_tokens)."""
    at = 0
    for doc_id, start, ids, total in window:
        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, at))
        at += len(ids)


def _cut(pieces: list, take: int) -> list:
    """The last `take` ids of the pieces, as pieces in their order; pieces is left with the others."""
    out: list = []
    while take:
        doc_id, start, ids, total = pieces.pop()
        k = min(take, len(ids))
        if k < len(ids):
            pieces.append((doc_id, start, ids[:-k], total))
        out.insert(0, (doc_id, start + len(ids) - k, ids[len(ids) - k :], total))
        take -= k
    return out


def closed(windows: list[tuple[int, list]], width: int) -> Iterator[list]:
    """Whole windows: the fullest with their gaps closed from the emptiest, and the rest as windows of powers of two."""
    filled, first, last = [f for f, _ in windows], 0, len(windows) - 1
    while first < last:
        window, gap = windows[first][1], width - filled[first]
        while gap and last > first:
            take = min(gap, filled[last])
            window += _cut(windows[last][1], take)
            gap, filled[last] = gap - take, filled[last] - take
            filled[first] += take
            if not filled[last]:
                last -= 1
        if gap:
            break
        yield window
        first += 1
    rest, left = (windows[first][1], filled[first]) if first <= last else ([], 0)
    while left:
        take = min(width, 1 << (left.bit_length() - 1))
        yield _cut(rest, take)
        left -= take


def pack(docs: DataFrame, width: int = 2048, tokenizer_path: str | None = None, open_ids: int = OPEN_IDS) -> DataFrame:
    """One row for each piece of a document: where it starts in its document, and its sequence and place there."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .subwords import END_ID, subwords

        number = TaskContext.get().partitionId() << 33
        encoder, windows, out = subwords(tokenizer_path), SumOfSquares(width), []
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encoder.encode([text])[0], np.uint16(END_ID))
                    total = len(ids)
                    whole = total // width * width
                    for start in range(0, whole, width):
                        _rows([(doc_id, start, ids[start : start + width], total)], number, out)
                        number += 1
                    if total > whole:
                        full = windows.put((doc_id, whole, ids[whole:].copy(), total), total - whole)
                        if full:
                            _rows(full, number, out)
                            number += 1
                    if windows.held > open_ids:
                        for window in closed(windows.taken(), width):
                            _rows(window, number, out)
                            number += 1
                    if len(out) > 10_000:
                        yield _batch(out)
                        out = []
        for window in closed(windows.taken(), width):
            _rows(window, number, out)
            number += 1
        yield _batch(out)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(packed, SCHEMA)


def _batch(rows: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)
