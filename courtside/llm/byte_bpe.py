"""Byte-level BPE by reduction up a tree.

The encoding of a text is made from those of its halves, on two levels:

- A text is halved down to LEAF characters. A leaf is matched by the pattern as if it stood alone. Two neighbours are joined by matching anew from the
  left one's first match that could look past its end, until a match ends where one of the right one's does: a match depends on the text from its start on
  only, so all matches outside that window stay as they are.
- A match's bytes are halved down to LEAF_BYTES, which are merged outright. Two neighbours are joined by merging the bytes of the last and first few tokens
  anew; the window grows, twice as wide each time, on the side where its outermost token and the next one outside would not both outlive a merge of their
  own. Tokens of which all neighbours do are the merge of the whole: up to the first merge across a token's end, merges on both sides go as in the pair alone.

Matches of a worker's past texts are remembered (KNOWN of them, of up to SHORT characters). Decoding joins the bytes of the ids, up the tree likewise.

Each row is encoded by itself: no shuffle. A null text is empty (no ids); a very long one goes up the tree, in memory for the one text; rows that are
repeated, have a shared doc_id or none are encoded each; an empty table gives no rows; other columns of the input are ignored.
"""
from __future__ import annotations

import base64
import functools
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RANKS_FILE = "byte_bpe_50k.tiktoken"
LEAF, LEAF_BYTES = 1 << 16, 5
#: Characters past a match's start that decide on it at most, beside those up to one past its end: a contraction has three.
AHEAD = 3
KNOWN, SHORT = 600_000, 64
#: Pairs of tokens and short stretches of bytes that a worker remembers the merges of.
MERGES = 300_000
#: Ids of a batch at most, but for one text.
BATCH_IDS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS_FILE)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBpe:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF, leaf_bytes: int = LEAF_BYTES):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self._pattern, self._leaf, self._leaf_bytes = regex.compile(pattern), leaf, leaf_bytes
        self._known: dict[str, bytes] = {}
        self._short: dict[bytes, list[int]] = {}
        self._pairs: dict[int, list[int]] = {}

    # a match's bytes

    def merged(self, raw: bytes) -> list[int]:
        """Least rank first, leftmost of equal ones."""
        ranks, none, parts = self.ranks, len(self.tokens), [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _remembered(self, raw: bytes) -> list[int]:
        """merged() of few bytes."""
        known = self._short.get(raw)
        if known is None:
            if len(self._short) >= MERGES:
                self._short.clear()
            known = self._short[raw] = self.merged(raw)
        return known

    def pair(self, a: int, b: int) -> list[int]:
        """What two neighbours' bytes are merged to: the two if they outlive it."""
        known = self._pairs.get(a << 32 | b)
        if known is None:
            if len(self._pairs) >= MERGES:
                self._pairs.clear()
            known = self._pairs[a << 32 | b] = self.merged(self.tokens[a] + self.tokens[b])
        return known

    def stands(self, a: int, b: int) -> bool:
        merged = self.pair(a, b)
        return merged[0] == a and len(merged) == 2

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        tokens, n, m = self.tokens, len(left), len(right)
        window = self.pair(left[-1], right[0])
        i = j = 1  # tokens of either side in the window
        while True:
            fits_left = i == n or window[0] == left[-i] or self.stands(left[-i - 1], window[0])
            fits_right = j == m or window[-1] == right[j - 1] or self.stands(window[-1], right[j])
            if fits_left and fits_right:
                return left[: n - i] + window + right[j:]
            i, j = i if fits_left else min(2 * i, n), j if fits_right else min(2 * j, m)
            window = self.merged(b"".join(tokens[t] for t in left[n - i :] + right[:j]))

    def _halves(self, raw: bytes) -> list[int]:
        if len(raw) <= self._leaf_bytes:
            return self._remembered(raw)
        middle = len(raw) // 2
        return self.joined(self._halves(raw[:middle]), self._halves(raw[middle:]))

    def match_ids(self, match: str) -> list[int]:
        raw = match.encode()
        whole = self.ranks.get(raw)
        return self._halves(raw) if whole is None else [whole]

    # a text's matches

    def _ids_of(self, matches: list[str]) -> list[bytes]:
        known = self._known
        new = {m for m in matches if m not in known}
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = set(matches)
        for m in new:
            known[m] = array("I", self.match_ids(m)).tobytes()
        out = list(map(known.__getitem__, matches))
        for m in new:
            if len(m) > SHORT:
                del known[m]
        return out

    def _tree(self, text: str, a: int, b: int) -> tuple[list[int], list[bytes]]:
        """text[a:b] alone: where its matches end, and their ids."""
        if b - a <= max(1, self._leaf):
            matches = self._pattern.findall(text, a, b)
            return np.cumsum([a, *map(len, matches)])[1:].tolist(), self._ids_of(matches)
        middle = (a + b) // 2
        (ends, ids), (right_ends, right_ids) = self._tree(text, a, middle), self._tree(text, middle, b)
        keep = bisect_left(ends, middle)  # those that end before `middle`, at which the look-ahead ends
        while keep and (ends[keep - 2] if keep > 1 else a) + AHEAD > middle:
            keep -= 1
        at, window, r = ends[keep - 1] if keep else a, [], 0
        right_starts = [middle, *right_ends]
        while True:
            r = bisect_left(right_starts, at, r)
            if right_starts[r] == at:
                break
            window.append(self._pattern.match(text, at, b)[0])
            at += len(window[-1])
        start = ends[keep - 1] if keep else a
        window_ends = np.cumsum([start, *map(len, window)])[1:].tolist()
        return ends[:keep] + window_ends + right_ends[r:], ids[:keep] + self._ids_of(window) + right_ids[r:]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self._tree(text, 0, len(text))[1]) if text else b"", np.uint32)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= max(1, self._leaf):
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str | None = None, pattern: str | None = None) -> ByteBpe:
    """One for each worker and vocabulary; a worker serves many tasks."""
    return ByteBpe(path or default_path(), pattern or default_pattern())


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids of each row of docs. path: ranks as `base64 rank` lines, a file that each executor has."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            doc_ids, texts, rows, held, first = batch.column("doc_id"), batch.column("text"), [], 0, 0
            for k in range(batch.num_rows):
                rows.append(bpe.encode(texts[k].as_py()))
                held += len(rows[-1])
                if held >= BATCH_IDS or k + 1 == batch.num_rows:
                    ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate(rows).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(first, len(rows)), ids], ["doc_id", "ids"])
                    rows, held, first = [], 0, k + 1

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) with the bytes of each row's ids (null ids: none) as `decoded`."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                raw = pa.array([bpe.decode(ids.values.to_numpy().tolist()) if ids.is_valid else b"" for ids in part.column("ids")], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), raw], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, ids array<int>, decoded binary")
