"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, the other of ordinary identifiers and words. Both are first-order, over the 64
characters of base64 and a few more, and are trained by counting over labelled samples: fit_labelled() takes them as rows; fit() makes
them of all documents, where what the fixed patterns match is labelled random and all other text is ordinary. A stretch of characters
whose summed log ratio reaches LEAST_BITS, over LONG characters or more, is reported as `markov`; it begins where the sum is lowest, ends where it is
highest, and is cut where the sum falls by DROP in between, so that ordinary words joined to a random key by slashes or
hyphens stay out. What the patterns match isn't scored again, but what is left beside it is; UUIDs, which are names, aren't scored.

Null and empty texts have no spans; very long texts are scanned whole; equal texts and repeated rows have equal spans; doc_id isn't looked at;
other columns stay as they are, but for a column `secrets`, which scan() replaces; an empty table gives uniform models that report nothing.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# a run that is long enough is the same as a long enough match of the plain run
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
STATES = len(_ALPHABET) + 1
_CODE = np.zeros(256, np.int64)  # 0: any other byte, and a run's end
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(1, STATES)
#: Characters of a stretch, log2 of how much likelier it must be as a random string, and the fall that ends it.
LONG, LEAST_BITS, DROP = 16, 24.0, 12.0
_UUID = re.compile(r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b")


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, where the secret string starts), by start and then kind."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), k, m.end(), m.start()) for k, p in ((1, _ACCESS), (2, _HEX)) for m in p.finditer(text)]
    return [(a, KINDS[k], b, s) for a, k, b, s in sorted(found)]


def _apart(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def labelled(text: str) -> tuple[list[str], str]:
    """(the random strings in it, the rest, with line ends in their places)."""
    random, rest, at = [], [], 0
    for a, b in _apart([(s, e) for _, _, e, s in base_spans(text)]):
        random.append(text[a:b])
        rest.append(text[at:a])
        at = b
    return random, "\n".join([*rest, text[at:]])


def _pairs(raw: bytes) -> np.ndarray:
    c = _CODE[np.frombuffer(b"\n" + raw + b"\n", np.uint8)]
    return np.bincount(c[:-1] * STATES + c[1:], minlength=STATES * STATES)


_UPPER, _LOWER = np.arange(1, 27), np.arange(27, 53)
_DIGITS, _JOINS = np.arange(53, 63), np.arange(63, STATES)
#: Share of ordinary words that are taken to stand in identifiers as well, for each way of joining.
JOINED = 0.05


def _with_identifiers(n: np.ndarray) -> np.ndarray:
    """Counts of ordinary pairs, and those of the same words in identifiers: joined by each of _JOINS, in capitals, in camel case, before a number."""
    ends, starts = n[1:, 0].copy(), n[0, 1:].copy()
    out = n.copy()
    out[_UPPER[:, None], _UPPER] += JOINED * n[_LOWER[:, None], _LOWER]
    ends[_UPPER - 1] += JOINED * ends[_LOWER - 1]
    starts[_UPPER - 1] += JOINED * starts[_LOWER - 1]
    for join in _JOINS:
        out[1:, join] += JOINED * ends
        out[join, 1:] += JOINED * starts
    # a word's end before a capital or a number; as many of the latter end again
    capitals = JOINED * starts[_LOWER - 1] / max(starts.sum(), 1)
    out[1:, _UPPER] += ends[:, None] * capitals
    out[1:, _DIGITS] += (JOINED / 10) * ends[:, None]
    return out


class Markov:
    """log2 of how much likelier each pair of characters is in a random string than in an ordinary one."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        shape = (STATES, STATES)
        random, ordinary = random.reshape(shape).astype(float), _with_identifiers(ordinary.reshape(shape).astype(float))
        # the prior of random strings is uniform and heavy, so that an alphabet not among the samples also fits
        p = (random + 50.0) / (random.sum(1, keepdims=True) + 50.0 * STATES)
        # an ordinary pair backs off to how common its second character is
        second = (ordinary[:, 1:].sum(0) + 0.5) / (ordinary[:, 1:].sum() + 0.5 * STATES)
        q = (ordinary + 20.0 * np.concatenate([[1 / STATES], second])) / (ordinary.sum(1, keepdims=True) + 20.0)
        self.ratio = np.log2(p / q)
        self.trained = bool(ordinary[1:, 1:].sum())

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The log ratio of each character, from the second on, after the one before it."""
        return self.ratio[codes[:-1], codes[1:]]


def _summed(counted: DataFrame) -> Markov:
    """From rows (label, pair, n): at most 2 x STATES x STATES sums reach the driver."""
    counts = {"random": np.zeros(STATES * STATES), "ordinary": np.zeros(STATES * STATES)}
    for r in counted.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r.label][r.pair] = r.n
    return Markov(counts["random"], counts["ordinary"])


_COUNTED = "label string, pair int, n long"


def _counter(split) -> Iterator[pd.DataFrame]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {"random": np.zeros(STATES * STATES, np.int64), "ordinary": np.zeros(STATES * STATES, np.int64)}
        for batch in batches:
            for row in batch.itertuples(index=False):
                for label, text in split(*row):
                    sums[label] += _pairs(text.encode())
        for label, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"label": label, "pair": at, "n": n[at]})

    return count


def fit_labelled(samples: DataFrame) -> Markov:
    """samples: string, is_secret. Nulls in either are left out."""
    split = lambda string, is_secret: [("random" if is_secret else "ordinary", string)]
    return _summed(samples.select("string", "is_secret").dropna().mapInPandas(_counter(split), _COUNTED))


def fit(docs: DataFrame) -> Markov:
    """From all texts: what the patterns match against the rest."""

    def split(text: str | None) -> list[tuple[str, str]]:
        if not text:
            return []
        random, rest = labelled(text)
        return [*([("random", "\n".join(random))] if random else []), ("ordinary", rest)]

    return _summed(docs.select("text").mapInPandas(_counter(split), _COUNTED))


def _stretches(bits: list[float], least: float) -> Iterator[tuple[int, int]]:
    """(first, last) of the stretches of a run's scores that sum up to least or more."""
    total, first, best, best_at = 0.0, 0, 0.0, -1
    for i, x in enumerate([*bits, -float("inf")]):
        total += x
        if total > best:
            best, best_at = total, i
        elif total <= 0 or total < best - DROP:
            if best >= least:
                yield first, best_at
            total, first, best, best_at = 0.0, i + 1, 0.0, -1


def markov_spans(text: str, taken: list[tuple[int, int]], model: Markov, least: float = LEAST_BITS) -> list[tuple[int, int]]:
    """(start, end) of random stretches outside the taken intervals."""
    points = np.frombuffer(text.encode("ascii") if text.isascii() else text.encode("utf-32-le"), np.uint8 if text.isascii() else np.uint32)
    codes = _CODE[np.where(points < 128, points, 0)]
    for a, b in taken:
        codes[a:b] = 0
    bits = np.where((codes[:-1] > 0) & (codes[1:] > 0), model.bits(codes), -1e6)
    # how far the sum is above its lowest so far: nothing is reported where that never reaches `least`
    total = np.concatenate([[0.0], np.cumsum(bits)])
    low = np.minimum.accumulate(total)
    high = np.flatnonzero(total - low >= least)
    out = []
    if len(high):
        ends = np.append(np.flatnonzero(bits == -1e6), len(bits))
        run = np.searchsorted(ends, high - 1)
        for r in np.unique(run).tolist():
            a = int(ends[r - 1]) + 1 if r else 0
            for first, last in _stretches(bits[a : ends[r]].tolist(), least):
                if last + 2 - first >= LONG:
                    out.append((a + first, a + last + 2))
    return out


def all_spans(text: str | None, model: Markov, least: float = LEAST_BITS) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' spans and of random stretches beside them, by start and then kind."""
    if not text:
        return []
    base = base_spans(text)
    out = [(a, KINDS.index(k), b) for a, k, b, _ in base]
    if model.trained:
        taken = [(a, b) for a, _, b, _ in base] + [m.span() for m in _UUID.finditer(text)]
        out += [(a, 3, b) for a, b in markov_spans(text, taken, model, least)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def scan(docs: DataFrame, model: Markov, least: float = LEAST_BITS) -> DataFrame:
    """All columns of docs, and secrets: array<struct<kind, start, end>>."""
    hold = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t, hold.value, least)])

    return docs.withColumn("secrets", spans("text"))


MASK = "[SECRET]"


def redact(docs: DataFrame, model: Markov, least: float = LEAST_BITS) -> DataFrame:
    """docs with each secret span of `text` (overlapping ones joined) replaced by MASK; n_chars, where there, follows."""
    hold = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask(t, all_spans(t, hold.value, least)))

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])
