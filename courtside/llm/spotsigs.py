"""SpotSigs: fingerprints from chains of content words that follow common words.

Wherever an anchor stands, the CHAIN content words after it form, with it, one spot signature; a text's fingerprint
is the set of its signatures, 64-bit numbers of which the printed fingerprint shows the first 24 bits each, in base 64. Anchors are the common words
below; only for texts that have no chain after any of these (tables, lists), one in RARE of all words by hash. Two fingerprints are as alike as the
Jaccard similarity of their sets. Sets are partitioned by their length, in steps of 1 / least: sets of partitions that aren't neighbours can't be
alike, nor can sets of too different lengths within these, and the comparison of two others ends as soon as too many signatures lack a partner.

Null and empty texts, and texts without words, have the empty fingerprint; texts too short for a chain have one signature, of all their
words; very long texts are read whole. Equal texts have equal fingerprints. Two empty fingerprints are alike (1), an empty one and another aren't (0).
The next document of a row is the one with the next doc_id, null ids first, ties (rows that share an id, or have none) by their texts; repeated rows have a row
each. An empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Common words of English, German, French and Spanish.
ANCHORS = frozenset("""
the of and to in a is that for it on was with be as by are this at from an or not have but
der die das und von den des im ist zu mit ein eine nicht auf als dem es
le la les de un une et en que qui du est au pour dans par sur
el los las y es por con para se del al su lo
""".split())  # fmt: skip
CHAIN, RARE, LEAST = 2, 8, 0.8
_WORD = re.compile(r"\w+")


class Spots:
    """signatures(text): the sorted set. It remembers the words it has met."""

    def __init__(self):
        self._known: dict[str, int] = {}

    def signatures(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        if not words:
            return np.empty(0, np.uint64)
        if len(self._known) > 400_000:
            self._known = {}
        known = self._known
        try:
            codes = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            import xxhash

            for w in words:
                if w not in known:
                    h = xxhash.xxh64_intdigest(w) & ~3
                    known[w] = h | (2 if w in ANCHORS else 0) | (1 if h >> 40 & 0xFF < 256 // RARE else 0)
            codes = np.array([known[w] for w in words], np.uint64)
        chains = self._chains(codes, codes & 2 != 0)
        if not len(chains):
            chains = self._chains(codes, codes & 1 != 0)
        if not len(chains):
            chains = _mix(np.bitwise_xor.reduce(_mix(codes + np.arange(len(codes), dtype=np.uint64))).reshape(1))
        return np.unique(chains)

    @staticmethod
    def _chains(codes: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """The signature of each anchor that has CHAIN content words after it."""
        plain = codes & 2 == 0
        content = codes[plain]
        at = np.flatnonzero(anchor)
        first = np.cumsum(plain)[at]  # content words up to and with the anchor
        there = first + CHAIN <= len(content)
        at, first = at[there], first[there]
        mixed = _mix(codes[at])
        for k in range(CHAIN):
            mixed = _mix(mixed + content[first + k])
        return mixed


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def as_string(signatures: np.ndarray) -> str:
    """The whole signatures, so that likeness can be told from what is printed."""
    return base64.b64encode(signatures.astype(">u8").tobytes()).decode()


def part_of(n: int, least: float = LEAST) -> int:
    """The length partition of a set of n signatures."""
    return math.floor(math.log(max(n, 1)) / -math.log(least) + 1e-9)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST, step: int = 64) -> bool:
    """likeness(a, b) >= least, pruned: by length partitions, by lengths, and by the signatures that lack a partner so far."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if part_of(len(b), least) - part_of(len(a), least) > 1 or len(a) < least * len(b):
        return False
    # least * union <= common, union = both lengths less common
    need = math.ceil(least * (len(a) + len(b)) / (1 + least) - 1e-9)
    common = 0
    for i in range(0, len(a), step):
        own = a[i : i + step]
        at = np.minimum(np.searchsorted(b, own), len(b) - 1)
        common += int((b[at] == own).sum())
        if common + len(a) - i - len(own) < need:
            return False
    return common >= need


def in_order(docs: DataFrame, rows_a_task: int = 4000, most: int = 4096) -> DataFrame:
    """(bucket, own, doc_id, text) sorted within partitions, so that each document is followed by the next by doc_id.

    Buckets are ranges of ids, cut at approximate quantiles. The first document of each bucket is also sent to the bucket before it
    (that of the first to the last), with own = 0, after that bucket's own rows. Texts are shuffled once.
    """
    from pyspark.ml.feature import Bucketizer

    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    buckets = max(1, min(most, n // rows_a_task))
    cuts = docs.agg(F.percentile_approx("_key", [k / buckets for k in range(1, buckets)] or [0.5], 10 * buckets).alias("c")).first().c or []
    splits = [-math.inf, *sorted({float(c) for c in (cuts if buckets > 1 else [])}), math.inf]
    placed = docs.withColumn("bucket", F.lit(0))
    if len(splits) > 2:
        cut = Bucketizer(splits=splits, inputCol="_double", outputCol="_bucket")
        placed = cut.transform(docs.withColumn("_double", F.col("_key").cast("double"))).withColumn("bucket", F.col("_bucket").cast("int"))
    heads = sorted((r.bucket, r.head) for r in placed.groupBy("bucket").agg(F.min("_key").alias("head")).collect())
    # a row for each bucket: its head goes to the bucket before
    to = docs.sparkSession.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], "_key long, before int")
    rows = placed.join(F.broadcast(to), "_key", "left").select(
        "_key", "doc_id", "text",
        F.explode(F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(1).alias("own")))).otherwise(F.array(F.struct("bucket", F.lit(1).alias("own")), F.struct(F.col("before").alias("bucket"), F.lit(0).alias("own"))))).alias("at"))
    rows = rows.select("at.bucket", "at.own", "_key", "doc_id", "text").repartition(len(splits) - 1, "bucket")
    return rows.sortWithinPartitions("bucket", F.desc("own"), "_key", "text").select("bucket", "own", "doc_id", "text")


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of an edited text (its last quarter from the next document's start), and their likeness."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        spots, last, done = Spots(), None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                out = []
                for bucket, own, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns)):
                    if bucket == done:  # the first of the rows that were sent here is the next
                        continue
                    own_set = spots.signatures(text)
                    if last is not None:
                        prev_id, prev, prev_set = last
                        k = len(prev) // 4
                        edited = prev[: len(prev) - k] + text[:k]
                        edited_set = spots.signatures(edited)
                        out.append((prev_id, len(prev), hashlib.sha256(edited.encode()).hexdigest(), as_string(prev_set), as_string(edited_set), likeness(prev_set, edited_set), likeness(prev_set, own_set), alike(prev_set, edited_set), alike(prev_set, own_set)))
                    last = (doc_id, text, own_set) if own else None
                    done = None if own else bucket
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_TYPES)], [c.split()[0] for c in COMPARED.split(", ")])

    return in_order(docs).mapInArrow(compare, COMPARED)


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, alike_edited boolean, alike_next boolean"
_TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.bool_()] * 2]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, and the signatures as array<long>."""

    @F.pandas_udf("fingerprint string, signatures array<long>")
    def spot(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        spots = Spots()
        for texts in batches:
            sets = [spots.signatures(t) for t in texts]
            yield pd.DataFrame({"fingerprint": [as_string(s) for s in sets], "signatures": [s.view(np.int64) for s in sets]})

    return docs.select("doc_id", spot("text").alias("f")).select("doc_id", "f.fingerprint", "f.signatures")


def near_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b, likeness between classes of equal fingerprints; membership doc_id, class_id), likeness at least `least`.

    Sets are partitioned by size, in steps of 1 / least, so that a set meets those of its own and the next partition only. In a partition they
    meet by the rarest signatures of each: so many that two sets alike enough share one of them. Then sizes, then the sets are compared.
    """
    found = written(fingerprints(docs))
    reps = written(found.where("fingerprint <> ''").groupBy(F.col("signatures").alias("s")).agg(F.min("doc_id").alias("id")))
    members = found.join(reps.select(F.col("s").alias("signatures"), F.col("id").alias("class_id")), "signatures", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    sig = reps.select("id", F.size("s").alias("n"), F.explode("s").alias("sig"))
    common = written(sig.groupBy("sig").count())
    ranked = sig.join(common, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("ranked"))
    prefix = F.slice("ranked", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least)) + 1e-9)
    parts = written(ranked.select("id", "n", step.alias("part"), F.explode(prefix.sig).alias("sig")))
    other = parts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "sig", F.col("part").alias("pb"))
    met = parts.withColumnsRenamed({"id": "a", "n": "na"}).join(other, ["part", "sig"]).where("(pb > part or a < b) and a <> b and least(na, nb) >= %r * greatest(na, nb)" % least).select("a", "b").distinct()
    sets = reps.select("id", "s")
    both = met.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    common_n = F.size(F.array_intersect("sa", "sb"))
    alike = common_n / (F.size("sa") + F.size("sb") - common_n)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), alike.alias("likeness")).where(F.col("likeness") >= least).distinct(), members
