"""MinHash near-deduplication by ProbMinHash.

A text's shingles of five words are weighted by how often they come. Each shingle sends arrivals of a Poisson process
whose rate is its weight; each arrival falls on a random register, which keeps the shingle that came first. Two texts agree
in a register with the probability of their probability Jaccard similarity; a shingle stops as soon as its next arrival
is later than all registers' (early termination). Registers are hashed in bands, texts that share a band are candidates,
and candidates are verified by their exact probability Jaccard similarity, `least` or more. For texts whose shingles all come once this
is the plain Jaccard similarity.

Texts with the same words are one text from the start. Candidates are looked at in turns, and links of one turn are
components in the next:
1. each text is compared with the one leader, of all the leaders of its buckets, whose registers are most like its own;
2. in buckets that still hold texts of several components, each text but those of the largest component is compared with the
   likeliest text of any other component; this goes on while it finds links, TURNS times at most;
3. then each text with every text of another component that is likely enough.
Turns 2 and 3 go through a bucket in chunks of bounded size, a pair of chunks a row: sketches of one bit for each of WIDE registers are compared
in bulk, and only pairs whose bits agree as often as those of `least` do are handed on. So no bucket is held in one task, none is expanded into its pairs,
and no link is left out: texts of different components in a bucket are unlike, by their sketches or word for word.

Texts without words (null, empty, punctuation alone) are each a class of their own; texts of under five words have one
shingle, of all of them; very long texts are hashed whole; each row is classed by its own text, so rows that share a doc_id may be in
several classes and repeated rows are in one; a class of rows without doc_id has the class_id null; an empty table gives no rows;
other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators.graph import connected_components

from .common import BROADCAST_IDS, discard, numbered, without_ids, written

SHINGLE = 5
#: Of lower-cased texts that have words.
WORDED = r"[\p{L}\p{N}]"
#: Chance that a pair of similarity 0.8 shares no band: (1 - 0.8^6)^32 = 6e-5.
ROWS, BANDS = 6, 32
REGISTERS = ROWS * BANDS
LEAST = 0.8
#: Registers of which a bit each is kept of texts that share a band.
WIDE = 2048
CHUNK, TURNS = 256, 4
#: Shingles and texts that are hashed at once.
_PART, _TEXTS, _WIDE_TEXTS = 200_000, 2000, 512
#: Arrivals of several turns that are made at once.
_ARRIVALS = 100_000


def least_alike(bits: int, least: float) -> int:
    """How many bits of two texts of similarity `least` agree, but for a chance of 1e-5: a bit agrees where the registers do, and at every other place by chance."""
    p = (1 + least) / 2
    return int(bits * p - 4.2 * (bits * p * (1 - p)) ** 0.5)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit depends on every other."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat word hashes of texts with sizes > 0 -> (text, shingle, weight) of all distinct shingles, ordered by neither."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count = np.maximum(sizes - SHINGLE + 1, 1)
    text = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    last = np.repeat(starts + sizes, count)
    w, h = words.view(np.uint64), np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = at + k < last
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(there, _mix(w[np.minimum(at + k, len(w) - 1)]), np.uint64(0))
    h = _mix(h)
    _, first, weight = np.unique(_mix(h + _mix(text.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    return text[first], h[first], weight


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers): in each register the shingle that arrived first.

    Texts are looked at for whether all their shingles are late after every eighth part of the turns so far, and the turns in between are
    made at once: arrivals that are too late change nothing, and short texts take many turns.
    """
    arrival, owner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    latest = np.empty(n)
    t, turn = np.zeros(len(text)), 0
    while len(text):
        turns = max(1, min(turn // 8, _ARRIVALS // len(text)))
        salts = np.arange(turn + 1, turn + turns + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        turn += turns
        draw = _mix(shingle + salts[:, None])
        wait = np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
        wait /= weight
        wait[0] = t - wait[0]
        for k in range(1, turns):
            wait[k] = wait[k - 1] - wait[k]
        t = wait[-1]
        register = text * registers + (_mix(draw) % np.uint64(registers)).astype(np.int64)
        if turns > 1 or turn > 1:  # most come too late for their registers
            at = np.flatnonzero((wait < arrival[register]).ravel())
            register, early = register.ravel()[at], wait.ravel()[at]
        else:
            at, register, early = np.arange(len(text)), register.ravel(), wait.ravel()
        np.minimum.at(arrival, register, early)
        first = early == arrival[register]
        owner[register[first]] = shingle[at[first] % len(text)]
        there = np.flatnonzero(np.bincount(text, minlength=n))
        latest[there] = arrival.reshape(n, registers)[there].max(1)
        go_on = np.flatnonzero(t < latest[text])
        if len(go_on) < len(text):
            text, shingle, weight, t = text[go_on], shingle[go_on], weight[go_on], t[go_on]
    return owner.reshape(n, registers)


def probability_jaccard(a: dict[int, int] | tuple, b: dict[int, int] | tuple) -> float:
    """Exact, of two (shingles, weights) with sorted distinct shingles."""
    (sa, wa), (sb, wb) = a, b
    every = np.union1d(sa, sb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, sa)] = wa
    y[np.searchsorted(every, sb)] = wb
    common = (x > 0) & (y > 0)
    if not common.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, common = ratio[order], x[order], y[order], common[order]
    below = np.concatenate([[0], np.cumsum(y)])
    above = np.concatenate([[0], np.cumsum(x[::-1])])[::-1]
    at = np.searchsorted(ratio, ratio[common], "left")  # the shingles from here on have no smaller ratio
    return float((1 / (above[at] / x[common] + below[at] / y[common])).sum())


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """The columns, raw (a hash of the text as it is), text_key (equal for equal words) and the words as hashes, of rows that have words."""
    lower = F.lower("text")
    docs = docs.where(lower.rlike(WORDED)).select(*columns, F.xxhash64("text").alias("raw"), F.array_remove(F.split(lower, r"[^\p{L}\p{N}]+"), "").alias("words"))
    # the key is never null, so that no join on it cuts all texts into words once more to leave out nulls
    key = F.coalesce(F.unhex(F.md5(F.array_join("words", " "))), F.lit(b""))
    return docs.select(*columns, "raw", key.alias("text_key"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _parts(lists: pa.ListArray, most: int, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last, flat values, sizes) of runs of rows that hold about `most` values; null lists are not among them."""
    ends, flat, a, n = lists.offsets.to_numpy(), lists.values.to_numpy(), 0, len(lists)
    while a < n:
        b = min(n, a + rows, max(a + 1, int(np.searchsorted(ends, ends[a] + most)) - 1))
        yield a, b, flat[ends[a] : ends[b]], np.diff(ends[a : b + 1]).astype(np.int64)
        a = b


SIGNED = "id long, doc_id long, raw long, text_key binary, bands array<long>, s0 long, s1 long, s2 long"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids are scrambled row numbers, so that the least id of a bucket is any of its texts."""
    for batch in batches:
        for a, b, flat, sizes in _parts(batch.column("hashes"), _PART, _TEXTS):
            owner = signatures(*shingles(flat, sizes), len(sizes))
            keys = np.zeros((len(sizes), BANDS), np.uint64)
            for k in range(ROWS):
                keys = _mix(keys * np.uint64(31) + owner[:, k::ROWS])
            keys = _mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            bits = np.packbits((owner & np.uint64(1)).astype(np.uint8), axis=1).view("<i8")
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_mix(part.column("id").to_numpy().view(np.uint64)).view(np.int64)), part.column("doc_id"), part.column("raw"), part.column("text_key"),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sizes) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel())),
                 *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(3))],
                [c.split()[0] for c in SIGNED.split(", ")])


TEXTS = "id long, shingles binary, weights binary"


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sorted distinct shingles, their weights; no weights where each comes once) of hashed words."""
    for batch in batches:
        for a, b, flat, sizes in _parts(batch.column("hashes"), _PART, _TEXTS):
            text, shingle, weight = shingles(flat, sizes)
            order = np.lexsort((shingle, text))
            text, shingle, weight = text[order], shingle[order], weight[order]
            cuts = np.searchsorted(text, np.arange(len(sizes) + 1)).tolist()
            ones = np.minimum.reduceat(weight == 1, cuts[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(a, b - a), pa.array([shingle[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                 pa.array([None if one else weight[i:j].astype("<i4").tobytes() for one, i, j in zip(ones, cuts, cuts[1:])], pa.binary())],
                [c.split()[0] for c in TEXTS.split(", ")])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, wide: a bit of each of WIDE registers) of rows of _weighed()."""
    for batch in batches:
        sizes = [len(s) // 8 for s in batch.column("shingles").to_pylist()]
        a = 0
        while a < len(sizes):
            b, held = a, 0
            while b < len(sizes) and b - a < _WIDE_TEXTS and (b == a or held + sizes[b] <= _PART):
                held += sizes[b]
                b += 1
            part = batch.slice(a, b - a)
            own = part.column("shingles").to_pylist()
            shingle = np.frombuffer(b"".join(own), np.uint64)
            weight = np.concatenate([np.ones(len(s) // 8) if w is None else np.frombuffer(w, "<i4") for s, w in zip(own, part.column("weights").to_pylist())])
            owner = signatures(np.repeat(np.arange(b - a), sizes[a:b]), shingle, weight, b - a, WIDE)
            wide = np.packbits((owner & np.uint64(1)).astype(np.uint8), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([w.tobytes() for w in wide], pa.binary())], ["id", "wide"])
            a = b


def similarity(a: bytes, wa: bytes | None, b: bytes, wb: bytes | None) -> float:
    """Of two rows of _weighed()."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if wa is None and wb is None:
        both = np.concatenate([x, y])
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common / (len(both) - common)
    weights = (np.ones(len(s)) if w is None else np.frombuffer(w, "<i4") for s, w in ((x, wa), (y, wb)))
    return probability_jaccard((x, next(weights)), (y, next(weights)))


def _verified(least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shingles_a", "weights_a", "shingles_b", "weights_b"))
            keep = [similarity(*row) >= least for row in zip(*columns)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "ca", "cb"])

    return verify


def _agreement(a: str, b: str):
    return F.lit(REGISTERS) - sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(3)), F.lit(0))


PAIRS = "a long, b long, ca long, cb long, n int"


def _crossing(best: bool, alike: int):
    """Of pairs of chunks: pairs (a, b) of texts of different components whose bits are alike, with their components and the bits that agree.

    best: for each text that is not of the largest component only the likeliest of another; else a pair is told in the least of the buckets it shares alone.
    """

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for c in ("xs", "ys"):
                    t = batch.column(c)[i].values
                    wide = np.frombuffer(b"".join(t.field("wide").to_pylist()), np.uint64).reshape(-1, WIDE // 64)
                    sides.append((t.field("id").to_numpy(), t.field("component").to_numpy(), wide))
                (xi, xc, xw), (yi, yc, yw) = sides
                n = np.zeros((len(xi), len(yi)), np.int16)
                for k in range(WIDE // 64):
                    n += np.bitwise_count(xw[:, k, None] ^ yw[None, :, k])
                n = np.where(xc[:, None] == yc[None, :], -1, WIDE - n)
                if best:
                    parts, sizes = np.unique(np.concatenate([xc, yc]), return_counts=True)
                    largest = parts[np.argmax(sizes)]
                    a = np.concatenate([np.arange(len(xi)), n.argmax(0)])
                    b = np.concatenate([n.argmax(1), np.arange(len(yi))])
                    own = np.concatenate([xc, yc]) != largest
                    swap = np.repeat([False, True], [len(xi), len(yi)])
                    keep = own & (n[a, b] >= alike)
                    a, b, swap = a[keep], b[keep], swap[keep]
                else:
                    a, b = np.nonzero(n >= alike)
                    bucket, own, other = batch.column("bucket")[i].as_py(), *(batch.column(c)[i].values.field("buckets").to_pylist() for c in ("xs", "ys"))
                    told = np.array([min(set(own[p]).intersection(other[q])) == bucket for p, q in zip(a.tolist(), b.tolist())], bool)
                    a, b = a[told], b[told]
                    swap = xi[a] > yi[b]
                if len(a):
                    pick = lambda x, y: pa.array(np.where(swap, y, x))
                    yield pa.RecordBatch.from_arrays([pick(xi[a], yi[b]), pick(yi[b], xi[a]), pick(xc[a], yc[b]), pick(yc[b], xc[a]), pa.array(n[a, b].astype(np.int32))], ["a", "b", "ca", "cb", "n"])

    return crossing


def _apart(members: DataFrame) -> DataFrame:
    """The members of buckets in which there are several components."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return members.join(sizes.select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "bucket")


def _in_chunks(members: DataFrame, best: bool, least: float) -> DataFrame:
    """PAIRS of likely texts of different components in a bucket. members: bucket, id, component, wide."""
    apart, fields = _apart(members), ["id", "component", "wide"]
    if not best:
        apart, fields = apart.join(apart.groupBy("id").agg(F.collect_list("bucket").alias("buckets")), "id"), [*fields, "buckets"]  # at most BANDS a text
    chunked = apart.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    chunks = chunked.groupBy("bucket", "chunks", "chunk").agg(F.collect_list(F.struct(*fields)).alias("xs"))
    single = chunks.where("chunks = 1").select("bucket", "xs", F.col("xs").alias("ys"))
    many = chunks.where("chunks > 1")
    left = many.select("bucket", "xs", F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("chunk"))
    double = left.join(many.select("bucket", "chunk", F.col("xs").alias("ys")), ["bucket", "chunk"]).select("bucket", "xs", "ys")
    pairs = single.unionByName(double).mapInArrow(_crossing(best, least_alike(WIDE, least)), PAIRS)
    if best:
        pairs = pairs.groupBy("a").agg(F.max(F.struct("n", "b", "ca", "cb")).alias("p")).select("a", "p.b", "p.ca", "p.cb")
    return pairs.select("a", "b", "ca", "cb").distinct()


def _links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b, and their components ca, cb) those that are near-duplicates by their words."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("shingles").alias(f"shingles_{side}"), F.col("weights").alias(f"weights_{side}")), side)
    return pairs.select("a", "b", "ca", "cb", "shingles_a", "weights_a", "shingles_b", "weights_b").mapInArrow(_verified(least), "a long, b long, ca long, cb long")


def _relabelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with the components that links join."""
    joined = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return members.join(joined, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now")


def classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, class_id) for each row: the least doc_id among the texts linked with it, directly or through others."""
    spark, own, scratch = docs.sparkSession, [], []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = _keyed(docs.withColumn("id", F.monotonically_increasing_id()), "id", "doc_id")
    signed = written(keyed.mapInArrow(_signed, SIGNED), "signed", own)
    # one text of each key
    reps = signed.groupBy("text_key").agg(F.min("id").alias("id"), F.min("doc_id").alias("doc_id"), F.min("raw").alias("raw"))
    reps = written(reps, "texts", own)
    distinct = signed.join(reps.select("id"), "id", "left_semi")
    banded = distinct.select("id", F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n > 1")
    bits = ["s0", "s1", "s2"]
    sketch = signed.select("id", *bits)
    shared = banded.join(leaders.select("bucket", "lo", "hi"), "bucket")
    members = written(shared.join(sketch, "id"), "members", scratch)
    if members.isEmpty():
        found = reps.select("text_key", F.col("doc_id").alias("class_id"))
        discard(spark, scratch)
        return _classed(docs, signed, found)
    near = members.select("id").distinct().join(reps.select("id", "text_key", "raw"), "id")
    near = written(near, "near", scratch)
    few = near.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    raws, near = near.select("raw").distinct(), near.select("id", "text_key")
    if few:
        raws, near = F.broadcast(raws), F.broadcast(near)
    # only texts that one of them is are cut into words again
    same = docs.withColumn("_raw", F.xxhash64("text")).join(raws.withColumnRenamed("raw", "_raw"), "_raw", "left_semi").select("text")
    texts = _keyed(same).join(near, "text_key").dropDuplicates(["id"]).select("id", "hashes")
    texts = written(texts.mapInArrow(_weighed, TEXTS), "shingles", scratch)
    # 1: the likeliest leader
    led = members.select("id", *bits, F.explode(F.array("lo", "hi")).alias("b")).where("id <> b").distinct()
    led = led.join(sketch.select(F.col("id").alias("b"), *(F.col(c).alias(f"b{c}") for c in bits)), "b").withColumn("n", _agreement("s", "bs")).where(F.col("n") >= least_alike(REGISTERS, least))
    led = led.groupBy("id").agg(F.max(F.struct("n", "b")).alias("most")).select(F.col("id").alias("a"), F.col("most.b").alias("b"), F.col("id").alias("ca"), F.col("most.b").alias("cb"))
    every = links = written(_links(led, texts, least), "links", scratch)
    members = _apart(_relabelled(members.select("bucket", "id", F.col("id").alias("component")), links)).drop("chunks")
    members = written(members, "apart", scratch)
    # sketches of those that are still apart
    apart = texts.join(members.select("id").distinct(), "id", "left_semi")
    wide = written(apart.mapInArrow(_sketched, "id long, wide binary"), "sketches", scratch)
    members = written(members.join(wide, "id"), "apart", scratch)
    # 2
    for _ in range(TURNS):
        links = written(_links(_in_chunks(members, True, least), texts, least), "links", scratch)
        if links.isEmpty():
            break
        every = every.unionByName(links)
        members = written(_relabelled(members, links), "apart", scratch)
    # 3
    every = every.unionByName(written(_links(_in_chunks(members, False, least), texts, least), "links", scratch))
    joined = connected_components(every)
    found = reps.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least_id = found.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    found = written(found.join(least_id, "component").select("text_key", "class_id"), "classes")
    discard(spark, scratch)
    return _classed(docs, signed, found)


def _classed(docs: DataFrame, signed: DataFrame, found: DataFrame) -> DataFrame:
    rows = signed.select("doc_id", "text_key").join(found, "text_key").select("doc_id", "class_id")
    # texts without words have classes of their own
    bare = docs.where(~F.coalesce(F.lower("text").rlike(WORDED), F.lit(False)))
    return rows.unionByName(bare.select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs less all but one row of each class of near-duplicates: the one with the least doc_id, rows without an id last.

    Rows are told apart by numbers of their own, so repeated rows, texts that share a doc_id and rows without an id are deduplicated too.
    Each text without words is a class of its own.
    """
    rows, row = numbered(docs, "dedup-rows")
    of = classes(rows.select(F.col(row).alias("doc_id"), "text"), least).select(F.col("doc_id").alias(row), "class_id")
    of = written(of.join(rows.select(row, "doc_id"), row), "classed")
    kept = of.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col(row)))[row].alias("kept"))
    return without_ids(rows, of.join(kept, "class_id").where(F.col(row) != F.col("kept")), row).select(docs.columns)
