"""Language-model scores: a causal self-attention network over subword ids, and a unigram base over words.

The network is written and trained in numpy. It reads windows of WIDTH ids that overlap by CONTEXT; each id is scored once, in the
window where it has CONTEXT ids or more before it (or all there are), with masked attention over a batch of windows at
a time. Its output is a two-level softmax: BRANCH groups of BRANCH leaves. Frequent ids are leaves of their own, the others share
leaves, in which their counts over all training texts decide. The tree is cut along the principal directions of which leaf
follows which. So the score of a text is the log10 of a probability over all id sequences that end with the end id.

Steps: one pass writes each text with its ids to the shared folder, and what words its task has counted. Counts of words, of ids and
of which leaf follows which are summed over all training texts. The network starts from a bounded sample (SAMPLE documents) and is then trained
further on every id of every training document, in windows side by side; the partitions' networks are averaged by their windows. A last pass
scores the texts. Words that make up a FREQUENT-th of all training words or more (so at most FREQUENT words) have their counts broadcast;
the others, which are rare, get theirs by a join.

Null and empty texts have the end alone; very long texts are read in parts and scored whole; each row is scored for itself, so repeated
rows and rows that share a doc_id have a score each; rows without a doc_id are training rows. A table without training rows gives
the uniform model, an empty table no rows. Other columns are ignored.
"""
from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

WIDTH, CONTEXT, D, BRANCH = 16, 4, 12, 32
LEAVES = BRANCH * BRANCH
SAMPLE, SAMPLE_IDS = 1000, 512
#: Windows that are laid out in memory at once, and that one step of the long training takes.
PART, LANES = 1 << 15, 512
FREQUENT = 1_000_000
END, VOCAB = 1, 49_408
#: Of a score: in single precision the next ones depend on a text's place in its batch.
DECIMALS = 4
#: Characters whose words a task holds at once; words it counts before it hands them on.
CHARS, HELD_WORDS = 2_000_000, 200_000


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def windows(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many ids (end included): of each window the text and its first position."""
    n = 1 + np.maximum(0, -(-(sizes - WIDTH) // step))
    text = np.repeat(np.arange(len(sizes)), n)
    return text, (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step


@functools.cache
def _keep_memory() -> None:
    """A step frees some 15 MB of arrays and the next one takes as much. The C library hands freed memory back to the system where it is more than twice
    the largest block that was freed before (of 32 MB at most), and new pages come zeroed; once such a block was freed, a worker keeps what it has."""
    np.empty(31 << 20, np.uint8)


def _exp(z: np.ndarray, most: float) -> np.ndarray:
    """exp(z) in place, of z up to 80; most: no z is above it, so that z is looked through only where the weights let it be larger."""
    if not most <= 80:
        np.minimum(z, 80, out=z)
    return np.exp(z, out=z)


class Attention:
    """Weights, and the tree: leaf_of[id], and log10 share of each id in its leaf."""

    def __init__(self, leaf_of: np.ndarray, share: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(0, 0.25, s).astype("f4")
        self.leaf_of, self.share = leaf_of.astype(np.int16), share
        self.w = {"e": normal(LEAVES + 1, D), "p": normal(WIDTH, D), "qkv": normal(D, 3 * D), "o": normal(D, D), "x": normal(D, D), "b": np.zeros(D, "f4"), "c1": normal(D, BRANCH), "b1": np.zeros(BRANCH, "f4"), "c2": normal(BRANCH, D, BRANCH), "b2": np.zeros((BRANCH, BRANCH), "f4")}
        #: Largest weights of attention before exp: far beyond what these weights give, so nothing overflows; none for what comes later.
        self.mask = np.where(np.tril(np.ones((WIDTH, WIDTH), bool)), 60, -1e9).astype("f4")

    def _hidden(self, x: np.ndarray):
        """What the layers hold: e, the projection, (q, k, v, 1) side by side, weights of attention times their sum, 1 over that sum, m, and the hidden values with a 1 after them."""
        w = self.w
        e = w["e"].take(x, 0)
        e += w["p"]
        project = np.concatenate([w["qkv"][:, :D] * e.dtype.type(D**-0.5), w["qkv"][:, D:]], 1)
        qkv = np.empty((*x.shape, 3 * D + 1), e.dtype)
        qkv[..., -1] = 1
        np.matmul(e.reshape(-1, D), project, out=qkv.reshape(-1, 3 * D + 1)[:, :-1])
        a = qkv[..., :D] @ qkv[..., D : 2 * D].transpose(0, 2, 1)
        np.minimum(a, self.mask.astype(a.dtype, copy=False), out=a)
        np.exp(a, out=a)
        m = (a @ qkv[..., 2 * D :]).reshape(-1, D + 1)  # its last column: the sums of a
        over = 1 / m[:, D:]
        m = m[:, :D] * over
        # a column more, whose tanh is 1
        wide = np.zeros((2 * D, D + 1), e.dtype)
        wide[:D, :D], wide[D:, :D] = w["o"], w["x"]
        h = m @ wide[:D]
        h += e.reshape(-1, D) @ wide[D:]
        h += np.append(w["b"], e.dtype.type(20))
        return e.reshape(-1, D), project, qkv, a, over, m, np.tanh(h, out=h)

    def _by_group(self, y: np.ndarray):
        """(places of y that are not -1, sorted by their leaf's group; those leaves' groups and members; where groups begin)."""
        at = np.flatnonzero(y.ravel() >= 0)
        leaf = y.ravel()[at]
        group = (leaf >> BRANCH.bit_length() - 1).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        group = group[order]
        return at[order], group, leaf[order] & BRANCH - 1, np.searchsorted(group, np.arange(BRANCH + 1)).tolist()

    def _softmaxes(self, own: np.ndarray, cuts: list[int]):
        """The exponentials of both levels and their sums; own: hidden values and a 1, by group."""
        w = self.w
        one, two = np.concatenate([w["c1"], w["b1"][None]]), np.concatenate([w["c2"], w["b2"][:, None]], 1)
        first = _exp(own @ one, np.abs(one).sum(0).max())  # hidden values are between -1 and 1
        second = np.empty_like(first)
        for g in range(BRANCH):
            if cuts[g + 1] > cuts[g]:
                np.matmul(own[cuts[g] : cuts[g + 1]], two[g], out=second[cuts[g] : cuts[g + 1]])
        _exp(second, np.abs(two).sum(1).max())
        ones = np.ones(BRANCH, first.dtype)
        return first, first @ ones, second, second @ ones

    def leaf_logs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of target leaves, and their places. x: (windows, WIDTH) of leaves before; y: leaves, -1 where none is scored."""
        at, group, member, cuts = self._by_group(y)
        first, sum1, second, sum2 = self._softmaxes(self._hidden(x)[-1].take(at, 0), cuts)
        row = np.arange(len(at))
        return np.log(first[row, group] / sum1 * (second[row, member] / sum2)), at

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all places (y: -1 is left out) and its gradient.

        Softmaxes stay undivided: what is D wide is divided by their sums rather than what is BRANCH or WIDTH wide.
        """
        w = self.w
        e, project, qkv, a, over, m, h = self._hidden(x)
        at, group, member, cuts = self._by_group(y)
        n, row = max(1, len(at)), np.arange(len(at))
        own = h.take(at, 0)
        first, sum1, second, sum2 = self._softmaxes(own, cuts)
        own1, own2 = first[row, group], second[row, member]
        loss = -float(np.log(own1 / sum1 * (own2 / sum2)).sum()) / n
        first[row, group] = own1 - sum1
        second[row, member] = own2 - sum2
        part1, part2 = (1 / (sum1 * sum1.dtype.type(n)))[:, None], (1 / (sum2 * sum2.dtype.type(n)))[:, None]
        g1, g2 = (own * part1).T @ first, np.zeros((BRANCH, D + 1, BRANCH), first.dtype)
        scaled, back, c2 = own * part2, np.empty((len(at), D), first.dtype), w["c2"].transpose(0, 2, 1)
        for branch in range(BRANCH):
            i, j = cuts[branch], cuts[branch + 1]
            if j > i:
                np.matmul(scaled[i:j].T, second[i:j], out=g2[branch])
                np.matmul(second[i:j], c2[branch], out=back[i:j])
        g = {"c1": g1[:D], "b1": g1[D], "c2": g2[:, :D], "b2": g2[:, D]}
        back *= part2
        back += (first @ w["c1"].T) * part1
        own = own[:, :D]
        back *= 1 - own * own
        dh = np.zeros((x.size, D), h.dtype)
        dh[at] = back
        g["o"], g["x"], g["b"] = m.T @ dh, e.T @ dh, back.sum(0)
        dm = np.empty((x.size, D + 1), h.dtype)
        np.multiply(dh @ w["o"].T, over, out=dm[:, :D])
        np.negative(np.einsum("ij,ij->i", dm[:, :D], m), out=dm[:, D])
        dm = dm.reshape(*x.shape, D + 1)
        ds = dm @ qkv[..., 2 * D :].transpose(0, 2, 1)
        ds *= a
        dqkv = np.empty((*x.shape, 3 * D), h.dtype)
        np.matmul(ds, qkv[..., D : 2 * D], out=dqkv[..., :D])
        np.matmul(ds.transpose(0, 2, 1), qkv[..., :D], out=dqkv[..., D : 2 * D])
        np.matmul(a.transpose(0, 2, 1), dm[..., :D], out=dqkv[..., 2 * D :])
        dqkv = dqkv.reshape(-1, 3 * D)
        g["qkv"] = e.T @ dqkv
        g["qkv"][:, :D] *= h.dtype.type(D**-0.5)
        de = dh @ w["x"].T
        de += dqkv @ project.T
        g["p"] = de.reshape(len(x), -1).sum(0).reshape(WIDTH, D)
        flat = x.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        g["e"] = np.zeros_like(w["e"])
        g["e"][flat[first]] = np.add.reduceat(de.take(order, 0), first, axis=0)
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, rate: float, lanes: int = 64, seed: int = 5) -> "Attention":
        _keep_memory()
        rng = np.random.default_rng(seed)
        order = np.concatenate([rng.permutation(len(x)) for _ in range(-(-steps * lanes // len(x)))]) if len(x) else []
        flat = self.flat()
        self._lay(flat)
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        for step in range(1, steps + 1 if len(x) else 1):
            pick = order[(step - 1) * lanes : step * lanes]
            _, grad = self.gradient(x[pick], y[pick])
            g = np.concatenate([grad[k].ravel() for k in sorted(grad)])
            now = rate * (1.05 - step / (steps + 1))
            m *= 0.9
            m += 0.1 * g
            g *= g
            g *= 0.02
            v *= 0.98
            v += g
            np.multiply(v, 1 / (1 - 0.98**step), out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= now / (1 - 0.9**step)
            flat -= g
        return self

    def _lay(self, flat: np.ndarray) -> None:
        """From now on the weights are views of flat."""
        at = 0
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = flat[at : at + n].reshape(self.w[k].shape)
            at += n

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def take(self, flat: np.ndarray) -> "Attention":
        self._lay(flat.astype("f4"))
        return self

    def windows_of(self, ids: np.ndarray, sizes: np.ndarray, overlap: int = CONTEXT):
        """(x, y, text) of the texts' windows; y is -1 beyond a text's end and where the window before has scored. ids: flat, ends included."""
        text, at = windows(sizes, WIDTH - overlap)
        starts = np.cumsum(sizes) - sizes
        # each text's leaves with the sign of a beginning before them
        line = np.full(len(ids) + len(sizes) + WIDTH, LEAVES, np.int16)
        line[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = self.leaf_of[ids]
        rows = np.lib.stride_tricks.sliding_window_view(line, WIDTH)
        first = starts[text] + text + at
        x, y = rows[first], rows[first + 1]
        end = sizes[text] - at  # ids from the window's start to the text's end
        short = np.flatnonzero(end < WIDTH)
        y[short] = np.where(np.arange(WIDTH) < end[short, None], y[short], -1)
        if overlap:
            y[at > 0, :overlap] = -1
        return x, y, text

    def _in_parts(self, sizes: np.ndarray, overlap: int) -> Iterator[tuple[int, int, int, int]]:
        """(first text, last, first id, last) of runs of texts with about PART windows."""
        part = np.cumsum(1 + np.maximum(0, -(-(sizes - WIDTH) // (WIDTH - overlap)))) // PART
        starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        a = 0
        for b in np.concatenate([np.flatnonzero(np.diff(part)) + 1, [len(sizes)]]).tolist() if len(sizes) else []:
            yield a, b, starts[a], starts[b]
            a = b

    def learn(self, ids: np.ndarray, sizes: np.ndarray, rate: float, seed: int) -> int:
        """Trains once on every id of the texts, in a random order of windows; how many windows there were."""
        total = 0
        for a, b, i, j in self._in_parts(sizes, 0):
            x, y, _ = self.windows_of(ids[i:j], sizes[a:b], 0)
            self.train(x, y, steps=-(-len(x) // LANES), rate=rate, lanes=LANES, seed=seed + a)
            total += len(x)
        return total

    def scores(self, ids: np.ndarray, sizes: np.ndarray, lanes: int = 1024) -> np.ndarray:
        """log10 probability of each text."""
        _keep_memory()
        out = np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.share[ids], len(sizes))
        for first, last, i, j in self._in_parts(sizes, CONTEXT):
            x, y, text = self.windows_of(ids[i:j], sizes[first:last])
            for a in range(0, len(x), lanes):
                logs, at = self.leaf_logs(x[a : a + lanes], y[a : a + lanes])
                out[first:last] += np.bincount(text[a : a + lanes][at // WIDTH], logs, last - first) / np.log(10)
        return out


def leaves(counts: np.ndarray) -> np.ndarray:
    """The leaf of each id by its count, before the leaves are numbered: 7 of 8 hold one frequent id each, the others share the rest by rank."""
    rank = np.empty(VOCAB, np.int64)
    rank[np.lexsort((np.arange(VOCAB), -counts))] = np.arange(VOCAB)
    single = LEAVES * 7 // 8
    # the others in runs of ranks that grow in length
    rest = single + np.minimum(LEAVES - single - 1, (np.log2(np.maximum(rank - single, 0) / single * 3 + 1) / np.log2((VOCAB - single) / single * 3 + 1) * (LEAVES - single)).astype(np.int64))
    return np.where(rank < single, rank, rest)


def follows(leaf: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(LEAVES * LEAVES): how often a leaf comes right before another in a text; the last leaf of one text does not lead to the next text."""
    if not len(ids):
        return np.zeros(LEAVES * LEAVES, np.int64)
    pair = leaf[ids[:-1]] * LEAVES + leaf[ids[1:]]
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(sizes) - 1] = False
    return np.bincount(pair[inside[:-1]], minlength=LEAVES * LEAVES)


def tree(counts: np.ndarray, ids: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(leaf_of, log10 share) from the ids' counts, and from how often leaves follow each other (follows) or, without it, from flat ids.

    The leaves are numbered so that halves, quarters and so on part where the leaves' neighbours differ most.
    """
    leaf = leaves(counts)
    pairs = (follows(leaf, ids, np.array([len(ids)])) if pairs is None else pairs).reshape(LEAVES, LEAVES)
    near = np.concatenate([np.sqrt(pairs), np.sqrt(pairs.T)], 1)
    near /= np.linalg.norm(near, axis=1, keepdims=True) + 1e-9
    near -= near.mean(0)
    _, _, axes = np.linalg.svd(near[:, np.argsort(-near.std(0))[:256]], full_matrices=False)
    near = near[:, np.argsort(-near.std(0))[:256]] @ axes[:24].T
    order, todo = np.arange(LEAVES), [(0, LEAVES)]
    while todo:
        a, b = todo.pop()
        if b - a > BRANCH:
            part = near[order[a:b]] - near[order[a:b]].mean(0)
            axis = np.linalg.svd(part, full_matrices=False)[2][0]
            order[a:b] = order[a:b][np.argsort(part @ axis, kind="stable")]
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    number = np.empty(LEAVES, np.int64)
    number[order] = np.arange(LEAVES)
    leaf = number[leaf]
    smooth = counts + 0.5
    return leaf, np.log10(smooth / np.bincount(leaf, smooth, LEAVES)[leaf])


ENCODED = "row long, doc_id long, held boolean, text string, ids binary, word binary, n long"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, times: int>>"


def _arrow(columns: dict, schema: dict) -> pa.RecordBatch:
    """columns, and nulls for the others of the schema."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in schema.items()], list(schema))


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `most` bytes."""
    part, a = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64)) // most, 0
    for b in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else []:
        yield batch.slice(a, b - a)
        a = b


def _encoded(tokenizer_path: str | None):
    schema = {"row": pa.int64(), "doc_id": pa.int64(), "held": pa.bool_(), "text": pa.string(), "ids": pa.binary(), "word": pa.binary(), "n": pa.int64()}

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .subwords import subwords

        encoder, counts = subwords(tokenizer_path), Counter()
        end = np.uint16(END).tobytes()

        def counted() -> Iterator[pa.RecordBatch]:
            words = list(counts.items())
            counts.clear()
            for a in range(0, len(words), 20_000):
                yield _arrow({"word": pa.array([w for w, _ in words[a : a + 20_000]], pa.binary()), "n": pa.array([n for _, n in words[a : a + 20_000]])}, schema)

        for batch in batches:
            for part in _slices(batch, CHARS):
                texts = part.column("text").to_pylist()
                held = [is_held_out(d) for d in part.column("doc_id").to_pylist()]
                for t, h in zip(texts, held):
                    if not h:
                        counts.update(tokens(t))
                        counts[b""] += 1  # the end
                yield _arrow({"row": part.column("row"), "doc_id": part.column("doc_id"), "held": pa.array(held), "text": part.column("text"), "ids": pa.array([x.tobytes() + end for x in encoder.encode(texts)], pa.binary())}, schema)
                if len(counts) > HELD_WORDS:
                    yield from counted()
        yield from counted()

    return encoded


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after another, and how many each has."""
    column = batch.column("ids")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint16, (ends[-1] - ends[0]) // 2, ends[0]), np.diff(ends).astype(np.int64) // 2


def _summed(texts: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all batches of of(ids, sizes), an array of `size` counts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += of(*_ids(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(size)
    summed = texts.select("ids").mapInArrow(sums, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[summed["at"].to_numpy()] = summed["n"]
    return out


def fit(texts: DataFrame) -> Attention:
    """From the training rows: row, ids (with the end id)."""
    spark = texts.sparkSession
    counts = _summed(texts, VOCAB, lambda ids, sizes: np.bincount(ids, minlength=VOCAB))
    leaf = leaves(counts)
    pairs = _summed(texts, LEAVES * LEAVES, lambda ids, sizes: follows(leaf, ids, sizes))
    net = Attention(*tree(counts, np.empty(0, np.uint16), pairs))
    # the start: crops of a bounded sample, by hash
    chance = F.xxhash64("row")
    crop = F.substring("ids", 1 + 2 * F.pmod(F.xxhash64("row", F.lit(1)), F.greatest(F.octet_length("ids") / 2 - SAMPLE_IDS, F.lit(1)).cast("long")).cast("int"), F.lit(2 * SAMPLE_IDS))
    some = [np.frombuffer(r.ids, np.uint16) for r in texts.select(chance.alias("chance"), crop.alias("ids")).orderBy("chance").limit(SAMPLE).collect()]
    if not some:
        return net
    x, y, _ = net.windows_of(np.concatenate(some), np.array([len(s) for s in some]))
    net.train(x, y, steps=3000, rate=0.02)
    hold = spark.sparkContext.broadcast(net)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        own, n = None, 0
        for batch in batches:
            if batch.num_rows:
                own = own or copy.deepcopy(hold.value)
                n += own.learn(*_ids(batch), rate=0.01, seed=batch.column("row")[0].as_py() & 0xFFFF)
        if own is not None:
            flat = own.flat().astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * n), pa.array(np.full(len(flat), n))], ["at", "v", "n"])

    means = texts.mapInArrow(further, "at long, v double, n long").groupBy("at").agg((F.sum("v") / F.sum("n")).alias("v")).toPandas()
    flat = net.flat()
    flat[means["at"].to_numpy()] = means["v"]
    return net.take(flat)


def scores(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark, scratch = docs.sparkSession, []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(rows.mapInArrow(_encoded(tokenizer_path), ENCODED), "lm-texts", scratch, compression="zstd")
    texts = rows.where("word is null")
    counts = written(rows.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "lm-words", compression="zstd")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = int(total.n or 0), int(total.v)
    frequent = counts.where(F.col("c") >= train_tokens / FREQUENT).where(F.length("word") <= 64)
    known = spark.sparkContext.broadcast({bytes(r.word): r.c for r in frequent.toLocalIterator()})
    hold = spark.sparkContext.broadcast(fit(texts.where("not held").select("row", "ids")))
    log_c = lambda c: np.log10(np.maximum(c + 0.5, 0.5) / (train_tokens + 0.5 * (distinct + 1)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = known.value.get
        for batch in batches:
            for part in _slices(batch, CHARS):
                words = [[*tokens(t), b""] for t in part.column("text").to_pylist()]
                n = np.fromiter(map(len, words), np.int64, len(words))
                first = np.cumsum(n) - n
                c = np.fromiter(map(count, chain.from_iterable(words), repeat(-1)), np.int64, n.sum())
                there = c >= 0
                base = np.add.reduceat(np.where(there, log_c(c), 0), first) if len(n) else np.empty(0)
                n_known = np.add.reduceat(there, first, dtype=np.int64) if len(n) else n
                at = np.flatnonzero(~there)
                rare, times, ends = [], [], [0]
                for own, places in zip(words, np.split(at, np.searchsorted(at, first[1:]))):
                    if len(places):
                        own = [own[i] for i in (places - first[len(ends) - 1]).tolist()]
                        if len(set(own)) < len(own):
                            own = Counter(own)
                            times += own.values()
                        else:
                            times += repeat(1, len(own))
                        rare += own
                    ends.append(len(rare))
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], ["word", "times"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held"), pa.array(n), pa.array(n_known), pa.array(base, pa.float64()), pa.array(np.round(hold.value.scores(*_ids(part)), DECIMALS)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                    [c.split()[0] for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare")])

    done = written(texts.select("row", "doc_id", "held", "text", "ids").mapInArrow(scored, SCORED), "lm-scores", compression="zstd")
    discard(spark, scratch)
    c = F.coalesce("c", F.lit(0))
    rest = done.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(counts, "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(train_tokens + 0.5 * (distinct + 1)))).alias("rest"))
    return done.drop("rare").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")
