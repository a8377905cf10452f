"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text from both sides and labels every byte; a document's probabilities
are the means over all its bytes. It is written and trained in numpy, by backpropagation through time, on a
bounded, balanced sample of labelled rows. Long texts are read in windows of WINDOW bytes, all of them.

Texts that are null, empty or without a letter get `und` with score 0. Equal texts get equal results; extra
columns are ignored; a table without any labelled row gives `und` everywhere.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW = 128
#: The bound on the training sample: so many texts of a language, of each a crop of so many characters.
SAMPLE_PER_LANG, CROP = 256, 256
_BUCKETS = 32
_LANES = 2048


class ByteGru:
    """H units each way. Arrays are laid out (units, lanes), so that each gate is one contiguous block."""

    def __init__(self, langs: list[str], hidden: int = 6, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, n = hidden, len(langs)
        self.langs, self.h = langs, h
        self.w = {
            "g": rng.normal(0, 0.3, (2, 3 * h, 256)).astype("f4"), "u": rng.normal(0, 0.3, (2, 3 * h, h)).astype("f4"),
            "o": rng.normal(0, 0.3, (2, n, h)).astype("f4"), "b": np.zeros((n, 1), "f4"),
        }

    def _states(self, x: np.ndarray, keep: bool = False):
        """x: (time, lanes) of bytes. States of both directions, each (time, H, lanes); with keep also the gates."""
        h, (steps, lanes) = self.h, x.shape
        out, gates = np.empty((2, steps, h, lanes), "f4"), []
        g, u = np.empty((3 * h, lanes), "f4"), np.empty((3 * h, lanes), "f4")
        for d in range(2):
            s, table, mix = np.zeros((h, lanes), "f4"), self.w["g"][d], self.w["u"][d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(table, x[t], axis=1, out=g, mode="clip")
                np.matmul(mix, s, out=u)
                zr = g[: 2 * h]
                zr += u[: 2 * h]
                np.tanh(zr, out=zr)  # the gates are (1 + tanh) / 2
                zr *= 0.5
                zr += 0.5
                n = u[2 * h :] * zr[h:]
                n += g[2 * h :]
                np.tanh(n, out=n)
                if keep:
                    gates.append((d, t, s, zr.copy(), n, u[2 * h :].copy()))
                s = s - n
                s *= zr[:h]
                s += n
                out[d, t] = s
        return out, gates

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        steps, lanes = states.shape[1], states.shape[3]
        p = np.empty((steps, len(self.langs), lanes), "f4")
        for t in range(steps):
            np.matmul(self.w["o"][0], states[0, t], out=p[t])
            p[t] += self.w["o"][1] @ states[1, t]
        p += self.w["b"]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes of the lanes, whose labels are y, and its gradient."""
        h = self.h
        states, gates = self._states(x, keep=True)
        p = self._probabilities(states)
        lanes = np.arange(len(y))
        loss = -float(np.log(p[:, y, lanes] + 1e-12).mean())
        p[:, y, lanes] -= 1
        p /= p.shape[0] * len(y)
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["b"][:, 0] = p.sum((0, 2))
        for d in range(2):
            for t in range(len(x)):
                grad["o"][d] += p[t] @ states[d, t].T
        back = None
        last = None
        for d, t, s, zr, n, un in reversed(gates):
            if d != last:
                back, last = np.zeros_like(s), d
            back = back + self.w["o"][d].T @ p[t]
            z, r = zr[:h], zr[h:]
            dn = back * (1 - z) * (1 - n * n)
            # z = (1 + tanh a) / 2, so dz/da = 2 z (1 - z)
            dz = back * (s - n) * 2 * z * (1 - z)
            dr = dn * un * 2 * r * (1 - r)
            top = np.concatenate([dz, dr, dn])
            grad["g"][d] += top @ (x[t][:, None] == np.arange(256)).astype(top.dtype)
            mixed = np.concatenate([dz, dr, dn * r])
            grad["u"][d] += mixed @ s.T
            back = back * z + self.w["u"][d].T @ mixed
        return loss, grad

    def train(self, texts: list[bytes], labels: list[int], steps: int = 400, lanes: int = 64, seed: int = 11) -> "ByteGru":
        """Adam on random windows; short texts are repeated to fill one, as in prediction."""
        rng, m, v = np.random.default_rng(seed), {}, {}
        y, weight = np.array(labels), np.bincount(labels, minlength=len(self.langs))
        chance = 1 / weight[y]
        chance /= chance.sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(texts), lanes, p=chance)
            x = np.empty((WINDOW, lanes), np.intp)
            for lane, i in enumerate(pick):
                b = np.frombuffer(texts[i], np.uint8)
                size = WINDOW if rng.random() < 0.75 else int(rng.integers(4, WINDOW))
                at = int(rng.integers(0, max(1, len(b) - size + 1)))
                x[:, lane] = np.resize(b[at : at + size], WINDOW)
            _, grad = self.gradient(x, y[pick])
            rate = 0.02 * min(1, 2 - 2 * step / (steps + 1))
            for k, g in grad.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): means of the probabilities of all bytes; each text has one byte at least."""
        sizes = np.array([len(t) for t in texts])
        counts = -(-sizes // WINDOW)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        x, used = np.empty((firsts[-1], WINDOW), np.uint8), np.full(firsts[-1], WINDOW, np.int32)
        for t, size, a, b in zip(texts, sizes.tolist(), firsts.tolist(), firsts[1:].tolist()):
            raw = np.frombuffer(t, np.uint8)
            full = size // WINDOW
            x[a : a + full] = raw[: full * WINDOW].reshape(full, WINDOW)
            if size % WINDOW:
                x[b - 1] = np.resize(raw[full * WINDOW :], WINDOW)
                used[b - 1] = size % WINDOW
        sums = np.empty((len(x), len(self.langs)))
        order = np.arange(WINDOW)
        for a in range(0, len(x), _LANES):
            part = np.ascontiguousarray(x[a : a + _LANES].T).astype(np.intp)
            p = self._probabilities(self._states(part)[0])
            if (used[a : a + _LANES] < WINDOW).any():
                p *= (order[:, None] < used[a : a + _LANES])[:, None, :]
            sums[a : a + _LANES] = p.sum(0).T
        return np.add.reduceat(sums, firsts[:-1], axis=0) / sizes[:, None]


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """SAMPLE_PER_LANG crops for each language at most, chosen and cut by hashes of the ids; read in many small groups."""
    salted = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        "lang", F.xxhash64("doc_id", F.lit(5)).alias("h"), F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, 9), greatest(1, length(text) - {CROP} + 1)) as int), {CROP})").alias("crop"))
    group = Window.partitionBy("lang", F.pmod("h", F.lit(_BUCKETS))).orderBy("h", "crop")
    rows = salted.withColumn("place", F.row_number().over(group)).where(F.col("place") <= SAMPLE_PER_LANG // _BUCKETS).select("lang", "crop").collect()
    return sorted((r.lang, r.crop) for r in rows)


def fit(docs: DataFrame, hidden: int = 6, steps: int = 400) -> ByteGru | None:
    """Learns from the lang of all given rows (a bounded sample of them)."""
    rows = sample(docs)
    langs = sorted({x for x, _ in rows})
    if not langs:
        return None
    return ByteGru(langs, hidden).train([t.encode() for _, t in rows], [langs.index(x) for x, _ in rows], steps)


def _labelled(docs: DataFrame, model: ByteGru | None) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of lang_pred and score, under a name that docs doesn't have; and that name."""
    hold = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = hold.value
        for texts in batches:
            out = pd.DataFrame({"lang_pred": "und", "score": 0.0}, index=range(len(texts)))
            has = [i for i, t in enumerate(texts) if net is not None and isinstance(t, str) and _lettered(t)]
            raw = [texts.iloc[i].encode() for i in has]
            at = 0
            while at < len(raw):  # in parts of about a million bytes
                end, held = at, 0
                while end < len(raw) and (end == at or held + len(raw[end]) <= 1 << 20):
                    held += len(raw[end])
                    end += 1
                p = net.pooled(raw[at:end])
                best = p.argmax(1)
                out.loc[has[at:end], "lang_pred"] = [net.langs[k] for k in best]
                out.loc[has[at:end], "score"] = np.clip(p.max(1), 0, 1)
                at = end
            yield out

    name = "_found"
    while name in docs.columns:
        name = "_" + name
    return docs.withColumn(name, label("text")), name


def predict(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """All columns of docs, and lang_pred and score in the place of any that docs has of these names; reads `text` alone."""
    found, name = _labelled(docs, model)
    return found.withColumns({"lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}).drop(name)


def _lettered(text: str) -> bool:
    return any(map(str.isalpha, text))


#: Below this a document isn't taken to be in any of the languages.
LEAST_SCORE = 0.4


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def keep_identified(docs: DataFrame, model: ByteGru | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose text is in a learned language."""
    found, name = _labelled(docs, model)
    return found.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).select(*docs.columns)
