"""Ids of the word_bpe_49k.json vocabulary, at the speed that whole corpora need.

The merges run in tiktoken over the same vocabulary, once for each distinct word that a worker meets; the
words of a text are then looked up. Texts with characters outside the ranges below, and special tokens, go
through the tokenizers library itself. tests/llm compare the two.
"""
from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np

END_ID = 1
VOCAB_FILE = "word_bpe_49k.json"
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Characters of a text whose words are looked up at once.
PART = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCAB_FILE)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies show each byte as a printable character: itself, or one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    out.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return out


class Subwords:
    """encode(texts): for each text its ids as a uint16 array, equal to tokenizers' encode(add_special_tokens=False)."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of = _byte_of_char()
        ranks = {}
        for token, i in vocab.items():
            if token.startswith("<|"):
                continue
            ends = i >= 256 and token.endswith("</w>")
            ranks[bytes(of[c] for c in (token[:-4] if ends else token)) + (b" " if ends else b"")] = i
        self._path, self._slow = path, None
        self._bpe = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in ranks.items():
            self._ends[i] = token.endswith(b" ")
        self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self._odd = regex.compile(r"[^\x20-\x7e\xa1-ɏ]|<\|")  # words have no space
        self._known: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        together = " ".join(words)
        if self._odd.search(together):
            plain = []
            for w in words:
                if self._odd.search(w):
                    self._known[w] = self._by_library(w)
                else:
                    plain.append(w)
            words, together = plain, " ".join(plain)
            if not words:
                return
        # none of these characters changes what is before or after it, so the words are lower-cased in one go
        low = (together if together.isascii() else unicodedata.normalize("NFC", together)).lower().split(" ")
        lines, pieces = low, np.ones(len(low), np.int64)
        cut = [i for i, letters in enumerate(map(str.isalpha, low)) if not letters]
        if cut:
            parts = []
            for i in cut:
                w = low[i]
                # letters and one character more are two pieces, which needs no pattern
                parts.append([w[:-1], w[-1]] if w[:-1].isalpha() else self._pieces.findall(w))
                low[i] = " ".join(parts[-1])
            pieces[cut] = list(map(len, parts))
            lines = [x for x in low if x] if not pieces[cut].all() else low
        ids = np.array(self._bpe.encode_ordinary(" ".join(lines) + " " if lines else ""), np.uint16)
        ends = np.concatenate([[0], np.flatnonzero(self._ends[ids]) + 1])
        cuts = (2 * ends[np.concatenate([[0], np.cumsum(pieces)])]).tolist()
        raw = ids.tobytes()
        self._known.update(zip(words, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _by_library(self, word: str) -> bytes:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
        return np.array(self._slow.encode(word, add_special_tokens=False).ids, np.uint16).tobytes()

    def _ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        known = self._known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > REMEMBERED:
                self._known = known = {"": b""}
                new = set(words) - {""}
            self._learn(list(new))
        return b"".join(map(known.__getitem__, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if t is None or len(t) <= PART:
                out.append(np.frombuffer(self._ids(t or ""), np.uint16))
                continue
            # a very long text in parts, cut at spaces, which end a word
            raw, a = [], 0
            while a < len(t):
                b = t.find(" ", a + PART)
                b = len(t) if b < 0 else b
                raw.append(self._ids(t[a:b]))
                a = b + 1
            out.append(np.frombuffer(b"".join(raw), np.uint16))
        return out


@functools.lru_cache(maxsize=2)
def subwords(path: str | None = None) -> Subwords:
    """One for each worker and vocabulary; a worker serves many tasks."""
    return Subwords(path or default_path())
