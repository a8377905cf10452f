"""Byte-level BPE up the tree against the tiktoken library, with leaves so small that nearly all is joined."""
import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from courtside.llm import byte_bpe, queries

from ..conftest import SMALL
from .test_corpus import none, odd  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "'", "'s", "'r", "'ll", "é", "漢", "1", "2023", "!", "...", "　", "😀", "the", "ing", "\x00", "‍", "A", "ſ", "'R", "aaaaaaaa", "     "]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf, leaf_bytes", [(1, 1), (2, 2), (3, 1), (5, 3), (17, 4), (byte_bpe.LEAF, byte_bpe.LEAF_BYTES)])
def test_equals_library(library, leaf, leaf_bytes):
    rng, own = random.Random(leaf), byte_bpe.ByteBpe(PATH, public_tokenizers.PATTERN, leaf, leaf_bytes)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(600)] + ["".join(rng.choices("abcdeinorst", k=rng.randint(100, 400))) for _ in range(40)] + ["".join(rng.choices("漢字é", k=200)), " " * 301 + "x", "<|endoftext|>"]
    for text in texts:
        ids = own.encode(text).tolist()
        assert ids == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 5)
    monkeypatch.setattr(byte_bpe, "MERGES", 5)
    own, rng = byte_bpe.ByteBpe(PATH, public_tokenizers.PATTERN), random.Random(0)
    for _ in range(50):
        text = " ".join("".join(rng.choices("ainotrs", k=rng.randint(1, 90))) for _ in range(12))
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_query_equals_library(spark, library):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {(d, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in rows}
    assert {tuple(r) for r in queries.op13_byte_bpe(spark, SMALL).collect()} == want


def test_odd_rows(spark, library, odd, none):
    back = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    texts = [r.text for r in odd.collect()]
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in back))) == sorted(map(repr, ((r.doc_id, library.encode_ordinary(r.text or "")) for r in odd.collect())))
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(t or "" for t in texts)
    assert byte_bpe.decode(byte_bpe.encode(none)).collect() == []
