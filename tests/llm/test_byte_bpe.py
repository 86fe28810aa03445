"""Byte-level BPE against the tiktoken library, which reads the same ranks."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from wayflow.llm import byte_bpe

ALPHABET = [*"ab1.Z'\t\n\r -_s", "é", "ß", "中", "😀", " ", "　", " ", "\x1c", "\x0b", "\x00", "<|endoftext|>", "'ll", " the", "٣", "ⅷ", "́", "‍", "  \n"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.Codec(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def texts() -> list[str]:
    r = random.Random(12)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(3000)]
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randrange(1, 12))) for _ in range(400)]
    out += [" ".join(r.choice(words) for _ in range(r.randrange(300))) for _ in range(60)]
    return [*out, "", " ", "\n\n", "x" * 5000, " " * 5000, "a" * 300 + "   b", "naïve " * 20000]


def test_ids_as_tiktoken(codec, library):
    given = texts()
    for i in range(0, len(given), 100):
        part = given[i : i + 100]
        for text, ids in zip(part, codec.encode(part), strict=True):
            assert ids.tolist() == library.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()


def test_every_character_as_tiktoken(codec, library):
    for low in range(0, 0x30000, 2048):
        part = [f"a{chr(c)}b {chr(c)}1 .{chr(c)}. \n{chr(c)} {chr(c)}{chr(c)}" for c in range(low, low + 2048) if not 0xD800 <= c < 0xE000]
        for text, ids in zip(part, codec.encode(part), strict=True):
            assert ids.tolist() == library.encode_ordinary(text)


def test_units_beyond_the_kept_ones(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_UNITS", 5)
    monkeypatch.setattr(byte_bpe, "STRETCH", 64)
    small = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    given = texts()[-70:-2] * 2
    assert [x.tolist() for k in range(0, len(given), 17) for x in small.encode(given[k : k + 17])] == [library.encode_ordinary(x) for x in given]


def test_offsets_cover_the_text(codec, library):
    for text in texts()[:600]:
        ids = codec.encode([text])[0]
        starts, ends = codec.offsets(text, ids)
        data, at = text.encode(), 0
        for k, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
            token = library.decode_single_token_bytes(k)
            assert a == len(data[:at].decode("utf-8", "ignore")) and len(data[: at + len(token)].decode("utf-8", "replace")) == b
            at += len(token)


def test_pieces_keep_split_characters(codec):
    text = "中文 😀😀 naïve ⅷ"
    ids = codec.encode([text])[0]
    for cut in range(len(ids) + 1):
        assert "".join(codec.decode_pieces([ids[:cut], ids[cut:]])) == text
    assert list(codec.decode_pieces(ids.reshape(-1, 1)))[-1] and list(codec.decode_pieces([])) == []
    assert codec.decode(np.zeros(0, np.int32)) == b""


def test_rows(spark, ranks, library):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x 😀"), (4, "word " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit("clash")})
    pattern = public_tokenizers.PATTERN
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip(docs, ranks, pattern).collect()}
    want = set()
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    encoded = byte_bpe.encode(docs.where("doc_id is null or doc_id < 4"), ranks, pattern)
    back = byte_bpe.decode(encoded, ranks, pattern).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((i or 0, t or "") for i, t in rows[:5])
    assert {len(r["starts"]) == len(r["ends"]) == len(r["ids"]) for r in encoded.collect()} == {True}
    assert byte_bpe.round_trip(docs.limit(0), ranks, pattern).count() == 0
