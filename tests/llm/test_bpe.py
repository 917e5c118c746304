"""Byte-level BPE against the tokenizer library, piece by piece and over whole tables."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import pytest
import tiktoken

from rankforge.llm.bpe import Encoder, Replay, decode_bpe, encode_bpe, read_ranks
from rankforge.llm.q_bpe import op12_byte_bpe, rank_file
from tests.llm.cases import TEXTS, by_row, clashing, documents, nothing

SF = "/root/testdata/sf0.001"
PATH, PATTERN = rank_file()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_random_vocabularies_and_words():
    """Vocabularies without any order between their tokens: merges of lower rank come up late."""
    rnd = random.Random(5)
    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)}
        tokens |= {bytes(rnd.choices(b"abc", k=rnd.randrange(2, 6))) for _ in range(60)}
        order = sorted(tokens)
        rnd.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rnd.choices("abcd", k=rnd.randrange(1, 40))) for _ in range(200)] + ["a" * 300]
        assert [ids(x) for x in Encoder(ranks, r"[\s\S]+").encode(words)] == [own.encode_ordinary(w) for w in words]


def test_every_code_point(library):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a {c}b{c} {c}1{c}{c} .{c}!" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    assert [ids(x) for x in Encoder(read_ranks(PATH), PATTERN).encode(texts)] == library.encode_ordinary_batch(texts)


def test_long_pieces_and_many_blocks(library, monkeypatch):
    from rankforge.llm import bpe

    monkeypatch.setattr(bpe, "BLOCK_CHARS", 5_000)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 700)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 900)
    rnd = random.Random(2)
    texts = ["a" * 60_000, "ab" * 9_000 + " " * 3_000, "eyJ" * 30_000, "", "\n\n x"]
    texts += ["".join(rnd.choice("ab e\tnth'sdl \n01.é ") for _ in range(rnd.randrange(9_000))) for _ in range(40)]
    assert [ids(x) for x in Encoder(read_ranks(PATH), PATTERN).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_replay_of_nothing():
    assert Replay(read_ranks(PATH))([]) == []


def test_awkward_rows(spark, library):
    for rows in (documents(spark), clashing(documents(spark))):
        both = decode_bpe(encode_bpe(rows, PATH, PATTERN), PATH).collect()
        assert sorted(((r["doc_id"], ids(r["ids"]), bytes(r["decoded"])) for r in both), key=repr) == sorted(
            ((k, library.encode_ordinary(t or ""), (t or "").encode()) for k, t, _ in TEXTS), key=repr
        )
    assert encode_bpe(nothing(spark), PATH, PATTERN).collect() == []


def test_ids_that_mean_nothing(spark):
    rows = [(1, None), (2, b""), (3, b"\x00\x00"), (4, struct.pack("<2I", 5, 4_000_000_000)), (5, struct.pack("<I", 50))]
    coded = spark.createDataFrame(rows, "doc_id long, ids binary")
    one = bytes(next(t for t, r in read_ranks(PATH).items() if r == 50))
    assert by_row(decode_bpe(coded, PATH).select("doc_id", "decoded")) == [(1, None), (2, bytearray()), (3, None), (4, None), (5, bytearray(one))]


def test_query_on_whole_table(spark, library):
    expected = []
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        text = row["text"] or ""
        tokens = library.encode_ordinary(text)
        coded = struct.pack(f"<{len(tokens)}I", *tokens)
        expected.append((row["doc_id"], len(tokens), hashlib.sha256(coded).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = op12_byte_bpe(spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert by_row(found) == sorted(expected, key=repr)
