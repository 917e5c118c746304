"""The prefix trie against a walk over a plain trie."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rankforge.llm.trie import numbered_turns, prefix_trie, screened, with_shared_openings
from tests.llm.cases import by_row

TURNS = "conv_id long, turn long, role string, text string"


def brute(conversations):
    """``{conv: [(role, text), ...]}`` as rows of nodes."""
    nodes = {}
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:depth]), []).append(conv)
    below = {n: [0, 0, 0] for n in nodes}  # children, leaves, saved
    for n in sorted(nodes, key=len, reverse=True):
        below[n][1] += not below[n][0]
        below[n][2] += (len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0)
        if n:
            up = below[n[:-1]]
            up[0] += 1
            up[1] += below[n][1]
            up[2] += below[n][2]
    return sorted(
        (
            (
                min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), *below[n],
                hashlib.sha256(",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(n)))).encode()).hexdigest(),
            )
            for n, m in nodes.items()
        ),
        key=repr,
    )


def trie(spark, conversations, **options):
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns, 1)]
    turns = spark.createDataFrame(rows, "conv long, pos int, role string, text string")
    convs = spark.createDataFrame([(c,) for c in conversations], "conv long")
    found = prefix_trie(turns, convs, **options)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return by_row(found)


@pytest.mark.parametrize("width", [64, 2**24])
def test_random_conversations(spark, width):
    """Also with a sketch so small that it proves hardly anything."""
    rnd = random.Random(width)
    conversations = {
        c: [(rnd.choice("ua"), rnd.choice(["", "é", "yes", "no 漢字"])) for _ in range(rnd.choice([0, 1, 2, 3, 4, 9]))]
        for c in rnd.sample(range(-500, 10**12, 999_999_937), 160)
    }
    conversations |= {c: conversations[min(conversations)] for c in range(40)}
    assert trie(spark, conversations, most_width=width) == brute(conversations)


def test_one_conversation_with_most_turns_and_many_ends_in_one_node(spark, monkeypatch):
    from rankforge.llm import trie as module

    monkeypatch.setattr(module, "PIECE_CHARS", 200)
    long = [("u", f"turn {i}") for i in range(3_000)]
    conversations = {7: long, 3: long[:2_000], 9: long[:2_000] + [("a", "else")]} | {100 + i: [("u", "same")] for i in range(2_000)}
    found = trie(spark, conversations)
    assert len(found) == 1 + 3_000 + 1 + 1
    same = next(r for r in found if r[0] == 100 and r[1] == 1)
    assert same[3:] == (2_000, 0, 1, 1_999 * 4, hashlib.sha256(",".join(str(100 + i) for i in range(2_000)).encode()).hexdigest())
    assert next(r for r in found if r[:2] == (3, 1))[2:6] == (3, 3, 1, 2)
    assert next(r for r in found if r[:2] == (3, 2_000))[2:6] == (3, 3, 2, 2)
    assert next(r for r in found if r[:2] == (9, 2_001))[2:6] == (3, 1, 0, 1)
    assert next(r for r in found if r[1] == 0)[3:6] == (2_003, 2, 3)


def test_no_and_silent_conversations(spark):
    assert trie(spark, {5: [], 4: []}) == brute({5: [], 4: []})
    empty = spark.createDataFrame([], "conv long, pos int, role string, text string")
    assert prefix_trie(empty, empty.select("conv")).collect() == []


def test_screen_proves_singletons_only(spark):
    rows = [(i % 700, i % 700 * 31) for i in range(1_000)]
    names = spark.createDataFrame(rows, "a long, b long").withColumn("a", F.xxhash64("a")).withColumn("b", F.xxhash64("b"))
    for width, least in ((64, 0), (2**16, 390)):
        alone = screened(names, width).where("alone").groupBy("a", "b").count().collect()
        assert all(r["count"] == 1 for r in alone) and least <= len(alone) <= 400


def test_turns_of_awkward_rows(spark):
    rows = [(1, 2, "u", "b"), (1, None, "u", "first"), (1, 2, "a", None), (1, 2, "a", None), (2, 5, None, "x"), (None, 0, "u", "no conversation")]
    plain = spark.createDataFrame(rows, TURNS)
    clashing = plain.select("*", F.lit("1").alias("TEXT"), F.lit("c").alias("conv"), F.lit(3).alias("pos"), F.lit(4).alias("CONV_ID"))
    expected = [(1, "a", "", 2), (1, "a", "", 3), (1, "u", "b", 4), (1, "u", "first", 1), (2, "", "x", 1)]
    for table in (plain, clashing):
        assert by_row(numbered_turns(table).select("conv", "role", "text", "pos")) == sorted(expected, key=repr)
    assert numbered_turns(plain.limit(0)).collect() == []


def test_shared_openings(spark):
    rnd = random.Random(3)
    table = {c: [("u", str(rnd.randrange(3))) for _ in range(rnd.randrange(1, 9))] for c in range(150, 360)}
    rows = [(c, i, r, t) for c, turns in table.items() for i, (r, t) in enumerate(turns)]
    turns = numbered_turns(spark.createDataFrame(rows, TURNS))
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    rebuilt = with_shared_openings(turns, F.col("conv") - F.col("conv") % 100, taken, 5)
    expected = {}
    for c, own in table.items():
        h = zlib.crc32(str(c).encode()) % 6
        expected[c] = table.get(c - c % 100, [])[:h] + own[h:]
    found = sorted((r["conv"], r["pos"], r["role"], r["text"]) for r in rebuilt.collect())
    assert found == sorted((c, i, *t) for c, ts in expected.items() for i, t in enumerate(ts, 1))
    nodes = by_row(prefix_trie(rebuilt, turns.select("conv").distinct()))
    assert nodes == brute(expected)
