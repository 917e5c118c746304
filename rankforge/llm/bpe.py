"""Byte-level BPE by corpus-level merge replay, and its inverse.

Texts are split into pre-tokens. The distinct pre-tokens of a block of texts lie
behind each other in one array of byte tokens, and an inverted index leads from
every token pair (named by the rank of its merge) to the positions where it
stands. Merges are then replayed over the whole block in rank order; each touches
its positions only and files the new pairs of their two neighbours.
"""

from __future__ import annotations

import base64
import sys
import types
from array import array
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import pick

BLOCK_CHARS = 2_000_000
BLOCK_PIECES = 200_000
CACHE_PIECES = 400_000
CACHED_PAIRS = 400_000
CACHED_LENGTH = 64
GONE, EDGE = -2, -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Replay:
    """Merges of one vocabulary, replayed over many words at once.

    The vocabulary must hold all 256 single bytes. Two neighbouring tokens merge
    when their joined bytes are a token, lowest rank first and leftmost first
    inside a word, and a word that is a token itself stays whole.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        self.span = max(ranks.values()) + 1
        doubles = [[ranks.get(bytes([a, b]), EDGE) for b in range(256)] for a in range(256)]
        self.doubles = np.array(doubles, np.int64)

    def _start(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte tokens with an edge in front of and behind every word, and the rank of the pair that starts at each."""
        sizes = np.array([len(w) for w in words], np.int64)
        inside = np.ones(int(sizes.sum()) + len(words) + 1, bool)
        inside[np.concatenate([[0], np.cumsum(sizes + 1)])] = False
        letters = np.frombuffer(b"".join(words), np.uint8)
        token = np.full(len(inside), EDGE, np.int64)
        token[inside] = self.single[letters]
        rank = np.full(len(inside), EDGE, np.int64)
        joined = inside[:-1] & inside[1:]
        byte = np.zeros(len(inside), np.int64)
        byte[inside] = letters
        rank[:-1][joined] = self.doubles[byte[:-1][joined], byte[1:][joined]]
        return token, rank

    def _pair(self, left: int, right: int) -> int:
        """Rank of the merge of two tokens, or EDGE."""
        rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], EDGE)
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[left * self.span + right] = rank
        return rank

    def __call__(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of every word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        tokens, starts = self._start(words)
        order = np.argsort(starts, kind="stable")
        order = order[np.searchsorted(starts[order], 0) :]
        cuts = np.flatnonzero(np.diff(starts[order], prepend=-1))
        places_of = {
            int(starts[part[0]]): part.tolist() for part in np.split(order, cuts[1:]) if len(part)
        }
        token, rank = array("q", tokens.tobytes()), array("q", starts.tobytes())
        before = array("q", np.arange(-1, len(tokens) - 1).tobytes())
        after = array("q", np.arange(1, len(tokens) + 1).tobytes())
        pair, known, span = self._pair, self.pairs, self.span
        waiting = list(places_of)
        heapify(waiting)

        while waiting:
            merge = heappop(waiting)
            places = places_of.pop(merge)
            places.sort()
            for done, at in enumerate(places, 1):
                if rank[at] != merge:
                    continue
                right = after[at]
                behind = after[right]
                token[at], token[right], rank[right] = merge, GONE, GONE
                after[at], before[behind] = behind, at
                left = before[at]
                follower, leader = token[behind], token[left]
                new = EDGE
                if follower >= 0:
                    new = known.get(merge * span + follower)
                    if new is None:
                        new = pair(merge, follower)
                rank[at] = lowest = new
                if new >= 0:
                    if new in places_of:
                        places_of[new].append(at)
                    else:
                        places_of[new] = [at]
                        heappush(waiting, new)
                if leader >= 0:
                    new = known.get(leader * span + merge)
                    if new is None:
                        new = pair(leader, merge)
                    rank[left] = new
                    if new >= 0:
                        if new in places_of:
                            places_of[new].append(left)
                        else:
                            places_of[new] = [left]
                            heappush(waiting, new)
                        if lowest < 0 or new < lowest:
                            lowest = new
                if 0 <= lowest < merge and done < len(places):
                    # A merge of lower rank has come up: it goes first, the other places wait for it.
                    places_of[merge] = places[done:]
                    heappush(waiting, merge)
                    break

        ends = np.frombuffer(token, np.int64)
        kept = ends >= 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        edges = np.flatnonzero(tokens == EDGE)
        data, bounds = ends[kept].astype("<u4").tobytes(), (4 * upto[edges]).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Ids of whole texts; pre-tokens seen before in this worker are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.replay = Replay(ranks)
        self.known: dict[str, bytes] = {}
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of all pieces, as one block of the corpus."""
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known = {}
            new = pieces
        words = list(new)
        spelt = [w.encode() for w in words]
        to_merge = [i for i, w in enumerate(spelt) if w not in self.whole]
        learnt = {words[i]: self.whole[w] for i, w in enumerate(spelt) if w in self.whole}
        learnt.update(zip([words[i] for i in to_merge], self.replay([spelt[i] for i in to_merge])))
        long = {w: learnt.pop(w) for w in words if len(w) > CACHED_LENGTH}
        self.known.update(learnt)
        return self.known if not long else {p: long.get(p) or self.known[p] for p in pieces}

    def _long(self, text: str) -> bytes:
        pieces, parts = (m.group() for m in self.pattern.finditer(text)), []
        while some := list(islice(pieces, BLOCK_PIECES)):
            parts.append(b"".join(map(self._learn(set(some)).__getitem__, some)))
        return b"".join(parts)

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Ids of each text in turn; blocks hold about ``BLOCK_CHARS`` characters."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size + len(texts[to]) <= BLOCK_CHARS:
                size, to = size + len(texts[to]), to + 1
            if to == at:
                yield self._long(texts[at])
                at += 1
                continue
            split = [self.pattern.findall(t) for t in texts[at:to]]
            ids = self._learn(set().union(*split))
            yield from (b"".join(map(ids.__getitem__, pieces)) for pieces in split)
            at = to


def _parts(values: pa.Array, sizes: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``BLOCK_CHARS`` bytes: only one of them at a time exists as Python objects."""
    upto = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_CHARS
    edges = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(values)]
    for begin, end in zip(edges, edges[1:]):
        yield values.slice(begin, end - begin)


def _kept(name: object, make: Callable):
    """An object that outlives the tasks of this worker process."""
    kept = sys.modules.setdefault("rankforge_worker_objects", types.ModuleType("rankforge_worker_objects")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def encode_bpe(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` for every row: the whole text as little-endian unsigned 32-bit ids, without special tokens.

    ``path`` names a rank file, ``pattern`` splits texts, each match on its own. A
    null text is an empty one and has no ids. Null and repeated keys stay as rows
    of their own; other columns are not read. The vocabulary (a fixed file, read
    on the driver) is broadcast; rows never move between partitions.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _kept((path, pattern), lambda: Encoder(ranks.value, pattern))
        for some in texts:
            for part in _parts(some, pc.binary_length(some)):
                yield pa.array(list(encoder.encode(part.to_pylist())), pa.binary())

    rows = pick(docs, key, text).toDF("_key", "_text")
    return rows.select(F.col("_key").alias(key), encoded(F.coalesce("_text", F.lit(""))).alias("ids"))


def decode_bpe(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and ``out``: the bytes that the ids stand for.

    Null ids give null, no ids give no bytes. An id that the vocabulary lacks, or
    a length that is no multiple of four, gives null. ``out`` must be a new name.
    """
    ranks = coded.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def decoded(codes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = _kept((path, "decode"), lambda: {rank: t for t, rank in ranks.value.items()}).__getitem__

        def text(data: bytes | None) -> bytes | None:
            if data is None or len(data) % 4:
                return None
            try:
                return b"".join(map(token, np.frombuffer(data, "<u4").tolist()))
            except KeyError:
                return None

        for some in codes:
            for part in _parts(some, pc.binary_length(some)):
                yield pa.array([text(d) for d in part.to_pylist()], pa.binary())

    return coded.select("*", decoded(F.col(f"`{ids}`")).alias(out))
