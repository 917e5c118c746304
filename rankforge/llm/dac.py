"""Directly addressable codes: a block of ids with random access to any of them.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first
chunk of every id, level k the k-th chunk of the ids that are long enough. A
bitmap per level tells whether an id goes on; the number of set bits before a
place, from a directory with one count per ``STRIDE`` bits, is the id's place on
the next level.

A file is ``MAGIC``, the length of a JSON header, the header and the arrays that
it lists, little-endian. It also holds the keys of its documents and where each
of them ends.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"DAC1"
STRIDE = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class Block:
    chunks: list[np.ndarray]
    bitmaps: list[np.ndarray]
    ranks: list[np.ndarray]
    size: int

    @staticmethod
    def encode(ids: np.ndarray) -> Block:
        chunks, bitmaps, ranks, rest = [], [], [], ids.astype(np.uint32)
        while True:
            chunks.append((rest & 255).astype(np.uint8))
            rest = rest >> 8
            more = rest > 0
            padded = np.zeros(-(-len(more) // STRIDE) * STRIDE, bool)
            padded[: len(more)] = more
            counts = padded.reshape(-1, STRIDE).sum(axis=1, dtype=np.int64)
            bitmaps.append(np.packbits(padded, bitorder="little"))
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))
            if not more.any():
                return Block(chunks, bitmaps, ranks, len(ids))
            rest = rest[more]

    def _going_on(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Continuation bit and number of set bits before each place of a level."""
        bits = self.bitmaps[level]
        byte, bit = at >> 3, (at & 7).astype(np.uint8)
        on = (bits[byte] >> bit) & 1
        before = self.ranks[level][at // STRIDE].astype(np.int64)
        first = at // STRIDE * (STRIDE // 8)
        for step in range(STRIDE // 8):  # whole bytes between the directory's count and the place
            inside = first + step < byte
            if not inside.any():
                break
            before += np.where(inside, _ONES[bits[np.minimum(first + step, byte)]], 0)
        part = bits[byte] & ((1 << bit.astype(np.uint16)) - 1).astype(np.uint8)
        return on.astype(bool), before + _ONES[part]

    def access(self, places) -> np.ndarray:
        """The ids at ``places``, without decoding any other."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.uint32)
        alive = np.arange(len(at))
        for level, chunk in enumerate(self.chunks):
            if not len(alive):
                break
            out[alive] |= chunk[at].astype(np.uint32) << np.uint32(8 * level)
            on, before = self._going_on(level, at)
            alive, at = alive[on], before[on]
        return out

    def decode(self) -> np.ndarray:
        """All ids, from the last level up."""
        higher = np.zeros(0, np.uint32)
        for chunk, bits in zip(reversed(self.chunks), reversed(self.bitmaps)):
            ids = chunk.astype(np.uint32)
            on = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
            ids[on] |= higher << np.uint32(8)
            higher = ids
        return higher


def write_block(ids: np.ndarray, ends: np.ndarray, keys: np.ndarray, known: np.ndarray) -> bytes:
    """File bytes of a block: documents end at ``ends``; ``keys`` count where ``known`` is set."""
    block = Block.encode(ids)
    arrays = [ends.astype("<i8"), keys.astype("<i8"), known.astype(np.uint8)]
    for chunk, bits, ranks in zip(block.chunks, block.bitmaps, block.ranks):
        arrays += [chunk, bits, ranks.astype("<u4")]
    head = json.dumps({"size": block.size, "levels": len(block.chunks), "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *[a.tobytes() for a in arrays]])


def read_block(data: bytes) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """Block, document ends, keys and whether each key is known."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of ids")
    (length,) = struct.unpack("<I", data[4:8])
    head, at, arrays = json.loads(data[8 : 8 + length]), 8 + length, []
    for kind, n in head["arrays"]:
        a = np.frombuffer(data, np.dtype(kind), n, at)
        arrays.append(a)
        at += a.nbytes
    levels = [arrays[3 + 3 * i : 6 + 3 * i] for i in range(head["levels"])]
    block = Block([x[0] for x in levels], [x[1] for x in levels], [x[2] for x in levels], head["size"])
    return block, arrays[0], arrays[1], arrays[2].astype(bool)
