"""Token-id output: texts as ids of a public tokenizer in directly addressable files."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import pick, worker_kept
from rankforge.llm.dac import read_block, write_block
from rankforge.plans.groups import scan_within
from rankforge.session import materialise, shared_dir

BLOCK_IDS = 1_000_000
CACHE_PIECES = 1_200_000
LATIN_END = "\u0250"
# Stands for the code of a first word that is not known yet.
NEW_HEAD = b"?"
SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies use for bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer splits before every single space and around every single
    newline between other characters, so the pieces between them can be encoded
    once and looked up again; the result is that of encoding the whole text.
    Texts with any other white space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same merges without the splitting pattern, for pieces that are one pre-token each.
        self.single = Tokenizer(Tokenizer.from_file(path).model)
        self.single.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = _byte_letters()
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        (self.newline,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline_bytes = self._whole("\n")
        self.marks: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], prefix: str, new: set[str]) -> None:
        """Encode pieces that are not in ``known``; where it is full, it starts anew with them."""
        if len(known) + 2 * len(new) > CACHE_PIECES:
            known.clear()
        # Signs behind letters are a pre-token of their own.
        tails, stems, words, others = [], set(), [], []
        for p in new:
            stem = p.rstrip(SIGNS)
            if stem.isalpha() and (stem.isascii() or max(stem) < LATIN_END):
                if stem is not p and len(stem) < len(p):
                    tails.append((p, stem, p[len(stem) :]))
                    stems.add(stem)
                else:
                    words.append(p)
            else:
                others.append(p)
        # difference_update() would walk through all that is known, for every batch.
        stems = {s for s in stems if s not in known}.difference(words)
        words += stems
        letters = self.letters
        spelt = [(prefix + p).encode().decode("latin-1").translate(letters) for p in words]
        between = f" {letters[10]} "
        self._store(known, words, self.single, [between.join(spelt[i : i + 100]) for i in range(0, len(spelt), 100)])
        self._store(known, others, self.tokenizer, ["\n".join([prefix + p for p in others[i : i + 100]]) for i in range(0, len(others), 100)])
        marks = self.marks
        for p, stem, tail in tails:
            if tail not in marks:
                marks[tail] = self._whole(tail)
            known[p] = known[stem] + marks[tail]

    def _store(self, known: dict[str, bytes], pieces: list[str], tokenizer, texts: list[str]) -> None:
        """Cut the ids of up to 100 pieces a text at the newlines between them."""
        if not pieces:
            return
        ids: list[int] = []
        for coded in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids += coded.ids
            ids.append(self.newline)
        codes = np.array(ids, "<u4")
        ends = np.flatnonzero(codes == self.newline)
        starts = np.append(0, ends[:-1] + 1).tolist()
        data = codes.tobytes()
        known.update((p, data[4 * x : 4 * y]) for p, x, y in zip(pieces, starts, ends.tolist(), strict=True))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        first, spaced, newline = self.first, self.spaced, self.newline_bytes
        # Every word is looked up once; only those that were not there are gathered and learnt.
        docs: list[tuple[list[str], list[int], list[bytes | None]] | None] = []
        new_heads, new_words = set(), set()
        for t in texts:
            words, gaps = t.split(), t.count(" ") + t.count("\n")
            # Every white-space character is a space or newline, and stands alone between two words.
            if len(words) != gaps + 1 or sum(map(len, words)) + gaps != len(t) or "<|" in t:
                docs.append(None)
                continue
            heads = [0]
            if "\n" in t:
                for line in t.split("\n")[:-1]:
                    heads.append(heads[-1] + line.count(" ") + 1)
            codes = list(map(spaced.get, words))
            for at in heads:
                codes[at] = first.get(words[at], NEW_HEAD)
                if codes[at] is NEW_HEAD:
                    new_heads.add(words[at])
            # No piece is without ids, so only those not found are false.
            if not all(codes):
                new_words.update(compress(words, map(not_, codes)))
            docs.append((words, heads, codes))
        self._learn(first, "", new_heads)
        self._learn(spaced, " ", new_words)
        return [self._whole(t) if doc is None else self._joined(newline, *doc) for t, doc in zip(texts, docs)]

    def _joined(self, newline: bytes, words: list[str], heads: list[int], codes: list[bytes | None]) -> bytes:
        """The ids of one text, with what has been learnt since they were looked up."""
        first, spaced = self.first, self.spaced
        for at in heads:
            if codes[at] is NEW_HEAD:
                codes[at] = first[words[at]]
        if not all(codes):
            codes = [c or spaced[w] for w, c in zip(words, codes)]
        for at in heads[1:]:
            codes[at] = newline + codes[at]
        return b"".join(codes)


def worker_encoder(path: str) -> Encoder:
    """The encoder of this worker process, which outlives its tasks and keeps the pieces it has learnt."""
    kept = worker_kept()
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _put(path: str, data: bytes) -> None:
    """Write a file under its name only when it is whole."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, inner)


def write_tokens(
    docs: DataFrame,
    root: str,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write block files below ``root``.

    Documents lie in ascending ``key`` order, null keys first and equal keys by
    text hash, over all files in name order. A null text is an empty one. A
    block closes after ``block_ids`` ids, at the end of a document, so a longer
    document has a file of its own. Keys must fit 64-bit integers. A task that
    runs again writes the same files with the same bytes. Returns the manifest:
    ``file, n_docs, n_ids``. Other columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder = worker_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        keys: list = []
        codes: list[bytes] = []
        size = 0

        def close() -> pd.DataFrame:
            name = f"ids-{part:06d}-{number:06d}.dac"
            lengths = np.array([len(c) // 4 for c in codes], np.int64)
            known = np.array([k is not None for k in keys], bool)
            values = np.array([0 if k is None else k for k in keys], np.int64)
            _put(f"{root}/{name}", write_block(np.frombuffer(b"".join(codes), "<u4"), np.cumsum(lengths), values, known))
            return pd.DataFrame({"file": [name], "n_docs": [len(keys)], "n_ids": [int(lengths.sum())]})

        for frame in frames:
            texts = [t or "" for t in frame["_text"].tolist()]
            frame_keys = [None if k is None or k != k else int(k) for k in frame["_key"].tolist()]
            for a in range(0, len(texts), 200):
                for k, code in zip(frame_keys[a : a + 200], encoder.encode(texts[a : a + 200])):
                    keys.append(k)
                    codes.append(code + end)
                    size += len(code) // 4 + 1
                    if size >= block_ids:
                        yield close()
                        keys, codes, size, number = [], [], 0, number + 1
        if keys:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, key, text).toDF("_key", "_text").withColumn("_key", F.col("_key").cast("string").cast("long"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text")]
    # Keys travel as text: a column with nulls would become floating point on the way.
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    text_keys = ordered.select(F.col("_key").cast("string").alias("_key"), "_text")
    # Written at once: the files belong to this one run of the job.
    return materialise(text_keys.mapInPandas(run, "file string, n_docs long, n_ids long"))


def read_tokens(manifest: DataFrame, root: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents from the files of ``write_tokens``: ``key, start, n_tokens, ids_crc32`` and, if wanted, ``ids``.

    ``start`` counts the ids of all documents before it, ``ids`` are little-endian unsigned 32-bit.
    """
    spark = manifest.sparkSession
    before = scan_within(manifest, [], [F.col("file")], {"_upto": ("sum", F.col("n_ids"))})
    before = before.select("file", (F.col("_upto") - F.col("n_ids")).alias("_start"))
    schema = "path string, modificationTime timestamp, length long, content binary"
    if manifest.isEmpty():
        files = spark.createDataFrame([], schema)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(root)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start, content in zip(frame["_start"].tolist(), frame["content"].tolist()):
                block, ends, keys, known = read_block(bytes(content))
                ids = block.decode().astype("<u4")
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                data = memoryview(ids.tobytes())
                codes = [bytes(data[4 * a : 4 * b]) if with_ids else data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                table = {
                    key: pd.array([int(k) if o else None for k, o in zip(keys.tolist(), known.tolist())], dtype="Int64"),
                    "start": start + begins,
                    "n_tokens": ends - begins,
                    "ids_crc32": [zlib.crc32(c) for c in codes],
                }
                yield pd.DataFrame(table | {"ids": codes} if with_ids else table)

    # One manifest row per file of a million ids; Spark broadcasts it when its own size check allows.
    placed = files.join(before, "file").select("_start", "content")
    schema = f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return placed.mapInPandas(run, schema)


def token_output(
    docs: DataFrame, tokenizer: str, end_id: int, root: str | None = None, with_ids: bool = True, **columns
) -> tuple[DataFrame, str]:
    """Write all documents and read them back: the documents and the folder of the files."""
    root = root or f"{shared_dir(docs.sparkSession)}/rankforge/ids-{uuid.uuid4().hex}"
    manifest = write_tokens(docs, root, tokenizer, end_id, **columns)
    return read_tokens(manifest, root, with_ids=with_ids), root
