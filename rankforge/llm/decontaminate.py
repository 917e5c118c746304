"""Benchmark decontamination with spaced seeds.

A seed is a hash of the words at fixed offsets of a window; the offsets between
them are ignored. Seeds of test items meet equal seeds of documents in an
equi-join; every hit names an alignment of an item with a document, and the
alignment is then compared word by word.

Each of the two masks alone hits every window of 13 words in which two or fewer
are substituted, so the default rule (11 of 13 words) loses nothing. Items of a
length of which the masks lose cases get masks of their own length.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, groupby
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import SPACE, pick
from rankforge.session import materialise

MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
BROADCAST_ROWS = 1_000_000
# Bounds of the choice of masks, not of what they find.
MOST_CHOICES, MOST_MASKS, LEAST_WORDS = 100_000, 64, 5


def word_codes(text: Column) -> Column:
    """Hashes of the words of a whole text, letters of any script lower-cased; empty without words.

    Upper case first, so that letters with several lower-case forms (ß and ss, σ and ς) meet.
    Lower case follows word by word: Catalyst drops the inner one of two nested case functions.
    """
    words = F.array_remove(F.split(F.upper(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _covers(masks: Sequence[Sequence[int]], length: int, misses: int) -> bool:
    """Whether every choice of ``misses`` places among ``length`` leaves some mask whole; false if there are too many to try."""
    placed = {frozenset(s + o for o in mask) for mask in masks for s in range(length - mask[-1])}
    if comb(length, misses) > MOST_CHOICES:
        return False
    return all(any(p.isdisjoint(lost) for p in placed) for lost in combinations(range(length), misses))


def _cut_masks(length: int, misses: int) -> list[tuple[int, ...]]:
    """Masks that find ``length`` words with ``misses`` substitutions: the words in parts, without any ``misses`` of the parts.

    One part more than substitutions is enough. More parts give masks of more
    words, and more of them: the fewest parts that give five words, within bounds.
    """
    best: tuple[int, list[tuple[int, ...]]] = (0, [])
    for n in range(misses + 1, length + 1):
        if best[1] and comb(n, misses) > MOST_MASKS:
            break
        parts = [range(length * k // n, length * (k + 1) // n) for k in range(n)]
        kept = [[o for p in chosen for o in p] for chosen in combinations(parts, n - misses)]
        words = min(map(len, kept))
        if words > best[0]:
            best = words, sorted({tuple(o - k[0] for o in k) for k in kept})
        if words >= LEAST_WORDS:
            break
    return best[1]


def masks_of(length: int, masks: Sequence[Sequence[int]], share: float) -> list[tuple[int, ...]]:
    """Masks of which one at least hits every passage of ``length`` words that ``share`` accepts: the given ones if they do."""
    misses = min(length - ceil(length * share - 1e-9), length - 1)
    return [tuple(m) for m in masks] if _covers(masks, length, misses) else _cut_masks(length, misses)


def _seeds(numbered: Sequence[tuple[int, Sequence[int]]], codes: str = "_codes") -> Column:
    """Seeds of all masks, one array after the other; each has ``size - span + 1`` of them, or none."""
    parts = []
    for number, mask in numbered:
        words = ", ".join(f"{codes}[i + {o}]" for o in mask)
        seeds = f"transform(sequence(0, size({codes}) - {mask[-1] + 1}), i -> xxhash64({number}, {words}))"
        parts.append(f"if(size({codes}) > {mask[-1]}, {seeds}, array())")
    return F.expr(f"concat({', '.join(parts)})")


def _placed(rows: DataFrame, numbered: Sequence[tuple[int, Sequence[int]]], keep: Sequence[str], at: str) -> DataFrame:
    """One row per mask and place: ``keep, _seed, at``."""
    numbered = sorted(numbered, key=lambda m: m[1][-1])
    seeds = rows.select(*keep, F.size("_codes").alias("_size"), F.posexplode(_seeds(numbered)).alias("_at", "_seed"))
    # Masks of one span have equally many seeds: the place is the rest of the position in their part.
    place, start = None, F.lit(0)
    for span, group in groupby(numbered, key=lambda m: m[1][-1] + 1):
        each = F.greatest(F.col("_size") - (span - 1), F.lit(0))
        end = start + each * len(list(group))
        here = (F.col("_at") - start) % each
        place = F.when(F.col("_at") < end, here) if place is None else place.when(F.col("_at") < end, here)
        start = end
    return seeds.select(*keep, "_seed", place.alias(at))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[Sequence[int]] = MASKS,
    window: int = 13,
    share: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Documents that hold a passage of a test item: ``key, item, n_matched, n_window``.

    One row per pair of keys. A passage is ``window`` successive words of an
    item (the whole item if shorter) of which at least ``share``, rounded up,
    stand in the same places of the document; ``n_matched`` is the most that any
    such window has. No such passage is missed: for a length of which ``masks`` lose
    cases, other masks are taken (``masks_of``).
    Null texts have no words. Null keys are a key of their own; rows that repeat
    a key are judged one by one and reported once. Other columns are not read.
    """
    items = pick(benchmark, item, item_text).toDF("_item", "_itext")
    items = materialise(items.select("_item", word_codes(F.col("_itext")).alias("_codes")).distinct())
    length = F.least(F.size("_codes"), F.lit(window))
    numbers: dict[tuple[int, ...], int] = {}
    placed = []
    for (n,) in items.where(length > 0).select(length).distinct().sort(length).collect():
        numbered = [(numbers.setdefault(m, len(numbers)), m) for m in masks_of(n, masks, share)]
        placed.append(_placed(items.where(length == n), numbered, ["_item"], "_iat"))
    if not placed:  # no item has words
        numbers = {tuple(m): k for k, m in enumerate(masks)}
        placed.append(_placed(items, [(k, m) for m, k in numbers.items()], ["_item"], "_iat"))
    tests = materialise(reduce(DataFrame.unionByName, placed))
    if tests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        tests = F.broadcast(tests)
    source = pick(docs, key, text).toDF("_key", "_text")
    coded = source.select("_key", word_codes(F.col("_text")).alias("_codes"))
    hits = _placed(coded, [(k, m) for m, k in numbers.items()], ["_key"], "_at").join(tests, "_seed")
    hits = materialise(hits.select("_key", "_item", (F.col("_at") - F.col("_iat")).alias("_shift")).distinct())

    # The words around hits: only documents with a hit are read again.
    found = hits.select(F.col("_key").alias("_k")).distinct()
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    texts = source.join(found, F.col("_key").eqNullSafe(F.col("_k")), "left_semi")
    texts = texts.select(F.col("_key").alias("_k"), word_codes(F.col("_text")).alias("_codes"))
    tested = hits.join(items.select(F.col("_item").alias("_i"), F.col("_codes").alias("_icodes")), F.col("_item").eqNullSafe(F.col("_i")))
    both = tested.join(texts, F.col("_key").eqNullSafe(F.col("_k")))
    length = F.least(F.size("_icodes"), F.lit(window))
    same = F.expr("transform(_icodes, (w, j) -> if(get(_codes, _shift + j) <=> w, 1, 0))")
    best = F.expr(
        "array_max(transform(sequence(0, size(_icodes) - _length), s -> aggregate(slice(_same, s + 1, _length), 0, (a, x) -> a + x)))"
    )
    judged = both.select("_key", "_item", "_icodes", length.alias("_length"), same.alias("_same"))
    judged = judged.select("_key", "_item", "_length", best.alias("_best"))
    leaks = judged.where(F.col("_best") >= F.ceil(F.col("_length") * share - 1e-9))
    return leaks.groupBy("_key", "_item").agg(
        F.max("_best").cast("long").alias("n_matched"), F.max("_length").cast("long").alias("n_window")
    ).withColumnsRenamed({"_key": key, "_item": item})
