"""Quality rules on repetition inside a text, from suffix arrays over words.

Texts of a batch are laid end to end as word numbers that are private to their
text, so one suffix array (prefix doubling on the still undecided suffixes)
serves the whole batch. The ranks kept after each doubling give longest common
prefixes of neighbours by descent. The common-prefix intervals of length
``min_repeat`` or more are the maximal repeated substrings; the union of their
occurrences and the longest of them decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rankforge.llm.common import map_texts, pick

SYMBOLS = str.maketrans("", "", "#*$%&|<>")
WINDOW = 3
BATCH_WORDS = 400_000
OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered double, longest_repeat long"
)


def longest_repeats(tokens: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Length of the longest substring at each position that occurs elsewhere in the same text.

    ``tokens`` are word numbers and ``text`` the ascending number of the text at each position.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64)
    key = text.astype(np.int64) * (int(tokens.max()) + 1) + tokens
    suffixes = np.argsort(key, kind="stable")
    sorted_key = key[suffixes]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(new)
    rank[suffixes] = np.repeat(starts, np.diff(np.append(starts, n)))
    last = np.append(text[1:] != text[:-1], True)
    end = np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), np.arange(n))]
    levels, step = [rank.copy()], 1
    group = np.cumsum(new) - 1
    alone = np.bincount(group) == 1
    places = np.flatnonzero(~alone[group])
    while len(places):
        members = suffixes[places]
        after = members + step
        follow = np.where(after <= end[members], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((follow, rank[members]))
        members, follow = members[order], follow[order]
        suffixes[places] = members
        old = rank[members]
        new = np.empty(len(members), bool)
        new[0] = True
        new[1:] = (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(members)))
        rank[members] = np.repeat(places[at], size)
        levels.append(rank.copy())
        step *= 2
        places = places[np.repeat(size, size) > 1]
    left, right = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(n - 1, np.int64)
    live = np.arange(n - 1)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left[live], right[live]
        inside = (a <= end[suffixes[live]]) & (b <= end[suffixes[live + 1]])
        ranks = levels[level]
        same = inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)])
        hit = live[same]
        common[hit] += 1 << level
        left[hit] += 1 << level
        right[hit] += 1 << level
    best = np.zeros(n, np.int64)
    best[suffixes[:-1]] = common
    best[suffixes[1:]] = np.maximum(best[suffixes[1:]], common)
    return best


def union_length(best: np.ndarray, least: int, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Words per text that lie in a repeated substring of at least ``least`` words."""
    n = len(best)
    # Left-maximal occurrences only: a repeat that starts one word earlier and ends at the same place holds this one.
    maximal = best >= least
    maximal[1:] &= ~((best[:-1] == best[1:] + 1) & (text[:-1] == text[1:]))
    at = np.flatnonzero(maximal)
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + best[at], -1)
    return np.bincount(text, weights=np.cumsum(depth[:n]) > 0, minlength=n_texts).astype(np.int64)


def _judge(texts: list[str | None], min_repeat: int, max_covered: float, max_repeat: int) -> list[np.ndarray]:
    """The columns of ``OUT`` for a batch of texts."""
    k = len(texts)
    counts, chars, symbols, dup_lines = (np.zeros(k, np.int64) for _ in range(4))
    numbers: dict[bytes, int] = {}
    parts = []
    for i, t in enumerate(texts):
        if not t:
            continue
        words = t.encode("utf-8", "surrogatepass").split()  # splits at the six ASCII white-space characters
        counts[i] = len(words)
        chars[i] = len(t) - sum(map(t.count, " \t\n\v\f\r"))
        symbols[i] = len(t) - len(t.translate(SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        dup_lines[i] = len(lines) - len(set(lines))
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
    text = np.repeat(np.arange(k), counts)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    best = longest_repeats(tokens, text)
    short = union_length(best, WINDOW, text, k)
    covered = union_length(best, min_repeat, text, k) / np.maximum(counts, 1)
    longest = np.zeros(k, np.int64)
    np.maximum.at(longest, text, best)
    failed = (counts < 50) | (100 * short > 50 * counts)
    kept = ~failed & (covered <= max_covered) & (longest <= max_repeat)
    return [counts, chars, symbols, dup_lines, short, failed, kept, covered, longest]


def repetition_rules(
    docs: DataFrame,
    min_repeat: int = 8,
    max_covered: float = 0.45,
    max_repeat: int = 100,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Judge every whole text: one row per input row.

    Returns ``key`` and the columns of ``OUT``. ``covered`` is the share of
    words inside maximal repeated substrings of ``min_repeat`` words or more,
    ``longest_repeat`` the longest repeated substring in words; ``kept`` needs
    both within their limits and ``base_failed`` false.

    Null and empty texts have no words and fail. Null keys and repeated rows
    stay as they are; other columns are not read. Batches hold whole texts up to
    ``BATCH_WORDS`` words; a longer text is a batch of its own, and needs about
    200 bytes a word.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in OUT.split(", ")]
        for frame in frames:
            texts = frame["_text"].tolist()
            # Words take six characters or so with their space; the bound need not be sharp.
            ends = np.cumsum([len(t) // 6 + 1 if t else 1 for t in texts])
            groups = (ends // BATCH_WORDS).tolist()
            at = 0
            while at < len(texts):
                to = at + 1
                while to < len(texts) and groups[to] == groups[at]:
                    to += 1
                values = _judge(texts[at:to], min_repeat, max_covered, max_repeat)
                yield pd.DataFrame({"_key": frame["_key"].iloc[at:to].array, **dict(zip(names, values))})
                at = to

    rows = pick(docs, key, text).toDF("_key", "_text")
    return map_texts(rows, key, run, OUT)
