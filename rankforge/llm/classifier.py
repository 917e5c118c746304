"""Quality classifier: a Gaussian kernel over document statistics by random Fourier features.

Fit: every partition of labelled rows sums its normal equations, one set per
fold; the sums give the ridge solution of all rows and, by subtraction, the
solution without each fold. The scores that rows get from the solution without
their own fold are calibrated by isotonic regression on bounded bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import map_texts, pick
from rankforge.session import materialise

FOLDS = 4
HELD_OUT = 2
_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#*$%&|<>@^~=+\\/_{}[]",
    "quote": b"\"'()-",
}
STATISTICS = [
    "words", "word_length", "word_spread", "longest_word", "distinct_words", "distinct_triples", "top_word", "lines", "line_length",
    "repeated_lines", *_SETS, "single_signs", "sign_ended", "capitalised",
]


def document_statistics(text: str | None) -> list[float]:
    """Shares and logarithms that describe a whole text; all zero without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(words), len(data)
    lengths = np.fromiter(map(len, words), np.int64, n)
    codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    _, times = np.unique(codes, return_counts=True)
    triples = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:]
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = [float(counts[list(letters)].sum()) / size for letters in _SETS.values()]
    firsts, lasts = bytes(w[0] for w in words), bytes(w[-1] for w in words)
    alone = int(((lengths == 1) & ~np.isin(np.frombuffer(firsts, np.uint8), np.frombuffer(_SETS["upper"] + _SETS["lower"] + _SETS["digit"], np.uint8)) & (np.frombuffer(firsts, np.uint8) < 128)).sum())
    ended = np.isin(np.frombuffer(lasts, np.uint8), np.frombuffer(_SETS["symbol"] + _SETS["shout"], np.uint8)).mean()
    capital = np.isin(np.frombuffer(firsts, np.uint8), np.frombuffer(_SETS["upper"], np.uint8)).mean()
    return [
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        len(times) / n,
        len(np.unique(triples)) / max(len(triples), 1),
        times.max() / n,
        np.log1p(len(lines)),
        np.log1p(size / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        *shares,
        alone / n,
        float(ended),
        float(capital),
    ]


def fold_of(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def with_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per input row, written once: ``key, _fold, _stats``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stats = [document_statistics(t) for t in frame["_text"].tolist()]
            yield pd.DataFrame({"_key": frame["_key"].array, "_stats": stats})

    rows = pick(docs, key, text).toDF("_key", "_text")
    done = map_texts(rows, "_key", run, "_stats array<double>")
    return materialise(done.withColumn("_fold", fold_of(F.col("_key"))))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        inner = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.directions + self.phases
        waves = np.cos(inner) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(stats), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.knots, self.levels), 0, 1)


def isotonic(bins: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing fit to bins of (score, positives, n), by pooling violators."""
    blocks: list[list[float]] = []
    for score, positives, n in bins.sort_values("score")[["score", "positives", "n"]].itertuples(index=False):
        blocks.append([score * n, positives, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    knots = np.array([s / n for s, _, n in blocks])
    levels = np.array([p / n for _, p, n in blocks])
    return knots, levels


def fit_quality(
    stats: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    waves: int = 256,
    ridge: float = 1e-3,
    seed: int = 7,
) -> Model:
    """Fit on all labelled rows whose fold is not the held-out one.

    A document with several labels counts once, with their mean. What reaches
    the driver is one set of normal equations per fold, summed on the executors,
    and at most 2,002 bins of scores: sizes that do not depend on the data.
    """
    known = pick(labels, key, label).toDF("_key", "_label").where(F.col("_key").isNotNull() & F.col("_label").isNotNull())
    known = known.groupBy("_key").agg(F.avg(F.col("_label").cast("double")).alias("_label"))
    train = materialise(stats.where(F.col("_fold") != HELD_OUT).join(known, "_key").select("_fold", "_stats", "_label"))
    d = len(STATISTICS)
    at = [F.col("_stats")[i] for i in range(d)]
    moments = train.agg(*[F.avg(x) for x in at], *[F.stddev_pop(x) for x in at]).first()
    mean = np.array([x or 0.0 for x in moments[:d]])
    scale = np.array([x if x and x > 1e-6 else 1.0 for x in moments[d:]])
    random = np.random.default_rng(seed)
    directions = random.standard_normal((d, waves)) / np.sqrt(d)
    phases = random.uniform(0, 2 * np.pi, waves)
    empty = Model(mean, scale, directions, phases, np.zeros(waves + 1), np.array([0.0]), np.array([0.5]))
    width = waves + 1

    def partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            x = empty.features(np.stack(frame["_stats"].to_numpy()))
            full = np.column_stack([x, frame["_label"].to_numpy()])
            for fold in frame["_fold"].unique().tolist():
                rows = full[(frame["_fold"] == fold).to_numpy()]
                sums[fold] = sums.get(fold, 0) + np.vstack([rows.T @ rows, np.full((1, width + 1), len(rows))])
        for fold, matrix in sums.items():
            yield pd.DataFrame({"fold": fold, "row": np.arange(width + 2), "values": list(matrix)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": frame["fold"][:1], "row": frame["row"][:1], "values": [np.sum(np.stack(frame["values"].to_numpy()), axis=0)]})

    kind = "fold int, row int, values array<double>"
    summed = train.mapInPandas(partial_sums, kind).groupBy("fold", "row").applyInPandas(add, kind).collect()
    equations = {f: np.zeros((width + 2, width + 1)) for f in range(FOLDS)}
    for r in summed:
        equations[r["fold"]][r["row"]] = r["values"]
    whole = sum(equations.values())

    def solve(m: np.ndarray) -> np.ndarray:
        n = max(m[-1, 0], 1.0)
        penalty = np.eye(width) * (ridge * n + 0.1)
        penalty[-1, -1] = 1e-6
        return np.linalg.solve(m[:width, :width] + penalty, m[:width, width])

    if not whole[-1, 0]:  # nothing to learn from: every score is one half
        return empty
    without = {f: solve(whole - m) if whole[-1, 0] > m[-1, 0] else solve(whole) for f, m in equations.items()}

    def out_of_fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = empty.features(np.stack(frame["_stats"].to_numpy()))
            raw = np.einsum("ij,ij->i", x, np.stack([without[f] for f in frame["_fold"].tolist()]))
            yield pd.DataFrame({"raw": np.clip(raw, -0.5, 1.5), "label": frame["_label"].array})

    scored = train.mapInPandas(out_of_fold, "raw double, label double")
    bins = scored.groupBy(F.floor(F.col("raw") * 1000).alias("bin")).agg(
        F.avg("raw").alias("score"), F.sum("label").alias("positives"), F.count(F.lit(1)).alias("n")
    )
    knots, levels = isotonic(pd.DataFrame([r.asDict() for r in bins.collect()]))
    return Model(mean, scale, directions, phases, solve(whole), knots, levels)


def score_quality(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with a calibrated ``score`` between 0 and 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 4096):
                part = frame.iloc[a : a + 4096]
                x = model.features(np.stack(part["_stats"].to_numpy()))
                yield pd.DataFrame({"_key": part["_key"].array, "score": model.calibrated(x @ model.weights)})

    return map_texts(stats.select("_key", "_stats"), "_key", run, "score double")


THRESHOLD = 0.7


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> DataFrame:
    """Score every whole text: one row per input row, ``key, held_out, score, predicted``.

    The score is calibrated to the share of label 1 and depends on the text
    alone. Rows whose crc32 of the key as text leaves 2 modulo 4 are held out of
    the fit. Null and empty texts score like any text, with all statistics zero;
    rows with a null key are scored and not held out; repeated rows stay. With
    no label at all every score is 0.5. Other columns are not read.
    """
    stats = with_statistics(docs, key, text)
    model = fit_quality(stats, labels, key, label)
    scored = score_quality(stats, model)
    held = F.coalesce(fold_of(F.col("_key")) == HELD_OUT, F.lit(False))
    return scored.select(
        F.col("_key").alias(key), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
