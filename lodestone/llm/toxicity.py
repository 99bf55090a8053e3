"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows, whose hashed n-grams are found on the executors.  Presence of each n-gram is counted per class, the
smoothed log-count ratio of a feature scales it, texts are brought to unit length, and logistic regression with an L2 penalty, in which both
classes weigh alike, is fitted on all features that occur.  The intercept is set where a part of the sample that a first fit hasn't seen is told apart
best.  Scoring adds the weights of the distinct n-grams of a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, small_batches

#: n-gram lengths in characters, bits of the feature hash.
ORDERS, BITS = (4, 5), 18
#: The bounds on labelled rows that are fitted, and on their characters.
TRAINING_ROWS, TRAINING_CHARS = 4000, 8_000_000
STEPS, PENALTY = 100, 1e-4
#: What a clean text that is called toxic costs against a toxic one that is called clean, where the intercept is set.
FALSE_ALARM = 4
#: Features of training texts that one step looks at together.
ENTRIES = 1 << 18
#: Characters hashed at a time; longer texts go in overlapping pieces.
PIECE = 1 << 21


@dataclass(frozen=True)
class Model:
    """By feature its weight and its squared ratio, both 0 for features that training didn't meet."""

    weights: np.ndarray
    squares: np.ndarray
    intercept: float
    #: Whether there were labels of both classes to tell apart.
    learnt: bool = True


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of the texts (each followed by zeros) in arrays of bounded length, with each one's text index."""
    gap, chars, owner, n = "\0" * max(ORDERS), [], [], 0
    for i, text in enumerate(texts):
        text = f" {text.lower()} "
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE + max(ORDERS) - 1] + gap
            chars.append(part)
            owner.append((i, len(part)))
            n += len(part)
            if n >= PIECE:
                yield _joined(chars, owner)
                chars, owner, n = [], [], 0
    if chars:
        yield _joined(chars, owner)


def _joined(chars: list[str], owner: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.array([i for i, _ in owner], np.int64), [w for _, w in owner])


def _hashes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, feature of the n-gram that starts at each place)."""
    h = points.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in ORDERS:
            yield n, ((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting is faster here than numpy's hashing."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def features(texts: list[str], wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct (text index << BITS | feature) of all n-grams that lie within a text; only of wanted features where given."""
    found = []
    for points, owner in _pieces(texts):
        for n, h in _hashes(points):
            at = np.arange(len(h)) if wanted is None else np.flatnonzero(wanted[h])
            inside = np.ones(len(at), bool)
            for j in range(n):
                inside &= points[at + j] != 0
            at = at[inside]
            found.append(distinct(owner[at] << BITS | h[at]))
    return distinct(np.concatenate(found)) if found else np.empty(0, np.int64)


def _logistic(found: list[np.ndarray], scale: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps.

    Text i has the features found[i], one at least, each of the value scale[feature] / length[i].  Steps join ENTRIES of them at a time, so
    besides found itself nothing grows with the texts but a number for each.
    """
    starts = np.append(0, np.cumsum([len(f) for f in found]))
    weigh = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    blocks, at = [], 0
    while at < len(y):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + ENTRIES, "right")) - 1)
        blocks.append((at, min(end, len(y))))
        at = blocks[-1][1]
    w, v, b, bv, t = np.zeros(len(scale)), np.zeros(len(scale)), 0.0, 0.0, 1.0
    for _ in range(STEPS):
        g, slope, u = np.zeros(len(scale)), 0.0, scale * v
        for i, j in blocks:
            own, first = np.concatenate(found[i:j]), starts[i:j] - starts[i]
            z = np.add.reduceat(u[own], first) / length[i:j] + bv
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i:j]) * weigh[i:j]
            g += np.bincount(own, np.repeat(err / length[i:j], np.diff(starts[i : j + 1])), len(scale))
            slope += err.sum()
        w_next, b_next = v - (scale * g + PENALTY * v) / (0.5 + PENALTY), bv - slope / (0.5 + PENALTY)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, bv = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return w.astype(np.float32), float(b)


def _fit(found: list[np.ndarray], y: np.ndarray, alpha: float) -> Model:
    """The features stay where they are; besides them there are numbers for each of the 2^BITS features and each text."""
    pos, neg = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for f, v in zip(found, y):  # distinct in a text
        (pos if v else neg)[f] += 1
    ratio = np.log((alpha + pos) / (alpha * 2 + y.sum())) - np.log((alpha + neg) / (alpha * 2 + (1 - y).sum()))
    ratio[pos + neg == 0] = 0
    some = [i for i, f in enumerate(found) if len(f)]
    length = np.array([max(np.sqrt((ratio[found[i]] ** 2).sum()), 1e-9) for i in some])
    w, b = _logistic([found[i] for i in some], ratio, length, y[some])
    weights = (w * ratio).astype(np.float32)
    return Model(weights, (ratio**2).astype(np.float32), b)


def fit(found: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> Model:
    """Fits the classifier to texts' distinct features; with one class only, or none, it scores every text by that class's rate (0 without labels)."""
    y = np.asarray(y, np.float64)
    none = np.zeros(1 << BITS, np.float32)
    if len(y) == 0 or y.min() == y.max() or not sum(map(len, found)):
        return Model(none, none, 6.0 if len(y) and y.mean() > 0.5 else -6.0, learnt=False)
    model, apart = _fit(found, y, alpha), np.arange(len(y)) % 4 == 3
    if min(y[apart].sum(), (1 - y[apart]).sum(), y[~apart].sum(), (1 - y[~apart]).sum()) < 5:
        return model
    first = _fit([f for f, out in zip(found, apart) if not out], y[~apart], alpha)
    z = np.array([_sum(f, first) for f, out in zip(found, apart) if out])
    order = np.argsort(z)
    wrong = np.cumsum(y[apart][order]) / y[apart].sum() + FALSE_ALARM * (1 - np.cumsum(1 - y[apart][order]) / (1 - y[apart]).sum())
    # Between the two scores where the cost of errors is least; of equal places the middle one.
    best = np.flatnonzero(wrong[:-1] <= wrong[:-1].min() + 1e-12)
    at = best[len(best) // 2]
    return Model(model.weights, model.squares, model.intercept - (z[order[at]] + z[order[at + 1]]) / 2)


def _sum(found: np.ndarray, model: Model) -> float:
    return float(model.weights[found].sum(dtype=np.float64) / max(np.sqrt(model.squares[found].sum(dtype=np.float64)), 1e-9)) + model.intercept


def score(texts: list[str], model: Model) -> np.ndarray:
    pairs = features(texts, model.squares > 0)
    row, col = pairs >> BITS, pairs & ((1 << BITS) - 1)
    length = np.sqrt(np.bincount(row, model.squares[col], len(texts)))
    z = np.bincount(row, model.weights[col], len(texts)) / np.maximum(length, 1e-9) + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS, chars: int = TRAINING_CHARS) -> Model:
    """Learns from at most `rows` labelled documents outside the held-out fifth, of at most `chars` characters; only their feature numbers reach the driver."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features([t]).astype(np.int32) for t in texts], dtype=object)

    sample = labelled_sample(docs, labels, label, rows, chars).select("doc_id", "y", found(F.col("text")).alias("found")).orderBy("doc_id").toArrow()
    lists = []
    for part in sample["found"].chunks:  # views, so the features are held once
        values, ends = part.values.to_numpy(), part.offsets.to_numpy()
        lists += [values[a:b] for a, b in zip(ends, ends[1:])]
    model = fit(lists, sample["y"].to_numpy())
    del lists, sample
    pyarrow.default_memory_pool().release_unused()
    return model


def add_scores(docs: DataFrame, model: Model, *, text_col: str = "text", to: str = "toxic_score") -> DataFrame:
    """docs with a double column `to`: the chance that a text is toxic.

    The whole text counts.  Null and empty texts score as a text without n-grams; repeated rows score alike.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(texts.fillna("").tolist(), shared.value))

    return docs.withColumn(to, scored(F.col(text_col)))
