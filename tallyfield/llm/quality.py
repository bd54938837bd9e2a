"""Quality classifier: naive Bayes support vectors over n-grams of word shapes.

A document is the set of 1- to 3-grams of its word shapes (letter case, digits, signs, and
whether a word repeats the one before). Each n-gram indicator is scaled by the log ratio of
its rates in the two classes, and a linear model with hinge loss is fitted by dual
coordinate descent. Words of more than ``PIECE`` characters (texts without white space, encoded
data) are cut into consecutive pieces, each a word of its own. A logistic curve, fitted on documents that the model has not seen,
turns margins into probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.labelled import held_out, labelled_sample

#: Labelled rows that a fit takes at most of each class, the first by hash of doc_id.
SAMPLE = {1: 3000, 0: 3000}
THRESHOLD = 0.3
HELD_OUT = (5, 0)
BUCKETS = 1 << 18
COST = 1.0
EPOCHS = 20
SEED = 11
CACHED_WORDS = 100_000
#: Longest run of characters that makes one shape; longer words are cut into such runs.
PIECE = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(zlib.crc32(b"repeat") << 8)


def shape(word: str) -> int:
    """Number of a word's shape: runs of upper, lower, digit and other letters, and its signs."""
    out, last = [], ""
    for c in word:
        kind = "A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else "l" if c.isalpha() else c
        if kind != last:
            out.append(kind)
            last = kind
    return zlib.crc32("".join(out).encode("utf-8", "surrogatepass")) << 8 | min(len(word), 40) // 8


def pieces(words: list[str]) -> tuple[list[str], list[bool]]:
    """Words, those above ``PIECE`` characters in pieces, and whether each repeats what is before it."""
    again = [False, *(a == b for a, b in zip(words[1:], words, strict=False))]
    if max(map(len, words)) <= PIECE:
        return words, again
    out: list[str] = []
    flags: list[bool] = []
    for word, same in zip(words, again, strict=True):
        cut = [word[at : at + PIECE] for at in range(0, len(word), PIECE)]
        out += cut
        flags += [same, *(same or a == b for a, b in zip(cut[1:], cut, strict=False))]
    return out, flags


class Features:
    """N-gram buckets of texts, with the shapes of words met before in a bounded memory."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Distinct buckets of a text in ascending order; a wordless text has the first bucket."""
        words = text.split() if text else []
        if not words:
            return np.zeros(1, dtype=np.int64)
        words, again = pieces(words)
        if len(self.known) > CACHED_WORDS:
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = shape(w)
        shapes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        shapes[np.array(again)] = _REPEAT
        grams, rolled = [], np.zeros(len(shapes), dtype=np.uint64)
        for n in range(1, 4):
            rolled = (rolled[: len(shapes) - n + 1] ^ shapes[n - 1 :]) * _MIX
            rolled ^= rolled >> np.uint64(31)
            grams.append(np.unique(rolled * _MIX >> np.uint64(46)))
            if len(shapes) == n:
                break
        return np.unique(np.concatenate(grams)).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    """Weight of each bucket, bias, and the slope and shift of the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum(dtype=np.float64)) / len(buckets) ** 0.5 + self.bias

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(buckets) + self.shift, -500, 500))))


def _support_vectors(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent on the L1 hinge loss; the bias is a constant feature."""
    pick = np.random.default_rng(SEED)
    weights, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    values = [ratio[r] / len(r) ** 0.5 for r in rows]
    norms = [float(v @ v) + 1 for v in values]
    # The rarer class weighs as much as the other.
    cost = {s: COST * len(y) / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    for _ in range(EPOCHS):
        moved = 0.0
        for i in pick.permutation(len(rows)):
            gradient = y[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[int(y[i])])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights * ratio, bias


def _logistic(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps on smoothed targets."""
    n1, n0 = int(positive.sum()), int((~positive).sum())
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -500, 500)))
        gradient = x @ (p - target) + [1e-3 * slope, 1e-3 * shift]
        curvature = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(curvature, gradient), -2, 2)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)


def fit(texts: list[str | None], labels: list[int]) -> QualityModel:
    """Ratios and support vectors on three documents of four, the logistic curve on the fourth."""
    if len(set(labels)) < 2:
        return QualityModel(np.zeros(BUCKETS, np.float32), 5.0 if 1 in labels else -5.0 if labels else 0.0, 1.0, 0.0)
    features = Features()
    rows = [features.of(t) for t in texts]
    y = np.where(np.array(labels) == 1, 1, -1)
    aside = np.zeros(len(rows), dtype=bool)
    for s in (-1, 1):
        aside[np.flatnonzero(y == s)[3::4]] = True
    own = np.flatnonzero(~aside)
    rates = []
    for s in (1, -1):
        counts = 1 + np.bincount(np.concatenate([rows[i] for i in own if y[i] == s]), minlength=BUCKETS)
        rates.append(np.log(counts / counts.sum()))
    ratio = rates[0] - rates[1]
    ratio[np.bincount(np.concatenate([rows[i] for i in own]), minlength=BUCKETS) == 0] = 0
    weights, bias = _support_vectors([rows[i] for i in own], y[own], ratio)
    plain = QualityModel(weights.astype(np.float32), bias, 1.0, 0.0)
    check = np.flatnonzero(aside) if aside.any() else own
    margins = np.array([plain.margin(rows[i]) for i in check])
    return QualityModel(plain.weights, bias, *_logistic(margins, y[check] == 1))


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on a bounded sample (``SAMPLE``) of the labelled rows outside the held-out fold."""
    return fit(*labelled_sample(docs, labels, "quality", HELD_OUT, SAMPLE))


def score_column(docs: DataFrame, model: QualityModel, text: Column) -> Column:
    """Probability of good quality of each text; null and wordless texts share one score."""
    # The model has a fixed number of buckets.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, model = Features(), shared.value
        for batch in batches:
            yield pa.array([model.score(features.of(t.as_py())) for t in batch], pa.float64())

    return of(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    One row per input row, repeated rows and null ids included. Only ``doc_id`` and ``text``
    enter, whole and of any length; an empty table gives no rows; without labels of both
    classes every text gets one and the same score.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", score_column(docs, model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id", held_out(*HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are predicted to be of good quality.

    Rows are judged by their text alone, read whole; null and empty texts get the model's score
    of an empty text. Repeated rows and null ids are kept or dropped like any other, columns of
    any name pass unchanged, an empty table gives no rows.
    """
    model = train(docs, labels)
    rows = docs.select(F.struct("*").alias("_row"), score_column(docs, model, F.col("text")).alias("_score"))
    return rows.filter(F.col("_score") >= THRESHOLD).select("_row.*")
