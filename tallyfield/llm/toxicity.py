"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of the character n-grams of its padded, lower-cased form. The vector of a
passage (a run of words) is the average over its words of the average over their n-grams,
and a softmax over two classes reads it; a text is as toxic as its most toxic passage, so
length does not thin out what is said. Training moves vectors and softmax together. Since
the softmax is linear, a trained n-gram contributes one number to the margin, so scoring
adds up one remembered number per word; a misspelt word keeps most n-grams of the word it
stands for. Texts are scored by every run of ``PASSAGE`` words, so it does not matter where
in a text something is said; training takes runs that do not overlap, save the last, and the
most toxic run of each clean text.
"""

from __future__ import annotations

import unicodedata
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
SAMPLE = {1: 800, 0: 1600}
THRESHOLD = 0.7
HELD_OUT = (3, 1)
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIMENSIONS = 4
#: Words that are averaged together; a text is as toxic as its most toxic passage.
PASSAGE = 50
#: Neutral words added to each average, so that a few words alone do not swing it.
BLANKS = 20
#: N-grams of fewer training passages keep a zero vector.
LEAST_PASSAGES = 8
FIRST_STEPS, SECOND_STEPS = 1200, 2400
BATCH = 64
RATE = 0.3
SOFTMAX_RATE = 0.05
#: Length that every vector loses from time to time.
SHRINK = 0.15
SHRINK_EVERY = 400
#: Margin of a passage of which nothing is known.
START_BIAS = -4.0
#: Averages over many n-grams are small; the scale keeps their gradients in range.
SCALE = 50.0
SEED = 7
CACHED_WORDS = 120_000
_PRIME = np.uint64(0x100000001B3)


def tokens(text: str | None) -> list[str]:
    """White-space words in lower case; none for null."""
    return text.lower().split() if text else []


def _bare(word: str) -> bytes:
    """A word between its first and last letter or digit, padded."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return b"<" + unicodedata.normalize("NFC", word[start:end]).encode("utf-8", "surrogatepass") + b">"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram buckets of all words in turn, and how many each word has (at least one)."""
    padded = [_bare(w) for w in words]
    raw = np.frombuffer(b"".join(padded), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(p) for p in padded])
    rolled = np.full(len(raw), 0xCBF29CE484222325, dtype=np.uint64)
    buckets, owners = [], []
    for n in range(1, max(GRAMS) + 1):
        count = len(raw) - n + 1
        if count <= 0:
            break
        rolled = (rolled[:count] ^ raw[n - 1 :]) * _PRIME
        if n not in GRAMS:
            continue
        inside = np.flatnonzero(owner[:count] == owner[n - 1 :])
        mixed = rolled[inside]
        buckets.append(((mixed ^ (mixed >> np.uint64(29))) * _PRIME >> np.uint64(46)).astype(np.int64))
        owners.append(owner[inside])
    # A word of one sign or none has no n-gram of three bytes; it gets the first bucket.
    lone = np.setdiff1d(np.arange(len(words)), owners[0] if owners else [])
    buckets.append(np.zeros(len(lone), dtype=np.int64))
    owners.append(lone)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owner, minlength=len(words))


def passages(words: list[str]) -> list[set[str]]:
    """The different words of consecutive runs of ``PASSAGE`` words, the last one ending with the text."""
    last = max(0, len(words) - PASSAGE)
    return [set(words[min(at, last) :][:PASSAGE]) for at in range(0, len(words), PASSAGE)]


def run_means(numbers: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """Mean margin of every run of ``PASSAGE`` words, by its first word (a shorter text is one run).

    ``numbers`` are equal for equal words, ``margins`` belong to the words. A word counts once
    in a run: at its first place, so it enters the runs that begin after its place before.
    """
    size = len(numbers)
    order = np.argsort(numbers, kind="stable")
    same = numbers[order[1:]] == numbers[order[:-1]]
    here = np.arange(size)
    starts = np.maximum(here - PASSAGE + 1, 0)
    starts[order[1:][same]] = np.maximum(starts[order[1:][same]], order[:-1][same] + 1)
    sums = np.bincount(starts, margins, size + 1) - np.bincount(here + 1, margins, size + 1)
    counts = np.bincount(starts, minlength=size + 1) - np.bincount(here + 1, minlength=size + 1)
    runs = max(1, size - PASSAGE + 1)
    return np.cumsum(sums)[:runs] / (np.cumsum(counts)[:runs] + BLANKS)


@dataclass
class _Bags:
    """Sparse rows: n-grams (places in ``buckets``) and weights of every passage; ``starts`` has one more entry."""

    buckets: np.ndarray
    grams: np.ndarray
    weights: np.ndarray
    starts: np.ndarray

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.starts[rows + 1] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(owner)) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        return self.grams[at], self.weights[at], owner


def _narrow(buckets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return buckets.astype(np.int32), sizes.astype(np.int32)


def _bags(cut: list[set[str]]) -> _Bags:
    """Bags of passages, without the n-grams of fewer than ``LEAST_PASSAGES`` passages.

    The n-grams of all passages are counted first and kept second, in pieces, so that those
    which are left out never lie in memory together.
    """
    words = sorted(set().union(*cut))
    each = [_narrow(*subwords(words[at : at + 10_000])) for at in range(0, len(words), 10_000)]
    buckets = np.concatenate([b for b, _ in each])
    sizes = np.concatenate([s for _, s in each])
    ends = np.cumsum(sizes)
    del each
    place = dict(zip(words, range(len(words)), strict=True))
    lengths = np.array([len(c) for c in cut])
    at = np.fromiter((place[w] for c in cut for w in sorted(c)), dtype=np.int32, count=int(lengths.sum()))
    del place, words
    firsts = np.cumsum(lengths) - lengths

    def pieces() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for low in range(0, len(cut), 500):
            own = slice(firsts[low], firsts[low] + lengths[low : low + 500].sum())
            here, each = at[own], sizes[at[own]]
            spread = np.arange(int(each.sum())) + np.repeat(ends[here] - np.cumsum(each), each)
            yield low, buckets[spread], each

    counts = np.zeros(BUCKETS, dtype=np.int64)
    for _, found, _ in pieces():
        counts += np.bincount(found, minlength=BUCKETS)
    kept = np.flatnonzero(counts >= min(LEAST_PASSAGES, max(1, len(cut) // 50)))
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[kept] = np.arange(len(kept))
    grams, weights, sums = [], [], []
    for low, found, each in pieces():
        size = lengths[low : low + 500]
        row = np.repeat(np.arange(len(size)), size)
        weight = np.repeat(1 / ((size[row] + BLANKS) * each), each)
        gram, row = number[found], np.repeat(row, each)
        known = gram >= 0
        grams.append(gram[known])
        weights.append(weight[known].astype(np.float32))
        sums.append(np.bincount(row[known], minlength=len(size)))
    starts = np.concatenate([[0], np.cumsum(np.concatenate(sums))])
    del buckets, sizes, at
    joined = np.concatenate(grams)
    grams.clear()
    return _Bags(kept, joined, np.concatenate(weights), starts)


@dataclass(frozen=True)
class ToxicityModel:
    """The margin that each n-gram bucket adds, and the bias."""

    margins: np.ndarray
    bias: float

    def word_margins(self, words: list[str]) -> np.ndarray:
        buckets, sizes = subwords(words)
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(self.margins[buckets].astype(np.float64), starts) / sizes


class Scorer:
    """Probabilities of texts, with the margins of words met before in a bounded memory."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}

    def means(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Mean margin of every run of words of each text; one of zero for a wordless text."""
        cut = [tokens(t) for t in texts]
        if len(self.known) > CACHED_WORDS:  # the words met first are the frequent ones
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))
        known = self.known
        missing = list(set().union(*cut) - known.keys())
        if missing:
            known.update(zip(missing, self.model.word_margins(missing).tolist(), strict=True))
        for words in cut:
            if not words:
                yield np.zeros(1)
                continue
            place = {w: n for n, w in enumerate(dict.fromkeys(words))}
            numbers = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
            margins = np.fromiter(map(known.__getitem__, place), dtype=np.float64, count=len(place))
            yield run_means(numbers, margins[numbers])

    def score(self, texts: list[str | None]) -> list[float]:
        out = [m.max() + self.model.bias for m in self.means(texts)]
        return (1 / (1 + np.exp(-np.clip(out, -500, 500)))).tolist()


class _Trainer:
    """Stochastic gradient steps on vectors and softmax together."""

    def __init__(self, bags: _Bags):
        self.bags, self.pick = bags, np.random.default_rng(SEED)
        # Vectors start at zero, so an n-gram never met adds nothing to any average.
        self.vectors = np.zeros((DIMENSIONS, len(bags.buckets)))
        self.softmax = self.pick.normal(0, 0.5, (DIMENSIONS, 2))
        self.bias = np.array([-START_BIAS, START_BIAS]) / 2
        self.moved = np.ones(len(bags.buckets))
        self.softmax_moved, self.bias_moved = np.ones((DIMENSIONS, 2)), np.full(2, 0.1)

    def hidden(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, weights, owner = self.bags.take(rows)
        weights = weights * SCALE
        sums = [np.bincount(owner, weights * v[ids], minlength=len(rows)) for v in self.vectors]
        return np.stack(sums, axis=1), ids, weights, owner

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(rows), 2000):
            logits = self.hidden(rows[at : at + 2000])[0] @ self.softmax + self.bias
            out.append(1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)

    def train(self, rows: np.ndarray, y: np.ndarray, steps: int) -> None:
        order = np.zeros(0, dtype=np.int64)
        for step in range(1, steps + 1):
            if len(order) < min(BATCH, len(rows)):
                order = np.concatenate([order, self.pick.permutation(len(rows))])
            own, order = order[:BATCH], order[BATCH:]
            hidden, ids, weights, owner = self.hidden(rows[own])
            logits = hidden @ self.softmax + self.bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            d_hidden = p @ self.softmax.T
            slope = np.stack(
                [np.bincount(ids, weights * d_hidden[owner, d], minlength=len(self.moved)) for d in range(DIMENSIONS)]
            )
            # Steps shrink with what an n-gram has moved before; rare n-grams start small.
            self.moved += (slope**2).sum(axis=0)
            self.vectors -= RATE * slope / np.sqrt(self.moved)
            d_softmax, d_bias = hidden.T @ p / len(own), p.mean(axis=0)
            self.softmax_moved += d_softmax**2
            self.softmax -= SOFTMAX_RATE * d_softmax / np.sqrt(self.softmax_moved)
            self.bias_moved += d_bias**2
            self.bias -= SOFTMAX_RATE * d_bias / np.sqrt(self.bias_moved)
            if step % SHRINK_EVERY == 0:
                # Group shrinkage: n-grams that carry little become zero and cannot add up to noise.
                length = np.sqrt((self.vectors**2).sum(axis=0))
                self.vectors *= np.maximum(0, 1 - SHRINK / np.maximum(length, SHRINK))

    def model(self) -> ToxicityModel:
        difference = self.softmax[:, 1] - self.softmax[:, 0]
        margins = np.zeros(BUCKETS, dtype=np.float32)
        margins[self.bags.buckets] = difference @ self.vectors * SCALE
        return ToxicityModel(margins, float(self.bias[1] - self.bias[0]))


def fit(texts: list[str | None], labels: list[int]) -> ToxicityModel:
    """Train on passages of labelled texts; with one class only, the bias alone answers.

    A toxic text need not be toxic throughout. After a first round on all passages, the
    passages of toxic texts that look clean are left out, the most toxic one of each text
    excepted; the most toxic run of each longer clean text, which its score goes by, is
    added; and a second round trains on these.
    """
    cut = [(passage, i) for i, t in enumerate(texts) for passage in passages(tokens(t))]
    if len(set(labels)) < 2 or not cut:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 5.0 if 1 in labels else -5.0)
    doc = np.array([i for _, i in cut])
    y = np.array(labels, dtype=np.int64)[doc]
    trainer, rows = _Trainer(_bags([c for c, _ in cut])), np.arange(len(cut))
    trainer.train(rows, y, FIRST_STEPS)
    p = trainer.probabilities(rows)
    best = np.zeros(len(texts))
    np.maximum.at(best, doc, p)
    stay = (y == 0) | (p >= 0.5) | (p == best[doc])
    scorer = Scorer(trainer.model())
    del trainer
    cut = [c for c, kept in zip(cut, stay, strict=True) if kept]
    for i, text in enumerate(texts):
        words = tokens(text) if labels[i] == 0 else []
        if len(words) > PASSAGE:
            at = int(next(scorer.means([text])).argmax())
            cut.append((set(words[at : at + PASSAGE]), i))
    del scorer
    trainer = _Trainer(_bags([c for c, _ in cut]))
    trainer.train(np.arange(len(cut)), np.array([labels[i] for _, i in cut], dtype=np.int64), SECOND_STEPS)
    return trainer.model()


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on a bounded sample (``SAMPLE``) of the labelled rows outside the held-out fold."""
    return fit(*labelled_sample(docs, labels, "toxic", HELD_OUT, SAMPLE))


def score_column(docs: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """Probability that each text is toxic; null and empty texts get that of the bias alone."""
    # The model has a fixed number of buckets.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = []
            for at in range(0, len(batch), 200):
                scores += scorer.score([t.as_py() for t in batch[at : at + 200]])
            yield pa.array(scores, pa.float64())

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


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic.

    Rows are judged by their text alone: null and empty texts have the score of no evidence,
    which is far below the threshold, and stay; repeated rows and null ids are kept or dropped
    like any other; texts are read whole; columns of any name pass unchanged. An empty table
    gives no rows; labels of one class alone decide for all rows.
    """
    model = train(docs, labels)
    rows = docs.select(F.struct("*").alias("_row"), score_column(docs, model, F.col("text")).alias("_score"))
    return rows.filter(F.col("_score") < THRESHOLD).select("_row.*")
