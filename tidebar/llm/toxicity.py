"""Toxicity (operator 9): subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the bag of its character n-grams, each hashed to one of ``buckets`` embedding rows; a text is
the average of its words; two softmax outputs read that average. Embeddings and outputs are fitted
together in numpy on a bounded sample of labelled texts. A misspelt word that was never seen still
shares most n-grams, and so most of its vector, with the word it distorts.

The model is linear in the average, so scoring needs one number for each n-gram row: the workers
get ``buckets`` floats, and a text costs one lookup a word.

Defined cases: a null text counts as empty; a text without words scores the model's bias (the share of
class 1 where there is nothing else); without labels of both classes every text scores the smoothed
share of class 1, 0.5 without any label. Repeated rows score alike, labels that disagree on an id count
as 1 from one half on, an empty table gives an empty table, input columns are carried along and one
with the name of an output column is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.common import label_sample, packed, tidy, unpacked

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Characters of words that a worker remembers before it starts anew.
REMEMBERED = 3_000_000


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the fitting sample: texts of each class (documented in the README)."""

    per_class: int = 3000
    buckets: int = 1 << 16
    width: int = 8
    shortest: int = 3
    longest: int = 4
    steps: int = 900
    batch: int = 64
    rate: float = 0.05
    shrink: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """``grams``: what an n-gram adds to the log odds, by bucket; a word adds its n-grams' mean."""

    grams: np.ndarray
    bias: float
    settings: Settings


def word_grams(word: str, s: Settings) -> list[int]:
    """Buckets of the n-grams of a lower-case word in marks of its ends; punctuation around it goes."""
    bare = EDGES.sub("", word) or word
    marked = f"<{bare}>".encode()
    if len(marked) <= s.shortest:
        return [zlib.crc32(marked) % s.buckets]
    return [
        zlib.crc32(marked[i : i + n]) % s.buckets
        for n in range(s.shortest, min(s.longest, len(marked)) + 1)
        for i in range(len(marked) - n + 1)
    ]


def text_grams(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights: its words' mean of each word's mean n-gram."""
    words = Counter(text.lower().split())
    total = sum(words.values())
    at, weight = [], []
    for word, n in words.items():
        grams = word_grams(word, s)
        at.append(grams)
        weight.append(np.full(len(grams), n / total / len(grams)))
    if not at:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    distinct, which = np.unique(np.concatenate(at), return_inverse=True)
    return distinct.astype(np.int32), np.bincount(which, np.concatenate(weight)).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, s: Settings) -> Model:
    """Embeddings and softmax together, by Adam on the cross-entropy of texts in small batches.

    After each step the rows it touched shrink by a constant length, so n-grams that tell nothing go
    back to the zero vector and the many clean words of a long text add no noise.
    ``prior`` is the share of class 1 among all labels; the sample may have another.
    """
    rng = np.random.default_rng(s.seed)
    table = np.zeros((s.buckets, s.width), np.float32)  # an n-gram that was never seen says nothing
    out = rng.normal(0, 0.5, (s.width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, out, bias)]
    step, order = 0, rng.permutation(len(bags))
    while step < s.steps:
        for lo in range(0, len(order), s.batch):
            rows = order[lo : lo + s.batch]
            sizes = [len(bags[i][0]) for i in rows]
            at = np.concatenate([bags[i][0] for i in rows])
            weight = np.concatenate([bags[i][1] for i in rows]) * 32  # keeps averages of small vectors apart
            of = np.repeat(np.arange(len(rows)), sizes)
            hidden = np.stack(
                [np.bincount(of, weight * table[at, k], len(rows)) for k in range(s.width)], axis=1
            ).astype(np.float32)
            logits = hidden @ out + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = error @ out.T
            touched, which = np.unique(at, return_inverse=True)
            to_table = np.stack(
                [np.bincount(which, weight * back[of, k], len(touched)) for k in range(s.width)], axis=1
            ).astype(np.float32)
            step += 1
            rate = s.rate * max(0.02, 1 - step / s.steps)
            _adam(table, touched, to_table, state[0], step, rate)
            norm = np.linalg.norm(table[touched], axis=1, keepdims=True)
            table[touched] *= np.maximum(0, 1 - rate * s.shrink / np.maximum(norm, 1e-12))
            _adam(out, slice(None), hidden.T @ error, state[1], step, rate)
            _adam(bias, slice(None), error.sum(axis=0), state[2], step, rate)
        order = rng.permutation(len(bags))
    share = labels.mean()
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    grams = (table @ (out[:, 1] - out[:, 0]) * 32).astype(np.float32)
    return Model(grams, float(bias[1] - bias[0] + shift), s)


def _adam(value, where, gradient, state, step, rate, fade=0.9, spread=0.999):
    first, second = state
    first[where] = fade * first[where] + (1 - fade) * gradient
    second[where] = spread * second[where] + (1 - spread) * gradient**2
    value[where] -= rate * (first[where] / (1 - fade**step)) / (
        np.sqrt(second[where] / (1 - spread**step)) + 1e-8
    )


class Words(dict):
    """word -> what it adds to the log odds, worked out when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self._model = model
        self._room = REMEMBERED

    def __missing__(self, word: str) -> float:
        s = self._model.settings
        value = float(self._model.grams[word_grams(word, s)].mean())
        self._room -= len(word) + 10
        if self._room < 0:
            self.clear()
            self._room = REMEMBERED
        if len(word) < 100:
            self[word] = value
        return value


def scores(texts: list[str | None], model: Model, words: Words) -> np.ndarray:
    logits = []
    for text in texts:
        split = (text or "").lower().split()
        logits.append(model.bias + (sum(map(words.__getitem__, split)) / len(split) if split else 0.0))
    return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, label: str, settings: Settings | None = None) -> Model:
    """Fit on at most ``2 * per_class`` texts; only their n-gram bags, made in tasks, reach the driver."""
    s = settings or Settings()
    rows, counts = label_sample(docs, labels, label, s.per_class)

    def bag(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            bags = [text_grams(t, s) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([b[0] for b in bags], pa.list_(pa.int32())),
                 pa.array([b[1] for b in bags], pa.list_(pa.float32()))],
                ["id", "y", "at", "weight"],
            )

    schema = "id long, y int, at array<int>, weight array<float>"
    sample = rows.mapInArrow(tidy(bag), schema).toArrow()
    y = sample.column("y").to_numpy()
    order = np.lexsort((y, sample.column("id").to_numpy()))
    bags = _slices(sample)
    bags, y = [bags[i] for i in order], y[order]
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(s.buckets, np.float32), float(np.log(prior / (1 - prior))), s)
    return fit(bags, y, prior, s)


def _slices(sample: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bags as views of the collected buffers; no Python object for each entry."""
    bags = []
    for at, weight in zip(sample.column("at").chunks, sample.column("weight").chunks, strict=True):
        a, w = at.flatten().to_numpy(), weight.flatten().to_numpy()
        cuts = at.offsets.to_numpy() - at.offsets[0].as_py()
        bags += [(a[i:j], w[i:j]) for i, j in zip(cuts, cuts[1:])]
    return bags


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability of class 1, from the whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # ``buckets`` floats
    packs = docs.select(packed(docs), F.col(text).alias("t"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shipped.value)
        for batch in source:
            found = scores(batch.column(1).to_pylist(), shipped.value, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])

    schema = T.StructType([packs.schema["row"], T.StructField("score", T.DoubleType())])
    return unpacked(packs.mapInArrow(tidy(run), schema), docs.columns, **{out: F.col("score")})
