"""Quality classifier (operator 6): random-indexing word vectors, pooled, and a two-layer network.

Words (runs of letters or digits, and runs of other visible characters, each with its kind of writing)
fall into ``buckets``. Every bucket has a fixed sparse random index vector of +1 and -1. A bucket's
context vector is the sum of the index vectors of the words next to its occurrences, over all texts:
tasks add up dense tables and one shuffle sums them. A text is pooled from the unit context vectors of
its words (mean and spread), with a few ratios of repetition. A two-layer numpy network is fitted on a
bounded sample of labelled texts, and a temperature and a shift, fitted on part of that sample that the
network never saw, calibrate its probabilities.

Defined cases: a null text counts as empty; texts without words have the zero vector and score what the
network gives for it; without labels of both classes every text scores the smoothed share of class 1,
0.5 without any label; repeated rows score alike; an empty table gives an empty table; input columns
are carried along and one with the name of an output column is replaced. Very long texts are read in
runs of words, so their memory is bounded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.common import label_sample, packed, unpacked

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
REMEMBERED = 300_000
#: Words whose contexts are added up at once.
RUN = 200_000


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the fitting sample: texts of each class (documented in the README)."""

    per_class: int = 3000
    buckets: int = 1 << 14
    width: int = 32
    marks: int = 2
    near: int = 2
    hidden: int = 24
    steps: int = 1500
    batch: int = 128
    rate: float = 0.01
    decay: float = 1e-3
    seed: int = 5


_ROW = re.compile(r"(.)\1{3,}", re.DOTALL)


class Buckets(dict):
    """token -> bucket, from its text in lower case and the way it is written."""

    def __init__(self, n: int):
        super().__init__()
        self._n = n

    def __missing__(self, token: str) -> int:
        if token.isalpha():
            kind = "u" if token.isupper() and len(token) > 1 else "l"
        elif token[0].isalnum():
            kind = "n"
        else:
            kind = "s"
        # of a sign that comes in a row the length tells little beyond three
        written = _ROW.sub(r"\1\1\1", token) if kind == "s" else token.lower()
        value = zlib.crc32(f"{kind}{written}".encode()) % self._n
        if len(token) < 100:
            if len(self) > REMEMBERED:
                self.clear()
            self[token] = value
        return value


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(s.seed)
    places = rng.integers(0, s.width, (s.buckets, 2 * s.marks))
    return places, np.tile(np.repeat([1.0, -1.0], s.marks), (s.buckets, 1))


def add_contexts(table: np.ndarray, words: np.ndarray, index: tuple[np.ndarray, np.ndarray], s: Settings) -> None:
    """Add to each word's row the index vectors of the words up to ``near`` places away; -1 parts texts."""
    places, signs = index
    for gap in range(1, s.near + 1):
        a, b = words[:-gap], words[gap:]
        ok = (a >= 0) & (b >= 0)
        if gap > 1:  # no boundary between them
            ok &= words[1 : len(words) - gap + 1] >= 0
        a, b = a[ok], b[ok]
        for x, y in ((a, b), (b, a)):
            at = (x[:, None] * s.width + places[y]).ravel()
            table += np.bincount(at, signs[y].ravel(), table.size)


def context_table(docs: DataFrame, text: str, s: Settings) -> np.ndarray:
    """The context vectors over all texts: ``buckets`` x ``width`` numbers, whatever the input's size."""

    def tables(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = Buckets(s.buckets), index_vectors(s)
        table = np.zeros(s.buckets * s.width)
        waiting: list[np.ndarray] = []
        size = 0
        for batch in source:
            for t in batch.column(0).to_pylist():
                for words in bucket_runs(t, names):
                    waiting += [words, np.array([-1])]
                    size += len(words)
                    if size > RUN:
                        add_contexts(table, np.concatenate(waiting), index, s)
                        waiting, size = [], 0
        if waiting:
            add_contexts(table, np.concatenate(waiting), index, s)
        rows = table.reshape(s.buckets, s.width)
        used = np.flatnonzero(np.abs(rows).sum(axis=1))
        for lo in range(0, len(used), 4096):
            some = used[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)),
                 pa.FixedSizeListArray.from_arrays(pa.array(rows[some].ravel()), s.width).cast(pa.list_(pa.float64()))],
                ["bucket", "v"],
            )

    parts = docs.select(text).mapInArrow(tables, "bucket int, v array<double>")
    summed = parts.groupBy("bucket").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(s.width)])
    rows = summed.toArrow()
    table = np.zeros((s.buckets, s.width), np.float32)
    if rows.num_rows:
        at = rows.column("bucket").to_numpy()
        for k in range(s.width):
            table[at, k] = rows.column(f"v{k}").to_numpy()
    return unit(table)


def unit(table: np.ndarray) -> np.ndarray:
    """Rows without their common part, at length 1."""
    lengths = np.linalg.norm(table, axis=1, keepdims=True)
    rows = table / np.maximum(lengths, 1e-9)
    used = lengths[:, 0] > 0
    if used.any():
        rows[used] -= rows[used].mean(axis=0)
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def bucket_runs(text: str | None, names: Buckets) -> Iterator[np.ndarray]:
    """The buckets of a text's tokens, in runs of bounded length."""
    found: list[str] = []
    if text and len(text) > 8 * RUN:
        for m in TOKEN.finditer(text):
            found.append(m[0])
            if len(found) >= RUN:
                yield np.fromiter(map(names.__getitem__, found), np.int64, len(found))
                found = []
    elif text:
        found = TOKEN.findall(text)
    if found:
        yield np.fromiter(map(names.__getitem__, found), np.int64, len(found))


def pooled(text: str | None, names: Buckets, vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, and how often words and their neighbours repeat.

    ``counts`` is a scratch row of zeros, a place for each bucket, given back as zeros.
    """
    width, words, pairs_met, pairs = vectors.shape[1], 0, 0, 0
    seen = []
    for run in bucket_runs(text, names):
        np.add.at(counts, run, 1)
        seen.append(np.unique(run))
        words += len(run)
        if len(run) > 1:
            both = run[:-1] * len(counts) + run[1:]
            pairs_met, pairs = pairs_met + len(np.unique(both)), pairs + len(both)
    out = np.zeros(2 * width + 5, np.float32)
    if not words:
        return out
    used = np.unique(np.concatenate(seen))
    share = counts[used] / words
    counts[used] = 0
    mean = share @ vectors[used]
    out[:width] = mean * 4
    out[width : 2 * width] = np.sqrt(np.maximum(share @ vectors[used] ** 2 - mean**2, 0)) * 4
    out[-5:] = (
        np.linalg.norm(mean) * 2, len(used) / words * 2, pairs_met / max(1, pairs) * 2,
        np.log(words) / 4, share.max() * 4,
    )
    return out


@dataclass(frozen=True)
class Network:
    """Two layers and the calibration of their log odds; ``first`` None gives ``shift`` for every text."""

    first: np.ndarray | None
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float
    shift: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        if self.first is None:
            return np.full(len(x), self.shift)
        hidden = np.maximum(0, x @ self.first + self.first_bias)
        return (hidden @ self.second + self.second_bias) / self.temperature + self.shift

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, prior: float, s: Settings) -> Network:
    """Adam on the cross-entropy, then temperature and shift on every fifth text, which it never saw."""
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(x))
    kept = order[: len(order) // 5]
    learn = order[len(kept) :]
    if min(np.bincount(y[kept], minlength=2)) < 5 or min(np.bincount(y[learn], minlength=2)) < 5:
        kept = learn = order  # too few to set any aside
    params = [
        rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], s.hidden)).astype(np.float32),
        np.zeros(s.hidden, np.float32), rng.normal(0, s.hidden**-0.5, s.hidden).astype(np.float32),
        np.zeros(1, np.float32),
    ]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(y == 1, 0.5 / max(y[learn].mean(), 1e-6), 0.5 / max(1 - y[learn].mean(), 1e-6))
    for step in range(1, s.steps + 1):
        rows = rng.choice(learn, min(s.batch, len(learn)), replace=False)
        xb = x[rows]
        before = xb @ params[0] + params[1]
        hidden = np.maximum(0, before)
        odds = hidden @ params[2] + params[3]
        error = ((1 / (1 + np.exp(-np.clip(odds, -60, 60)))) - y[rows]) * weight[rows] / len(rows)
        back = np.outer(error, params[2]) * (before > 0)
        grads = [
            xb.T @ back + s.decay * params[0], back.sum(axis=0), hidden.T @ error + s.decay * params[2],
            np.array([error.sum()]),
        ]
        rate = s.rate * (1 - (step - 1) / s.steps)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    raw = Network(params[0], params[1], params[2], float(params[3][0]), 1.0, 0.0)
    temperature, shift = _calibrated(raw.odds(x[kept]), y[kept], prior)
    return Network(params[0], params[1], params[2], float(params[3][0]), temperature, shift)


def _calibrated(odds: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Temperature and shift with the least cross-entropy, classes weighted to their shares ``prior``."""
    weight = np.where(y == 1, prior / max(y.mean(), 1e-6), (1 - prior) / max(1 - y.mean(), 1e-6))
    best = (np.inf, 1.0, 0.0)
    for temperature in np.geomspace(0.5, 8, 25):
        scaled, shift = odds / temperature, 0.0
        for _ in range(30):  # Newton on the shift
            p = 1 / (1 + np.exp(-np.clip(scaled + shift, -60, 60)))
            slope = (weight * p * (1 - p)).sum() + 1e-3
            shift += float(np.clip((weight * (y - p)).sum() / slope, -1, 1))
        margin = np.where(y == 1, 1, -1) * (scaled + shift)
        loss = (weight * np.logaddexp(0, -margin)).sum()
        if loss < best[0]:
            best = (loss, float(temperature), shift)
    return best[1], best[2]


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    network: Network
    settings: Settings


def train(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", settings: Settings | None = None) -> Model:
    s = settings or Settings()
    vectors = context_table(docs, text, s)
    rows, counts = label_sample(docs.select("doc_id", F.col(text).alias("text")), labels, label, s.per_class)
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)
    size = 2 * s.width + 5

    def pool(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scratch = Buckets(s.buckets), np.zeros(s.buckets)
        for batch in source:
            x = [pooled(t, names, shipped.value, scratch) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float32()))], ["id", "y", "x"]
            )

    sample = rows.mapInArrow(pool, "id long, y int, x array<float>").toArrow()
    order = np.lexsort((sample.column("y").to_numpy(), sample.column("id").to_numpy()))
    y = sample.column("y").to_numpy()[order]
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    if len(set(y.tolist())) < 2:
        return Model(vectors, Network(None, None, None, 0.0, 1.0, float(np.log(prior / (1 - prior)))), s)
    x = np.concatenate([c.flatten().to_numpy() for c in sample.column("x").chunks]).reshape(-1, size)[order]
    return Model(vectors, fit(x, y, prior, s), s)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the calibrated probability of class 1, from the whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    packs = docs.select(packed(docs), F.col(text).alias("t"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        names, scratch = Buckets(m.settings.buckets), np.zeros(m.settings.buckets)
        for batch in source:
            x = np.array([pooled(t, names, m.vectors, scratch) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(m.network.probability(x).astype(np.float64))], ["row", "score"]
            )

    schema = T.StructType([packs.schema["row"], T.StructField("score", T.DoubleType())])
    return unpacked(packs.mapInArrow(run, schema), docs.columns, **{out: F.col("score")})
