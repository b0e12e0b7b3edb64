"""Three-class gradient boosting of several models at once (one for each fold, or fold and symbol).

Features are binned once and kept as blocks: the rows of a model in a task, feature by feature, with their margins.
Every level of every round is one Spark job for the trees of all classes and all models together: tasks add up
(gradient, hessian, rows) by (model, class, node, feature, bin), the sums of a node meet in one reducer where a
model has several blocks, and only the best split of each node reaches the driver. So the number of jobs does
not grow with the number of models, and what travels depends on nodes and bins and not on rows.

Gradients are those of the softmax of all classes; they and the losses are added up as whole multiples of 2^-24, so
a model is the same whatever the partitions and the order of the rows. A model ends when a round improves
the loss of its held-out tail by less than a share of it, and keeps its rounds up to the best one.

Blocks are kept between rounds as a persisted RDD that is checkpointed every ``WRITE_EVERY`` rounds; a lost
partition is made again from the last written one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.session import checkpoint_folder, cut_lineage

CLASSES = 3
UNIT = float(1 << 24)
WRITE_EVERY = 16
#: Rows of a model that one task takes, about.
SLICE = 50_000
BINNED = "g int, id long, y int, w double, tail boolean, bins binary"


@dataclass(frozen=True)
class BoostConfig:
    rounds: int = 500
    rate: float = 0.1
    depth: int = 5
    bins: int = 64
    subsample: float = 0.8
    min_rows: int = 5
    l2: float = 1.0
    tolerance: float = 0.001
    seed: int = 42


@dataclass
class Tree:
    """A binary tree in heap order: node i has the children 2i + 1 and 2i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has reached after some levels (a leaf where it ends before)."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            right = bins[rows, np.maximum(f, 0)] > self.bin[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


@dataclass
class BoostedTrees:
    """Cut points of the features and rounds of one tree a class."""

    features: list[str]
    cuts: list[np.ndarray]
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        out = np.zeros((len(x), CLASSES))
        for trees in self.rounds:
            add(out, trees, bins, self.depth)
        return out

    def probabilities(self) -> Column:
        """The three probabilities of a row that has the features as columns."""

        @F.pandas_udf("array<double>")
        def predict(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.empty((0, len(self.features)))
            return pd.Series(list(softmax(self.margins(rows))))

        return predict(F.array(*[F.col(c).cast("double") for c in self.features]))

    def to_json(self) -> str:
        return json.dumps({
            "features": self.features, "cuts": [c.tolist() for c in self.cuts], "depth": self.depth, "losses": self.losses,
            "rounds": [[[t.feature.tolist(), t.bin.tolist(), t.value.tolist()] for t in trees] for trees in self.rounds],
        })

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        d = json.loads(text)
        rounds = [
            [Tree(np.array(f, np.int32), np.array(b, np.int32), np.array(v, float)) for f, b, v in trees] for trees in d["rounds"]
        ]
        return cls(d["features"], [np.array(c, float) for c in d["cuts"]], d["depth"], rounds, d["losses"])


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of cut points below each value; a missing value counts as 0."""
    x = np.nan_to_num(x)
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, x[:, f])
    return out


def add(margins: np.ndarray, trees: list[Tree], bins: np.ndarray, depth: int) -> None:
    for k, tree in enumerate(trees):
        margins[:, k] += tree.value[tree.nodes(bins, depth)]


def gradients(margins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the weighted loss for each class, in whole units."""
    p = softmax(margins)
    g = w[:, None] * (p - (y[:, None] == np.arange(CLASSES)))
    h = np.maximum(2.0 * w[:, None] * p * (1.0 - p), 1e-6)
    return np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64)


def sampled(ids: np.ndarray, round_: int, cfg: BoostConfig) -> np.ndarray:
    """Which rows a round learns from: a hash of row, round and seed, so that reruns agree."""
    x = ids.astype(np.uint64) + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 + cfg.seed & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53) < cfg.subsample


def best_split(sums: np.ndarray, cfg: BoostConfig) -> tuple[int, int, float, float, float]:
    """(feature, bin, value, left value, right value) of a node from its sums (3, features, bins).

    Feature -1 where no split gains; of equal gains the first feature and the lowest bin.
    """
    g, h = sums[0] / UNIT, sums[1] / UNIT
    below = np.cumsum(sums, axis=2)
    total = below[:, :1, -1:]
    left_g, left_h = below[0] / UNIT, below[1] / UNIT
    all_g, all_h = total[0, 0, 0] / UNIT, total[1, 0, 0] / UNIT
    right_g, right_h = (total[0] - below[0]) / UNIT, (total[1] - below[1]) / UNIT
    fit = (below[2] >= cfg.min_rows) & (total[2] - below[2] >= cfg.min_rows)
    gain = left_g**2 / (left_h + cfg.l2) + right_g**2 / (right_h + cfg.l2) - all_g**2 / (all_h + cfg.l2)
    gain = np.where(fit, gain, -1.0)
    at = int(np.argmax(gain))
    value = -cfg.rate * all_g / (all_h + cfg.l2)
    if gain.flat[at] <= 1e-9:
        return -1, 0, value, value, value
    f, b = divmod(at, g.shape[1])
    left = -cfg.rate * left_g[f, b] / (left_h[f, b] + cfg.l2)
    right = -cfg.rate * right_g[f, b] / (right_h[f, b] + cfg.l2)
    return f, b, value, left, right


def quantile_cuts(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 distinct cut points of each feature; one aggregate for all features."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), shares, 10_000).alias(f"q{i}")
                       for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [], float)) for q in found]


def _binned(rows: DataFrame, features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    packed = rows.select("g", "id", "y", "w", "tail", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(features))
            own = [r.tobytes() for r in binned(x, cuts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(own, pa.binary())], ["g", "id", "y", "w", "tail", "bins"]
            )

    return packed.mapInArrow(run, BINNED)


@dataclass
class Block:
    """Rows of one model: what is learned from them, bins (feature, row) and margins (row, class)."""

    g: int
    ids: np.ndarray
    y: np.ndarray
    w: np.ndarray
    tail: np.ndarray
    bins: np.ndarray
    margins: np.ndarray


def _blocks(rows: DataFrame, width: int) -> RDD:
    """One block for each model that a partition has rows of; a partition is a slice of a model, about."""

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in source:
            g, ids, y, w, tail = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            bins = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(batch.num_rows, width)
            for one in np.unique(g).tolist():
                at = np.flatnonzero(g == one)
                parts.setdefault(one, []).append((ids[at], y[at], w[at], tail[at].astype(bool), bins[at]))
        for one, found in parts.items():
            ids, y, w, tail, bins = (np.concatenate(x) for x in zip(*found, strict=True))
            data = [x.tobytes() for x in (ids.astype(np.int64), y.astype(np.int32), w.astype(float), tail, bins.T)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([one], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], ["g", "id", "y", "w", "tail", "bins"]
            )

    def unpack(r) -> Block:
        ids, y, w, tail, bins = (
            np.frombuffer(x, t) for x, t in zip(r[1:], (np.int64, np.int32, np.float64, np.bool_, np.uint8), strict=True)
        )
        return Block(r[0], ids, y, w, tail, bins.reshape(width, len(ids)), np.zeros((len(ids), CLASSES)))

    return rows.mapInArrow(pack, "g int, id binary, y binary, w binary, tail binary, bins binary").rdd.map(unpack)


def level_sums(margins, y, w, ids, bins, trees: list[Tree], level: int, round_: int, cfg: BoostConfig) -> np.ndarray:
    """Sums by (class, node of the level, [gradient, hessian, rows], feature, bin) of rows that are learned from.

    ``bins``: (feature, row). A feature at a time, so that the sums being added to stay in the processor's cache.
    """
    width, first, nodes = bins.shape[0], (1 << level) - 1, 1 << level
    out = np.zeros((CLASSES, nodes, 3, width, cfg.bins))
    use = sampled(ids, round_, cfg)
    grad, hess = (x[use].astype(np.float64) for x in gradients(margins, y, w))
    bins = bins[:, use]
    for k, tree in enumerate(trees):
        node = tree.nodes(bins.T, level) - first  # negative where a branch has ended before
        here = np.flatnonzero(node >= 0)
        if not len(here):
            continue
        start, own = node[here] * cfg.bins, bins[:, here]
        g, h = grad[here, k], hess[here, k]
        for f in range(width):
            index = start + own[f]
            for c, x in enumerate((g, h, None)):
                out[k, :, c, f] = np.bincount(index, x, minlength=nodes * cfg.bins).reshape(nodes, cfg.bins)
    return out.reshape(CLASSES, nodes, 3, width * cfg.bins)


def _level(state: RDD, live: dict[int, list[Tree]], width: int, level: int, round_: int, cfg: BoostConfig, alone: bool) -> list:
    """(model, class, node, best split) for every node of a level, and with level 0 the loss of each model's tail (class -1).

    ``alone``: a model has one block, whose sums are those of the model.
    """

    def sums(block: Block) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        if block.g not in live:
            return
        at, held = np.flatnonzero(~block.tail), np.flatnonzero(block.tail)
        found = level_sums(
            block.margins[at], block.y[at], block.w[at], block.ids[at], block.bins[:, at], live[block.g], level, round_, cfg)
        for k in range(CLASSES):
            for node in range(1 << level):
                if found[k, node, 2].any():
                    yield (block.g, k, node), found[k, node].astype(np.int64)
        if level == 0 and len(held):
            p = softmax(block.margins[held])[np.arange(len(held)), block.y[held]]
            lost = np.rint(-np.log(np.maximum(p, 1e-15)) * block.w[held] * UNIT).sum(), np.rint(block.w[held] * UNIT).sum()
            yield (block.g, -1, 0), np.array(lost).astype(np.int64)

    def best(node: tuple[tuple[int, int, int], np.ndarray]) -> tuple:
        (g, k, at), total = node
        if k < 0:
            return g, k, at, (-1, 0, float(total[0] / total[1]) if total[1] else 0.0, 0.0, 0.0)
        return g, k, at, best_split(total.reshape(3, width, cfg.bins), cfg)

    found = state.flatMap(sums)
    if not alone:
        found = found.reduceByKey(np.add, max(1, min(state.context.defaultParallelism, len(live) * CLASSES << level)))
    return found.map(best).collect()  # a short row for each node of the level


def _advanced(state: RDD, done: dict[int, list[Tree]], depth: int) -> RDD:
    """The state with the trees of a round added to the margins."""

    def run(block: Block) -> Block:
        if block.g not in done:
            return block
        margins = block.margins.copy()
        add(margins, done[block.g], block.bins.T, depth)
        return replace(block, margins=margins)

    return state.map(run)


def boost(
    rows: DataFrame, features: list[str], cfg: BoostConfig | None = None, model: str = "fold",
    cut_rows: DataFrame | None = None,
) -> dict[int, BoostedTrees]:
    """Models by the whole number in ``model``.

    ``rows``: model, id (long), label (0, 1, 2), weight, _tail (the held-out rows) and the features.
    ``cut_rows`` gives the cut points (default: all rows that are learned from); with folds in time order
    the rows of the first fold keep later rows out of them.
    """
    cfg = cfg or BoostConfig()
    cuts = quantile_cuts((rows if cut_rows is None else cut_rows).filter("NOT _tail"), features, cfg.bins)
    named = rows.select(
        F.col(model).cast("int").alias("g"), "id", F.col("label").cast("int").alias("y"), F.col("weight").cast("double").alias("w"),
        F.col("_tail").alias("tail"), *[F.col(f"`{c}`") for c in features],
    )
    rows = cut_lineage(_binned(named, features, cuts), "boosting")
    sizes = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    slices = max(1, -(-max(sizes.values()) // SLICE))
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(slices))).repartitionByRange(
        len(sizes) * slices, "g", "_slice").drop("_slice")
    state = _blocks(dealt, len(features)).persist(StorageLevel.MEMORY_AND_DISK)
    if not state.context.getCheckpointDir():
        state.context.setCheckpointDir(checkpoint_folder(rows.sparkSession))
    width = len(features)
    models = {g: BoostedTrees(features, cuts, cfg.depth) for g in sizes}
    live, before = set(models), None
    for round_ in range(cfg.rounds + 1):
        trees = {g: [Tree.empty(cfg.depth) for _ in range(CLASSES)] for g in live}
        for level in range(cfg.depth):
            split, first = False, (1 << level) - 1
            for r in _level(state, trees, width, level, round_, cfg, slices == 1):
                g, k, at, (feature, cut, value, left, right) = r[0], r[1], first + r[2], r[3]
                if k < 0:
                    models[g].losses.append(value)
                    continue
                tree = trees[g][k]
                tree.feature[at], tree.bin[at] = feature, cut
                if level == 0:
                    tree.value[at] = value
                if feature >= 0:
                    split = True
                    tree.value[2 * at + 1], tree.value[2 * at + 2] = left, right
            if level == 0:
                if before is not None:
                    before.unpersist()
                for g in list(live):
                    seen = models[g].losses
                    if round_ == cfg.rounds or len(seen) > 1 and seen[-2] - seen[-1] < cfg.tolerance * seen[-2]:
                        live.discard(g)
                        trees.pop(g)
            if not live or not split:
                break
        if not live:
            break
        for g in live:
            models[g].rounds.append(trees[g])
        before, state = state, _advanced(state, {g: trees[g] for g in live}, cfg.depth).persist(StorageLevel.MEMORY_AND_DISK)
        if (round_ + 1) % WRITE_EVERY == 0:
            state.checkpoint()
    state.unpersist()
    for one in models.values():
        if one.losses:
            one.rounds = one.rounds[: int(np.argmin(one.losses))]
    return models
