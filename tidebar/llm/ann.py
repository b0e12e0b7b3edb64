"""Approximate nearest neighbours by cosine (operator 10): a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample (``Settings.sample`` vectors), every vector is then handed down to
its leaf, and a leaf's vectors lie in blocks of bounded size. A query walks the tree from the root with a
priority queue: the node whose centre is nearest comes next, whichever level it is on, until a number of
leaves is visited. That number is calibrated: a sample of the queries is compared with all vectors, and
leaves are added until the true neighbours lie in the visited leaves often enough (``recall``), with all
leaves as the last resort. Scores are exact cosines of the original vectors in double precision.

Equal vectors are one entry with the smallest ids, which is all that any query can be given of it; the
query rows that share a vector are searched once.

Defined cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite
components take no part, nor do rows with a null id; ties go to the smaller id; repeated rows with one
id are answers of their own, but never to that id; fewer than k candidates give all that were found; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.llm.common import parts_for, written
from tidebar.llm.vectors import answers, asked, matrix, own_classes, ranked_answers, usable, with_first_ids


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors that the tree is fitted on, ``trial`` the queries that calibrate it."""

    sample: int = 20_000
    trial: int = 200
    branches: int = 8
    leaf_rows: int = 128
    most_leaves: int = 4096
    rounds: int = 8
    recall: float = 0.95
    block: int = 4096
    chunk: int = 16_384
    seed: int = 3


class Tree:
    """Nodes in one array: unit centres, first child and number of children; leaves have a number."""

    def __init__(self, sample: np.ndarray, leaves: int, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.centres = [unit(sample.mean(axis=0, keepdims=True))[0] if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[tuple[int, int]] = [(0, 0)]
        self.leaf = [0]
        least = max(2, len(sample) / max(1, leaves))
        waiting = [(0, np.arange(len(sample)))]
        n_leaves = 1
        while waiting:
            node, rows = waiting.pop()
            if len(rows) <= least or n_leaves >= leaves or len(rows) < 2 * s.branches:
                continue
            centres, of = means(sample[rows], s.branches, s.rounds, rng)
            if len(centres) < 2:
                continue
            first = len(self.centres)
            self.children[node] = (first, len(centres))
            for i, centre in enumerate(centres):
                self.centres.append(centre)
                self.children.append((0, 0))
                waiting.append((first + i, rows[of == i]))
            n_leaves += len(centres) - 1
        self.centres = np.array(self.centres)
        ends = [i for i, (_, n) in enumerate(self.children) if not n]
        self.leaves = len(ends)
        self.leaf = np.full(len(self.centres), -1)
        self.leaf[ends] = np.arange(len(ends))

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: the nearest child, level by level."""
        node = np.zeros(len(rows), np.int64)
        open_nodes = {0} if self.children[0][1] else set()
        while open_nodes:
            following = set()
            for n in open_nodes:
                at = np.flatnonzero(node == n)
                first, count = self.children[n]
                if len(at):
                    node[at] = first + np.argmax(rows[at] @ self.centres[first : first + count].T, axis=1)
                    following |= {int(x) for x in np.unique(node[at]) if self.children[x][1]}
            open_nodes = following
        return self.leaf[node]

    def visits(self, row: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in the order in which a priority queue of nodes, nearest centre first, meets them.

        ``most`` leaves, and more until these hold ``least`` vectors by their ``sizes``.
        """
        near = self.centres @ row
        queue, found, held = [(-near[0], 0)], [], 0
        while queue and (len(found) < most or held < least):
            _, node = heapq.heappop(queue)
            first, count = self.children[node]
            if not count:
                found.append(int(self.leaf[node]))
                held += sizes.get(found[-1], 0) if sizes else 0
            for child in range(first, first + count):
                heapq.heappush(queue, (-near[child], child))
        return found


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; centres that no row is nearest to are left out."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    of = np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        of = np.argmax(rows @ centres.T, axis=1)
        used, of = np.unique(of, return_inverse=True)
        sums = np.zeros((len(used), rows.shape[1]))
        np.add.at(sums, of, rows)
        centres = unit(sums)
    of = np.argmax(rows @ centres.T, axis=1)
    used, of = np.unique(of, return_inverse=True)
    return centres[used], of


def best(
    queries: np.ndarray, rows: np.ndarray, firsts: np.ndarray, k: int,
    only: tuple[np.ndarray, np.ndarray] | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query the k best rows with their cosines; ties to the smaller first id.

    ``only``: which leaves each query visits, and the leaf of each row.
    """
    lengths = np.sqrt((rows * rows).sum(axis=1))
    for lo in range(0, len(queries), 256):
        some = queries[lo : lo + 256]
        norms = np.sqrt((some * some).sum(axis=1))
        near = (some @ rows.T) / norms[:, None] / lengths
        if only is not None:
            near[~only[0][lo : lo + 256][:, only[1]]] = -np.inf
        k_here = min(k, len(rows))
        kth = np.partition(near, len(rows) - k_here, axis=1)[:, len(rows) - k_here]
        for i in range(len(some)):
            at = np.flatnonzero((near[i] >= kth[i] - 1e-12) & (near[i] > -np.inf))
            # the products above round by their place in a block; these do not
            exact = (rows[at] * some[i]).sum(axis=1) / (lengths[at] * norms[i])
            order = np.lexsort((firsts[at], -exact))[:k]
            yield lo + i, at[order], exact[order]


def nearest(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, every: int = 50,
    settings: Settings | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every query of the set."""
    s = settings or Settings()
    rows, width = usable(table, vec_id, embedding, zeros=False)
    classes = written(
        with_first_ids(rows, "v", k + 1).select(
            F.monotonically_increasing_id().alias("key"), F.col("ids")[0].alias("first"), "v", "ids"), "vectors"
    )
    total = classes.count()
    sample = classes.select("first", "v").orderBy(F.xxhash64("first"), "first").limit(s.sample).toArrow()
    leaves = min(s.most_leaves, max(1, total // s.leaf_rows))
    tree = Tree(unit(matrix(sample.column("v")).reshape(sample.num_rows, width)), leaves, s)
    shipped = table.sparkSession.sparkContext.broadcast(tree)  # ``most_leaves`` and their parents at most

    def placed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                leaf = shipped.value.assign(unit(matrix(batch.column(2))))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *batch.columns], ["leaf", *batch.schema.names])

    kind = rows.schema["v"].dataType.simpleString()
    index = written(classes.mapInArrow(placed, f"leaf long, key long, first long, v {kind}, ids array<long>"), "index")
    # a query's key is that of its vector; the vectors of the queries are a 50th of all
    mine = index.select(F.col("key").alias("q"), "v")
    queries = written(asked(rows, every).join(mine, "v").select("id", "q"), "asked")
    keys = written(queries.select("q").distinct().join(mine, "q").select("q", "v"), "keys")
    visits = _calibrated(index, keys, tree, k, s)
    most = k + own_classes(rows, "v", every)

    # neighbouring leaves share a unit of work; a leaf beyond the size of a block has units of its own
    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    units = _units(sizes, s.block)
    chunks = parts_for(keys.count(), s.chunk)
    where = F.broadcast(table.sparkSession.createDataFrame(
        [(leaf, u[0], len(u)) for leaf, u in units.items()], "leaf long, first_unit int, parts int"
    ))
    laid = index.join(where, "leaf").select(
        (F.col("first_unit") + F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).alias("unit"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "leaf", "first", "v", "ids",
    )
    placing = table.sparkSession.sparkContext.broadcast((units, sizes))

    def walked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            at, unit_of, met = [], [], []
            for i, x in enumerate(unit(matrix(batch.column(1)))):
                by_unit: dict[int, list[int]] = {}
                unit_of_leaf, held = placing.value
                for leaf in shipped.value.visits(x, visits, held, most):
                    for u in unit_of_leaf.get(leaf, ()):
                        by_unit.setdefault(u, []).append(leaf)
                for u, leaves_met in by_unit.items():
                    at.append(i)
                    unit_of.append(u)
                    met.append(leaves_met)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit_of, pa.int32()), *[c.take(pa.array(at, pa.int64())) for c in batch.columns],
                 pa.array(met, pa.list_(pa.int64()))],
                ["unit", "q", "v", "met"],
            )

    sent = keys.mapInArrow(walked, f"unit int, q long, v {kind}, met array<long>").withColumn(
        "c", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")
    )

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        q, score, at = [], [], []
        if left.num_rows and right.num_rows:
            firsts, names = left.column("first").to_numpy(), right.column("q").to_numpy()
            here, of = np.unique(left.column("leaf").to_numpy(), return_inverse=True)
            met = right.column("met").combine_chunks()
            visited = np.zeros((len(names), len(here)), bool)
            flat = met.flatten().to_numpy()
            place = np.searchsorted(here, flat)
            known = here[np.minimum(place, len(here) - 1)] == flat  # a part of a leaf may be empty
            of_query = np.repeat(np.arange(len(names)), np.diff(met.offsets.to_numpy()))
            visited[of_query[known], place[known]] = True
            rows = matrix(left.column("v"))
            for i, found, cosines in best(matrix(right.column("v")), rows, firsts, most, (visited, of)):
                q.append(np.full(len(found), names[i]))
                score.append(cosines)
                at.append(found)
        where_found = pa.array(np.concatenate(at) if at else np.empty(0, np.int64))
        return pa.table({
            "q": pa.array(np.concatenate(q) if q else [], pa.int64()),
            "score": pa.array(np.concatenate(score) if score else [], pa.float64()),
            "first": left.column("first").combine_chunks().take(where_found),
            "ids": left.column("ids").combine_chunks().take(where_found),
        })

    found = (
        laid.groupBy("unit", "c").cogroup(sent.groupBy("unit", "c"))
        .applyInArrow(compared, "q long, score double, first long, ids array<long>")
    )
    lists = written(answers(found, most, "score", True), "answers")
    return ranked_answers(queries, lists, k, "score")


def _units(sizes: dict[int, int], block: int) -> dict[int, range]:
    """The units of work of each leaf: some leaves in a row together, or parts of a large one."""
    units, last, room = {}, -1, 0
    for leaf in sorted(sizes):
        parts = math.ceil(sizes[leaf] / block)
        if parts > 1:
            units[leaf] = range(last + 1, last + 1 + parts)
            last, room = last + parts, 0
        else:
            if sizes[leaf] > room:
                last, room = last + 1, block
            room -= sizes[leaf]
            units[leaf] = range(last, last + 1)
    return units


def _calibrated(index: DataFrame, keys: DataFrame, tree: Tree, k: int, s: Settings) -> int:
    """Leaves to visit so that a sample of queries meets ``recall`` of its true k nearest vectors."""
    trial = keys.orderBy(F.xxhash64("q"), "q").limit(s.trial).toArrow()
    if not trial.num_rows or tree.leaves == 1:
        return tree.leaves
    rows, names = matrix(trial.column("v")), trial.column("q").to_numpy()
    shipped = index.sparkSession.sparkContext.broadcast(rows)

    def true(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            leaf, key, first = (batch.column(c).to_numpy() for c in range(3))
            found = list(best(shipped.value, matrix(batch.column(3)), first, k + 1))
            at = np.concatenate([f for _, f, _ in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([i for i, _, _ in found], [len(f) for _, f, _ in found]), pa.int64()),
                 pa.array(np.concatenate([c for _, _, c in found])), pa.array(first[at]), pa.array(key[at]), pa.array(leaf[at])],
                ["q", "score", "first", "key", "leaf"],
            )

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))
    near = (
        index.select("leaf", "key", "first", "v").mapInArrow(true, "q long, score double, first long, key long, leaf long")
        .withColumn("n", rank).filter(F.col("n") <= k + 1).select("q", "key", "leaf").toArrow()
    )
    needed = []
    orders = [{leaf: i for i, leaf in enumerate(tree.visits(x, tree.leaves))} for x in unit(rows)]
    for q, key, leaf in zip(*(near.column(c).to_pylist() for c in ("q", "key", "leaf")), strict=True):
        if key != names[q]:
            needed.append(orders[q][leaf] + 1)
    if not needed:
        return tree.leaves
    needed.sort()
    return needed[min(len(needed), math.ceil(s.recall * len(needed))) - 1]
