"""Exact top-k search of binary codes (operator 4) by incremental multi-index hashing.

A vector's code has a bit for each component, set where it is not negative. A block of distinct codes is
indexed by each of m segments of the code. A query probes the segments' buckets at radius 0, then 1, and
so on: after segment s at radius r every code within m * r + s differing bits has been met, so once the
kth verified distance is no larger, the k nearest of the block are certain, ties included. Blocks are
searched independently and their answers merged; a query key is sent to every block.

Equal codes are one entry with the smallest ids, which is all that any query can be given of it.

Defined cases: vectors that are null, hold null or non-finite components or have another dimension than
most, and rows with a null id take no part; a zero vector has the code of all ones; nearest first, ties
to the smaller id; repeated rows with one id are answers of their own, but never to that id; fewer than k
candidates give all; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import parts_for, written
from tidebar.llm.vectors import answers, asked, matrix, own_classes, ranked_answers, usable, with_first_ids

#: Distinct codes of a block, about.
BLOCK = 8192
#: Query keys that meet a block in one task.
CHUNK = 262_144


def codes_of(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, code): up to 64 sign bits of each vector that takes part, the first component highest."""
    rows, width = usable(table, vec_id, embedding, zeros=True)
    if width > 64:
        raise ValueError("codes have at most 64 bits")

    def signs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            bits = np.zeros((batch.num_rows, 64), np.uint8)
            bits[:, :width] = matrix(batch.column(1)).reshape(batch.num_rows, width) >= 0
            code = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.view(np.int64))], ["id", "code"])

    return rows.mapInArrow(signs, "id long, code long")


class SegmentIndex:
    """Distinct codes by the values of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        width = max(4, min(16, math.ceil(math.log2(max(2, len(codes))))))
        edges = [*range(0, 64, width), 64]
        self._segments = []
        for lo, hi in zip(edges, edges[1:]):
            values = ((codes >> np.uint64(64 - hi)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << (hi - lo)) + 1))
            self._segments.append((64 - hi, hi - lo, order, starts))
        self._masks: dict[tuple[int, int], np.ndarray] = {}

    def _flips(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self._masks:
            self._masks[width, radius] = np.array(
                [sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64
            )
        return self._masks[width, radius]

    def nearest(self, code: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of all codes up to the kth smallest distance."""
        want, m = min(k, len(self.codes)), len(self._segments)
        distance = np.full(len(self.codes), 255, np.uint8)
        histogram = np.zeros(256, np.int64)
        one = np.uint64(code)
        for radius in range(17):
            for s, (shift, width, order, starts) in enumerate(self._segments):
                if radius <= width:
                    value = int(code) >> shift & ((1 << width) - 1)
                    probes = value ^ self._flips(width, radius)
                    lo, n = starts[probes], starts[probes + 1] - starts[probes]
                    some = n > 0
                    lo, n = lo[some], n[some]
                    at = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    at = at[distance[at] == 255]
                    distance[at] = np.bitwise_count(self.codes[at] ^ one)
                    histogram += np.bincount(distance[at], minlength=256)
                sure = m * radius + s
                if histogram[: sure + 1].sum() >= want:
                    kth = int(np.searchsorted(np.cumsum(histogram), want))
                    found = np.flatnonzero(distance <= kth)
                    return found, distance[found].astype(np.int64)
        raise AssertionError("all radii were tried")


def nearest_codes(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, every: int = 50,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest by differing bits of every query of the set."""
    rows = written(codes_of(table, vec_id, embedding), "codes")
    index = written(with_first_ids(rows, "code", k + 1), "distinct")
    most = k + own_classes(rows, "code", every)
    queries = asked(rows, every).select("id", F.col("code").alias("q"))
    keys = written(queries.select("q").distinct(), "keys")
    blocks = parts_for(index.count(), block)
    chunks = parts_for(keys.count(), CHUNK)
    place = F.pmod(F.xxhash64("code"), F.lit(blocks))
    laid = index.select(
        place.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "code", "ids"
    )
    sent = keys.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"),
        F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int").alias("c"), "q",
    )

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        codes = left.column("code").to_numpy().view(np.uint64)
        if len(codes) and right.num_rows:
            tree = SegmentIndex(codes)
            for q in right.column("q").to_numpy():
                at, distance = tree.nearest(int(np.uint64(q.view(np.uint64))), most)
                # of codes at the same distance those with the smallest first ids
                order = np.lexsort((firsts(left)[at], distance))[:most]
                found[0].append(np.full(len(order), q))
                found[1].append(at[order])
                found[2].append(distance[order])
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]
        ids = left.column("ids").combine_chunks().take(pa.array(flat[1]))
        return pa.table({
            "q": pa.array(flat[0], pa.int64()), "distance": pa.array(flat[2], pa.int64()),
            "first": pa.array(firsts(left)[flat[1]], pa.int64()), "ids": ids,
        })

    def firsts(left: pa.Table) -> np.ndarray:
        lists = left.column("ids").combine_chunks()
        if not len(lists):
            return np.empty(0, np.int64)
        return lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()]

    found = (
        laid.groupBy("b", "c").cogroup(sent.groupBy("b", "c"))
        .applyInArrow(searched, "q long, distance long, first long, ids array<long>")
    )
    lists = written(answers(found, most, "distance", False), "answers")
    return ranked_answers(queries, lists, k, "distance")
