"""SimHash near-duplicates (operator 3) by a self-join of a binary trie of fingerprints.

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it set. Two
fingerprints are linked at ``budget`` or fewer differing bits, and groups are what links connect.

The distinct fingerprints form a binary trie. Two nodes of it are traversed together, from the root
with itself downwards: a pair of children adds a differing bit where one goes left and the other right,
and is pruned beyond the budget. The trie is cut into subtrees of at most ``leaf`` fingerprints. Tasks
first traverse pairs of the upper nodes down to pairs of subtrees within the budget; such a pair of
blocks is then one unit of work, traversed in numpy. A unit returns a spanning forest of its links, so
a large ball of near copies costs rows in proportion to its size, not to its pairs.

What reaches the driver is the number of fingerprints under prefixes, ``16 * subtrees`` short rows at
most; there are never more than ``SUBTREES`` times a small factor, as ``leaf`` grows beyond that.

Defined cases: a null or empty text has the fingerprint zero, linked like any other; a text with fewer
words than a shingle is one shingle; texts of any length count whole, repeats included; equal
fingerprints are one group; rows with a null id take part and get their group's smallest id, null if it
has none; repeated rows come back as often as they came; an empty table gives an empty table; input
columns are carried along and one with the name of an output column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.common import packed, unpacked, written

SEED = 42
LEAF = 16_384
SUBTREES = 16_384
#: Node pairs held at once while two blocks are traversed.
FRONTIER = 200_000


# -- fingerprints ---------------------------------------------------------------------------------

def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, A-Z in lower case, single spaces between words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = [n + i for i, n in enumerate(accumulate(map(len, words)))]
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        some = hashes[lo : lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(
    docs: DataFrame, text: str = "text", out: str = "fingerprint", size: int = 3, keep: list[str] | None = None
) -> DataFrame:
    """Add ``out``: the 64 bits as a long. ``keep`` names the columns to carry along (default: all)."""
    kept = docs.columns if keep is None else keep
    packs = docs.select(packed(docs.select(*kept)), F.col(text).cast("binary").alias("t"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["row", "f"])

    schema = T.StructType([packs.schema["row"], T.StructField("f", T.LongType())])
    return unpacked(packs.mapInArrow(run, schema), kept, **{out: F.col("f")})


@dataclass(frozen=True)
class Budget:
    """Most differing bits: ``steps`` are (leading bits, most among them), by growing number of bits."""

    steps: tuple[tuple[int, int], ...] = ((64, 3),)

    def after(self, level: int) -> int:
        """What may differ among the first ``level`` bits."""
        return next(most for bits, most in self.steps if level <= bits)

    def holds(self, differing: np.ndarray) -> np.ndarray:
        ok = np.ones(len(differing), bool)
        for bits, most in self.steps:
            ok &= np.bitwise_count(differing >> np.uint64(64 - bits)) <= most
        return ok


# -- subtrees -------------------------------------------------------------------------------------

def subtrees(codes: DataFrame, leaf: int) -> list[tuple[int, int, int]]:
    """(t, prefix, depth) of the shallowest nodes of each trie t with at most ``leaf`` fingerprints."""
    spark, sizes = codes.sparkSession, {}
    for r in codes.groupBy("t").agg(F.count("*").alias("n")).collect():
        sizes[r["t"]] = r["n"]
    total = max(sizes.values(), default=0)
    leaf = max(leaf, total // SUBTREES)
    found: list[tuple[int, int, int]] = []
    hot = {(t, 0) for t in sizes}  # nodes that are still open, all at depth ``base``
    base, depth = 0, min(64, max(0, math.ceil(math.log2(max(1, total / leaf)))) + (3 if total > leaf else 0))
    while hot:
        counts = codes.select("t", (F.shiftrightunsigned("code", 64 - depth) if depth else F.lit(0)).alias("p"))
        if base:
            rows = [(t, p - 2**64 if p >= 2**63 else p) for t, p in hot]
            open_nodes = F.broadcast(spark.createDataFrame(rows, "t int, q long"))
            counts = counts.withColumn("q", F.shiftrightunsigned("p", depth - base)).join(open_nodes, ["t", "q"])
        below = {
            (r["t"], r["p"] & (2**64 - 1)): r["n"]
            for r in counts.groupBy("t", "p").agg(F.count("*").alias("n")).collect()
        }
        nodes = {depth: below}
        for d in range(depth, base, -1):  # sums upwards
            up: dict[tuple[int, int], int] = {}
            for (t, p), n in nodes[d].items():
                up[t, p >> 1] = up.get((t, p >> 1), 0) + n
            nodes[d - 1] = up
        for d in range(base, depth + 1):  # the shallowest that are small enough
            found += [(*x, d) for x in hot if nodes[d][x] <= leaf or d == 64]
            hot = {x for x in hot if nodes[d][x] > leaf and d < 64}
            if d < depth:
                hot = {y for t, p in hot for y in ((t, 2 * p), (t, 2 * p + 1)) if y in nodes[d + 1]}
        base, depth = depth, min(64, depth + 4)
    return sorted(found, key=lambda x: (x[0], x[1] << (64 - x[2])))


def partner_subtrees(
    first: int, prefixes: list[int], depths: list[int], budget: Budget, end: int
) -> list[int]:
    """Subtrees from ``first`` to ``end`` that differ from it in few enough of the bits both know."""
    own, depth = prefixes[first], depths[first]
    out = []

    def descend(lo: int, hi: int, level: int, differing: int) -> None:
        if differing > budget.after(level) or hi <= first or lo >= hi:
            return
        if hi - lo == 1 and depths[lo] <= level or level >= depth:
            out.extend(range(max(lo, first), hi))
            return
        # subtrees lo..hi share ``level`` bits: those with the next bit set come last
        a, b = lo, hi
        while a < b:
            mid = (a + b) // 2
            if (prefixes[mid] << (64 - depths[mid])) >> (63 - level) & 1:
                b = mid
            else:
                a = mid + 1
        bit = (own << (64 - depth)) >> (63 - level) & 1
        descend(lo, a, level + 1, differing + (bit != 0))
        descend(a, hi, level + 1, differing + (bit != 1))

    descend(first, end, 0, 0)
    return out


# -- the traversal of two blocks ------------------------------------------------------------------

class Block:
    """Sorted distinct fingerprints; a trie node is the range of those below it."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes)
        self._ones: dict[int, np.ndarray] = {}

    def split(self, start: np.ndarray, end: np.ndarray, level: int) -> np.ndarray:
        """Where the right child begins, for nodes that share ``level`` bits."""
        if level not in self._ones:
            bit = (self.codes >> np.uint64(63 - level)) & np.uint64(1)
            self._ones[level] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]).astype(np.int32)
        ones = self._ones[level]
        return end - (ones[end] - ones[start])


def near(a: Block, b: Block, budget: Budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the budget; of a block with itself, each pair once."""
    same = a is b
    whole = [np.array([x], np.int32) for x in (0, len(a.codes), 0, len(b.codes), 0)]
    stack = [(0, *whole)] if len(a.codes) and len(b.codes) else []
    while stack:
        level, s, e, t, f, d = stack.pop()
        if len(s) > FRONTIER:
            half = len(s) // 2
            stack += [(level, *(x[:half] for x in (s, e, t, f, d))), (level, *(x[half:] for x in (s, e, t, f, d)))]
            continue
        few = (e - s).astype(np.int64) * (f - t) <= 8
        if level == 64 or few.all():
            few[:] = True
        if few.any():
            yield from _verified(a, b, s[few], e[few], t[few], f[few], budget, same)
            s, e, t, f, d = (x[~few] for x in (s, e, t, f, d))
        if not len(s):
            continue
        m, g = a.split(s, e, level), b.split(t, f, level)
        mirror = (s == t) & (e == f) if same else np.zeros(len(s), bool)
        nexts = [(s, m, t, g, d), (m, e, g, f, d), (s, m, g, f, d + 1), (m, e, t, g, d + 1)]
        kept, most = [], budget.after(level + 1)
        for i, (s2, e2, t2, f2, d2) in enumerate(nexts):
            ok = (s2 < e2) & (t2 < f2) & (d2 <= most)
            if i == 3:
                ok &= ~mirror
            kept.append([x[ok] for x in (s2, e2, t2, f2, d2)])
        stack.append((level + 1, *(np.concatenate(x) for x in zip(*kept))))


def _verified(a, b, s, e, t, f, budget, same):
    wide, high = (e - s).astype(np.int64), (f - t).astype(np.int64)
    sizes = wide * high
    for lo, hi in _runs(sizes, 4 * FRONTIER):
        n = sizes[lo:hi]
        at = np.repeat(np.arange(lo, hi), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        i, j = s[at] + within // high[at], t[at] + within % high[at]
        ok = budget.holds(a.codes[i] ^ b.codes[j])
        if same:
            ok &= i < j
        if ok.any():
            yield i[ok], j[ok]


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


class Forest:
    """Connected positions; each knows the smallest position it is connected to so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def block_links(a: np.ndarray, b: np.ndarray | None, budget: Budget) -> tuple[np.ndarray, np.ndarray]:
    """Links whose components are those of all pairs within ``a`` (``b`` None) or between ``a`` and ``b``.

    At most one a fingerprint: to the smallest it is connected to.
    """
    left = Block(a)
    right = left if b is None else Block(b)
    codes = left.codes if b is None else np.concatenate([left.codes, right.codes])
    offset = 0 if b is None else len(left.codes)
    forest = Forest(len(codes))
    for i, j in near(left, right, budget):
        forest.join(i, j + offset)
    moved = np.flatnonzero(forest.root != np.arange(len(codes)))
    return codes[moved], codes[forest.root[moved]]


# -- the join -------------------------------------------------------------------------------------

def links(codes: DataFrame, budget: Budget, leaf: int = LEAF, linked: Callable = block_links) -> DataFrame:
    """``codes`` (t, code; distinct): links t, a, b within each trie t, see ``block_links``."""
    spark = codes.sparkSession
    tree = subtrees(codes, leaf)
    prefixes, depths = [p for _, p, _ in tree], [d for _, _, d in tree]
    first, last = {}, {}
    for i, (t, _, _) in enumerate(tree):
        first.setdefault(t, i)
        last[t] = i + 1
    starts = {t: np.array([p << (64 - d) for _, p, d in tree[first[t] : last[t]]], np.uint64) for t in first}
    ends = [last[t] for t, _, _ in tree]
    shipped = spark.sparkContext.broadcast((prefixes, depths, ends, starts, first))

    def placed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, starts, first = shipped.value
        for batch in source:
            t, code = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.empty(len(t), np.int64)
            for one in np.unique(t).tolist():
                rows = t == one
                at[rows] = first[one] + np.searchsorted(starts[one], code[rows].view(np.uint64), side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), batch.column(1)], ["t", "block", "code"])

    blocks = written(
        codes.select(F.col("t").cast("int").alias("t"), "code").mapInArrow(placed, "t int, block long, code long")
        .groupBy("block").agg(F.max("t").alias("t"), F.collect_list("code").alias("codes")),  # ``leaf`` at most
        "blocks",
    )

    def partners(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, depths, ends, _, _ = shipped.value
        for batch in source:
            for one in batch.column(0).to_pylist():
                others = partner_subtrees(one, prefixes, depths, budget, ends[one])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one] * len(others), pa.int64()), pa.array(others, pa.int64())], ["a", "b"]
                )

    pairs = spark.range(len(tree)).mapInArrow(partners, "a long, b long")
    work = (
        pairs.join(blocks.select(F.col("block").alias("a"), F.col("codes").alias("left")), "a")
        .repartition(max(24, min(4000, len(tree) * 4)), "b", "a")
        .join(blocks.select(F.col("block").alias("b"), "t", F.col("codes").alias("right")), "b")
        .select("a", "b", "left", "right", "t")
    )

    def compared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k in range(batch.num_rows):
                one, two = (
                    batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (2, 3)
                )
                inside = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                u, v = linked(one, None if inside else two, budget)
                t = pa.array(np.full(len(u), batch.column(4)[k].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [t, pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["t", "a", "b"]
                )

    return work.mapInArrow(compared, "t int, a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each linked node with the smallest node it is connected to.

    Alternating large stars and small stars; every round is written to the shared folder, and the
    rounds end when one changes nothing. The joins are merges also where a side is small: a broadcast of each
    round would stay in the driver's memory until its next full collection.
    """
    pairs = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        "links",
    )
    print_of = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    while True:
        state = pairs.agg(F.count("*"), print_of).first()
        if state == before or state[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.hint("merge"), "u")
        small = (
            joined.select(F.col("u"), F.col("m").alias("v"))
            .unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        pairs = written(small, "links")


def groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, budget: int = 3, leaf: int = LEAF,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``fingerprint`` (long) and ``component_id``, the smallest id that links reach."""
    kept = docs.columns if keep is None else keep
    marked = written(with_fingerprint(docs, text, "__code", size, keep=kept), "fingerprints")
    return grouped(marked, doc_id, kept, budget, leaf)


def grouped(marked: DataFrame, doc_id: str, kept: list[str], budget: int, leaf: int) -> DataFrame:
    codes = written(
        marked.groupBy(F.col("__code").alias("code")).agg(F.min(doc_id).alias("least")), "codes"
    )
    found = components(links(codes.select(F.lit(0).alias("t"), "code"), Budget(((64, budget),)), leaf))
    roots = codes.join(found, codes.code == found.node, "left").select(
        "code", "least", F.coalesce("root", "code").alias("root")
    )
    smallest = roots.groupBy("root").agg(F.min("least").alias("component"))
    named = written(roots.join(smallest, "root").select("code", "component"), "components")
    packs = marked.select(packed(marked), F.col("__code").alias("code"))
    return unpacked(
        packs.join(named, "code", "left"), kept,
        fingerprint=F.col("code"), component_id=F.col("component"),
    )
