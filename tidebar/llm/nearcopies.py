"""Near copies of documents: the SimHash trie picks near pairs, an exact join of shingles completes them.

Two texts are near copies where their sets of five-word shingles have a Jaccard similarity of 0.8 or more;
groups are what such links connect, and one document of each group stays. No link is missed, but for
collisions of 64-bit hashes:

1. Texts with equal sets are one class. Each class has a fingerprint of its set.
2. The trie self-join of operator 3 runs over the fingerprints and over their swapped halves, so that every
   pair of fingerprints with seven or fewer differing bits is met in one of them. Its spanning edges are
   compared as sets; those that hold connect most near copies in proportion to their number.
3. Sets ordered in one way share a shingle of their prefixes where they are similar enough. Shingles are
   ordered by how often they occur in all texts (rarest first, counted in a table of fixed size), so that a
   bucket of one prefix shingle seldom holds other texts than near copies. One exchange brings the buckets
   together; a bucket of one class, or of classes that are connected already, is left.
4. What is still apart, and may be similar by the places of the shared shingle, is compared as sets. Buckets with the same smallest member are one unit of work, so a
   set travels to few units; a large unit is cut into pieces that meet in pairs. In a unit a pair is skipped
   where its places bound the similarity below 0.8 or its ends have been connected meanwhile, so a group of
   n copies costs about n comparisons.

The order of shingles and the trie have no influence on the groups, only on the work.

Defined cases: texts are compared whole; a text of fewer words than a shingle is one shingle; texts without
words, null texts among them, are one class, so one of them stays; of a group the row with the smallest id
stays, one with a null id only where no other has an id; of rows with that same id one stays; repeated rows
are copies; an empty table gives an empty table; all columns are carried along, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidebar.llm.common import BROADCAST_IDS, packed, small, tidy, unpacked, written
from tidebar.llm.simhash import LEAF as TRIE_LEAF
from tidebar.llm.simhash import Block, Budget, Forest, components, links, near, shingle_hashes

#: Of two fingerprints with seven differing bits one half has three at most.
NEAR = Budget(((32, 3), (64, 7)))
#: Members of a piece of a unit of work, and shingles of a piece.
PIECE, PIECE_SHINGLES = 512, 2_000_000
#: Bits of the place of a shingle in the table of counts: by the number of texts, within these bounds.
COUNT_BITS = (22, 24)
#: Counts of a task that are told apart, and counters in a row of them.
LEVELS, COUNTERS = (1, 2, 4, 16), 1 << 15
#: Shingles that a task counts at once, and candidate pairs that a unit holds at once.
COUNTED, PAIRS = 500_000, 100_000


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it set."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[lo : lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


# -- near pairs by the trie -------------------------------------------------------------------------

def spanning_pairs(a: np.ndarray, b: np.ndarray | None, budget: Budget) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the budget that connect all that such pairs connect, within ``a`` or between ``a`` and ``b``."""
    left = Block(a)
    right = left if b is None else Block(b)
    codes = left.codes if b is None else np.concatenate([left.codes, right.codes])
    offset = 0 if b is None else len(left.codes)
    forest, found = Forest(len(codes)), [np.empty((2, 0), np.int64)]
    for i, j in near(left, right, budget):
        i, j = i.astype(np.int64), j.astype(np.int64) + offset
        while True:
            one, two = forest.root[i], forest.root[j]
            apart = one != two
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            _, first = np.unique(np.maximum(one[apart], two[apart]), return_index=True)  # each root is joined once
            found.append(np.stack([i[first], j[first]]))
            forest.join(i[first], j[first])
    i, j = np.concatenate(found, axis=1)
    return codes[i], codes[j]


def _swapped(code: str) -> F.Column:
    return F.shiftleft(code, 32).bitwiseOR(F.shiftrightunsigned(code, 32))


def near_edges(classes: DataFrame, leaf: int = TRIE_LEAF) -> DataFrame:
    """(a, b): classes (class, code) with equal fingerprints, or with near ones as the trie's spanning edges."""
    known = written(classes.groupBy("code").agg(F.min("class").alias("first")), "codes")
    both = known.select(F.lit(0).alias("t"), "code").unionByName(known.select(F.lit(1).alias("t"), _swapped("code").alias("code")))
    found = links(written(both, "halves"), NEAR, leaf, spanning_pairs).select(
        *[F.when(F.col("t") == 0, F.col(c)).otherwise(_swapped(c)).alias(c) for c in ("a", "b")]
    )
    for c in ("a", "b"):
        named = known.select(F.col("code").alias(c), F.col("first").alias(f"{c}_class"))
        found = found.join(named, c).drop(c).withColumnRenamed(f"{c}_class", c)
    equal = classes.join(known, "code").filter("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"))
    return found.select("a", "b").unionByName(equal)


# -- the order of shingles --------------------------------------------------------------------------

def count_levels(texts: DataFrame, size: int, bits: int) -> np.ndarray:
    """How often shingles occur in ``texts`` (rid, t): a number from 0 to 255 for each place in a table of 2^bits."""

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.uint16)
        held: list[np.ndarray] = []
        room = COUNTED

        def add() -> None:
            nonlocal room
            if held:
                at, times = np.unique(np.concatenate(held), return_counts=True)
                n[at] = np.minimum(n[at] + times, LEVELS[-1])
            held.clear()
            room = COUNTED

        for batch in source:
            for t in batch.column(1).to_pylist():
                held.append((shingle_set(t, size) >> np.uint64(64 - bits)).astype(np.int64))
                room -= len(held[-1])
                if room < 0:
                    add()
        add()
        for lo in range(0, len(n), COUNTERS):
            some = n[lo : lo + COUNTERS]
            if some.any():
                planes = [np.packbits(some >= level).tobytes() for level in LEVELS]
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), *[pa.array([p]) for p in planes]], names)

    def summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by ``lo``; levels add up to about the count within a task."""
        at, total = None, None
        steps = np.diff(LEVELS, prepend=0)
        for batch in source:
            for k in range(batch.num_rows):
                lo = batch.column(0)[k].as_py()
                if lo != at:
                    if at is not None:
                        yield done(at, total)
                    at, total = lo, np.zeros(COUNTERS, np.int64)
                for c, step in enumerate(steps):
                    total += step * np.unpackbits(np.frombuffer(batch.column(c + 1)[k].as_buffer(), np.uint8))
        if at is not None:
            yield done(at, total)

    def done(at: int, total: np.ndarray) -> pa.RecordBatch:
        level = np.minimum(255, np.floor(8 * np.log2(1 + total))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level.tobytes()])], ["lo", "level"])

    names = ["lo", *[f"p{level}" for level in LEVELS]]
    rows = (
        texts.mapInArrow(tidy(counted), "lo int, " + ", ".join(f"{n} binary" for n in names[1:]))
        .repartition("lo").sortWithinPartitions("lo").mapInArrow(tidy(summed), "lo int, level binary")
    )
    out = np.zeros(1 << bits, np.uint8)
    for row in rows.toArrow().to_pylist():  # 2^bits bytes
        out[row["lo"] : row["lo"] + COUNTERS] = np.frombuffer(row["level"], np.uint8)
    return out


def prefix(hashes: np.ndarray, level: np.ndarray, bits: int, similarity: float) -> np.ndarray:
    """The first of the sorted ``hashes``, rarest first, that a set as similar must share one of."""
    n = len(hashes)
    if not n:
        return hashes
    order = np.argsort(level[(hashes >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
    return hashes[order[: n - math.ceil(similarity * n - 1e-9) + 1]]


def shared_entries(texts: DataFrame, n_texts: int, size: int, similarity: float) -> DataFrame:
    """(token, rid, pos, n, unit): prefix shingles that several classes have, with their smallest class as unit."""
    bits = min(COUNT_BITS[1], max(COUNT_BITS[0], math.ceil(math.log2(16 * max(1, n_texts)))))
    shipped = texts.sparkSession.sparkContext.broadcast(count_levels(texts, size, bits))

    def indexed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kept, sizes = [], []
            for t in batch.column(1).to_pylist():
                hashes = shingle_set(t, size)
                kept.append(prefix(hashes, shipped.value, bits, similarity))
                sizes.append(len(hashes))
            lengths = [len(x) for x in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.uint64), *kept]).view(np.int64)),
                 pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lengths)),
                 pa.array(np.concatenate([np.empty(0, np.int32), *[np.arange(x, dtype=np.int32) for x in lengths]])),
                 pa.array(np.repeat(np.array(sizes, np.int32), lengths))],
                ["token", "rid", "pos", "n"],
            )

    bucket = Window.partitionBy("token")
    return written(
        texts.mapInArrow(tidy(indexed), "token long, rid long, pos int, n int")
        .withColumn("m", F.count("*").over(bucket)).withColumn("unit", F.min("rid").over(bucket))
        .filter("m > 1").drop("m"),
        "entries",
    )


# -- comparing sets ---------------------------------------------------------------------------------

class Unit:
    """Members with their sets; what is connected, and which pairs were compared in vain."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray, similarity: float):
        self._sets, self._similarity = sets, similarity
        _, self._label = np.unique(label, return_inverse=True)
        self._forest = Forest(len(sets))
        self._refuted = np.empty(0, np.int64)
        self.links: list[tuple[int, int]] = []

    def roots(self, members: np.ndarray) -> np.ndarray:
        return self._forest.root[self._label[members]]

    def _similar(self, i: int, j: int) -> bool:
        one, two = self._sets[i], self._sets[j]
        shared = len(np.intersect1d(one, two, assume_unique=True))
        return shared >= self._similarity * (len(one) + len(two) - shared)

    def connect(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare pairs until each is refuted or connected: of any two groups first one pair, then more."""
        n = len(self._sets)
        pairs = np.setdiff1d(np.minimum(i, j) * n + np.maximum(i, j), self._refuted)
        refuted, take = [], 1
        while True:
            i, j = pairs // n, pairs % n
            one, two = self.roots(i), self.roots(j)
            apart = one != two
            if not apart.any():
                break
            pairs = pairs[apart]
            groups = (np.minimum(one, two) * n + np.maximum(one, two))[apart]
            order = np.argsort(groups, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(groups[order]) != 0]))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            tried = order[place < take]
            for key in pairs[tried].tolist():
                x, y = divmod(key, n)
                if self._forest.root[self._label[x]] == self._forest.root[self._label[y]]:
                    continue
                if self._similar(x, y):
                    self.links.append((x, y))
                    self._forest.join(self._label[[x]], self._label[[y]])
                else:
                    refuted.append(key)
            pairs = np.delete(pairs, tried)
            take *= 2
        self._refuted = np.union1d(self._refuted, np.array(refuted, np.int64))


def possible(pos_a, n_a, pos_b, n_b, similarity: float) -> np.ndarray:
    """Whether sets that share a shingle at these places, and none before, may be similar enough."""
    shared = np.ceil((n_a + n_b) * (similarity / (1 + similarity)) - 1e-6)
    return np.minimum(n_a - pos_a, n_b - pos_b) >= shared


def _bucket_pairs(entries: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rid, i, j) for each bucket of a unit: its members, and the pairs of them that may be similar.

    Only pairs with two labels; of two pieces, only pairs between them.
    """
    token, rid, pos, n, label, c = (entries.column(x).to_numpy() for x in ("token", "rid", "pos", "n", "label", "c"))
    within = entries.num_rows and entries.column("x")[0] == entries.column("y")[0]
    by = np.argsort(token, kind="stable")
    rid, pos, n, label, c = rid[by], pos[by].astype(np.int64), n[by].astype(np.int64), label[by], c[by]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(token[by]) != 0])) if len(by) else np.empty(0, np.int64)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(by)]):
        if (label[lo:hi] == label[lo]).all():
            continue
        if within:
            i, j = np.triu_indices(hi - lo, 1)
        else:
            first = c[lo:hi] == c[lo:hi].min()
            i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(first), np.flatnonzero(~first)))
        x, y = i + lo, j + lo
        ok = (label[x] != label[y]) & possible(pos[x], n[x], pos[y], n[y], similarity)
        if ok.any():
            yield rid[lo:hi], i[ok], j[ok]


def _unit_members(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """The members of a unit that have a pair to compare, once each."""

    def run(entries: pa.Table) -> pa.Table:
        found = [rid[np.unique(np.concatenate([i, j]))] for rid, i, j in _bucket_pairs(entries, similarity)]
        rids = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
        return pa.table({k: pa.array([entries.column(k)[0].as_py()] * len(rids), entries.schema.field(k).type) for k in ("unit", "x", "y")}
                        | {"rid": pa.array(rids, pa.int64())})

    return run


def _unit_links(similarity: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(entries: pa.Table, members: pa.Table) -> pa.Table:
        rid = members.column("rid").to_numpy()
        order = np.argsort(rid)
        rid = rid[order]
        lists = members.column("set").combine_chunks()
        sets = [lists[int(k)].values.to_numpy(zero_copy_only=False) for k in order]
        at, label = entries.column("rid").to_numpy(), entries.column("label").to_numpy()
        known = np.isin(at, rid)
        labels = np.zeros(len(rid), np.int64)
        labels[np.searchsorted(rid, at[known])] = label[known]
        unit = Unit(sets, labels, similarity)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        room = PAIRS
        for own, i, j in _bucket_pairs(entries, similarity):
            i, j = np.searchsorted(rid, own[i]), np.searchsorted(rid, own[j])
            apart = unit.roots(i) != unit.roots(j)
            held.append((i[apart], j[apart]))
            room -= int(apart.sum())
            if room < 0:
                unit.connect(*(np.concatenate(x) for x in zip(*held)))
                held, room = [], PAIRS
        if held:
            unit.connect(*(np.concatenate(x) for x in zip(*held)))
        found = np.array(unit.links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(rid[found[:, 0]], pa.int64()), "b": pa.array(rid[found[:, 1]], pa.int64())})

    return run


def similar_pairs(buckets: DataFrame, texts: DataFrame, size: int, similarity: float, piece: int = PIECE) -> DataFrame:
    """Pairs a, b of similar sets that connect what pairs of a bucket connect.

    ``buckets``: (unit, token, rid, pos, n, label); members with one label are connected already.
    """
    members = buckets.select("unit", "rid", "n").distinct().groupBy("unit").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    cuts = written(
        members.select("unit", F.greatest(F.ceil(F.col("k") / piece), F.ceil(F.col("w") / PIECE_SHINGLES)).cast("int").alias("pieces")),
        "units",
    )
    laid = written(
        buckets.join(small(cuts), "unit")
        .withColumn("c", F.pmod(F.xxhash64("rid"), F.col("pieces")).cast("int"))
        .withColumn("d", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("unit", F.least("c", "d").alias("x"), F.greatest("c", "d").alias("y"), "token", "rid", "pos", "n", "label", "c"),
        "laid",
    )
    keys = ["unit", "x", "y"]
    wanted = written(
        laid.groupBy(*keys).applyInArrow(_unit_members(similarity), "unit long, x int, y int, rid long"), "wanted"
    )

    def shingled(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingle_set(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rid", "set"])

    ends = written(wanted.select("rid").distinct(), "ends")
    sets = texts.join(small(ends, BROADCAST_IDS), "rid", "left_semi").mapInArrow(tidy(shingled), "rid long, set array<long>")
    left = laid.join(wanted, [*keys, "rid"], "left_semi")
    return written(
        left.groupBy(*keys).cogroup(wanted.join(sets, "rid").groupBy(*keys)).applyInArrow(_unit_links(similarity), "a long, b long"),
        "similar",
    )


# -- the operator -----------------------------------------------------------------------------------

def without_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8,
    piece: int = PIECE, leaf: int = TRIE_LEAF,
) -> DataFrame:
    """The rows that stay: of each group the one with the smallest id; see the module's text."""
    packs = docs.select(
        packed(docs), F.col(text).cast("binary").alias("t"), F.col(doc_id).alias("id"),
        F.monotonically_increasing_id().alias("rid"),
    )

    def digested(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            digest = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            codes = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                 pa.array(codes), pa.array([len(s) for s in sets], pa.int32())],
                ["row", "id", "rid", "d0", "d1", "code", "n"],
            )

    schema = T.StructType([packs.schema["row"], packs.schema["id"]] + [T.StructField(c, T.LongType()) for c in ("rid", "d0", "d1", "code")])
    rows = written(packs.mapInArrow(tidy(digested), schema.add("n", T.IntegerType())), "digested")
    classes = written(
        rows.groupBy("d0", "d1").agg(
            F.min("rid").alias("class"), F.min("id").alias("best"),
            F.coalesce(F.min_by("rid", "id"), F.min("rid")).alias("stays"),
            F.first("code").alias("code"), F.first("n").alias("n"),
        ),
        "classes",
    )
    texts = rows.select("rid", F.col("row").getField(text).cast("binary").alias("t"))
    # of the rows of a class one is read on; the others are few or are many short longs
    extra = written(rows.select("rid").join(classes.select(F.col("class").alias("rid")), "rid", "left_anti"), "extra")
    single = texts.join(small(extra, BROADCAST_IDS), "rid", "left_anti")

    edges = written(near_edges(classes.filter("n > 0"), leaf), "edges")
    sizes = classes.select(F.col("class").alias("rid"), "n")
    units = components(edges)
    near_buckets = (
        edges.withColumn("token", F.xxhash64("a", "b")).select("token", F.explode(F.array("a", "b")).alias("rid"))
        .join(units.select(F.col("node").alias("rid"), F.col("root").alias("unit")), "rid", "left").join(sizes, "rid")
        .select(F.coalesce("unit", "rid").alias("unit"), "token", "rid", F.lit(0).alias("pos"), "n", F.col("rid").alias("label"))
    )
    first = similar_pairs(written(near_buckets, "near"), texts, size, similarity, piece)

    entries = shared_entries(single, classes.count(), size, similarity)
    known = components(first)
    labelled = entries.join(known, entries.rid == known.node, "left").select(
        *[entries[c] for c in ("unit", "token", "rid", "pos", "n")], F.coalesce("root", "rid").alias("label")
    )
    labelled = written(labelled, "labelled")
    open_ = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    second = similar_pairs(written(labelled.join(open_, "token"), "open"), texts, size, similarity, piece)

    found = components(first.unionByName(second))
    groups_ = classes.join(found, F.col("class") == F.col("node"), "left").select(
        F.coalesce("root", "class").alias("root"), "best", "stays"
    )
    staying = groups_.groupBy("root").agg(F.coalesce(F.min_by("stays", "best"), F.min("stays")).alias("rid"))
    # the rows that go are few: as single longs they can meet the texts where these lie
    going = written(rows.select("rid").join(staying.select("rid"), "rid", "left_anti"), "going")
    return unpacked(rows.join(small(going, BROADCAST_IDS), "rid", "left_anti"), docs.columns)
