"""Mixing sources to target weights (operator 2), in DataFrame operations only.

Targets: sources share the words of the whole corpus by weight; a target stops at ``epochs`` times its
source's words, and the excess is shared again by weight until no target is above.

Schedule: slot i of the mix has the golden-ratio point frac(i * phi); points map through the cumulative
shares of the targets to a source, which spreads every source evenly over the whole schedule. The slots
of a source are ranked, and slot number k takes block number k of its source: the source's documents in
a shuffled order, laid end to end, cut into blocks of equal words, and started over where they end.
Point counts differ from a source's quota of blocks by a few slots: surplus slots are left out, missing
ones are put at the end of the schedule, and the last block of a source is cut short at its target.

All ranks and running sums work in two levels (bucket sums, then within a bucket), so that a source with
a third of all rows is spread over many tasks; the order within a source is a hash, so buckets are even.

Defined cases: a null or empty text has no words, nothing is taken of it; a null source is a source of
its own, last in order; null ids take part; rows that are repeated are documents of their own; without
any words every target is 0; an empty table gives an empty table; input columns are carried along, and
one with the name of an output column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.llm.common import BROADCAST_ROWS, ordered_scan, packed, parts_for, small, unpacked, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK = 256
PHI = (math.sqrt(5) - 1) / 2
#: frac(2^24 * phi): the points of large numbers, free of rounding
PHI_HIGH = (2**24 * 0x9E3779B97F4A7C15 % 2**64) / 2**64
#: Rows of a (source, bucket) group, about, where a source is small; it grows with the root of the rows.
BUCKET_ROWS = 16


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def golden_point(i: Column) -> Column:
    high, low = F.floor(i / 2**24), i % 2**24
    x = high * F.lit(PHI_HIGH) + low * F.lit(PHI)
    return x - F.floor(x)


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, size) with weights that repeat in the order of names, null last."""
    ranked = ordered_scan(sources, [F.col("source").isNull(), F.col("source")], name="sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.withColumn("weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """Add ``target`` to (source, size, weight).

    A source is full where epochs * size / weight is below the level that the rest shares. In the order
    of that ratio the full ones come first, and running sums give every candidate's level.
    """
    rows = sources.withColumn("cap", F.col("size") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = rows.agg(F.sum("size").alias("all"), F.sum("weight").alias("weights")).first()
    if not total["all"]:
        return sources.withColumn("target", F.lit(0.0))
    scanned = written(
        ordered_scan(rows, [F.col("ratio"), F.col("source").isNull(), F.col("source")], ["cap", "weight"], "levels"),
        "levels",
    )
    level = (F.lit(float(total["all"])) - F.col("before_cap")) / (F.lit(float(total["weights"])) - F.col("before_weight"))
    # the first source that is not filled by the level of itself and all after it fixes the level
    fixed = scanned.filter(F.col("ratio") >= level).agg(F.min_by(level, "position")).first()[0]
    share = F.col("weight") * F.lit(fixed) if fixed is not None else F.col("cap")
    return scanned.select("source", "size", "weight", F.least(F.col("cap"), share).alias("target"))


def schedule(shares: DataFrame, block: int) -> DataFrame:
    """(slot, s, k): slot ``slot`` of the mix takes block ``k`` of source number ``s``.

    ``shares``: (s, target, blocks, low, high), written; low..high is a source's part of 0..1.
    """
    spark = shares.sparkSession
    sums = shares.agg(F.sum("blocks"), F.count("*")).first()
    slots, n = int(sums[0] or 0), int(sums[1])
    # a grid over 0..1: a point meets the few sources whose part touches its cell
    cells = 1 << max(10, math.ceil(math.log2(max(1, n))) + 2)
    grid = shares.filter("high > low").select(
        "s", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell"),
    )
    points = spark.range(0, slots, 1, parts_for(slots, 200_000, 8)).select(
        F.col("id").alias("slot"), golden_point(F.col("id")).alias("x")
    )
    cell = F.floor(F.col("x") * cells).alias("cell")
    hint = F.broadcast if n * 2 + cells <= BROADCAST_ROWS else lambda df: df
    placed = (
        points.select("slot", "x", cell).join(hint(grid), "cell").filter("low <= x AND x < high")
        .select("slot", "s")
    )
    width = max(256, math.isqrt(max(1, slots)))
    placed = written(placed.withColumn("chunk", F.floor(F.col("slot") / width)), "slots")
    counts = placed.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("s", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("s", "chunk").orderBy("slot")
    ranked = placed.join(before, ["s", "chunk"]).select(
        "slot", "s", (F.col("before") + F.row_number().over(inside) - 1).alias("k")
    )
    quota = shares.select("s", "blocks")
    planned = ranked.join(small(quota), "s").filter("k < blocks").select("slot", "s", "k")
    had = placed.groupBy("s").agg(F.count("*").alias("had"))
    missing = shares.join(had, "s", "left").select(
        "s", F.explode(F.expr("filter(sequence(coalesce(had, 0L), greatest(blocks, coalesce(had, 0L))), k -> k < blocks)")).alias("k")
    ).select((F.lit(slots) + F.col("k")).alias("slot"), "s", "k")
    return planned.unionByName(missing)


def positions(docs: DataFrame) -> DataFrame:
    """``docs`` (s, size, h, rid and more): add ``start``, the words before a document in its source's order.

    Two levels: about the root of a source's rows go to a bucket, by ranges of the hash.
    """
    counts = docs.groupBy("s").agg(F.count("*").alias("n")).withColumn(
        "buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / F.greatest(F.lit(BUCKET_ROWS), F.sqrt("n") / 4))).cast("long")
    )
    spread = written(
        docs.join(small(written(counts.select("s", "buckets"), "buckets")), "s")
        .withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("buckets"))),
        "spread",
    )
    sums = spread.groupBy("s", "bucket").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("s", "bucket", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("before"))
    inside = (
        Window.partitionBy("s", "bucket").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, -1)
    )
    return spread.join(before, ["s", "bucket"]).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK, seed: int = 7,
    keep: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with ``size``, ``source_size``, ``target`` and ``taken``; the blocks; the slots.

    blocks: (s, k, start, words), which words of block ``k`` come from the document that starts there;
    slots: (slot, s, k). Joined on (s, k) in the order of the slot they are the mix.
    """
    kept = docs.columns if keep is None else keep
    size = words(F.col(text))
    order = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.xxhash64(text))
    sized = written(
        docs.select(
            packed(docs.select(*kept)), F.col(source).alias("source"), size.alias("size"), order.alias("h"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "sized",
    )  # from here on only numbers are moved; the rows join again at the end
    by_source = written(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "sources")
    wanted = targets(cyclic_weights(by_source.select("source", "size"), weights), epochs)
    ordered = written(
        ordered_scan(wanted, [F.col("source").isNull(), F.col("source")], ["target"], "targets")
        .withColumn("s", F.col("position")),
        "targets",
    )
    whole = ordered.agg(F.sum("target")).first()[0] or 1.0
    floor_target = F.floor(F.col("target") + 1e-6).cast("long")
    shares = written(
        ordered.select(
            "s", "source", F.col("size").alias("source_size"), "target", floor_target.alias("limit"),
            F.ceil(floor_target / block).cast("long").alias("blocks"),
            (F.col("before_target") / whole).alias("low"),
            ((F.col("before_target") + F.col("target")) / whole).alias("high"),
        ),
        "shares",
    )
    slots = written(schedule(shares, block), "schedule")

    known = small(shares.select("s", "source", "source_size", "target", "limit"))
    numbered = sized.alias("d").join(known.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source"))).select(
        "d.rid", "k.s", "d.size", "k.source_size", "k.target", "k.limit", "d.h"
    )
    placed = written(positions(numbered), "positions")

    # the words epoch e takes of a document: [e * source_size + start, + size) below the limit
    first, end = "e * source_size + start", "least(e * source_size + start + size, limit)"
    pieces = (
        placed.filter("size > 0 AND limit > 0")
        .select("s", "start", "size", "source_size", "limit", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("e"))
        .filter(f"{first} < limit")
        .select("s", "start", F.expr(first).alias("a"), F.expr(end).alias("b"))
        .select(
            "s", "start", "a", "b",
            F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("k"),
        )
        .select(
            "s", "k", "start",
            (F.least("b", (F.col("k") + 1) * block) - F.greatest("a", F.col("k") * block)).cast("long").alias("words"),
        )
    )
    taken = (
        pieces.join(slots.select("s", "k"), ["s", "k"])
        .groupBy("s", "start").agg(F.sum("words").alias("taken"))
    )
    has_words = F.col("p.size") > 0  # documents without words share their start with another
    found = placed.alias("p").join(
        taken.alias("t"), (F.col("p.s") == F.col("t.s")) & (F.col("p.start") == F.col("t.start")) & has_words, "left"
    ).select("p.rid", "p.source_size", "p.target", F.coalesce("t.taken", F.lit(0)).alias("taken"))
    out = sized.select("rid", "row", "size").join(found, "rid")
    return (
        unpacked(
            out, kept, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"),
            taken=F.col("taken").cast("long"),
        ),
        pieces,
        slots,
    )
