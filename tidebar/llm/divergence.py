"""Source divergence audit (operator 11) over a quadtree of the group-term count matrix.

A group is the documents of one language and source; the matrix of a language has a row for each group
and a column for each kept term. Smoothed shares are whole numbers, and a group diverges from another by
f = (p - q)^2 / q, rounded down, summed over all kept terms; so the sums are exact.

Counting is combined within a task before anything is shuffled, and one exchange by (language, term)
serves the counts, the document frequencies and the language totals. The matrix is then cut into tiles of
``ROWS`` x ``ROWS`` groups and about ``COLUMNS`` terms. A tile is a quadtree of k x k quadrants (k = 2) in
bitmaps with ranks; two groups' rows are traversed together and a pair of quadrants is left at once
where either is all zero. Such quadrants are priced without a visit: all zero cells of a row have one
share, so a sum over them needs only how often each share of the other row occurs, and columns that are
zero in both rows only their number, which is done once for the whole language. A tile returns one row for
each pair of its groups, never one for each term.

Defined cases: null text, language and source are empty strings; a group without kept terms takes part
with the share of a count of zero; a language without kept terms gives value 0 for every pair; ties are
ranked by the item's UTF-8 bytes; repeated rows count as documents of their own; texts of any length count
whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.llm.common import ordered_scan, small, written

SCALE = 1_000_000_000
#: Groups a side and terms, about, of a tile.
ROWS, COLUMNS = 128, 4096
#: Terms that a task holds before it sends their counts on.
HELD = 200_000
#: Node pairs held at once while two rows' trees are traversed.
FRONTIER = 200_000
#: Bytes of a text that are split at once.
PIECE = 4 << 20

#: ASCII letters in lower case, bytes of other characters as they are, all else white space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


# -- counting ---------------------------------------------------------------------------------------

def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of bounded size that end between terms."""
    data = text.encode().translate(_LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(docs: DataFrame, text: str, lang: str, source: str, most: int = HELD) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, combined within each task up to ``most`` terms."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for key, t in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                times, docs_with = found.setdefault(key, (Counter(), Counter()))
                held -= len(times)
                of_doc: set[bytes] = set()
                for words in terms_of(t):
                    times.update(words)
                    of_doc.update(words)
                docs_with.update(of_doc)
                held += len(times)
                if held > most:
                    yield from sent(found)
                    found, held = {}, 0
        yield from sent(found)

    def sent(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang_, source_), (times, docs_with) in found.items():
            if times:
                n = len(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang_] * n, pa.string()), pa.array([source_] * n, pa.string()),
                     pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64()),
                     pa.array([docs_with[w] for w in times], pa.int64())],
                    ["lang", "source", "term", "n", "d"],
                )

    return rows.mapInArrow(count, "lang string, source string, term string, n long, d long")


def share(n, total, terms):
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for counts far beyond 64-bit products."""
    return F.expr(
        f"1L + (CAST({SCALE} AS decimal(10,0)) * CAST({n} + 1 AS decimal(19,0))) div CAST({total} + {terms} AS decimal(19,0))"
    )


def divergence(p, q):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


# -- the quadtree -----------------------------------------------------------------------------------

class CountTree:
    """A k x k quadtree (k = 2) of cells: a bit for each quadrant of each node, children found by rank."""

    def __init__(self, row: np.ndarray, col: np.ndarray, depth: int):
        code = np.zeros(len(row), np.int64)
        for b in range(depth):
            code |= ((col >> b) & 1) << (2 * b) | ((row >> b) & 1) << (2 * b + 1)
        self.depth, self.order = depth, np.argsort(code, kind="stable")
        self._levels: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = code[self.order]
        for _ in range(depth):
            parents, at = np.unique(nodes >> 2, return_inverse=True)
            bits = np.zeros(4 * len(parents), bool)
            bits[4 * at + (nodes & 3)] = True
            self._levels.append((bits, np.cumsum(bits, dtype=np.int32) - 1))
            nodes = parents
        self._levels.reverse()

    def below(self, level: int, node: np.ndarray, right: int, lower: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the quadrant has cells, and its place among the next level's nodes where it has."""
        bits, rank = self._levels[level]
        at = 4 * node + 2 * lower + right
        return bits[at], rank[at]


def joint_cells(a: CountTree, b: CountTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in each tree's order) of all pairs of cells in one column; within one tree, each pair once."""
    same = a is b
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(a.order) and len(b.order) else []
    while stack:
        level, x, y = stack.pop()
        if len(x) > FRONTIER:
            half = len(x) // 2
            stack += [(level, x[:half], y[:half]), (level, x[half:], y[half:])]
            continue
        if level == a.depth:
            if same:
                x, y = x[x != y], y[x != y]
            if len(x):
                yield x, y
            continue
        kept = []
        for right in (0, 1):
            for upper, lower in ((0, 0), (0, 1), (1, 0), (1, 1)):
                (has_a, to_a), (has_b, to_b) = a.below(level, x, right, upper), b.below(level, y, right, lower)
                ok = has_a & has_b  # an all-zero quadrant on either side ends the visit
                if same and upper > lower:
                    ok &= x != y
                kept.append((to_a[ok], to_b[ok]))
        x, y = (np.concatenate(side).astype(np.int64) for side in zip(*kept))
        if len(x):
            stack.append((level + 1, x, y))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tile_sums(
    row_a: np.ndarray, col_a: np.ndarray, p_a: np.ndarray, zero_a: np.ndarray,
    row_b: np.ndarray, col_b: np.ndarray, p_b: np.ndarray, zero_b: np.ndarray, same: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """value[a, b], value[b, a] and the number of columns that are not zero in both, for rows a and b.

    ``zero_*``: each row's share of a count of zero; ``row, col, p``: its other cells.
    """
    depth = int(max(row_a.max(initial=0), row_b.max(initial=0), col_a.max(initial=0), col_b.max(initial=0))).bit_length()
    ab, ba = _one_sided(zero_a, row_b, p_b, row_a, p_a, zero_b), _one_sided(zero_b, row_a, p_a, row_b, p_b, zero_a)
    seen = np.bincount(row_a, minlength=len(zero_a))[:, None] + np.bincount(row_b, minlength=len(zero_b))[None, :]
    a = CountTree(row_a, col_a, depth)
    b = a if same else CountTree(row_b, col_b, depth)
    for x, y in joint_cells(a, b):
        x, y = a.order[x], b.order[y]
        r, s, p, q = row_a[x], row_b[y], p_a[x], p_b[y]
        p0, q0 = zero_a[r], zero_b[s]
        forth, back = _f(p, q) - _f(p0, q) - _f(p, q0), _f(q, p) - _f(q0, p) - _f(q, p0)
        np.add.at(ab, (r, s), forth)
        np.add.at(ba, (s, r), back)
        np.subtract.at(seen, (r, s), 1)
        if same:
            np.add.at(ab, (s, r), back)
            np.add.at(ba, (r, s), forth)
            np.subtract.at(seen, (s, r), 1)
    return ab, ba, seen


def _one_sided(zero_g, row_h, p_h, row_g, p_g, zero_h) -> np.ndarray:
    """For rows g and h: sums of f(zero_g, h's cells) and of f(g's cells, zero_h), by how often shares occur."""
    out = np.zeros((len(zero_g), len(zero_h)), np.int64)
    for rows, shares, axis in ((row_h, p_h, 1), (row_g, p_g, 0)):
        if not len(rows):
            continue
        order = np.lexsort((shares, rows))
        r, p = rows[order], shares[order]
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])]))
        times = np.diff(np.append(new, len(r)))
        r, p = r[new], p[new]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        if axis:
            out[:, r[first]] += np.add.reduceat(_f(zero_g[:, None], p[None, :]) * times, first, axis=1)
        else:
            out[r[first], :] += np.add.reduceat(_f(p[:, None], zero_h[None, :]) * times[:, None], first, axis=0)
    return out


def _tile(table: pa.Table, rows: int) -> pa.Table:
    """The sums of one tile; rows with a null term name the groups and their share of zero."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    same, parts = i == j, []
    terms = pc.fill_null(table.column("term").combine_chunks().dictionary_encode().indices, -1).to_numpy()
    block, at, p = (table.column(c).to_numpy() for c in ("block", "at", "p"))
    for side in (i, j):
        names, cells = (block == side) & (terms < 0), (block == side) & (terms >= 0)
        zero = np.ones(int(at[names].max(initial=-1)) + 1, np.int64)
        zero[at[names]] = p[names]
        parts.append((at[cells].astype(np.int64), terms[cells].astype(np.int64), p[cells], zero))
    ab, ba, seen = tile_sums(*parts[0], *parts[1], same)
    g, h = (x.ravel() for x in np.indices(ab.shape))
    columns = [(i, j, g, h, ab, seen)] + ([] if same else [(j, i, h, g, ba.T, seen)])
    return pa.table({
        "lang": pa.array([table.column("lang")[0].as_py()] * (len(g) * len(columns)), pa.string()),
        "g": pa.array(np.concatenate([x * rows + r for x, _, r, _, _, _ in columns]).astype(np.int64)),
        "h": pa.array(np.concatenate([x * rows + r for _, x, _, r, _, _ in columns]).astype(np.int64)),
        "value": pa.array(np.concatenate([v.ravel() for *_, v, _ in columns])),
        "seen": pa.array(np.concatenate([s.ravel() for *_, s in columns]).astype(np.int64)),
    })


# -- the audit --------------------------------------------------------------------------------------

def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3,
    top_terms: int = 200, rows: int = ROWS, columns: int = COLUMNS, held: int = HELD,
) -> DataFrame:
    """lang, source, part, item, value, rank; see the module's text."""
    by_term = Window.partitionBy("lang", "term")
    cells = written(
        counted(docs, text, lang, source, held).repartition("lang", "term")
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        .withColumn("docs", F.sum("d").over(by_term)).withColumn("of_lang", F.sum("n").over(by_term))
        .withColumn("lead", F.row_number().over(by_term.orderBy("source")) == 1)
        .filter(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "of_lang", "lead"),
        "cells",
    )
    groups, langs = _groups(docs, cells, lang, source)
    shares = written(
        cells.join(small(groups), ["lang", "source"]).join(small(langs), "lang").select(
            "lang", "source", "pos", "term", share("n", "total", "terms").alias("p"),
            share("of_lang", "lang_total", "terms").alias("q"),
        ),
        "shares",
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = (
        shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
    )
    pairs = _pairs(shares, groups, langs, rows, columns).withColumn("rank", F.row_number().over(best))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("term")).select(*out).unionByName(pairs.withColumn("part", F.lit("pair")).select(*out))


def _groups(docs: DataFrame, cells: DataFrame, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(lang, source, pos, total, p0) of every group, and (lang, terms, lang_total, groups) of every language."""
    names = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("lead").cast("long")).alias("terms"))
    known = names.join(totals, ["lang", "source"], "left").fillna(0)
    placed = written(ordered_scan(known, [F.col("lang"), F.col("source")], name="groups"), "groups")
    langs = written(
        placed.groupBy("lang").agg(
            F.sum("terms").alias("terms"), F.sum("total").alias("lang_total"), F.count("*").alias("groups"),
            F.min("position").alias("first"),
        ),
        "langs",
    )
    groups = placed.drop("terms").join(small(langs), "lang").select(
        "lang", "source", (F.col("position") - F.col("first")).alias("pos"), "total",
        F.when(F.col("terms") > 0, share("-1 + 1", "total", "terms")).alias("p0"),
    )
    return written(groups, "groups"), langs.drop("first")


def _pairs(shares: DataFrame, groups: DataFrame, langs: DataFrame, side: int, columns: int) -> DataFrame:
    """(lang, source, item, value) for each two groups of a language."""
    tiles = small(langs.filter("terms > 0").select(
        "lang", F.ceil(F.col("terms") / columns).cast("long").alias("wide"), F.ceil(F.col("groups") / side).cast("long").alias("high")
    ))
    placed = [F.floor(F.col("pos") / side).alias("block"), F.pmod("pos", F.lit(side)).alias("at")]
    cells = shares.join(tiles, "lang").select(
        "lang", *placed, "term", "p", "high", F.pmod(F.xxhash64("term"), F.col("wide")).alias("column")
    )
    names = groups.join(tiles, "lang").select(
        "lang", *placed, F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "high",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("column"),
    )
    sums = (
        cells.unionByName(names)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)))
        .select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "column", "block", "at", "term", "p")
        .groupBy("lang", "i", "j", "column")
        .applyInArrow(lambda tile: _tile(tile, side), "lang string, g long, h long, value long, seen long")
        .groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    )
    one = groups.select("lang", "source", F.col("pos").alias("g"), F.col("p0").alias("a"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("pos").alias("h"), F.col("p0").alias("b"))
    # the result itself has a row for each two groups of a language
    return (
        one.join(small(two), "lang").filter("g <> h").join(small(langs), "lang")
        .join(sums, ["lang", "g", "h"], "left")
        .select(
            "lang", "source", "item",
            F.when(
                F.col("terms") > 0,
                F.coalesce("value", F.lit(0)) + (F.col("terms") - F.coalesce("seen", F.lit(0))) * divergence("a", "b"),
            ).otherwise(F.lit(0)).cast("long").alias("value"),
        )
    )
