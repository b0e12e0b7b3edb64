"""Alignment of two tokenizations of one text (operator 13) by nearest-start joins.

Tokenizer A is byte-level BPE and encodes a space and the text; B is a sentencepiece model, which adds that
space itself. Both sides' tokens are byte ranges of the same bytes. In each Arrow batch ``pandas.merge_asof``,
keyed by document, gives every token start the other side's covering token; the union of both directions is
all overlaps, and overlaps with equal ends cut both sides into groups and are the links.

Each document's links are kept as indices of id pairs. Tokens that end together agree on their shared bytes,
so one's bytes are a suffix of the other's: the pairs that can ever be linked are listed from the two
vocabularies alone, a fixed table (``possible_pairs``). Counts over the corpus are sums of one such table
from each task, and are shipped back whole: their size is bounded by the vocabularies and not by the data.

Texts are cut before single spaces between visible characters, where neither tokenizer can join the sides,
and a worker remembers the ids of what stands between two cuts; where B's pieces could join them, texts are
encoded whole.

Defined cases: null and empty texts, and texts that either side does not give back byte for byte (B takes
U+2581 for a space), have no tokens: zeros and an empty digest; strings of special tokens are plain text; a
null id stays; repeated rows count as often as they come; an empty table gives an empty table; an input
column with the name of an output column is replaced, all others are carried along.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.common import packed, unpacked, written

#: Bytes of pieces and their ids, about, that a worker remembers before it starts anew.
REMEMBERED = 24_000_000
#: Characters of texts that are aligned at once; a longer text is one unit.
AT_ONCE = 500_000
#: Characters of new pieces that are encoded together.
TOGETHER = 50_000
_CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
_VISIBLE = re.compile("[^\\s▁]([^▁]*[^\\s▁])?")


# -- the two tokenizers -----------------------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: itself where it is visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, from the contents of their files. What stands between two cuts is remembered with its ids."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        import sentencepiece
        import tokenizers

        self._a = tokenizers.Tokenizer.from_str(a_json.decode())
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        entries = self._a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            known = all(c in letters for c in entry)
            self.a_bytes[i] = bytes(letters[c] for c in entry) if known else entry.encode()
        self.b_bytes = []
        joins = False
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode())
            joins |= not self._b.is_control(i) and re.search("[^▁]▁", piece) is not None
        self._whole = joins  # a piece that holds a space after another character could join the sides of a cut
        self._lengths = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._room = REMEMBERED
        self._flat = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self._ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def pieces(self, text: str) -> list[str]:
        """The text between its cuts, without the spaces of the cuts."""
        return [text] if self._whole else _CUT.split(text)

    def _ids(self, piece: str) -> tuple[list[int], list[int]]:
        return self._a.encode(" " + piece, add_special_tokens=False).ids, self._b.encode(piece)

    def _learn(self, new: list[str]) -> None:
        """Ids of new pieces: many at once, joined by the spaces of cuts, where each is visible at both ends."""
        fit = [p for p in new if not self._whole and _VISIBLE.fullmatch(p)]
        alone = list(set(new) - set(fit))
        sizes = np.cumsum([len(p) + 1 for p in fit])
        found = []
        at = 0
        while at < len(fit):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER)))
            found.append((fit[at:end], self._together(fit[at:end])))
            at = end
        found += [([p], [(np.array(x, np.int32), [len(x)]) for x in self._ids(p)]) for p in alone]
        for side in (0, 1):
            self._flat[side] = np.concatenate([self._flat[side], *[sides[side][0] for _, sides in found]])
            sizes = np.concatenate([sides[side][1] for _, sides in found])
            self._ends[side] = np.concatenate([self._ends[side], self._ends[side][-1] + np.cumsum(sizes)])
        for pieces, _ in found:
            for p in pieces:
                self._known[p] = len(self._known)
                self._room -= len(p) + 100

    def _together(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each side the ids of all words, and how many each word has."""
        want = np.cumsum([1 + len(w.encode()) for w in words])
        out = []
        for ids, lengths in zip(self._ids(" ".join(words)), self._lengths):
            ids = np.array(ids, np.int32)
            ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ends, want)
            if not len(ends) or ends[-1] != want[-1] or (ends[at] != want).any():
                break  # a side does not give these bytes back
            out.append((ids, np.diff(at, prepend=-1)))
        if len(out) == 2:
            return out
        each = [self._ids(w) for w in words]
        return [
            (np.array([i for x in each for i in x[side]], np.int32), np.array([len(x[side]) for x in each]))
            for side in (0, 1)
        ]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts by A and how many each has, and the same by B."""
        if self._room < 0:
            self._forget()
        parts = [self.pieces(t) if t else [] for t in texts]
        flat = [p for part in parts for p in part]
        new = [p for p in dict.fromkeys(flat) if p not in self._known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self._known.__getitem__, flat), np.int64, len(flat))
        last = np.concatenate([[0], np.cumsum([len(part) for part in parts])]).astype(np.int64)
        out = []
        for ids, ends in zip(self._flat, self._ends):
            first, n = ends[at], ends[at + 1] - ends[at]
            upto = np.concatenate([[0], np.cumsum(n)])
            out += [ids[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])], np.diff(upto[last])]
        return tuple(out)


def possible_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """Sorted a * len(b_bytes) + b of all id pairs in which one's bytes end with the other's."""
    found, width = [], len(b_bytes)
    for one, other, key in ((a_bytes, b_bytes, lambda i, j: i * width + j), (b_bytes, a_bytes, lambda j, i: i * width + j)):
        by_bytes: dict[bytes, list[int]] = {}
        for j, y in enumerate(other):
            if y:
                by_bytes.setdefault(y, []).append(j)
        for i, x in enumerate(one):
            for k in range(len(x)):
                found += [key(i, j) for j in by_bytes.get(x[k:], ())]
    return np.unique(np.array(found, np.int64))


@lru_cache(maxsize=2)
def _loaded(a_json: bytes, b_model: bytes) -> Tokenizers:
    return Tokenizers(a_json, b_model)


# -- one batch --------------------------------------------------------------------------------------

def _joined(entries: pa.Array, at: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """The entries at these places one behind the other: where each begins, then the end; and the bytes."""
    if not len(at):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = entries.take(pa.array(at)).buffers()
    return np.frombuffer(offsets, np.int64, len(at) + 1), memoryview(data or b"").cast("B")


class Aligned:
    """The tokens, overlaps and links of a batch of texts; positions are places in the flat id arrays."""

    def __init__(self, both: Tokenizers, texts: list[str | None], a_vocabulary: pa.Array, b_vocabulary: pa.Array):
        plain = [t or "" for t in texts]
        want = [b" " + t.encode() if t else b"" for t in plain]
        a, n_a, b, n_b = both.encode(plain)
        sides = [(a, n_a, a_vocabulary), (b, n_b, b_vocabulary)]
        lengths, same = [], np.ones(len(texts), bool)
        for ids, n, vocabulary in sides:
            ends, data = _joined(vocabulary, ids)
            at = ends[np.concatenate([[0], np.cumsum(n)])]
            same &= [data[s:e] == w for s, e, w in zip(at.tolist(), at[1:].tolist(), want)]
            lengths.append(np.diff(ends))
        self.same, self._wide_a = same, len(both.a_bytes)
        self.n = [np.where(same, n, 0) for _, n, _ in sides]
        kept = [np.repeat(same, n) for _, n, _ in sides]
        self.ids = [ids[k] for (ids, _, _), k in zip(sides, kept)]
        self.doc = [np.repeat(np.arange(len(texts)), n) for n in self.n]
        self.end = [np.cumsum(x[k]) for x, k in zip(lengths, kept)]
        self.start = [e - x[k] for e, x, k in zip(self.end, lengths, kept)]
        self.overlaps = self._overlaps()
        one, two = self.overlaps
        together = self.end[0][one] == self.end[1][two]
        order = np.argsort(one[together], kind="stable")
        self.links = [x[together][order] for x in (one, two)]

    def _overlaps(self) -> list[np.ndarray]:
        frames = [
            pd.DataFrame({"doc": d, "start": s, f"token{i}": np.arange(len(s))})
            for i, (d, s) in enumerate(zip(self.doc, self.start))
        ]
        forth = pd.merge_asof(frames[0], frames[1], on="start", by="doc")  # the B token that covers an A start
        back = pd.merge_asof(frames[1], frames[0], on="start", by="doc")
        one, two = back["token0"].to_numpy(np.int64), back["token1"].to_numpy(np.int64)
        new = self.start[0][one] != self.start[1][two]  # equal starts were found both ways
        return [
            np.concatenate([forth["token0"].to_numpy(np.int64), one[new]]),
            np.concatenate([forth["token1"].to_numpy(np.int64), two[new]]),
        ]

    def per_doc(self, positions: np.ndarray) -> np.ndarray:
        """How many of these A positions each document has."""
        return np.bincount(self.doc[0][positions], minlength=len(self.same))

    def groups(self, names: pa.Array) -> list[memoryview]:
        """Each document's groups as text; ``names`` has every id with each mark that may follow it."""
        ends = [np.zeros(len(x), bool) for x in self.ids]
        for e, at in zip(ends, self.links):
            e[at] = True
        n_groups = len(self.links[0])
        group = [np.cumsum(e) - e for e in ends]
        sizes = [np.bincount(g, minlength=n_groups) for g in group]
        before_b, upto_a = np.concatenate([[0], np.cumsum(sizes[1])]), np.cumsum(sizes[0])
        sequence = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        width = len(names) // 2
        sequence[np.arange(len(group[0])) + before_b[group[0]]] = self.ids[0] + np.where(ends[0], width, 0)
        sequence[np.arange(len(group[1])) + upto_a[group[1]]] = self._wide_a + self.ids[1] + np.where(ends[1], width, 0)
        ends_, data = _joined(names, sequence)
        at = ends_[np.concatenate([[0], np.cumsum(self.n[0] + self.n[1])])].tolist()
        return [data[s : max(s, e - 1)] for s, e in zip(at, at[1:])]  # without the last mark


def _names(wide_a: int, wide_b: int) -> pa.Array:
    """Decimal ids with the mark inside a side, then with the mark that ends it."""
    inside = [f"{i}," for i in (*range(wide_a), *range(wide_b))]
    ends = [f"{i}|" for i in range(wide_a)] + [f"{i};" for i in range(wide_b)]
    return pa.array(inside + ends, pa.large_binary())


# -- the corpus -------------------------------------------------------------------------------------

def aligned(
    docs: DataFrame, a_json: bytes, b_model: bytes, text: str = "text", keep: list[str] | None = None,
    details: bool = False,
) -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, groups_sha256 and ``links`` (indices of ``possible_pairs``).

    ``details`` adds ``groups`` (the digested text) and ``overlaps``, pairs of token places of A and B.
    """
    kept = docs.columns if keep is None else keep
    packs = docs.select(packed(docs.select(*kept)), F.col(text).alias("t"))
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((a_json, b_model))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(*files.value)
        vocabularies = [pa.array(x, pa.large_binary()) for x in (both.a_bytes, both.b_bytes)]
        names = _names(len(both.a_bytes), len(both.b_bytes))
        pairs = possible_pairs(both.a_bytes, both.b_bytes)
        for batch in slices(source):
            found = Aligned(both, batch.column(1).to_pylist(), *vocabularies)
            one, two = found.links
            n_links = found.per_doc(one)
            key = found.ids[0][one].astype(np.int64) * len(both.b_bytes) + found.ids[1][two]
            texts = found.groups(names)
            shas = [hashlib.sha256(x).hexdigest() if n else "" for x, n in zip(texts, found.n[0].tolist())]
            offsets = np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32)
            index = np.searchsorted(pairs, key).astype(np.int32)
            columns = [
                batch.column(0), pa.array(found.n[0]), pa.array(found.n[1]), pa.array(n_links), pa.array(n_links),
                pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(index)),
            ]
            if details:
                columns += [pa.array([bytes(x).decode() for x in texts], pa.string()), _overlap_lists(found)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = T.StructType([packs.schema["row"]] + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")])
    schema = schema.add("groups_sha256", T.StringType()).add("links", T.ArrayType(T.IntegerType()))
    if details:
        place = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
        schema = schema.add("groups", T.StringType()).add("overlaps", T.ArrayType(place))
    return unpacked(packs.mapInArrow(run, schema), kept, **{c: F.col(c) for c in schema.names[1:]})


def slices(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut by the characters of their texts, the second column."""
    for batch in source:
        upto = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _overlap_lists(found: Aligned) -> pa.Array:
    one, two = found.overlaps
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    first = [np.concatenate([[0], np.cumsum(n)]) for n in found.n]
    doc = found.doc[0][one]
    places = pa.StructArray.from_arrays(
        [pa.array((one - first[0][doc]).astype(np.int32)), pa.array((two - first[1][doc]).astype(np.int32))], ["a", "b"]
    )
    offsets = np.concatenate([[0], np.cumsum(found.per_doc(one))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), places)


def pair_counts(links: DataFrame, n_pairs: int) -> np.ndarray:
    """How often each possible pair is linked in all documents; a task sends each pair once."""

    def summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_pairs, np.int64)
        for batch in source:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_pairs)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["pair", "n"])

    sums = links.mapInArrow(summed, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_pairs, np.int64)
    out[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    return out


def align(docs: DataFrame, a_json: bytes, b_model: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the columns of ``aligned`` without ``links``, and n_best and count_sum from the corpus's counts."""
    marked = written(aligned(docs, a_json, b_model, text, keep), "aligned")
    both = Tokenizers(a_json, b_model)
    pairs = possible_pairs(both.a_bytes, both.b_bytes)
    counts = pair_counts(marked.select("links"), len(pairs))
    highest = np.zeros(len(both.b_bytes), np.int64)
    np.maximum.at(highest, pairs % len(both.b_bytes), counts)
    shipped = docs.sparkSession.sparkContext.broadcast((counts, counts == highest[pairs % len(both.b_bytes)]))
    carried = [c for c in marked.columns if c != "links"]
    packs = marked.select(packed(marked.select(*carried)), "links")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shipped.value
        for batch in source:
            lists = batch.column(1)
            at = lists.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.diff(s[ends])) for s in sums]], ["row", "n_best", "count_sum"]
            )

    schema = T.StructType([packs.schema["row"]] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])
    return unpacked(packs.mapInArrow(run, schema), carried, n_best=F.col("n_best"), count_sum=F.col("count_sum"))
