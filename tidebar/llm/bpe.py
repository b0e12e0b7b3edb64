"""Byte-level BPE (operator 1): a sentencepiece model written straight from a rank file.

A rank file lists byte strings by merge rank. Each byte string becomes a piece of a BPE model
(its bytes mapped to one letter each, its score the negative rank), the model's normalisation is
the identity, and the model is serialised by hand: nothing is trained. The model encodes pre-tokens
(the matches of a pattern); decoding maps ids back to their byte strings and joins them.

Defined cases: a null or empty text has no ids; empty and null id lists decode to no bytes; text of
any length is encoded whole; repeated rows give repeated results; an empty table gives an empty
table; an input column with the name of an output column is replaced, all others are carried along.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.common import packed, tidy, unpacked

#: Bytes of words and their ids that a worker remembers before it starts anew.
REMEMBERED = 30_000_000
#: Texts whose new words are learned together, and the letters at which such a group is closed.
TOGETHER = 500
GROUP_LETTERS = 250_000
#: Ids whose bytes are gathered at once, wherever a list begins or ends.
GATHERED = 50_000
#: byte b is written as the letter U+0100 + b: 256 letters, none of them white space
LETTERS = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """byte string -> rank; every single byte must be there, so that every text can be encoded."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing or len(set(ranks.values())) != len(ranks):
        raise ValueError(f"not a byte-level vocabulary: bytes missing {missing[:5]}, or repeated ranks")
    return ranks


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float | bool) -> bytes:
    """One protobuf field: length-delimited, 32-bit float or varint, by the type of the value."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def letters(piece: bytes) -> str:
    return piece.decode("latin-1").translate(LETTERS)


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of the vocabulary; piece i is the i-th smallest rank, the last is unknown."""
    order = sorted(ranks, key=ranks.get)
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, letters(p)) + _field(2, float(-ranks[p])) + _field(3, normal)) for p in order
    ]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = (
        _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(order))
        + b"".join(_field(k, 2**64 - 1) for k in (41, 42, 43))  # no begin, end or padding piece
    )
    identity = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class Encoder:
    """Texts to ids, as int32 bytes. A pre-token that is itself in the vocabulary is that one id.

    ``spaced`` says of the pattern that a match takes one space before it where it can, and holds
    spaces nowhere else but among white space alone. A text may then be cut before every space that
    stands between two visible characters, and what lies between two cuts is remembered with its ids.
    A text with other white space at a cut (two spaces, a space after a line end) is matched whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = False):
        import regex
        import sentencepiece

        self._find = regex.compile(pattern).findall
        self._blank = regex.compile(r"\s").match
        self._ranks = ranks
        self._ids = np.array(sorted(ranks.values()), dtype=np.int32)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self._spaced = spaced
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, bytes | None] = {}
        self._room = REMEMBERED

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that can each be matched alone."""
        matched = [self._find(p) for p in pieces]
        ids, split = {}, []
        for token in {t for found in matched for t in found}:
            rank = self._ranks.get(token.encode())
            if rank is None:
                split.append(token)
            else:
                ids[token] = rank.to_bytes(4, "little")
        found = self._model.encode([letters(t.encode()) for t in split], num_threads=1) if split else []
        for token, merged in zip(split, found, strict=True):
            ids[token] = self._ids[merged].tobytes()
        return [b"".join([ids[t] for t in found]) for found in matched]

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of each word with a space before it; None where no cut may be made there."""
        sound = []
        for word in words:
            if not word or self._blank(word[0]) or self._blank(word[-1]):
                self._known[word] = None
            else:
                sound.append(word)
        for word, ids in zip(sound, self._pieces([f" {w}" for w in sound]), strict=True):
            self._known[word] = ids
            self._room -= len(word) + len(ids) + 100

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        if not self._spaced:
            return self._pieces(texts)
        if self._room < 0:
            self._forget()
        split = [text.split(" ") for text in texts]
        new: set[str] = set()
        for words in split:
            new.update(words[1:])
        self._learn(new.difference(self._known))
        whole = []  # first words, and texts that cannot be cut
        rests = []
        for text, words in zip(texts, split, strict=True):
            rest = list(map(self._known.__getitem__, words[1:]))
            sound = None not in rest and not (words[0] and len(words) > 1 and self._blank(words[0][-1]))
            whole.append(words[0] if sound else text)
            rests.append(rest if sound else [])
        return [
            b"".join([first, *rest]) for first, rest in zip(self._pieces(whole), rests, strict=True)
        ]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if len(some) == TOGETHER or size >= GROUP_LETTERS:
                out += self._encode_some(some)
                some, size = [], 0
        return out + self._encode_some(some) if some else out


class Decoder:
    """Id lists, laid end to end, to their byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = sorted((i, b) for b, i in ranks.items())
        self._length = np.full(pieces[-1][0] + 1, -1, dtype=np.int64)
        self._length[[i for i, _ in pieces]] = [len(b) for _, b in pieces]
        self._start = np.concatenate([[0], np.cumsum(np.maximum(self._length, 0))[:-1]])
        self._bytes = np.frombuffer(b"".join(b for _, b in pieces), dtype=np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each list; ``counts`` has the number of ids of each."""
        ends, parts, size = np.cumsum(counts), [], 0
        cuts = np.zeros(len(counts), dtype=np.int64)
        for lo in range(0, len(ids), GATHERED):
            some = ids[lo : lo + GATHERED]
            if some.min() < 0 or some.max() >= len(self._length) or self._length[some].min() < 0:
                raise ValueError("an id is not in the vocabulary")
            lengths = self._length[some]
            stops = np.cumsum(lengths)
            places = np.arange(stops[-1]) + np.repeat(self._start[some] - (stops - lengths), lengths)
            parts.append(self._bytes[places].tobytes())
            here = slice(*np.searchsorted(ends, [lo, lo + len(some)], side="right"))  # the lists that end among these ids
            cuts[here] = size + stops[ends[here] - lo - 1]
            size += len(parts[-1])
        joined, at = b"".join(parts), [0, *cuts.tolist()]
        return [joined[a:b] for a, b in zip(at, at[1:])]


def _shipped(df: DataFrame, ranks: dict[bytes, int]):
    """The vocabulary for the workers: under a megabyte, whatever the size of the input."""
    return df.sparkSession.sparkContext.broadcast(ranks)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids",
           spaced: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of int): the whole text encoded, each match of ``pattern`` by itself.

    ``spaced``: see ``Encoder``; only for patterns that have this property. ``keep`` names the columns
    to carry along (default: all).
    """
    shipped = _shipped(df, ranks)
    kept = df.columns if keep is None else keep
    packs = df.select(packed(df.select(*kept)), F.col(text).alias("t"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shipped.value, pattern, spaced)
        for batch in source:
            found = coder.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
            flat = np.frombuffer(b"".join(found), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["row", "ids"]
            )

    schema = T.StructType([packs.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return unpacked(packs.mapInArrow(tidy(run), schema), kept, **{ids: F.col("ids")})


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded",
           keep: list[str] | None = None) -> DataFrame:
    """Add ``out`` (binary): the byte strings of the ids, joined. ``keep``: as in ``encode``."""
    shipped = _shipped(df, ranks)
    kept = df.columns if keep is None else keep
    packs = df.select(packed(df.select(*kept)), F.col(ids).alias("i"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Decoder(shipped.value)
        for batch in source:
            lists = batch.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found = coder.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["row", "decoded"])

    schema = T.StructType([packs.schema["row"], T.StructField("decoded", T.BinaryType())])
    return unpacked(packs.mapInArrow(tidy(run), schema), kept, **{out: F.col("decoded")})
