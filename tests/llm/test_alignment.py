import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.cases import edge_docs, edge_rows, empty_docs
from tidebar.llm import alignment
from tidebar.llm.catalog import ALIGNED, llm_queries

FILES = [open(public_tokenizers.path(x), "rb").read() for x in ALIGNED]
COLUMNS = {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}


class Plain:
    """The contract, one document and one token at a time, with the libraries' own tables."""

    def __init__(self):
        self.a = Tokenizer.from_str(FILES[0].decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=FILES[1])
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in visible}
        for b in range(256):
            if b not in visible:
                self.byte[chr(256 + len(self.byte) - len(visible))] = b

    def sides(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in a]
        b = [
            (i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
            for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]
        ]
        whole = (" " + text).encode()
        if any(b"".join(x for _, x in side) != whole for side in (a, b)):
            return [], []
        out = []
        for side in (a, b):
            at, spans = 0, []
            for i, x in side:
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        return out

    def doc(self, text):
        a, b = self.sides(text) if text else ([], [])
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, x, y = [], 0, 0
        for cut in cuts:
            part = [[], []]
            while x < len(a) and a[x][2] <= cut:
                part[0].append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= cut:
                part[1].append(str(b[y][0]))
                y += 1
            groups.append("|".join(",".join(ids) for ids in part))
        links = [(i, j) for i, _, e in a for j in [k for k, _, f in b if f == e]] if len(a) < 3000 else None
        if links is None:
            at = {f: k for k, _, f in b}
            links = [(i, at[e]) for i, _, e in a if e in at]
        overlaps = {
            (x, y) for x, (_, s, e) in enumerate(a) for y, (_, t, f) in enumerate(b) if max(s, t) < min(e, f)
        } if len(a) < 3000 else None
        return a, b, ";".join(groups), links, overlaps


def plain_rows(texts):
    one = Plain()
    docs = [(i, *one.doc(t)) for i, t in texts]
    counts = Counter(x for d in docs for x in d[4])
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return sorted(
        (str(i), len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[x] == top[x[1]] for x in links),
         sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if a else "")
        for i, a, b, g, links, _ in docs
    )


TEXTS = [
    "the unbelievable the the", "naïve Ünïcödé 漢字かな 🙂👍🏽 é", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>",
    "  two  spaces \n\n\t tabs ", " ", "\n", "it's 12345 don't\xa0x\x00y\x1cz", "x" * 300, "​ zero﻿", "word.Word,word;word|word",
]


def test_query_against_plain(spark, tmp_path):
    rows = [(r[0], r[1]) for r in edge_rows()] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(1000, TEXTS[0])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = llm_queries()["op13_tokenizer_alignment"](spark, str(tmp_path))
    assert set(out.columns) == COLUMNS
    assert all(t == "bigint" for c, t in out.dtypes if c != "groups_sha256")
    found = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect())
    assert found == plain_rows(rows)


def test_overlaps_are_all_pairs_that_share_bytes(spark):
    one = Plain()
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in alignment.aligned(docs, *FILES, details=True).collect():
        a, b, groups, links, overlaps = one.doc(r.text)
        assert {(x.a, x.b) for x in r.overlaps} == overlaps and len(r.overlaps) == len(overlaps)
        assert r.groups == groups and len(r.links) == len(links)


def test_pieces_encode_as_whole_texts(monkeypatch):
    rng = random.Random(2)
    words = ["the", "Ünï", "漢字", "don't", "12,5", "a_b", "x" * 9, "▁y", "🙂", "end.", "\x00", "q\n\nr"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", " \xa0"]) for _ in range(n)) for n in (3000, 1, 7, 40)]
    whole = alignment.Tokenizers(*FILES)
    whole._whole = True
    want = [x.tolist() for x in whole.encode(["", *texts])]
    monkeypatch.setattr(alignment, "TOGETHER", 30)
    monkeypatch.setattr(alignment, "REMEMBERED", 200)  # forgotten between batches
    both = alignment.Tokenizers(*FILES)
    assert len(both.pieces(texts[0])) > 1000
    for _ in range(2):
        assert [x.tolist() for x in both.encode(["", *texts])] == want


def test_possible_pairs():
    a, b = [b"ab", b"b", b"c", b""], [b"b", b"xab", b"c", b"zz"]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))}
    assert {divmod(int(k), len(b)) for k in alignment.possible_pairs(a, b)} == want


def test_defined_cases(spark):
    docs = edge_docs(spark).withColumnRenamed("n_chars", "n_best")
    out = alignment.align(docs, *FILES)
    assert out.count() == docs.count()
    assert out.columns == [c for c in docs.columns if c != "n_best"] + ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    none = out.filter("text is null or text = ''").collect()
    assert none and all(r.n_a == r.n_b == r.n_groups == r.n_links == r.n_best == r.count_sum == 0 and r.groups_sha256 == "" for r in none)
    assert alignment.align(empty_docs(spark), *FILES).collect() == []
