import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.cases import CLASHING, edge_docs, empty_docs
from tidebar.llm import bpe

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "don't I'LL 's 't'", "x\x85 y\xa0z \xa0q",
    "\x00▁ é 漢字🙂👨‍👩‍👧 <|endoftext|> 12345 ½ⅷ", "a" * 5000, "🙂" * 500, " " * 300 + "x", "\x1c a \x1c", "ab\r\n\tcd",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("spaced", [True, False])
def test_encoder_agrees_with_the_library(ranks, reference, spaced, monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 3)
    monkeypatch.setattr(bpe, "REMEMBERED", 500)  # forgets all the time
    found = bpe.Encoder(ranks, public_tokenizers.PATTERN, spaced).encode([*TEXTS, None])
    want = [reference.encode_ordinary(t) for t in [*TEXTS, ""]]
    assert [np.frombuffer(x, np.int32).tolist() for x in found] == want
    ids = np.concatenate([np.array(w, np.int32) for w in want])
    back = bpe.Decoder(ranks).decode(ids, np.array([len(w) for w in want]))
    assert back == [t.encode() for t in [*TEXTS, ""]]


def peak(fn, *args):
    tracemalloc.start()
    try:
        return fn(*args), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_batch_takes_little_more_memory_than_its_texts(ranks):
    """Texts of a batch are cut and gathered in groups of bounded size, whatever they and their lists are."""
    texts = ["", *[" ".join(f"word{i % 7} of{j % 50}" for j in range(2000)) for i in range(200)], "", "x y " * 300_000, ""]
    size = sum(len(t) for t in texts)
    coder = bpe.Encoder(ranks, public_tokenizers.PATTERN, True)
    found, most = peak(coder.encode, texts[:-2])
    assert most < 4 * size
    found += coder.encode(texts[-2:])
    ids, counts = np.frombuffer(b"".join(found), np.int32), np.array([len(x) // 4 for x in found])
    back, most = peak(bpe.Decoder(ranks).decode, ids, counts)
    assert back == [t.encode() for t in texts] and most < 5 * size
    assert bpe.Decoder(ranks).decode(ids[:0], counts[:0]) == [] and bpe.Decoder(ranks).decode(ids[:0], counts[:1]) == [b""]


def test_unknown_ids_and_vocabularies_are_refused(ranks, tmp_path):
    with pytest.raises(ValueError):
        bpe.Decoder(ranks).decode(np.array([10**6]), np.array([1]))
    (tmp_path / "v").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "v"))


def test_frame(spark, ranks, reference):
    docs = edge_docs(spark)
    out = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, spaced=True), ranks)
    assert set(CLASHING) <= set(out.columns) and out.columns.count("ids") == 1
    rows = out.select("text", "ids", "decoded", "row").collect()
    assert len(rows) == docs.count() and {r["row"] for r in rows} == {"x"}
    for r in rows:
        assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(empty_docs(spark), ranks, public_tokenizers.PATTERN).count() == 0


def test_query_digests(spark, reference):
    from tidebar.llm.catalog import byte_bpe

    d = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    for r in byte_bpe(spark, d).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
