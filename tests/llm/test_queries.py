"""The registered queries over given tables: columns, folds, thresholds and values against plain code."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.test_mixing import plain_targets
from tidebar.llm import quality, toxicity
from tidebar.llm.catalog import llm_queries

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").collect()


def run(spark, name):
    return llm_queries()[name](spark, DIR)


def kinds(df):
    return {c: t for c, t in df.dtypes}


def test_source_mix(spark, docs):
    df = run(spark, "op2_source_mix")
    assert kinds(df) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    words = re.compile(rb"[^\x20\x09-\x0D]+")
    size = {d.doc_id: len(words.findall((d.text or "").encode())) for d in docs}
    per_source, taken = defaultdict(int), defaultdict(int)
    for d in docs:
        per_source[d.source] += size[d.doc_id]
    want, source = plain_targets(per_source), {d.doc_id: d.source for d in docs}
    rows = df.collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == per_source[s] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[s], abs=1e-6)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_simhash_groups(spark, docs):
    df = run(spark, "op3_simhash_groups")
    assert kinds(df) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    rows = {r.doc_id: r for r in df.collect()}
    codes = []
    for d in docs:
        words = (d.text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        codes.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0)
        assert rows[d.doc_id].fingerprint == f"{codes[-1]:016x}"
    codes, ids = np.array(codes, np.uint64), np.array([d.doc_id for d in docs])
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    labels = ids.copy()
    while True:
        following = np.array([labels[row].min() for row in near])
        if (following == labels).all():
            break
        labels = following
    assert [rows[i].component_id for i in ids.tolist()] == labels.tolist()


@pytest.mark.parametrize("name,label,at_least", [("op6_quality", "quality", 0.3), ("op9_toxicity", "toxic", 0.5)])
def test_scores(spark, docs, name, label, at_least):
    df = run(spark, name)
    assert kinds(df) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == len(docs)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= at_least)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    held = [(rows[i].score, y) for i, y in truth.items() if i in rows and rows[i].held_out]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good]) > 0.8


def test_toxicity_scores_are_means_of_ngrams(spark, docs):
    """A score worked out again from the model: bias and the mean over words of the mean over n-grams."""
    rng = np.random.default_rng(0)
    s = toxicity.Settings()
    model = toxicity.Model(rng.normal(size=s.buckets).astype(np.float32), -0.3, s)
    rows = toxicity.score(spark.createDataFrame([(d.doc_id, d.text) for d in docs[:60]], "doc_id long, text string"), model).collect()
    for r in rows:
        words, total = (r.text or "").lower().split(), 0.0
        for w in words:
            marked = f"<{toxicity.EDGES.sub('', w) or w}>".encode()
            spans = [marked] if len(marked) <= s.shortest else [
                marked[i : i + n] for n in range(s.shortest, min(s.longest, len(marked)) + 1) for i in range(len(marked) - n + 1)]
            total += sum(float(model.grams[zlib.crc32(x) % s.buckets]) for x in spans) / len(spans)
        logit = model.bias + (total / len(words) if words else 0.0)
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_whole_tokens_count():
    """Tokens that differ only far behind their beginning have buckets of their own; so have rows of signs."""
    names = quality.Buckets(1 << 20)
    assert names["x" * 60 + "a"] != names["x" * 60 + "b"]
    assert names["!" * 9] == names["!!!"] and names["!!!?"] != names["!!!#"]
    assert "y" * 200 not in names and names["y" * 200] == quality.Buckets(1 << 20)["y" * 200]


def test_vector_search(spark):
    df = run(spark, "op10_vector_search")
    assert kinds(df) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    given = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
             if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    ids, found = np.array(list(given)), defaultdict(list)
    v = np.stack(list(given.values()))
    for r in df.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in given if i % 50 == 0}
    hit = 0
    for q, rows in found.items():
        cosine = v @ given[q] / np.linalg.norm(v, axis=1) / np.linalg.norm(given[q])
        order = [i for i in np.lexsort((ids, -cosine)) if ids[i] != q][:5]
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(cosine[ids == i][0], abs=1e-12) for _, i, s in rows)
        hit += len({i for _, i, _ in rows} & set(ids[order].tolist()))
    assert hit >= 0.9 * 5 * len(found)
