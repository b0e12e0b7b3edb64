import numpy as np
import pytest
import xxhash

from tests.llm.cases import edge_docs, empty_docs
from tidebar.llm import simhash


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(linked, labels):
    labels = np.array(labels)
    while True:
        following = np.array([labels[row].min() for row in linked])
        if (following == labels).all():
            return labels.tolist()
        labels = following


def test_fingerprints():
    for text in ["", None, "a", "A b", "a B c", "x y z x y z w", " a\n\tb\r c \x0b d\x0ce", "É é a b c"]:
        assert simhash.fingerprint(text.encode() if text else None) == plain_fingerprint(text)


def some_codes():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**63, 1500, dtype=np.uint64) * np.uint64(2)
    ball = codes[5] ^ (np.uint64(1) << np.arange(0, 60, dtype=np.uint64))
    return np.unique(np.concatenate(
        [codes, codes[:200] ^ np.uint64(1 << 40), codes[:100] ^ np.uint64(5), ball, np.array([0, 2**64 - 1], np.uint64)]
    ))


@pytest.mark.parametrize("leaf", [40, 10_000])
def test_trie_join_finds_all_components(spark, leaf):
    codes = some_codes()
    df = spark.createDataFrame([(0, int(x)) for x in codes.view(np.int64)], "t int, code long")
    found = simhash.components(simhash.links(df, simhash.Budget(((64, 3),)), leaf)).collect()
    root = {r["node"]: r["root"] for r in found}
    signed = codes.view(np.int64)
    want = plain_roots(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3, signed)
    assert [root.get(x, x) for x in signed.tolist()] == want


def test_pairs_of_blocks_and_budgets(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    codes = some_codes()
    a, b = simhash.Block(codes[::2]), simhash.Block(codes[1::2])
    for budget in (simhash.Budget(((64, 3),)), simhash.Budget(((32, 1), (64, 4)))):
        for left, right in ((a, b), (a, a)):
            got = {(i, j) for x, y in simhash.near(left, right, budget) for i, j in zip(x.tolist(), y.tolist())}
            apart = left.codes[:, None] ^ right.codes[None, :]
            ok = budget.holds(apart.ravel()).reshape(apart.shape)
            want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(ok))) if left is not right or i < j}
            assert got == want


def test_groups(spark):
    docs = edge_docs(spark)
    rows = simhash.groups(docs, leaf=8).select("doc_id", "text", "fingerprint", "component_id").collect()
    assert len(rows) == docs.count()
    codes = np.array([plain_fingerprint(r["text"]) for r in rows], np.uint64)
    assert [np.uint64(r["fingerprint"] % 2**64) for r in rows] == codes.tolist()
    big = 10**9
    ids = [big if r["doc_id"] is None else r["doc_id"] for r in rows]
    want = plain_roots(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3, ids)
    assert [big if r["component_id"] is None else r["component_id"] for r in rows] == want
    assert simhash.groups(empty_docs(spark)).count() == 0


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    """A small table would be broadcast; each of these stays in the driver's memory for a while."""
    plans = []
    keep = simhash.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {i: 0 if i < 10 else 10 for i in range(21) if i not in (0, 10)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
