import numpy as np
import pytest

from tests.llm.cases import edge_docs, edge_rows, empty_docs
from tidebar.llm import nearcopies
from tidebar.llm.simhash import Budget, shingle_hashes


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts, similarity=0.8):
    """The smallest place that each text is connected to, by all pairs of its set of shingles."""
    sets = [shingles(t) for t in texts]
    labels = list(range(len(texts)))
    linked = [
        [j for j, b in enumerate(sets) if a == b or (a and b and len(a & b) >= similarity * len(a | b))] for a in sets
    ]
    while True:
        following = [min(labels[j] for j in near) for near in linked]
        if following == labels:
            return labels
        labels = following


def check(spark, rows, **kw):
    """Of each plain group the row with the smallest id stays, and nothing else."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted((r.doc_id for r in nearcopies.without_near_copies(docs, **kw).collect()))
    least = {}
    for (i, _), g in zip(rows, plain_groups([t for _, t in rows])):
        least[g] = min(i, least.get(g, i))
    assert kept == sorted(least.values())
    return kept


@pytest.mark.parametrize("kw", [{}, {"piece": 7, "leaf": 64}])
def test_against_all_pairs(spark, kw):
    rng = np.random.default_rng(3)
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] is not None and len(r[1] or "") < 100_000]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    n = 1000
    for i in range(40):  # a text and one with a few words changed
        words = [f"v{x}" for x in rng.integers(0, 3000, 200)]
        rows.append((n, " ".join(words)))
        words[5 + i % 3 :: 100] = ["other"] * len(words[5 + i % 3 :: 100])
        rows.append((n + 1, " ".join(words)))
        n += 2
    check(spark, rows, **kw)


def test_copies_among_texts_of_one_template(spark):
    """300 texts at 0.7 to 0.79 of each other, and a copy at about 0.9 of every third."""
    rng = np.random.default_rng(5)
    template, rows = [f"t{i}" for i in range(260)], []
    for i in range(300):
        words = template + [f"u{i}-{k}" for k in range(int(rng.integers(36, 52)))]
        rows.append((len(rows), " ".join(words)))
        if i % 3 == 0:
            words[-14:] = [f"v{i}-{k}" for k in range(14)]
            rows.append((len(rows), " ".join(words)))
    assert len(check(spark, rows, piece=50)) == 300


def test_pairs_at_the_bound_are_all_found(spark):
    """Eight words against the same and a ninth: 4 of 5 shingles; and longer texts just above 0.8."""
    rows = []
    for i in range(60):
        words = [f"s{i}-{k}" for k in range(8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, "more"]))]
    for i in range(60, 120):
        words = [f"l{i}-{k}" for k in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:90], *[f"m{i}-{k}" for k in range(10)]]))]
    assert len(check(spark, rows)) == 120


def test_a_passage_in_many_texts_and_a_large_group(spark):
    """A passage in every sixth text makes no bucket of all of them; 400 near copies of one text leave one."""
    rng = np.random.default_rng(8)
    passage, base = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        rows.append((i, " ".join([*words[:60], *passage, *words[60:]] if i % 6 == 0 else words)))
    for i in range(400):
        words = list(base)
        words[int(rng.integers(0, 300))] = f"c{i}"
        words[int(rng.integers(0, 300))] = f"d{i}"
        rows.append((2000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in nearcopies.without_near_copies(docs, piece=64).collect()}
    assert kept == {*range(1200), 2000}
    texts = docs.selectExpr("doc_id as rid", "cast(text as binary) as t")
    entries = nearcopies.shared_entries(texts.filter("rid < 2000"), 1200, 5, 0.8)
    assert entries.count() == 0  # the passage comes last in the order


def test_spanning_pairs_are_near_and_connect_all():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 300, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, *[codes[:100] ^ np.uint64((1 << a) | (1 << b)) for a, b in ((0, 9), (3, 40), (50, 61))]]))
    budget = Budget(((64, 3),))
    for a, b in ((codes, None), (codes[::2], codes[1::2])):
        i, j = nearcopies.spanning_pairs(a, b, budget)
        assert (np.bitwise_count(i ^ j) <= 3).all()
        every = np.sort(codes)
        near = np.bitwise_count(every[:, None] ^ every[None, :]) <= 3
        if b is not None:
            side = np.isin(every, a)
            near &= side[:, None] != side[None, :]
        labels, parent = np.arange(len(every)), {x: x for x in every.tolist()}
        while True:
            following = np.array([min(labels[row].min(initial=len(every)), labels[k]) for k, row in enumerate(near)])
            if (following == labels).all():
                break
            labels = following

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j.tolist()):
            assert root(x) != root(y)  # no cycle
            parent[max(root(x), root(y))] = min(root(x), root(y))
        assert [root(x) for x in every.tolist()] == every[labels].tolist()


def test_levels_follow_counts(spark):
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i}" if i % 5 else "the same five words here") for i in range(200)]
    texts = spark.createDataFrame(rows, "rid long, text string").repartition(6).selectExpr("rid", "cast(text as binary) as t")
    level = nearcopies.count_levels(texts, 5, 22)
    place = int(shingle_hashes(b"the same five words here", 5)[0] >> np.uint64(42))
    assert level[place] == level.max() > 3 * np.median(level[level > 0])
    assert np.count_nonzero(level) >= 150


def test_defined_cases(spark):
    docs = edge_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = nearcopies.without_near_copies(docs)
    assert out.columns == docs.columns
    groups = plain_groups([t if len(t or "") < 100_000 else "long " * 9 + t[-3:] for _, t in rows])
    kept = out.collect()
    where = {}
    for (i, t), g in zip(rows, groups):
        where.setdefault((i, t), g)
    long = [g for (_, t), g in zip(rows, groups) if len(t or "") >= 100_000]
    found = [where[r["doc_id"], r["text"]] for r in kept]
    assert len(found) == len(set(found)) and len(set(groups)) - len(set(found)) == len(set(long)) - 1
    for r in kept:
        ids = [i for (i, _), g in zip(rows, groups) if g == where[r["doc_id"], r["text"]] and i is not None]
        assert r["doc_id"] == (min(ids) if ids else None)
    assert nearcopies.without_near_copies(empty_docs(spark)).collect() == []
