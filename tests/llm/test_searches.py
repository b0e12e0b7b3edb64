import numpy as np
import pytest

from tidebar.llm import ann, topk

NAN = float("nan")


def vectors(spark, n=600, seed=0, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.6).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(hot)]  # copies of one vector
    rows += [(100, rows[100][1]), (100, rows[101][1])]  # an id that comes again
    bad = [(None, rows[0][1]), (5000, None), (5050, [NAN] * 16), (5100, [None] * 16), (5150, [1.0] * 3), (5200, [float("inf")] * 16)]
    zero = [(5250, [0.0] * 16), (5300, [0.0] * 16)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad + zero], "vec_id long, embedding array<float>, score string")
    return df.repartition(4), rows, zero


@pytest.mark.parametrize("n, block", [(1, 8192), (300, 8192), (900, 64)])
def test_segment_index(n, block):
    rng = np.random.default_rng(n)
    codes = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    index = topk.SegmentIndex(codes)
    for q in [*codes[:20], *rng.integers(0, 2**63, 20, dtype=np.uint64)]:
        at, distance = index.nearest(int(q), 7)
        want = np.bitwise_count(codes ^ q).astype(int)
        kth = np.sort(want)[min(7, len(codes)) - 1]
        assert set(at) == set(np.flatnonzero(want <= kth)) and (want[at] == distance).all()


def test_code_search_is_exact(spark):
    df, rows, zero = vectors(spark, hot=40)
    found = {}
    for r in topk.nearest_codes(df, k=7, block=50).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    usable = rows + zero
    ids = np.array([i for i, _ in usable])
    bits = np.array([v for _, v in usable]) >= 0
    queries = sorted({i for i in ids if i % 50 == 0 and i != 100})
    assert set(found) == {*queries, 100}
    for q in queries:
        apart = (bits != bits[np.flatnonzero(ids == q)[0]]).sum(axis=1)
        order = [i for i in np.lexsort((ids, apart)) if ids[i] != q][:7]
        assert [(n + 1, ids[i], apart[i]) for n, i in enumerate(order)] == found[q]
    assert len(found[100]) == 21 and all(v != 100 for _, v, _ in found[100])  # the three rows of that id


def test_vector_search(spark):
    df, rows, _ = vectors(spark, n=2000, hot=60)
    settings = ann.Settings(leaf_rows=20, block=32, chunk=8, trial=50, sample=500)
    found = {}
    for r in ann.nearest(df, settings=settings).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=np.float64)
    lengths = np.sqrt((v * v).sum(axis=1))
    hit = total = 0
    for q in sorted({i for i in ids if i % 50 == 0 and i != 100}):
        at = np.flatnonzero(ids == q)[0]
        cosine = (v * v[at]).sum(axis=1) / (lengths * lengths[at])
        order = [i for i in np.lexsort((ids, -np.round(cosine, 12))) if ids[i] != q][:5]
        got = found[q]
        assert len(got) == 5 and q not in [i for i, _ in got]
        assert [(-s, i) for i, s in got] == sorted((-s, i) for i, s in got)
        for i, s in got:
            assert s == pytest.approx(max(cosine[ids == i]), abs=1e-12)
        hit, total = hit + len({i for i, _ in got} & set(ids[order])), total + 5
    assert hit >= 0.9 * total
    # a copy's neighbours are the other copies with the smallest ids
    assert [i for i, _ in found[2050]] == [3, 2000, 2001, 2002, 2003]


def test_an_id_that_comes_many_times_loses_no_answer(spark):
    schema = "vec_id long, embedding array<float>"
    one, near = [1.0, 0.5, 0.25, 0.125], [-1.0, 2.0, 1.0, 1.0]
    rows = [(0, one)] * 12 + [(i, one) for i in range(1, 21)] + [(3, one)] * 4 + [(i, near) for i in range(21, 40)]
    rows += [(50, [1.0 + i, -3.0 * i, 2.0, -1.0]) for i in range(1, 9)] + [(51, [1.0, -3.0, 2.0, -1.0])]  # an id with many vectors
    df = spark.createDataFrame(rows, schema).repartition(3)
    for found, k in ((ann.nearest(df, k=5), 5), (topk.nearest_codes(df, k=10), 10)):
        of = {}
        for r in found.orderBy("rank").collect():
            of.setdefault(r["query_id"], []).append(r["vec_id"])
        want = [1, 2, 3, 3, 3, 3, 3, 4, 5, 6][:k]
        assert len(of[0]) == 12 * k and sorted(of[0]) == sorted(want * 12)
        assert len(of[50]) == 8 * k and 50 not in of[50]


def test_small_leaves_give_all_answers(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 16))
    rows = [(i, (centres[i % 300] + rng.normal(size=16) * 1e-3).astype(np.float32).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.nearest(df, settings=ann.Settings(leaf_rows=2)).groupBy("query_id").count().collect()
    assert len(out) == 120 and {r["count"] for r in out} == {5}


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert topk.nearest_codes(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], schema)
    assert [tuple(r)[:3] for r in ann.nearest(two).collect()] == [(0, 1, 1)]
    assert [tuple(r) for r in topk.nearest_codes(two).collect()] == [(0, 1, 1, 0)]


def test_tree_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    sample = ann.unit(rng.normal(size=(800, 8)))
    tree = ann.Tree(sample, 50, ann.Settings())
    assert tree.leaves > 20
    order = tree.visits(sample[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and order[: 3] == tree.visits(sample[0], 3)
    assert set(tree.assign(sample)) <= set(order)
