from collections import defaultdict

import pytest

from tests.llm.cases import edge_docs, empty_docs
from tidebar.llm import mixing
from tidebar.llm.common import ordered_scan


def plain_targets(sizes, epochs=3, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [n for n in names if n not in full]
        left = total - sum(epochs * sizes[n] for n in full)
        level = left / sum(weight[n] for n in rest) if rest else 0
        over = {n for n in rest if weight[n] * level > epochs * sizes[n]}
        if not over:
            return {n: epochs * sizes[n] if n in full else weight[n] * level for n in names}
        full |= over


@pytest.mark.parametrize("block", [7, 256])
def test_against_plain_targets(spark, block):
    docs = edge_docs(spark)
    out, pieces, slots = mixing.mix(docs, block=block)
    assert out.columns.count("size") == 1 and out.columns.count("taken") == 1
    rows = out.collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split())
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
    for name, words in taken.items():
        assert abs(words - want[name]) <= 1
    # every slot is used once, and the blocks of a source are whole and in order
    used = slots.groupBy("s", "k").count().filter("count <> 1").count()
    assert used == 0
    full = pieces.groupBy("s", "k").sum("words").collect()
    assert max(r[2] for r in full) == block
    again = {(r["doc_id"], r["text"], r["source"]): r["taken"] for r in mixing.mix(docs.repartition(5), block=block)[0].collect()}
    assert again == {(r["doc_id"], r["text"], r["source"]): r["taken"] for r in rows}


def test_slots_are_spread_evenly(spark):
    rows = [(i, "w " * 50, f"s{i % 2}") for i in range(400)]
    _, _, slots = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=10)
    order = [r["s"] for r in slots.orderBy("slot", "s").collect()]
    share = order.count(0) / len(order)
    for n in (50, 200, 800):
        assert abs(order[:n].count(0) - share * n) <= 4


def test_without_words_or_rows(spark):
    assert mixing.mix(empty_docs(spark))[0].count() == 0
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    rows = mixing.mix(docs)[0].collect()
    assert len(rows) == 2 and all((r["taken"], r["target"], r["size"]) == (0, 0.0, 0) for r in rows)


def test_ordered_scan(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)] + [(None, 3)], "k long, v long")
    rows = ordered_scan(df, [df.k.isNull(), df.k], ["v"], partitions=4).orderBy("position").collect()
    total = 0
    for i, r in enumerate(rows):
        assert (r["position"], r["before_v"]) == (i, total)
        total += r["v"]
    assert [r["k"] for r in rows] == [*range(50), None]
