"""Toxicity, quality and page languages: what they learn, and every defined case."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import edge_docs, empty_docs, sentence
from tidebar.llm import langid, quality, toxicity
from tidebar.llm.common import held_out

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=240):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randrange(20, 80)).split()
        toxic, good = i % 4 == 0, i % 3 != 0
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["dreadful", "hateful", "vile"])
        text = " ".join(words) if good else " ".join(w + rng.choice(["###", "!!"]) for w in words)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (10**6, 1, 0), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def auc(y, p):
    rank = np.argsort(np.argsort(p)) + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(y) - n1)


@pytest.mark.parametrize("module, label, settings", [
    (toxicity, "toxic", toxicity.Settings(steps=250)), (quality, "quality", quality.Settings(steps=300)),
])
def test_held_out_texts_and_edges(spark, module, label, settings):
    docs, labels = labelled(spark)
    model = module.train(docs, labels, label, settings=settings)
    scored = module.score(docs, model).withColumn("held", held_out(F.col("doc_id"))).join(labels.filter(f"{label} IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id")
    held = scored.filter("held").toPandas()
    assert len(held) > 20 and auc(held[label].values, held["score"].values) > 0.95
    if module is toxicity:  # a misspelling that was never seen
        rows = spark.createDataFrame([(1, "w1 w2 hatefull w3 w4 dreadfull w7 w8"), (2, "w1 w2 w9 w3 w4 w5 w7 w8")], "doc_id long, text string")
        p = {r["doc_id"]: r["score"] for r in module.score(rows, model).collect()}
        assert p[1] > 0.5 > p[2]
    edges = edge_docs(spark)
    out = module.score(edges, model)
    assert out.columns.count("score") == 1
    rows = out.select("doc_id", "text", "score", "row").collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if not (r["text"] or "").strip()}
    assert len(blank) == 1
    again = {(r["doc_id"], r["text"]): r["score"] for r in module.score(edges.repartition(5), model).collect()}
    assert all(again[r["doc_id"], r["text"]] == pytest.approx(r["score"], abs=1e-9) for r in rows)
    assert module.score(empty_docs(spark), model).count() == 0


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_without_labels(spark, module, label):
    docs, labels = labelled(spark, 12)
    none = module.train(docs, labels.limit(0), label)
    assert {r["score"] for r in module.score(docs, none).collect()} == {0.5}
    one = module.train(docs, spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 1, 1)], LABELS), label)
    share = {round(r["score"], 6) for r in module.score(docs, one).collect()}
    assert len(share) == 1 and share.pop() > 0.5
    nothing = module.train(empty_docs(spark), labels, label)
    assert module.score(docs, nothing).count() == docs.count()


def test_contexts_stay_within_texts():
    s = quality.Settings(buckets=64, width=8)
    words = np.array([3, 5, -1, 7, 9])
    table = np.zeros(64 * 8)
    places, signs = quality.index_vectors(s)
    quality.add_contexts(table, words, (places, signs), s)
    rows = table.reshape(64, 8)

    def index(w):
        out = np.zeros(8)
        np.add.at(out, places[w], signs[w])
        return out

    assert np.allclose(rows[3], index(5)) and np.allclose(rows[5], index(3)) and np.allclose(rows[7], index(9))


TEXT = {"en": "the house of the man and that thing with the other", "de": "das haus und der mann nicht von ein ist auch"}


def test_languages(spark):
    rng = random.Random(4)
    docs = [(" ".join(rng.sample(TEXT[k].split(), 8)), k) for k in ("en", "de") for _ in range(40)] + [(None, "en"), ("x", None)]
    docs = spark.createDataFrame(docs, "text string, lang string")
    page = lambda k, body, lang="": f"<!DOCTYPE html><html{lang}><head><script>var und='das';</script></head><body><p>{body}</p><!-- das -->"
    rows = [(i, f"http://{k}.example.{'de' if k == 'de' else 'org'}/x", page(k, TEXT[k], f' lang="{k}"'), "x") for i, k in enumerate(["en", "de"] * 20)]
    rows += [
        (100, "http://de.example.de/only-host", page("", ""), "x"), (101, "https://new.example.de:80/", "<html LANG=de>", "x"),
        (102, None, None, "x"), (103, "not an address", "", "x"), (104, "http://en.example.org/", page("", TEXT["de"] * 3, ' lang="en"'), "x"),
        (104, "http://en.example.org/", page("", TEXT["en"] * 20_000), "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, declared string")
    out = langid.identify(pages, docs)
    assert out.columns.count("declared") == 1
    got = {}
    for r in out.collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i in range(40):
        assert got[i][0]["language"] == ("en", "de")[i % 2] and got[i][0]["probability"] > 0.9
    assert got[100][0]["language"] == "de" and got[100][0]["declared"] is None  # by its host alone
    assert got[101][0]["language"] == "de" and got[101][0]["host"] == "new.example.de"
    assert got[102][0]["host"] is None and got[102][0]["probability"] == pytest.approx(got[103][0]["probability"])
    assert {r["text_language"] for r in got[104]} == {"en", "de"}
    assert langid.identify(pages.limit(0), docs).count() == 0
    without = langid.identify(pages, docs.limit(0)).collect()
    assert len(without) == len(rows) and {r["language"] for r in without} == {None}
