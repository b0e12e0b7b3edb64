import threading

import numpy as np
import pandas as pd
import pytest

from tidebar.plans import boosting as bo
from tidebar.plans import training as tr

NAMES = [f"f{i}" for i in range(6)]


def rows(n=2000, seed=0, models=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(NAMES)))
    x[:, 5] = rng.integers(0, 4, n)
    score = np.stack([np.zeros(n), x[:, 0] + x[:, 5] * 0.5, x[:, 1] * x[:, 2]], axis=1) + rng.normal(size=(n, 3)) * 0.3
    pdf = pd.DataFrame(x, columns=NAMES)
    pdf["label"] = score.argmax(axis=1)
    pdf["weight"] = np.where(pdf.label == 0, 1.5, 0.75)
    pdf["id"] = rng.permutation(n)
    pdf["_tail"] = np.arange(n) >= int(n * 0.8)
    pdf["fold"] = np.arange(n) % models
    return pdf


def plain(pdf, cuts, cfg):
    """One model by masks over rows and loops over nodes, features and bins."""
    head = pdf[~pdf._tail]
    x = {k: np.stack([np.searchsorted(c, d[f].to_numpy()) for f, c in zip(NAMES, cuts)], axis=1) for k, d in (("head", head), ("tail", pdf[pdf._tail]))}
    y, w = head.label.to_numpy(), head.weight.to_numpy()
    tail = pdf[pdf._tail]
    margins = {"head": np.zeros((len(head), 3)), "tail": np.zeros((len(tail), 3))}
    losses, rounds = [], []
    for round_ in range(cfg.rounds + 1):
        e = np.exp(margins["tail"] - margins["tail"].max(axis=1, keepdims=True))
        p = (e / e.sum(axis=1, keepdims=True))[np.arange(len(tail)), tail.label]
        losses.append(float(np.sum(-np.log(p) * tail.weight.to_numpy()) / tail.weight.sum()))
        if round_ == cfg.rounds or len(losses) > 1 and losses[-2] - losses[-1] < cfg.tolerance * losses[-2]:
            break
        use = bo.sampled(head.id.to_numpy(), round_, cfg)
        e = np.exp(margins["head"] - margins["head"].max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        trees = []
        for k in range(3):
            g = np.rint(w * (p[:, k] - (y == k)) * bo.UNIT).astype(np.int64)
            h = np.rint(np.maximum(2 * w * p[:, k] * (1 - p[:, k]), 1e-6) * bo.UNIT).astype(np.int64)

            def grow(mask, heads, tails, depth):
                G, H = g[mask & use].sum() / bo.UNIT, h[mask & use].sum() / bo.UNIT
                value, best = -cfg.rate * G / (H + cfg.l2), (1e-9, None, None)
                if depth < cfg.depth:
                    for f in range(len(NAMES)):
                        for b in range(cfg.bins):
                            left = mask & use & (x["head"][:, f] <= b)
                            right = mask & use & ~left
                            if left.sum() >= cfg.min_rows and right.sum() >= cfg.min_rows:
                                gain = -(G**2) / (H + cfg.l2)
                                for side in (left, right):
                                    gain += (g[side].sum() / bo.UNIT) ** 2 / (h[side].sum() / bo.UNIT + cfg.l2)
                                if gain > best[0]:
                                    best = (gain, f, b)
                if best[1] is None:
                    return {"head": np.where(heads, value, 0.0), "tail": np.where(tails, value, 0.0)}
                _, f, b = best
                lh, lt = x["head"][:, f] <= b, x["tail"][:, f] <= b
                one = grow(mask & lh, heads & lh, tails & lt, depth + 1)
                two = grow(mask & ~lh, heads & ~lh, tails & ~lt, depth + 1)
                return {s: one[s] + two[s] for s in one}

            trees.append(grow(np.ones(len(head), bool), np.ones(len(head), bool), np.ones(len(tail), bool), 0))
        for k, t in enumerate(trees):
            for s in margins:
                margins[s][:, k] += t[s]
        rounds.append({s: m.copy() for s, m in margins.items()})
    best = int(np.argmin(losses))
    return losses, rounds[best - 1] if best else {s: np.zeros_like(m) for s, m in margins.items()}, best


def test_models_of_all_folds_match_plain_numpy(spark):
    pdf, cfg = rows(), bo.BoostConfig(rounds=4, depth=3, bins=16, rate=0.3, tolerance=1e-4)
    found = bo.boost(spark.createDataFrame(pdf).repartition(5), NAMES, cfg)
    again = bo.boost(spark.createDataFrame(pdf).repartition(2), NAMES, cfg)
    assert set(found) == {0, 1}
    for fold, model in found.items():
        assert model.to_json() == again[fold].to_json()
        own = pdf[pdf.fold == fold]
        losses, margins, best = plain(own, model.cuts, cfg)
        np.testing.assert_allclose(model.losses, losses, rtol=1e-6)
        assert len(model.rounds) == best == 4
        for side, part in (("head", own[~own._tail]), ("tail", own[own._tail])):
            np.testing.assert_allclose(model.margins(part[NAMES].to_numpy()), margins[side], atol=1e-9)
        right = (model.margins(own[own._tail][NAMES].to_numpy()).argmax(axis=1) == own[own._tail].label).mean()
        assert right > 0.6


def test_models_end_when_the_tail_gains_no_more(spark):
    pdf = rows(600, seed=1, models=1)
    pdf["label"] = np.random.default_rng(2).integers(0, 3, len(pdf))  # nothing to learn
    model = bo.boost(spark.createDataFrame(pdf), NAMES, bo.BoostConfig(rounds=50))[0]
    assert len(model.losses) < 10 and len(model.rounds) == int(np.argmin(model.losses))


def test_margins_survive_written_states(spark, monkeypatch):
    pdf, cfg = rows(400, seed=3, models=1), bo.BoostConfig(rounds=5, depth=2, bins=8, tolerance=-1.0)
    a = bo.boost(spark.createDataFrame(pdf), NAMES, cfg)[0]
    monkeypatch.setattr(bo, "WRITE_EVERY", 2)
    assert bo.boost(spark.createDataFrame(pdf), NAMES, cfg)[0].to_json() == a.to_json()


def test_models_of_several_blocks_are_the_same(spark, monkeypatch):
    pdf, cfg = rows(900), bo.BoostConfig(rounds=3, depth=3, bins=8, tolerance=-1.0)
    pdf.loc[::9, "id"] = 5  # an id that repeats
    whole = bo.boost(spark.createDataFrame(pdf), NAMES, cfg)
    monkeypatch.setattr(bo, "SLICE", 70)
    parts = bo.boost(spark.createDataFrame(pdf).repartition(3), NAMES, cfg)
    assert {g: m.to_json() for g, m in parts.items()} == {g: m.to_json() for g, m in whole.items()}


def test_forests_do_not_wait_for_the_boosting(spark, monkeypatch):
    begun, fit, boost = threading.Event(), tr.RandomForestClassifier.fit, tr.boost

    def fitted(*args):
        begun.set()
        return fit(*args)

    def boosted(*args):
        assert begun.wait(120)
        return boost(*args)

    monkeypatch.setattr(tr.RandomForestClassifier, "fit", fitted)
    monkeypatch.setattr(tr, "boost", boosted)
    pdf = rows(700, models=1).drop(columns=["id", "weight", "_tail", "fold"])
    pdf["symbol"], pdf["row_ix"], pdf["close"] = "A", np.arange(700), 100.0 + np.arange(700) % 7
    pdf["timeframe"], pdf["ts"] = "5m", pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf.row_ix * 5, unit="min")
    cfg = tr.EnsembleConfig(boost_rounds=3, boost_depth=2, forest_trees=3, forest_depth=3)
    folds, _ = tr.walk_forward_ensemble(spark.createDataFrame(pdf), NAMES, cfg, n_splits=2)
    assert [r["fold"] for r in folds.orderBy("fold").collect()] == [1, 2]


def test_scores_and_storage(spark):
    pdf = rows(300, models=1)
    df = spark.createDataFrame(pdf)
    model = bo.boost(df, NAMES, bo.BoostConfig(rounds=3, depth=2))[0]
    other = bo.BoostedTrees.from_json(model.to_json())
    p = np.array([r[0] for r in df.select("id", other.probabilities().alias("p")).orderBy("id").select("p").collect()])
    want = bo.softmax(model.margins(pdf.sort_values("id")[NAMES].to_numpy()))
    np.testing.assert_allclose(p, want, rtol=1e-12)


@pytest.mark.parametrize("change", ["one class", "no tail", "missing", "constant"])
def test_odd_rows(spark, change):
    pdf = rows(200, models=1)
    if change == "one class":
        pdf["label"] = 1
    if change == "no tail":
        pdf["_tail"] = False
    if change == "missing":
        pdf.loc[::7, "f0"] = np.nan
    if change == "constant":
        pdf[NAMES] = 1.0
    model = bo.boost(spark.createDataFrame(pdf), NAMES, bo.BoostConfig(rounds=2, depth=2))[0]
    p = bo.softmax(model.margins(pdf[NAMES].to_numpy()))
    assert np.isfinite(p).all() and p.shape == (200, 3)
    if change == "no tail":
        assert len(model.rounds) == 2 and model.losses == []
    if change == "one class":
        assert (p.argmax(axis=1) == 1).all()


def test_no_rows(spark):
    assert bo.boost(spark.createDataFrame(rows(10)).filter("id < 0"), NAMES) == {}


def test_training_of_symbols(spark):
    """The whole way of one symbol: guards, folds, last fit."""
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame(rng.normal(size=(2 * n, 3)), columns=NAMES[:3])
    pdf["symbol"] = ["A"] * n + ["B"] * n
    pdf["row_ix"] = list(range(n)) * 2
    pdf["label"] = np.where(pdf.f0 > 0.6, 1, np.where(pdf.f0 < -0.6, 2, 0))
    pdf.loc[pdf.symbol == "B", "label"] = 1  # no hold labels
    pdf["close"] = 100 + np.cumsum(rng.normal(size=2 * n)) * 0.1
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf.row_ix * 5, unit="min")
    pdf["timeframe"] = "5m"
    cfg = tr.EnsembleConfig(boost_rounds=5, boost_depth=2, forest_trees=3, forest_depth=3)
    found = {r["symbol"]: r for r in tr.train_symbols(spark.createDataFrame(pdf), ["A", "B", "C"], NAMES[:3], cfg, n_splits=2)}
    assert found["B"]["status"] == "too few hold labels" and found["C"]["status"] == "too few rows"
    assert found["A"]["status"] == "trained" and found["A"]["rows"] == n and found["A"]["mean_accuracy"] > 0.8
    scored = found["A"]["model"].score(spark.createDataFrame(pdf).filter("symbol = 'A'"))
    assert scored.filter("y_pred = label").count() > 0.85 * n
