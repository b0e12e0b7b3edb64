import numpy as np
import pandas as pd
import pytest
from helpers import bars, series, walk
from pyspark.sql import functions as F

from tidebar.operators import features as ft
from tidebar.operators import labels as lb
from tidebar.operators.indicators import REGISTRY, with_indicators
from tidebar.operators.quantiles import exact_quantiles
from tidebar.operators.selection import greedy_select
from tidebar.operators.timeline import (
    KEYS,
    Layout,
    chunked,
    core_rows,
    ewm,
    positioned,
    prefix_scan,
    time_bucket,
)
from tidebar.sources.bars import numbered, numbered_with_obv


def close_to(a, b, tol=1e-8):
    a, b = np.asarray(a, float), np.asarray(b, float)
    assert (np.isnan(a) == np.isnan(b)).all()
    np.testing.assert_allclose(a, b, rtol=tol, atol=tol, equal_nan=True)


@pytest.fixture(scope="module")
def indicators(spark):
    return series(with_indicators(bars(spark, walk())))


def test_averages_match_recursion(indicators):
    c = indicators["close"]
    for n in (9, 21, 50, 200):
        close_to(indicators[f"ema_{n}"], c.ewm(span=n, adjust=False).mean())
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    close_to(indicators["macd_hist"], macd - macd.ewm(span=9, adjust=False).mean())


def test_warm_up_rows(indicators):
    first = {c: indicators[c].first_valid_index() for c in
             ("rsi", "atr", "adx", "vol_20", "vol_pct", "sma_50", "stoch_d", "roc_20")}
    assert first == {"rsi": 14, "atr": 13, "adx": 27, "vol_20": 20, "vol_pct": 119,
                     "sma_50": 49, "stoch_d": 15, "roc_20": 20}
    assert indicators["rsi"].dropna().between(0, 100).all()


def test_rank_and_obv(indicators):
    close_to(indicators["vol_pct"], indicators["vol_20"].rolling(100).rank(pct=True))
    step = np.sign(indicators["close"].diff()).fillna(0) * indicators["volume"]
    close_to(indicators["obv"], step.cumsum())


def test_small_chunks_equal_one_chunk(spark):
    pdf = walk(n=9000, symbols=("A",))
    df = bars(spark, pdf)
    whole = series(with_indicators(df, Layout(rows=20000)))
    cut = series(with_indicators(df, Layout(rows=4400, back=4352)))
    assert len(whole) == len(cut) == 9000
    for c in [*REGISTRY, "ema_200", "sma_200", "obv"]:
        close_to(whole[c], cut[c], 1e-9)


def test_block_size_does_not_matter(spark):
    df = numbered(bars(spark, walk(n=3000, symbols=("A",))))
    got = []
    for block in (512, 2048):
        lay = Layout(rows=32768, back=4352, block=block)
        got.append(series(core_rows(ewm(chunked(df, lay), {"y": ("close", 0.2, 0, 1)}, layout=lay))))
    close_to(got[0]["y"], got[1]["y"], 1e-11)


@pytest.mark.parametrize("alpha,rows,block", [(0.2, 32768, 2048), (0.2, 4400, 256), (1 / 14, 32768, 2048)])
def test_averages_over_missing_values(spark, alpha, rows, block):
    pdf = walk(n=1500, symbols=("A",))
    x = pdf.close.to_numpy().copy()
    rng = np.random.default_rng(3)
    x[rng.random(1500) < 0.1] = np.nan
    x[:4] = np.nan
    x[700:760] = np.nan
    pdf["x"] = x
    lay = Layout(rows=rows, back=4352, ahead=0, block=block)
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    df = chunked(positioned(df, KEYS, F.lit(0), ["ts"]), lay)
    got = series(core_rows(ewm(df, {"y": ("x", alpha, 2, 5)}, layout=lay, gaps=("y",))))
    y = pdf.x.where(pdf.index >= 2).ewm(alpha=alpha, adjust=False, min_periods=5).mean()
    close_to(got["y"], y)


def test_no_feature_sees_the_future(spark):
    pdf = walk(n=260, symbols=("A",))
    full = series(ft.with_features(bars(spark, pdf)))
    part = series(ft.with_features(bars(spark, pdf.iloc[:200])))
    for c in ft.BASE_FEATURES:
        close_to(full[c].iloc[:200], part[c], 1e-9)


def test_closed_alignment_never_uses_a_running_bar(spark):
    base = bars(spark, walk(n=50, symbols=("A",))).select("symbol", "ts", "close")
    ctx = base.filter("hour(ts) % 4 = 0").select("symbol", "ts", F.col("ts").alias("seen"))
    for align, wait in (("open", 0), ("close", 4)):
        got = series(ft.join_context(base, ctx, ["seen"], "4h", align)).dropna()
        assert ((got["ts"] - got["seen"]) >= pd.Timedelta(hours=wait)).all()
        assert ((got["ts"] - got["seen"]) < pd.Timedelta(hours=wait + 4)).all()


def test_positions_with_many_buckets(spark):
    df = bars(spark, walk(n=300)).withColumn("x", F.hash("ts") % 10)
    got = positioned(df, KEYS, time_bucket(7 * 3600), ["ts"])
    for s in ("A", "B"):
        assert (series(got, s)["pos"] == np.arange(300)).all()
    scan = prefix_scan(
        df.withColumn("b", time_bucket(7 * 3600)),
        {"total": ("sum", F.col("close")), "top": ("max", F.col("high")),
         "held": ("last", F.when(F.col("x") == 0, F.col("close")))}, KEYS, "b", ["ts"])
    p = series(scan)
    close_to(p["total"], p["close"].cumsum())
    close_to(p["top"], p["high"].cummax())
    close_to(p["held"], p["close"].where(p["x"] == 0).ffill())


def test_constant_price(spark):
    pdf = walk(n=150, symbols=("A",))
    pdf[["open", "high", "low", "close"]] = 50.0
    p = series(with_indicators(bars(spark, pdf)))
    assert (p["bb_width"].dropna().abs() < 1e-9).all()
    assert (p["rsi"].dropna().abs() < 1e-6).all()


def test_short_series_has_only_warm_up(spark):
    p = series(with_indicators(bars(spark, walk(n=10, symbols=("A",)))))
    assert p["rsi"].isna().all() and p["sma_20"].isna().all() and p["ema_9"].notna().all()


@pytest.mark.parametrize("layout", [Layout(), Layout(rows=4400)])
def test_triple_barrier_against_loop(spark, layout):
    pdf = walk(n=500, symbols=("A",))
    p = series(lb.with_labels(bars(spark, pdf), "triple_barrier", 8, 1.5, layout=layout))
    ind = series(with_indicators(bars(spark, pdf)))
    want = np.zeros(len(p), int)
    for i in range(len(p) - 8):
        atr, e = ind["atr"][i], ind["close"][i]
        if not atr > 0:
            continue
        for j in range(i + 1, i + 9):
            up, down = ind["high"][j] >= e + 1.5 * atr, ind["low"][j] <= e - 1.5 * atr
            if up or down:
                want[i] = (1 if ind["close"][j] >= e else 2) if up and down else (1 if up else 2)
                break
    assert (p["label"].to_numpy() == want).all() and (p["label"].iloc[-8:] == 0).all()


def test_labels_over_chunk_borders(spark):
    pdf = walk(n=900, symbols=("A",))
    df = bars(spark, pdf)
    for method in ("vol_adaptive", "fixed"):
        a = series(lb.with_labels(df, method, layout=Layout(rows=2000, back=100)))
        b = series(lb.with_labels(df, method, layout=Layout(rows=150, back=100)))
        assert (a["label"] == b["label"]).all()


def test_unknown_label_method(spark):
    with pytest.raises(ValueError):
        lb.with_labels(bars(spark, walk(n=5)), "nope")


@pytest.mark.parametrize("limit", [None, 3])
def test_greedy_selection_against_loop(spark, limit):
    rng = np.random.default_rng(3)
    rows = []
    for k in ("A", "B"):
        for e in np.flatnonzero(rng.random(3000) < 0.4):
            rows.append((k, int(e), int(e + rng.integers(1, 13))))
    df = spark.createDataFrame(rows, "k string, e long, f long")
    size = 40
    got = greedy_select(df, ["k"], "e", "f", 13, group=F.floor(F.col("e") / size), limit=limit,
                        fan=5).toPandas()
    want = []
    for k in ("A", "B"):
        free, group, n = -1, None, 0
        for kk, e, f in sorted(r for r in rows if r[0] == k):
            if e // size != group:
                group, n = e // size, 0
            if e >= free and (limit is None or n < limit):
                want.append((k, e, f))
                free, n = f, n + 1
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(want)


def test_obv_needs_previous_bucket(spark):
    p = series(numbered_with_obv(bars(spark, walk(n=300, symbols=("A",))), bucket_bars=11))
    step = np.sign(p["close"].diff()).fillna(0) * p["volume"]
    close_to(p["obv"], step.cumsum())
    assert (p["pos"] == np.arange(300)).all()


def test_rolling_needs_every_value(spark):
    pdf = walk(n=300, symbols=("A",))
    pdf.loc[[60, 61, 200], ["volume", "high"]] = np.nan
    holes = bars(spark, pdf)
    for c in ("volume", "high"):
        holes = holes.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    got = series(with_indicators(holes))
    assert got["volume_ratio"].isna().sum() > 0
    ready = pdf["volume"].rolling(20).count() == 20
    assert (got["volume_ratio"].notna() == ready).all()
    top = pdf["high"].rolling(14).max()
    assert (got["stoch_k"].notna() == top.notna()).all()


def test_bars_are_hashed_not_sorted(spark):
    from tidebar.sources import bars as src

    ticks = spark.range(100).selectExpr(
        "'A' AS s", "double(id + 1) AS p", "timestamp_seconds(id * 60) AS t", "id AS tie")
    built = src.build_bars(ticks, "s", "p", "t", "tie", "1h")
    assert "Sort" not in built._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in src.upsert(built, built)._jdf.queryExecution().executedPlan().toString()
    first = built.orderBy("ts").first()
    assert (first["open"], first["close"], first["high"], first["volume"]) == (1.0, 60.0, 60.0, 60.0)
    same = spark.createDataFrame(
        [("A", 3.0, 0, 2), ("A", 5.0, 0, 1), ("A", 4.0, 0, 3)], "s string, p double, t long, tie long")
    one = src.build_bars(same.withColumn("t", F.timestamp_seconds("t")), "s", "p", "t", "tie", "1h").first()
    assert (one["open"], one["close"]) == (5.0, 4.0)


def test_last_of_several_new_bars_wins(spark):
    from tidebar.sources import bars as src

    old = bars(spark, walk(n=3, symbols=("A",)))
    new = old.limit(1).withColumn("close", F.lit(1.0)).withColumn("seq", F.lit(1)).unionByName(
        old.limit(1).withColumn("close", F.lit(2.0)).withColumn("seq", F.lit(7)))
    rows = src.upsert(old, new, seq="seq").orderBy("ts").collect()
    assert len(rows) == 3 and rows[0]["close"] == 2.0


@pytest.mark.parametrize("together", [20_000, 300])
def test_quantiles_of_any_span(spark, together):
    rng = np.random.default_rng(6)
    pdf = pd.concat([
        pd.DataFrame({"k": "wide", "x": rng.normal(size=6000) ** 3}), pd.DataFrame({"k": "ties", "x": rng.integers(0, 4, 5000) * 1.5}),
        pd.DataFrame({"k": "spike", "x": np.r_[np.zeros(3000), rng.normal(size=2000)]}), pd.DataFrame({"k": "few", "x": [3.0, 1.0, np.nan]}),
        pd.DataFrame({"k": "none", "x": [np.nan]}),
    ])
    probs = {"a": 0.0, "b": 0.05, "c": 0.3, "d": 0.5, "e": 0.999, "f": 1.0}
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None))).repartition(7)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "x", probs, together).collect()}
    want = pdf.dropna().groupby("k").x.quantile(list(probs.values())).unstack()
    assert set(got) == {"wide", "ties", "spike", "few"}
    for k in got:
        np.testing.assert_allclose([got[k][n] for n in probs], want.loc[k], rtol=1e-12, atol=1e-15)
    assert exact_quantiles(df.limit(0), ["k"], "x", probs).collect() == []
