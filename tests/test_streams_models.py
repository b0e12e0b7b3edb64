import numpy as np
import pytest
from helpers import bars, walk
from pyspark.sql import functions as F

from tidebar.operators import features as ft
from tidebar.operators import signals as sg
from tidebar.plans import training as tr
from tidebar.session import cut_lineage
from tidebar.operators.indicators import with_indicators
from tidebar.sources.bars import BAR_SCHEMA
from tidebar.streaming import bars as sb
from tidebar.streaming import state as st
from tidebar.streaming.publish import Published

FEATURES = ["rsi", "macd_hist", "bb_pct", "adx", "return_5", "volume_ratio"]


def blend(spark, n=120):
    rng = np.random.default_rng(4)
    pdf = walk(n=n)[["symbol", "timeframe", "ts"]]
    pdf["pos"] = np.tile(np.arange(n), 2)
    pdf["raw_long"] = rng.uniform(0.1, 0.6, 2 * n)
    pdf["raw_short"] = rng.uniform(0.1, 0.4, 2 * n)
    pdf["raw_regime"] = rng.choice(["RANGE", "TRENDING"], 2 * n)
    df = spark.createDataFrame(pdf).selectExpr(
        "*", "greatest(0D, 1 - raw_long - raw_short) AS raw_hold")
    return df.selectExpr("*", f"{sg._pick('raw_long', 'raw_short', 'raw_hold')} AS raw_signal",
                         "'AGREE' AS agreement")


def as_stream(spark, df, tmp_path, parts=3):
    path = str(tmp_path / "in")
    df.repartition(1).sortWithinPartitions("ts").write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_smoothing_state_equals_batch(spark, tmp_path):
    df = blend(spark)
    batch = sg.smooth(df).toPandas().set_index(["symbol", "ts"]).sort_index()
    stream = sb.drain(st.stream_signals(as_stream(spark, df, tmp_path).drop(
        "timeframe", "pos", "raw_hold", "agreement")), "signals").toPandas()
    stream = stream.set_index(["symbol", "ts"]).sort_index()
    np.testing.assert_allclose(stream["ema_long"], batch["ema_long"], rtol=1e-9)
    np.testing.assert_allclose(stream["ema_short"], batch["ema_short"], rtol=1e-9)
    raw = df.toPandas().sort_values(["symbol", "ts"])
    for s, g in raw.groupby("symbol"):
        held, last, want = "RANGE", None, []
        for r in g.raw_regime:
            held = r if r == last else held
            last = r
            want.append(held)
        assert stream.loc[s]["regime"].tolist() == want


def test_scored_sink_evaluates_each_bar_once(spark, tmp_path):
    """Three batches after stored history: scores as over the whole series, history read once, replays change nothing."""
    src = bars(spark, walk(n=240)).select(*[f.name for f in BAR_SCHEMA])
    stamps = sorted(r[0] for r in src.select("ts").distinct().collect())
    past, path, folder = src.filter(F.col("ts") < stamps[150]), str(tmp_path / "in"), str(tmp_path / "out")
    for lo, hi in ((150, 180), (180, 181), (181, 240)):
        src.filter(F.col("ts").between(stamps[lo], stamps[hi - 1])).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(path)
    asked = []

    def score(df):
        asked.append(df.count())
        return df.select("symbol", "ts", "rsi", "sma_50")

    sb.scored_sink(stream, folder, score, past).awaitTermination()
    schema = "symbol string, ts timestamp, rsi double, sma_50 double"
    scores = Published(spark, f"{folder}/scores")
    got = scores.read(schema).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = with_indicators(src).filter(F.col("ts") >= stamps[150]).select("symbol", "ts", "rsi", "sma_50").toPandas()
    want = want.sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert asked == [60, 2, 118] and len(got) == 180 and (got.ts == want.ts).all()
    np.testing.assert_allclose(got[["rsi", "sma_50"]], want[["rsi", "sma_50"]], rtol=1e-9)
    assert len(Published(spark, f"{folder}/tails").batches()) <= 2
    # the last batch comes again after its note was lost, and once more after it was written
    fs, at = scores._file("log", "scores", 2)
    fs.delete(at, False)
    assert scores.read(schema).count() == 62
    again = cut_lineage(scores.read(schema, [("scores", 2)]))
    assert scores.publish(again, "scores", 2) and not scores.publish(again.limit(1), "scores", 2)
    assert scores.read(schema).count() == 180 and scores.read(schema).distinct().count() == 180


def test_a_failed_batch_leaves_no_rows(spark, tmp_path):
    table = Published(spark, str(tmp_path / "t"))
    rows = spark.range(1000).repartition(40)
    staged = table.stage(rows)  # joined into few files
    fs, at = table._file("staging", staged)
    assert fs.getContentSummary(at).getFileCount() <= 3
    table.move(staged, "q", 0)  # the failure comes before the note
    assert table.batches() == [] and table.read("id long").count() == 0
    assert table.publish(rows, "q", 0) and not table.publish(rows.limit(3), "q", 0)
    assert table.publish(spark.range(5), "q", 1)
    assert table.read("id long").count() == 1005 and table.batches() == [("q", 0), ("q", 1)]
    table.forget("q", 1)
    assert table.read("id long").count() == 5


def test_log_sink(spark, tmp_path):
    logs = spark.sql(
        "SELECT 'INFO' AS level, 'core.risk.x' AS logger, concat('m', id) AS message, "
        "map('k', 'v') AS context, '2024-01-01 00:00:00' AS logged_at, current_timestamp() AS ts "
        "FROM range(40)")
    q = sb.log_sink(as_stream(spark, logs, tmp_path).drop("ts"), str(tmp_path / "logs"))
    q.awaitTermination()
    got = Published(spark, str(tmp_path / "logs"), "json").read("channel string, message string")
    assert got.count() == 40 and got.select("channel").distinct().collect() == [("bot",)]


@pytest.fixture(scope="module")
def frame(spark):
    df = tr.training_frame(bars(spark, walk(n=420)), future_bars=8, atr_mult=1.5)
    return cut_lineage(df.select("symbol", "timeframe", "ts", "row_ix", "close", "label", *FEATURES))


def test_training_rows_are_complete_and_numbered(frame):
    pdf = frame.toPandas()
    assert not pdf.isna().any().any()
    for _, g in pdf.groupby("symbol"):
        assert sorted(g.row_ix) == list(range(len(g)))
        assert len(g) == 420 - 119 - 8


def test_ensemble_save_load_and_registry(spark, frame, tmp_path):
    cfg = tr.EnsembleConfig(boost_rounds=1, boost_depth=2, forest_trees=3, forest_depth=3)
    model = tr.fit_ensemble(frame, FEATURES, cfg)
    a = model.score(frame).orderBy("symbol", "ts").toPandas()
    p = np.array(a["proba"].tolist())
    np.testing.assert_allclose(p.sum(axis=1), 1.0)
    assert (p.argmax(axis=1) == a["y_pred"]).all()
    path = str(tmp_path / "model")
    tr.save_model(model, path)
    b = tr.load_model(spark, path).score(frame).orderBy("symbol", "ts").toPandas()
    np.testing.assert_allclose(p, np.array(b["proba"].tolist()))
    assert model.importance(spark, 3).count() == 3
    # a frame without one of the features counts it as 0
    assert model.score(frame.drop("adx")).count() == len(a)

    reg = str(tmp_path / "registry")
    row = dict(symbol="A", path=path, wf_sharpe=0.5, wf_f1=0.4, bars_trained=1,
               date_range="", feature_names=FEATURES)
    for v, ok, day in (("1", True, "2024-01-01"), ("2", True, "2024-01-02"),
                       ("3", False, "2024-01-03")):
        stamp = spark.sql(f"SELECT timestamp '{day}' AS t").first()["t"]
        tr.register_model(spark, reg, {**row, "version": v, "wf_accepted": ok,
                                       "trained_at": stamp})
    active = tr.active_models(spark, reg)
    assert [r["version"] for r in active.collect()] == ["2"]
    score = sb.registry_scorer(reg)
    rows = frame.filter("symbol = 'A'")
    assert score(rows).select("version").distinct().collect() == [("2",)]
    stamp = spark.sql("SELECT timestamp '2024-01-04' AS t").first()["t"]
    tr.register_model(spark, reg, {**row, "version": "4", "wf_accepted": True,
                                   "trained_at": stamp})
    assert score(rows).select("version").distinct().collect() == [("4",)]
    # a version that cannot be loaded leaves the previous one in place
    stamp = spark.sql("SELECT timestamp '2024-01-05' AS t").first()["t"]
    tr.register_model(spark, reg, {**row, "path": path + "-gone", "version": "5",
                                   "wf_accepted": True, "trained_at": stamp})
    assert score(rows).select("version").distinct().collect() == [("4",)]
    issues = tr.integrity_issues(active, [*FEATURES, "other"]).first()["issues"]
    assert issues == ["1 missing features"]


def test_walk_forward_and_validation(frame):
    cfg = tr.EnsembleConfig(boost_rounds=1, boost_depth=2, forest_trees=3, forest_depth=3,
                            calibration="sigmoid")
    folds, summary = tr.walk_forward_ensemble(frame, FEATURES, cfg, n_splits=2, gap=8, min_train=100)
    rows = folds.collect()
    assert len(rows) == 4 and all(0 <= r["accuracy"] <= 1 for r in rows)
    assert summary.count() == 2
    model = tr.fit_ensemble(frame, FEATURES, cfg)
    scored = model.score(frame).withColumnRenamed("label", "y_true")
    rep = tr.validation_report(scored.filter("row_ix >= 200"), scored.filter("row_ix < 200"))
    assert {r["status"] for r in rep.collect()} <= {"READY", "REVIEW", "ISSUES"}


def test_alignment_fills_missing_features(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, a double")
    got = ft.align_columns(df, ["a", "b"], ["id"]).first()
    assert (got["a"], got["b"]) == (2.0, 0.0)
    assert ft.FEATURES and len(ft.FEATURES) == len(set(ft.FEATURES)) == 129
    assert len(ft.ENGINEERED) == 66 and F is not None
