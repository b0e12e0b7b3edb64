"""Model training on Spark ML: feature frame, ensemble, calibration, walk-forward, registry."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import RobustScaler, RobustScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.params import LABEL_ATR_MULT
from tidebar.functions.scalar import argmax3, num, sql_lookup
from tidebar.operators import evaluation as ev
from tidebar.operators import features as ft
from tidebar.operators import labels as lb
from tidebar.operators import ledger as lg
from tidebar.operators import outcomes as oc
from tidebar.operators.indicators import with_indicators
from tidebar.operators.timeline import KEYS, LAYOUT, core_rows, positioned
from tidebar.plans.boosting import BoostConfig, BoostedTrees, boost
from tidebar.session import cut_lineage

CLASSES = (0, 1, 2)


def training_frame(base: DataFrame, context_1h: DataFrame | None = None, future_bars: int = 12,
                   atr_mult: float | None = None, align: str = "open") -> DataFrame:
    """Bars of all symbols -> key, ts, pos, close, 129 features, label.

    Indicators, features, flags and labels share one chunked shuffle; the hourly context is
    as-of joined.  Rows without complete features and the unlabeled tail are left out, and the
    remaining rows are renumbered in ``row_ix``.
    """
    layout = replace(LAYOUT, ahead=future_bars)
    mult = num(atr_mult) if atr_mult is not None else sql_lookup(LABEL_ATR_MULT, "symbol", 3.0)
    df = ft.chunked_features(base, layout)
    df = lb.triple_barrier(df, future_bars, mult)
    df = df.selectExpr("*", f"{lb.lead('close', future_bars)} IS NOT NULL AS _labeled")
    df = core_rows(df).filter("_labeled")
    df = ft.clean_features(df, [*KEYS, "ts", "pos", "close", "label"])
    names = list(ft.BASE_FEATURES)
    if context_1h is not None:
        ctx = ft.htf_1h_columns(with_indicators(context_1h))
        df = ft.join_context(df, ctx, ft.HTF_1H, "1h", align)
        names += ft.HTF_1H
    df = cut_lineage(df, "features").dropna(subset=names)
    # a missing value inside a series leaves a gap in ``pos``, so complete rows are numbered anew
    df = positioned(df, KEYS, F.floor(F.col("pos") / 4096), ["pos"], out="row_ix")
    return df.select(*KEYS, "ts", "row_ix", "close", "label",
                     *[F.col(c).cast("float").alias(c) for c in names])


@dataclass
class EnsembleConfig:
    """Sizes of the two members; weights and class weighting follow the published trainer.

    Boosting ends before ``boost_rounds`` once a round improves the loss on the held-out tail by
    less than the share ``boost_tolerance``.
    """

    boost_rounds: int = 500
    boost_rate: float = 0.1
    boost_tolerance: float = 0.001
    boost_depth: int = 5
    forest_trees: int = 200
    forest_depth: int = 10
    weights: tuple[float, float] = (0.55, 0.45)
    calibration: str = "isotonic"
    holdout: float = 0.15
    seed: int = 42
    features: list[str] = field(default_factory=list)


@dataclass
class Ensemble:
    """Scaler, weighted members and their per-class calibrators."""

    features: list[str]
    scaler: RobustScalerModel
    members: list[tuple[str, object, float]]
    calibrators: dict[str, list]

    def _member(self, df: DataFrame, name: str, model, out: str) -> DataFrame:
        made = ("rawPrediction", "probability", "prediction")
        if name == "boosted":
            return df.withColumn(out, model.probabilities())
        df = model.transform(df).withColumn(out, normalised(pad_classes(vector_to_array("probability"))))
        return df.drop(*made)

    def _calibrated(self, df: DataFrame, name: str, out: str) -> DataFrame:
        cal = self.calibrators.get(name)
        if not cal:
            return df
        parts = []
        for k, model in enumerate(cal):
            if model is None:
                parts.append(F.col(out)[k])
                continue
            df = df.withColumn(f"_x{k}", F.col(out)[k])
            if isinstance(model, IsotonicRegressionModel):
                df = model.setFeaturesCol(f"_x{k}").setPredictionCol(f"_y{k}").transform(df)
            else:
                a, b = model
                df = df.withColumn(f"_y{k}", 1.0 / (1.0 + F.exp(-(F.col(f"_x{k}") * a + b))))
            parts.append(F.col(f"_y{k}"))
        df = df.withColumn(out, normalised(F.array(*parts)))
        return df.drop(*[f"_{a}{k}" for k in CLASSES for a in "xy"])

    def score(self, df: DataFrame, calibrated: bool = True) -> DataFrame:
        """Adds ``proba``, ``y_pred``, ``confidence``; features the frame lacks count as 0."""
        keep = df.columns
        have = set(keep)
        missing = [c for c in self.features if c not in have]
        work = df.select("*", *[F.lit(0.0).alias(c) for c in missing])
        work = work.fillna(0.0, subset=self.features)
        work = VectorAssembler(inputCols=self.features, outputCol="_raw").transform(work)
        work = self.scaler.transform(work)
        total = sum(w for _, _, w in self.members)
        for name, model, _ in self.members:
            work = self._member(work, name, model, f"_p_{name}")
            if calibrated:
                work = self._calibrated(work, name, f"_p_{name}")
        vote = F.array(*[
            sum((F.col(f"_p_{n}")[k] * (w / total) for n, _, w in self.members), F.lit(0.0))
            for k in CLASSES
        ])
        return work.select(*keep, vote.alias("proba")).withColumns(
            {"y_pred": argmax3(F.col("proba")), "confidence": F.array_max("proba")})

    def importance(self, spark: SparkSession, top: int = 15) -> DataFrame:
        """Top features of the forest member."""
        forest = next(m for n, m, _ in self.members if n == "forest")
        rows = [(f, float(v)) for f, v in zip(self.features, forest.featureImportances.toArray())]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature").limit(top)


def pad_classes(p: Column) -> Column:
    """Three probabilities even if the training rows lacked the last classes."""
    return F.transform(F.array(*[F.lit(k) for k in CLASSES]),
                       lambda k: F.coalesce(F.get(p, k), F.lit(0.0)))


def normalised(p: Column) -> Column:
    s = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: F.when(s > 0, x / s).otherwise(1.0 / len(CLASSES)))


def marked_rows(train: DataFrame, cfg: EnsembleConfig, by=("symbol",), order: str = "row_ix") -> DataFrame:
    """Training rows with balanced class weights and ``_tail``, the chronological end of each key."""
    lo = train.groupBy(*by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    rows = train.join(lo, list(by))
    tail = F.col(order) > F.col("_hi") - F.floor((F.col("_hi") - F.col("_lo") + 1) * cfg.holdout)
    return lb.with_weights(rows.withColumn("_tail", tail), by=by).drop("_lo", "_hi")


def boosted_members(marked: DataFrame, features: list[str], cfg: EnsembleConfig, model: str,
                    by=("symbol",), order: str = "row_ix", cut_rows: DataFrame | None = None) -> dict[int, BoostedTrees]:
    """The boosting member of every model at once, see ``boost``."""
    rows = marked.withColumn("id", F.xxhash64(*by, order))
    settings = BoostConfig(rounds=cfg.boost_rounds, rate=cfg.boost_rate, depth=cfg.boost_depth,
                           tolerance=cfg.boost_tolerance, seed=cfg.seed)
    return boost(rows, features, settings, model, cut_rows)


def fit_ensemble(train: DataFrame, features: list[str], cfg: EnsembleConfig | None = None,
                 by=("symbol",), order: str = "row_ix",
                 boosted: BoostedTrees | Callable[[], BoostedTrees] | None = None) -> Ensemble:
    """Scale on the training rows only, fit both members with balanced class weights, and
    calibrate each on the chronological tail of the training rows.

    ``boosted``: the boosting member, where it is trained together with those of other models, or a call that
    waits for it; the other member is fitted meanwhile.
    """
    cfg = cfg or EnsembleConfig()
    rows = marked_rows(train, cfg, by, order).persist()
    try:
        if boosted is None:
            one = rows.withColumn("_model", F.lit(0))
            boosted = boosted_members(one, features, cfg, "_model", by, order).get(0)
        vec = VectorAssembler(inputCols=features, outputCol="_raw").transform(rows).select(
            "_raw", *features, "_tail", "weight", F.col("label").cast("double").alias("label"))
        head = vec.filter("NOT _tail")
        scaler = RobustScaler(inputCol="_raw", outputCol="_scaled", withCentering=True,
                              withScaling=True).fit(head)
        forest = RandomForestClassifier(
            featuresCol="_scaled", labelCol="label", weightCol="weight", minInstancesPerNode=5,
            numTrees=cfg.forest_trees, maxDepth=cfg.forest_depth, seed=cfg.seed,
        ).fit(scaler.transform(head).select("_scaled", "label", "weight"))
        boosted = boosted() if callable(boosted) else boosted
        model = Ensemble(features, scaler, [("boosted", boosted, cfg.weights[0]),
                                            ("forest", forest, cfg.weights[1])], {})
        if cfg.calibration != "none":
            model.calibrators = _calibrate(model, vec.filter("_tail"), cfg.calibration)
    finally:
        rows.unpersist()
    return model


def _calibrate(model: Ensemble, held: DataFrame, method: str) -> dict[str, list]:
    """Per member and class: isotonic or logistic map from raw to observed frequency."""
    out: dict[str, list] = {}
    held = model.scaler.transform(held)
    for name, member, _ in model.members:
        scored = model._member(held, name, member, "_p").select("label", "_p").persist()
        try:
            seen = {int(r[0]) for r in scored.select("label").distinct().collect()}
            fits = []
            for k in CLASSES:
                one = scored.select(F.col("_p")[k].alias("x"),
                                    (F.col("label") == k).cast("double").alias("label"))
                if k not in seen or len(seen) < 2:
                    fits.append(None)
                elif method == "isotonic":
                    fits.append(IsotonicRegression(featuresCol="x", labelCol="label").fit(one))
                else:
                    lr = LogisticRegression(featuresCol="v", labelCol="label", maxIter=20).fit(
                        VectorAssembler(inputCols=["x"], outputCol="v").transform(one))
                    fits.append((float(lr.coefficients[0]), float(lr.intercept)))
            out[name] = fits
        finally:
            scored.unpersist()
    return out


def money_report(pred: DataFrame, keys=("symbol", "fold")) -> DataFrame:
    """Trading metrics of predictions: close-only exits, one position at a time, compounded."""
    rows = pred.select(*keys, F.col("row_ix").alias("pos"), "close",
                       F.col("y_pred").alias("signal"))
    kept = oc.ledger(oc.fold_exits(rows, keys=keys), 11, keys, free="free_from")
    return lg.compound_metrics(kept, list(keys))


def walk_forward(
    frame: DataFrame,
    fit: Callable[[DataFrame, object], object],
    score: Callable[[object, DataFrame], DataFrame],
    n_splits: int = 5,
    gap: int = 12,
    test_size: int | None = None,
    min_train: int = 200,
    rolling: int | None = None,
    by=("symbol",),
    together: Callable[[DataFrame], dict] | None = None,
    threads: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Train and test on each fold in time order; returns (fold metrics, summary).

    ``together(train rows of all folds)`` gives what the models of all folds are trained for in common jobs,
    by fold; ``fit(train, that of its fold)`` and ``score(model, test)`` are the caller's hooks. The rows of
    the folds are written once, the folds (ten at most) are fitted at the same time, and the predictions of
    all folds are united and written once before the reports read them.
    """
    rows = cut_lineage(
        ev.assign_folds(frame, by, n_splits, gap, test_size, min_train, rolling, "row_ix"), "folds")
    keep = [*by, "fold", "row_ix", "close", "y_true", "y_pred", "confidence"]
    present = sorted(r[0] for r in rows.select("fold").distinct().collect())
    if not present:
        raise ValueError("not enough rows for a single fold")
    common = together(rows.filter("role = 'train'")) if together else {}

    def run(fold: int) -> DataFrame:
        part = rows.filter(F.col("fold") == fold)
        model = fit(part.filter("role = 'train'"), common.get(fold))
        return score(model, part.filter("role = 'test'")).withColumnRenamed("label", "y_true").select(*keep)

    with ThreadPool(threads) as pool:
        scored = pool.map(run, present)
    pred = cut_lineage(reduce(DataFrame.unionByName, scored), "predictions")
    keys = [*by, "fold"]
    empty = {c: 0.0 for c in ("sharpe", "profit_factor", "win_rate", "total_return",
                              "max_drawdown")}
    folds = ev.fold_report(pred, keys).join(
        money_report(pred, keys).drop("n"), keys, "left").fillna(empty)
    return folds, ev.fold_summary(folds, by)


def walk_forward_ensemble(frame: DataFrame, features: list[str], cfg: EnsembleConfig | None = None,
                          by=("symbol",), **folds) -> tuple[DataFrame, DataFrame]:
    """The ensemble over folds: boosting for all folds in common jobs, forests and calibration fold by fold.

    The boosting runs in a thread of its own while the forests are fitted; a fold waits for it before calibration. Cut points come from the training rows of the first fold, which are past rows in every later one.
    """
    cfg = cfg or EnsembleConfig()

    pool = ThreadPoolExecutor(max_workers=1)

    def together(train: DataFrame) -> dict[int, Callable[[], BoostedTrees]]:
        marked = cut_lineage(marked_rows(train, cfg, [*by, "fold"]), "marked")
        present = [r[0] for r in marked.select("fold").distinct().collect()]
        past = marked.filter(F.col("fold") == min(present))
        found = pool.submit(boosted_members, marked, features, cfg, "fold", by, cut_rows=past)
        return {fold: lambda fold=fold: found.result().get(fold) for fold in present}

    with pool:
        return walk_forward(
            frame, lambda train, boosted: fit_ensemble(train, features, cfg, by, boosted=boosted),
            lambda model, test: model.score(test), by=by, together=together, **folds)


def train_symbol(frame: DataFrame, symbol: str, features: list[str],
                 cfg: EnsembleConfig | None = None, min_rows: int = 800, **folds) -> dict:
    """End-to-end training of one symbol: guards, walk-forward verdict, final fit."""
    rows = frame.filter(F.col("symbol") == symbol)
    dist = lb.label_distribution(rows).first()
    if dist is None or dist["n_total"] < min_rows:
        return {"symbol": symbol, "status": "too few rows"}
    if dist["hold_pct"] < 20:
        return {"symbol": symbol, "status": "too few hold labels"}
    _, summary = walk_forward_ensemble(rows, features, cfg, **folds)
    line = summary.first().asDict()
    model = fit_ensemble(rows, features, cfg)
    return {"symbol": symbol, "status": "trained", "model": model, "rows": dist["n_total"],
            **{k: v for k, v in line.items() if k != "symbol"}}


def train_symbols(frame: DataFrame, symbols: list[str], features: list[str],
                  cfg: EnsembleConfig | None = None, threads: int = 4, **kw) -> list[dict]:
    """Several symbols at once on one session; their Spark jobs interleave."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(lambda s: train_symbol(frame, s, features, cfg, **kw), symbols))


# --- stored models ---------------------------------------------------------------------------


def save_model(model: Ensemble, path: str) -> None:
    spark = SparkSession.active()
    model.scaler.write().overwrite().save(f"{path}/scaler")
    meta: dict = {"features": model.features, "members": [], "calibrators": {}}
    for name, member, weight in model.members:
        if name == "boosted":
            spark.createDataFrame([(member.to_json(),)], "model string").coalesce(1).write.mode(
                "overwrite").text(f"{path}/{name}")
        else:
            member.write().overwrite().save(f"{path}/{name}")
        meta["members"].append([name, weight])
    for name, fits in model.calibrators.items():
        kinds = []
        for k, m in enumerate(fits):
            if isinstance(m, IsotonicRegressionModel):
                m.write().overwrite().save(f"{path}/calibration-{name}-{k}")
                kinds.append("isotonic")
            else:
                kinds.append(m)
        meta["calibrators"][name] = kinds
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Ensemble:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    members = [
        (n, BoostedTrees.from_json(spark.read.text(f"{path}/{n}", wholetext=True).first()[0])
         if n == "boosted" else RandomForestClassificationModel.load(f"{path}/{n}"), w)
        for n, w in meta["members"]
    ]
    cal = {
        name: [
            IsotonicRegressionModel.load(f"{path}/calibration-{name}-{k}") if m == "isotonic"
            else (tuple(m) if m else None)
            for k, m in enumerate(kinds)
        ]
        for name, kinds in meta["calibrators"].items()
    }
    return Ensemble(meta["features"], RobustScalerModel.load(f"{path}/scaler"), members, cal)


REGISTRY_SCHEMA = (
    "symbol string, version string, path string, wf_sharpe double, wf_f1 double, "
    "wf_accepted boolean, bars_trained bigint, date_range string, trained_at timestamp, "
    "feature_names array<string>"
)


def register_model(spark: SparkSession, registry: str, row: dict) -> None:
    """Append a version; rejected models are kept but never become active."""
    spark.createDataFrame([row], REGISTRY_SCHEMA).write.mode("append").parquet(registry)


def active_models(spark: SparkSession, registry: str) -> DataFrame:
    """Newest accepted version per symbol."""
    rows = spark.read.schema(REGISTRY_SCHEMA).parquet(registry).filter("wf_accepted")
    return ev.latest(rows, ("symbol",), "trained_at")


def integrity_issues(active: DataFrame, expected: list[str]) -> DataFrame:
    """Registry checks per active model: feature count, missing features, weak metrics."""
    want = F.array(*[F.lit(c) for c in expected])
    missing = F.array_except(want, F.col("feature_names"))
    return active.select(
        "symbol", "version",
        F.filter(
            F.array(
                F.when(F.size(missing) > 0, F.concat(F.size(missing).cast("string"),
                                                     F.lit(" missing features"))),
                F.when(F.col("wf_sharpe") < ev.MIN_SHARPE, "sharpe below minimum"),
                F.when(F.col("wf_f1") < ev.MIN_F1, "f1 below minimum"),
            ),
            lambda m: m.isNotNull(),
        ).alias("issues"),
    )


def validation_report(oos: DataFrame, train: DataFrame, by=("symbol",)) -> DataFrame:
    """Validation row per key: prediction sanity, overfit gap against the training rows, trade
    report on fixed risk, overall status.

    ``oos`` and ``train``: symbol, timeframe, ts, row_ix, close, y_true, y_pred, confidence.
    """
    oos = cut_lineage(oos, "oos")
    rep = ev.prediction_report(oos, by)
    fit = train.groupBy(*by).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("train_accuracy"))
    sig = oos.withColumnsRenamed({"row_ix": "pos", "y_pred": "signal"})
    trades = oc.ledger(oc.close_only_exits(sig), 32, same_bar=False)
    money = lg.r_metrics(trades, by)
    # daily returns on the fixed capital give the Sharpe ratio
    daily = trades.groupBy(*by, F.to_date("ts").alias("day")).agg(
        (F.sum("pnl_net") / 10_000.0).alias("r"))
    sharpe = daily.groupBy(*by).agg(
        F.when(F.stddev_pop("r") > 1e-10, F.avg("r") / F.stddev_pop("r") * F.sqrt(F.lit(252.0)))
        .otherwise(0.0).alias("sharpe"))
    df = (rep.join(fit, list(by), "left").join(money, list(by), "left")
          .join(sharpe, list(by), "left").fillna(0.0))
    df = df.withColumn(
        "issues",
        F.when(F.col("timeout_exits") / F.col("n_trades") > 0.5,
               F.array_append("issues", F.lit("mostly timeouts"))).otherwise(F.col("issues")))
    return ev.verdict(df)
