"""Registered queries that train and apply Spark ML models (no SQL equivalent)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators import evaluation as ev
from tidebar.operators import features as ft
from tidebar.plans import training as tr
from tidebar.plans.catalog_series import rounded, stamp
from tidebar.session import cut_lineage
from tidebar.sources import bars as src

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = tr.EnsembleConfig()


def frame(s: SparkSession, d: str) -> DataFrame:
    return cut_lineage(
        tr.training_frame(src.event_bars(s, d, "15m"), src.event_bars(s, d, "1h")), "frame")


def model_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    q["model_training_frame"] = lambda s, d: tr.training_frame(
        src.event_bars(s, d, "15m"), src.event_bars(s, d, "1h")
    ).groupBy("symbol", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_ix").alias("first_ix"),
        F.max("row_ix").alias("last_ix"))

    def scored(s: SparkSession, d: str) -> DataFrame:
        rows = ev.holdout(frame(s, d), 0.2, pos="row_ix")
        model = tr.fit_ensemble(rows.filter("role = 'train'"), ft.FEATURES, CONFIG)
        return model.score(rows.filter("role = 'test'")).selectExpr(
            "symbol", stamp(), "label", "y_pred", *rounded("confidence", 4))

    q["model_holdout_scores"] = scored

    def forward(s: SparkSession, d: str) -> DataFrame:
        folds, _ = tr.walk_forward_ensemble(frame(s, d), ft.FEATURES, CONFIG)
        return folds.selectExpr(
            "symbol", "fold", "n", *rounded("accuracy f1_macro sharpe win_rate", 4))

    q["model_walk_forward"] = forward

    def importance(s: SparkSession, d: str) -> DataFrame:
        return tr.fit_ensemble(frame(s, d), ft.FEATURES, CONFIG).importance(s)

    q["model_feature_importance"] = importance
    return q
