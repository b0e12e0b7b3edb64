"""Walk-forward folds and classification reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalar import EPS, issues
from tidebar.operators.quantiles import exact_quantiles

MIN_SHARPE, MIN_F1, MIN_CONSISTENCY = 0.30, 0.33, 0.60


def assign_folds(df: DataFrame, by=("symbol",), n_splits: int = 5, gap: int = 8,
                 test_size: int | None = None, min_train: int = 200,
                 rolling: int | None = None, pos: str = "pos") -> DataFrame:
    """One row per (row, fold) it belongs to, with ``fold`` (1 = oldest) and ``role``.

    Fold bounds are arithmetic on the row count of the key, so only that count is joined in
    (one row per key) and the folds of a row are computed from its position.  Folds with too
    little training history are dropped.
    """
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    size = (
        str(int(test_size)) if test_size is not None
        else f"greatest(50, (_n - {min_train} - {gap * n_splits}) div {n_splits})"
    )
    d = df.join(n, list(by)).selectExpr("*", f"{size} AS _size")
    start = "greatest(0, x.train_end - {0})".format(rolling) if rolling else "0"
    folds = (
        f"filter(transform(transform(sequence(0, {n_splits - 1}), i -> named_struct('i', i, "
        f"'test_start', _n - (i + 1) * _size, 'test_end', _n - i * _size, "
        f"'train_end', _n - (i + 1) * _size - {gap})), x -> named_struct('i', x.i, "
        f"'train_start', {start}, 'train_end', x.train_end, 'test_start', x.test_start, "
        f"'test_end', x.test_end)), x -> x.train_end - x.train_start >= {min_train})"
    )
    d = d.selectExpr("*", f"{folds} AS _folds")
    d = d.selectExpr(
        "*",
        f"filter(transform(_folds, x -> named_struct('fold', size(_folds) - x.i, 'role', "
        f"CASE WHEN {pos} >= x.train_start AND {pos} < x.train_end THEN 'train' "
        f"WHEN {pos} >= x.test_start AND {pos} < x.test_end THEN 'test' END)), "
        "y -> y.role IS NOT NULL) AS _member",
    )
    return d.selectExpr(*df.columns, "inline(_member)")


def holdout(df: DataFrame, share: float = 0.2, by=("symbol",), pos: str = "pos") -> DataFrame:
    """Chronological split: the last ``share`` of each key's rows is ``test``."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, list(by)).selectExpr(
        *df.columns,
        f"CASE WHEN {pos} >= _n - floor(_n * double({share})) THEN 'test' ELSE 'train' END AS role",
    )


def first_rows(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """First n rows per key of a numbered frame."""
    return df.filter(F.col(pos) < n)


def last_rows(df: DataFrame, n: int, by=("symbol", "timeframe"), pos: str = "pos") -> DataFrame:
    """Last n rows per key of a numbered frame (the key's end is one aggregated row)."""
    end = df.groupBy(*by).agg(F.max(pos).alias("_end"))
    return df.join(end, list(by)).filter(F.col(pos) > F.col("_end") - n).select(*df.columns)


def latest(df: DataFrame, by=("symbol",), order: str = "ts") -> DataFrame:
    """Latest row per key, as one aggregate of each column (hashed where the columns are numbers).

    ``order`` differs among the rows of a key.
    """
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*by, *rest)


def _counts(k: int) -> tuple[Column, Column, Column]:
    y, p = F.col("y_true"), F.col("y_pred")
    return (F.count_if((p == k) & (y == k)), F.count_if((p == k) & (y != k)),
            F.count_if((p != k) & (y == k)))


def fold_report(pred: DataFrame, by=("symbol", "fold")) -> DataFrame:
    """Accuracy, precision, recall and F1 of the two directional classes per fold.

    ``f1_macro`` here is the mean over LONG and SHORT only.
    """
    cols = []
    for k, name in ((1, "long"), (2, "short")):
        tp, fp, fn = _counts(k)
        prec, rec = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
        cols += [prec.alias(f"precision_{name}"), rec.alias(f"recall_{name}"),
                 (2 * prec * rec / (prec + rec + EPS)).alias(f"f1_{name}")]
    share = lambda k: F.count_if(F.col("y_pred") == k) / F.count(F.lit(1)) * 100
    df = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        *cols,
        *[share(k).alias(f"{n}_pct") for k, n in ((0, "hold"), (1, "long"), (2, "short"))],
    )
    return df.withColumn("f1_macro", (F.col("f1_long") + F.col("f1_short")) / 2)


def class_report(pred: DataFrame, by=("symbol",), classes=(0, 1, 2)) -> DataFrame:
    """Per-class precision, recall, F1 and support; empty denominators give 0."""
    parts = []
    for k in classes:
        tp, fp, fn = _counts(k)
        zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        parts.append(F.struct(
            F.lit(k).alias("label"), zero(tp, tp + fp).alias("precision"),
            zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
            (tp + fn).alias("support"),
        ))
    return pred.groupBy(*by).agg(F.array(*parts).alias("_c")).selectExpr(*by, "inline(_c)")


def prediction_report(pred: DataFrame, by=("symbol",)) -> DataFrame:
    """Class shares, accuracy, three-class macro F1, confidence percentiles, issue flags.

    ``pred``: y_true, y_pred, confidence (the largest class probability).
    """
    f1 = []
    for k in (0, 1, 2):
        tp, fp, fn = _counts(k)
        f1.append(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))
    marks = exact_quantiles(
        pred, by, "confidence", {f"conf_p{n}": n / 100 for n in (25, 50, 75, 90)})
    share = lambda k: F.count_if(F.col("y_pred") == k) / F.count(F.lit(1))
    df = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[share(k).alias(f"{n}_pct") for k, n in ((0, "hold"), (1, "long"), (2, "short"))],
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        ((f1[0] + f1[1] + f1[2]) / 3).alias("f1_macro"),
        F.avg("confidence").alias("mean_conf"),
    ).join(marks, list(by))
    return df.select(
        "*",
        issues(
            (F.col("hold_pct") > 0.55, "hold-biased"),
            ((F.col("long_pct") < 0.05) | (F.col("short_pct") < 0.05), "one direction absent"),
            (F.col("mean_conf") < 0.36, "mean confidence low"),
            (F.col("mean_conf") > 0.75, "mean confidence high"),
        ).alias("issues"),
    )


def regime_accuracy(pred: DataFrame, by=("symbol",), min_rows: int = 50) -> DataFrame:
    """Accuracy in overlapping regime groups; groups under ``min_rows`` are left out.

    ``pred`` carries the 0/1 regime flags of its bar, so nothing can drift out of line.
    """
    names = F.array(
        F.when(F.col("regime_trending") == 1, "trending"),
        F.when(F.col("regime_trending") == 0, "ranging"),
        *[F.when(F.col(f"regime_{n}") == 1, n)
          for n in ("high_vol", "low_vol", "bull_20", "bear_20")],
    )
    df = pred.withColumn("regime_group", F.explode(F.filter(names, lambda x: x.isNotNull())))
    return df.groupBy(*by, "regime_group").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
    ).filter(F.col("n") >= min_rows)


def fold_summary(folds: DataFrame, by=("symbol",), min_sharpe: float = MIN_SHARPE,
                 min_f1: float = MIN_F1, min_consistency: float = MIN_CONSISTENCY) -> DataFrame:
    """Means over folds, population deviation of Sharpe, consistency, verdict with reasons."""
    df = folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[F.avg(c).alias(f"mean_{c}")
          for c in ("accuracy", "f1_macro", "sharpe", "profit_factor", "win_rate")],
        F.stddev_pop("sharpe").alias("std_sharpe"),
        F.avg((F.col("sharpe") > 0).cast("double")).alias("consistency"),
    )
    reasons = issues(
        (F.col("mean_sharpe") < min_sharpe, "sharpe"),
        (F.col("mean_f1_macro") < min_f1, "f1"),
        (F.col("consistency") < min_consistency, "consistency"),
    )
    return df.withColumn("accepted", F.size(reasons) == 0).withColumn(
        "recommendation",
        F.when(F.size(reasons) == 0, "ACCEPT").otherwise(
            F.concat(F.lit("REJECT ("), F.concat_ws(", ", reasons), F.lit(")"))),
    )


def label_issues(dist: DataFrame) -> DataFrame:
    """Imbalance notes of a label distribution (shares in percent) and the training aborts."""
    pairs = [(n, F.col(f"{n}_pct")) for n in ("hold", "long", "short")]
    return dist.select(
        "*",
        issues(*[(c < 10, f"low {n}") for n, c in pairs],
               *[((c >= 10) & (c < 20), f"somewhat low {n}") for n, c in pairs],
               (F.greatest("long_pct", "short_pct") > 60, "one-sided")).alias("label_issues"),
        ((F.col("hold_pct") > 15) & (F.col("long_pct") > 15) & (F.col("short_pct") > 15)).alias(
            "balanced"),
        (F.col("hold_pct") < 20).alias("abort_training"),
    )


def verdict(df: DataFrame) -> DataFrame:
    """Overall state of a validated model from its accuracy, overfit gap and Sharpe.

    Columns: accuracy, train_accuracy, f1_macro, sharpe, issues.
    """
    gap = F.col("train_accuracy") - F.col("accuracy")
    failures = issues(
        (F.col("accuracy") < 0.36, "accuracy near random"),
        (gap > 0.20, "overfitting"),
        (F.col("sharpe") <= 0.3, "sharpe below 0.3"),
    )
    notes = issues(
        ((gap > 0.10) & (gap <= 0.20), "moderate overfit"),
        ((F.col("sharpe") > 0.3) & (F.col("sharpe") <= 0.8), "marginal sharpe"),
    )
    band = (F.when(F.col("sharpe") > 1.5, "excellent").when(F.col("sharpe") > 0.8, "good")
            .when(F.col("sharpe") > 0.3, "marginal").otherwise("failing"))
    df = df.select(
        "*", gap.alias("overfit_gap"), band.alias("sharpe_band"), failures.alias("failures"),
        F.concat(F.col("issues"), notes).alias("warnings"),
    )
    return df.withColumn(
        "status",
        F.when(F.size("failures") > 0, "ISSUES").when(F.size("warnings") > 2, "REVIEW")
        .otherwise("READY"),
    )
