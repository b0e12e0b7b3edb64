"""Forward-looking labels: 0 hold, 1 long, 2 short."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.params import LABEL_ATR_MULT
from tidebar.functions.scalar import num, sql_lookup
from tidebar.operators.indicators import chunked_indicators
from tidebar.operators.quantiles import exact_quantiles
from tidebar.operators.timeline import KEYS, LAYOUT, Layout, chunked, core_rows, lag, over, rolling
from tidebar.sources.bars import numbered

METHODS = ("triple_barrier", "vol_adaptive", "quantile", "fixed")


def ahead(expr: str, n: int) -> str:
    """Array of an expression over the next n bars."""
    return over(f"collect_list({expr})", f"ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING")


def lead(x: str, n: int) -> str:
    return over(f"lead({x}, {n})")


def triple_barrier(df: DataFrame, bars: int = 8, mult: str = "double(1.5)",
                   atr: str = "atr", out: str = "label") -> DataFrame:
    """First of close +/- mult*atr touched by the next ``bars`` highs and lows.

    A bar touching both sides counts by its close against the entry.  The last ``bars`` rows
    of a series, and rows without a positive ATR, are 0.
    """
    kept = df.columns
    df = df.selectExpr(
        "*",
        f"{ahead('struct(high AS h, low AS l, close AS c)', bars)} AS _next",
        f"close + ({mult}) * {atr} AS _top",
        f"close - ({mult}) * {atr} AS _floor",
    )
    df = df.selectExpr(
        "*", "get(filter(_next, b -> b.h >= _top OR b.l <= _floor), 0) AS _hit"
    )
    return df.selectExpr(
        *kept,
        f"CASE WHEN size(_next) < {bars} OR {atr} IS NULL OR {atr} <= 0 OR _hit IS NULL THEN 0 "
        "WHEN _hit.h >= _top AND _hit.l <= _floor THEN CASE WHEN _hit.c >= close THEN 1 ELSE 2 END "
        f"WHEN _hit.h >= _top THEN 1 ELSE 2 END AS {out}",
    )


def vol_adaptive(df: DataFrame, bars: int = 8, sigma: float = 1.0, window: int = 20,
                 out: str = "label") -> DataFrame:
    """Forward log return against sigma times the trailing deviation of log returns.

    The first bar's log return counts as 0, so the deviation exists from row window-1 on.
    """
    kept = df.columns
    df = df.selectExpr(
        "*",
        f"CASE WHEN pos = 0 THEN double(0) ELSE ln(close / ({lag('close')} + 1e-10)) END AS _lr0",
        f"ln({lead('close', bars)} / (close + 1e-10)) AS _fwd",
    )
    df = df.selectExpr(
        "*", f"coalesce({rolling('stddev_samp(_lr0)', window)}, double(0)) * {num(sigma)} AS _thr"
    )
    return df.selectExpr(
        *kept,
        "CASE WHEN _fwd IS NULL OR _thr <= 0 THEN 0 WHEN _fwd > _thr THEN 1 "
        f"WHEN _fwd < -_thr THEN 2 ELSE 0 END AS {out}",
    )


def fixed_threshold(df: DataFrame, bars: int = 12, threshold: float = 0.008,
                    out: str = "label") -> DataFrame:
    """Forward return of ``bars`` bars beyond +/- threshold."""
    kept = df.columns
    df = df.selectExpr("*", f"{lead('close', bars)} / close - 1 AS _fwd")
    return df.selectExpr(
        *kept,
        f"CASE WHEN _fwd > {num(threshold)} THEN 1 WHEN _fwd < -{num(threshold)} THEN 2 "
        f"ELSE 0 END AS {out}",
    )


def quantile_labels(df: DataFrame, bars: int = 8, pct: float = 0.33) -> DataFrame:
    """Top and bottom ``pct`` of a series' forward returns become long and short.

    Takes chunked rows and returns core rows.
    """
    kept = [c for c in df.columns if c not in ("core", "chunk", "block")]
    df = core_rows(df.selectExpr("*", f"({lead('close', bars)} - close) / close AS _fwd"))
    cuts = exact_quantiles(df, KEYS, "_fwd", {"_low": pct, "_high": 1.0 - pct})
    return df.join(cuts, list(KEYS)).selectExpr(
        *kept,
        "CASE WHEN _fwd >= _high THEN 1 WHEN _fwd <= _low THEN 2 ELSE 0 END AS label",
    )


def with_labels(bars: DataFrame, method: str = "triple_barrier", future_bars: int = 8,
                atr_mult: float | None = 1.5, sigma: float = 1.0, pct: float = 0.33,
                threshold: float = 0.008, layout: Layout = LAYOUT) -> DataFrame:
    """Bars with ``pos`` and ``label``; dispatches on the method name.

    ``atr_mult=None`` uses the per-symbol table of the history trainer.
    """
    layout = replace(layout, ahead=future_bars)
    if method == "triple_barrier":
        mult = (
            num(atr_mult) if atr_mult is not None else sql_lookup(LABEL_ATR_MULT, "symbol", 3.0)
        )
        df = triple_barrier(chunked_indicators(bars, layout), future_bars, mult)
    elif method in ("vol_adaptive", "quantile", "fixed"):
        df = chunked(numbered(bars), layout)
        if method == "quantile":
            return quantile_labels(df, future_bars, pct)
        if method == "vol_adaptive":
            df = vol_adaptive(df, future_bars, sigma)
        else:
            df = fixed_threshold(df, future_bars, threshold)
    else:
        raise ValueError(f"unknown label method: {method!r}")
    return core_rows(df).select(*bars.columns, "pos", "label")


def std_fallback_labels(bars: DataFrame, future_bars: int = 8, atr_mult: float = 1.5,
                        layout: Layout = LAYOUT) -> DataFrame:
    """Triple barrier without an ATR column: width from the 14-bar deviation of log returns."""
    df = chunked(numbered(bars), replace(layout, ahead=future_bars))
    df = df.selectExpr("*", f"ln(close / {lag('close')}) AS _ret")
    df = df.selectExpr("*", f"{rolling('stddev_samp(_ret)', 14, 1)} * close AS _width")
    df = triple_barrier(df, future_bars, num(atr_mult), "_width")
    return core_rows(df).select(*bars.columns, "pos", "label")


def label_distribution(labeled: DataFrame, min_hold_pct: float = 0.20, by=("symbol",)
                       ) -> DataFrame:
    """Counts and shares per class, with the too-few-holds warning."""
    def share(k: int) -> Column:
        return F.count_if(F.col("label") == k) / F.count(F.lit(1)) * 100

    return labeled.groupBy(*by).agg(
        *[F.count_if(F.col("label") == k).alias(n)
          for k, n in ((0, "n_hold"), (1, "n_long"), (2, "n_short"))],
        F.count(F.lit(1)).alias("n_total"),
        *[share(k).alias(n) for k, n in ((0, "hold_pct"), (1, "long_pct"), (2, "short_pct"))],
        (share(0) < min_hold_pct * 100).alias("hold_too_low"),
    )


def class_weights(labeled: DataFrame, by=("symbol",)) -> DataFrame:
    """Balanced weights n / (classes * n_class) as one small row per (key, class)."""
    counts = labeled.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n_class"))
    totals = counts.groupBy(*by).agg(
        F.sum("n_class").alias("n_all"), F.count(F.lit(1)).alias("n_classes")
    )
    return counts.join(totals, list(by)).select(
        *by, "label", "n_class",
        (F.col("n_all") / (F.col("n_classes") * F.col("n_class"))).alias("weight"),
    )


def with_weights(labeled: DataFrame, by=("symbol",)) -> DataFrame:
    """Rows with their balanced class weight; the weight table has three rows per key."""
    weights = class_weights(labeled, by).select(*by, "label", "weight")
    return labeled.join(weights, [*by, "label"])
