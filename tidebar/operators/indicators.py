"""Technical indicator columns of a bar series, computed for all series in one shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from tidebar.functions.scalar import num, sql_finite, sql_flag
from tidebar.operators.timeline import (
    LAYOUT,
    Layout,
    chunked,
    core_rows,
    ewm,
    lag,
    pct_rank,
    rolling,
)
from tidebar.sources.bars import numbered_with_obv

# fixed values: columns usable as model features, in registry order
REGISTRY = [
    "ema_9", "ema_21", "ema_50", "sma_20", "sma_50", "macd", "macd_signal", "macd_hist",
    "rsi", "stoch_k", "stoch_d", "roc_5", "roc_10", "roc_20", "atr",
    "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct",
    "vol_10", "vol_20", "vol_ratio", "vol_pct", "adx", "adx_dmp", "adx_dmn",
    "volume_ratio", "obv_ema", "vwap_ratio",
    "candle_body", "candle_body_ratio", "candle_upper_wick", "candle_lower_wick",
    "is_bullish", "is_doji",
    "pct_from_high", "pct_from_low", "price_position", "higher_high", "lower_low",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
]
EXTRA = ["ema_200", "sma_200", "volume_sma", "obv"]
COUNTS = {"is_bullish", "is_doji", "higher_high", "lower_low"}
WILDER = 1.0 / 14
ANNUAL = math.sqrt(252 * 96)

CANDLES = {
    "candle_body": "(close - open) / open",
    "candle_body_ratio": "abs(close - open) / (high - low + 1e-10)",
    "candle_upper_wick": "(high - greatest(open, close)) / (high - low + 1e-10)",
    "candle_lower_wick": "(least(open, close) - low) / (high - low + 1e-10)",
    "is_bullish": sql_flag("close > open"),
    "is_doji": sql_flag("abs((close - open) / open) < 1e-3"),
}
CLOCK = {
    "hour_sin": "sin(2 * pi() * hour(ts) / 24)",
    "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
    "dow_sin": "sin(2 * pi() * weekday(ts) / 7)",
    "dow_cos": "cos(2 * pi() * weekday(ts) / 7)",
}


def span(n: int) -> float:
    return 2.0 / (n + 1)


def named(columns: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in columns.items()]


def indicator_columns(df: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """All indicators on chunked rows (needs ``pos``, ``obv``, ``chunk``, ``block``)."""
    keep = list(df.columns)
    # values of earlier bars
    df = df.selectExpr(
        "*", f"{lag('high')} AS _h1", f"{lag('low')} AS _l1",
        *[f"{lag('close', n)} AS _c{n}" for n in (1, 5, 10, 20)],
    )
    df = df.selectExpr(
        "*",
        "CASE WHEN pos > 0 THEN greatest(close - _c1, double(0)) END AS _gain",
        "CASE WHEN pos > 0 THEN greatest(_c1 - close, double(0)) END AS _loss",
        # the first bar has no previous close: greatest() skips the NULLs
        "greatest(high - low, abs(high - _c1), abs(low - _c1)) AS _tr",
        "CASE WHEN pos > 0 THEN greatest(high - _h1, double(0)) END AS _rise",
        "CASE WHEN pos > 0 THEN greatest(_l1 - low, double(0)) END AS _fall",
        "ln(close / _c1) AS _lr",
        "(high + low + close) / 3 * volume AS _tpv",
    )
    # bounded frames first, while rows are narrow: every frame size keeps its own row buffer
    df = df.selectExpr(
        "*",
        *[f"{rolling('avg(close)', n)} AS sma_{n}" for n in (20, 50, 200)],
        f"{rolling('stddev_samp(close)', 20)} AS _dev",
        *[f"{rolling('min(low)', n)} AS _lo{n}" for n in (14, 20)],
        *[f"{rolling('max(high)', n)} AS _hi{n}" for n in (14, 20)],
        f"{rolling('avg(volume)', 20)} AS volume_sma",
        f"{rolling('sum(_tpv)', 20)} AS _tpv20",
        f"{rolling('sum(volume)', 20)} AS _vol20",
        *[
            f"{rolling('stddev_samp(_lr)', n, 1)} * {num(ANNUAL)} AS vol_{n}"
            for n in (10, 20)
        ],
    )
    # the smaller move is zeroed; on a tie both stay
    df = df.selectExpr(
        "*",
        "CASE WHEN _rise < _fall THEN double(0) ELSE _rise END AS _up",
        "CASE WHEN _fall < _rise THEN double(0) ELSE _fall END AS _down",
    )
    df = ewm(
        df,
        {
            **{f"ema_{n}": ("close", span(n), 0, 1) for n in (9, 21, 50, 200)},
            "_fast": ("close", span(12), 0, 1),
            "_slow": ("close", span(26), 0, 1),
            "_ag": ("_gain", WILDER, 1, 14),
            "_al": ("_loss", WILDER, 1, 14),
            "atr": ("_tr", WILDER, 0, 14),
            "_su": ("_up", WILDER, 1, 14),
            "_sd": ("_down", WILDER, 1, 14),
            "obv_ema": ("obv", span(20), 0, 1),
        },
        layout=layout,
        gaps=("atr", "_su", "_sd"),  # a bar without a high or low has no range or move
    )
    df = df.selectExpr(
        "*",
        "_fast - _slow AS macd",
        "100 - 100 / (1 + _ag / (_al + 1e-10)) AS rsi",
        "100 * _su / (atr + 1e-10) AS adx_dmp",
        "100 * _sd / (atr + 1e-10) AS adx_dmn",
    )
    df = df.selectExpr(
        "*", "100 * abs(adx_dmp - adx_dmn) / (adx_dmp + adx_dmn + 1e-10) AS _dx"
    )
    df = ewm(
        df,
        {"macd_signal": ("macd", span(9), 0, 1), "adx": ("_dx", WILDER, 14, 14)},
        layout=layout,
        gaps=("adx",),
    )
    df = df.selectExpr(
        "*",
        "macd - macd_signal AS macd_hist",
        "(close - _lo14) / (_hi14 - _lo14 + 1e-10) * 100 AS stoch_k",
        *[f"close / _c{n} - 1 AS roc_{n}" for n in (5, 10, 20)],
        "sma_20 AS bb_mid",
        "sma_20 + 2 * _dev AS bb_upper",
        "sma_20 - 2 * _dev AS bb_lower",
        "4 * _dev / (sma_20 + 1e-10) AS bb_width",
        "(close - (sma_20 - 2 * _dev)) / (4 * _dev + 1e-10) AS bb_pct",
        "vol_10 / (vol_20 + 1e-10) AS vol_ratio",
        "volume / (volume_sma + 1e-10) AS volume_ratio",
        "close / (_tpv20 / (_vol20 + 1e-10) + 1e-10) - 1 AS vwap_ratio",
        *named(CANDLES),
        "(close - _hi20) / _hi20 AS pct_from_high",
        "(close - _lo20) / _lo20 AS pct_from_low",
        "(close - _lo20) / (_hi20 - _lo20 + 1e-10) AS price_position",
        f"{sql_flag('high > _h1')} AS higher_high",
        f"{sql_flag('low < _l1')} AS lower_low",
        *named(CLOCK),
    )
    df = df.selectExpr(
        "*",
        f"{rolling('avg(stoch_k)', 3, 13)} AS stoch_d",
        f"{pct_rank('vol_20', 100, 20)} AS vol_pct",
    )
    out = [c for c in (*REGISTRY, *EXTRA) if c not in keep]
    return df.select(*keep, *out)


def chunked_indicators(bars: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Bars -> numbered, chunked rows with every indicator; keeps the chunk helper columns
    so that features and labels can add windows without another shuffle."""
    return indicator_columns(chunked(numbered_with_obv(bars), layout), layout)


def with_indicators(bars: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Bars with ``pos`` and all indicator columns; infinities become NULL."""
    df = core_rows(chunked_indicators(bars, layout))
    out = [*REGISTRY, *EXTRA]
    keep = [x for x in df.columns if x not in out]
    return df.selectExpr(
        *keep, *[x if x in COUNTS else f"{sql_finite(x)} AS {x}" for x in out]
    )
