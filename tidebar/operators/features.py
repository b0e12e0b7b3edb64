"""Model feature rows: engineered columns, regime flags and higher-timeframe context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalar import sql_finite, sql_flag
from tidebar.operators.indicators import (
    COUNTS,
    REGISTRY,
    chunked_indicators,
    with_indicators,
)
from tidebar.operators.timeline import (
    KEYS,
    LAYOUT,
    Layout,
    asof_backward,
    core_rows,
    lag,
    pct_rank,
    rolling,
)
from tidebar.functions.params import TIMEFRAME_SECONDS

HORIZONS = (1, 3, 5, 10, 20)
STAT_WINDOWS = (5, 10, 20)
# oscillator -> position of its first value
STAT_INPUTS = {"rsi": 14, "macd": 0, "adx": 27, "volume": 0}

FLAGS = [
    "rsi_oversold", "rsi_overbought", "rsi_mid_cross_up", "rsi_mid_cross_down",
    "macd_cross_up", "macd_cross_down", "macd_positive", "macd_hist_rising",
    "ema_9_21_cross_up", "ema_9_21_cross_down", "bb_squeeze",
]
REGIME_FLAGS = [
    "regime_trending", "regime_strong", "regime_weak", "regime_squeeze", "regime_expansion",
    "regime_high_vol", "regime_low_vol", "regime_bull_20", "regime_bear_20",
]
ENGINEERED = [
    *[f"{kind}_{p}" for p in HORIZONS for kind in ("return", "log_ret", "hl_range")],
    *[f"{x}_{s}{n}" for x in STAT_INPUTS for n in STAT_WINDOWS for s in ("ma", "std", "z")],
    *FLAGS,
    "atr_ratio", "atr_z20", "vol_price_momentum", "vol_spike",
]
HTF_1H = [
    "htf1h_trend", "htf1h_rsi", "htf1h_rsi_zone", "htf1h_macd_hist", "htf1h_macd_bull",
    "htf1h_adx", "htf1h_trending", "htf1h_bb_pct", "htf1h_above_50ema",
]
HTF_4H = [
    "htf4h_trend", "htf4h_above_50ema", "htf4h_rsi", "htf4h_adx", "htf4h_trending",
    "htf4h_vol_regime", "htf4h_expanding", "htf4h_macd_bull",
]
BASE_FEATURES = [*REGISTRY, *ENGINEERED, *REGIME_FLAGS]
FEATURES = [*BASE_FEATURES, *HTF_1H]
INT_COLUMNS = {*COUNTS, *FLAGS, *REGIME_FLAGS}


def engineered_columns(df: DataFrame) -> DataFrame:
    """The 66 engineered features on chunked indicator rows."""
    keep = df.columns
    previous = ("rsi", "macd", "macd_signal", "macd_hist", "ema_9", "ema_21")
    df = df.selectExpr(
        "*",
        *[f"{lag('close', p)} AS _p{p}" for p in HORIZONS],
        *[f"{rolling('max(high)', p)} AS _hh{p}" for p in HORIZONS],
        *[f"{rolling('min(low)', p)} AS _ll{p}" for p in HORIZONS],
        *[
            f"{rolling(f'{agg}({x})', n, first)} AS {x}_{name}{n}"
            for x, first in STAT_INPUTS.items()
            for n in STAT_WINDOWS
            for name, agg in (("ma", "avg"), ("std", "stddev_samp"))
        ],
        *[f"{lag(x)} AS _b_{x}" for x in previous],
        f"{rolling('percentile(bb_width, 0.2D)', 20, 19)} AS _q20",
        f"{rolling('avg(atr)', 20, 13)} AS _atr_ma",
        f"{rolling('stddev_samp(atr)', 20, 13)} AS _atr_sd",
    )

    def crossed(a: str, b: str, up: bool) -> str:
        now, before = (">", "<=") if up else ("<", ">=")
        b0 = f"_b_{b}" if b in previous else b
        return sql_flag(f"{a} {now} {b} AND _b_{a} {before} {b0}")

    return df.selectExpr(
        *keep,
        *[f"close / _p{p} - 1 AS return_{p}" for p in HORIZONS],
        *[f"ln(close / (_p{p} + 1e-10)) AS log_ret_{p}" for p in HORIZONS],
        *[f"(_hh{p} - _ll{p}) / (close + 1e-10) AS hl_range_{p}" for p in HORIZONS],
        *[f"{x}_{s}{n}" for x in STAT_INPUTS for n in STAT_WINDOWS for s in ("ma", "std")],
        *[
            f"({x} - {x}_ma{n}) / ({x}_std{n} + 1e-10) AS {x}_z{n}"
            for x in STAT_INPUTS
            for n in STAT_WINDOWS
        ],
        f"{sql_flag('rsi < 30')} AS rsi_oversold",
        f"{sql_flag('rsi > 70')} AS rsi_overbought",
        f"{crossed('rsi', '50', True)} AS rsi_mid_cross_up",
        f"{crossed('rsi', '50', False)} AS rsi_mid_cross_down",
        f"{crossed('macd', 'macd_signal', True)} AS macd_cross_up",
        f"{crossed('macd', 'macd_signal', False)} AS macd_cross_down",
        f"{sql_flag('macd > 0')} AS macd_positive",
        f"{sql_flag('macd_hist > _b_macd_hist')} AS macd_hist_rising",
        f"{crossed('ema_9', 'ema_21', True)} AS ema_9_21_cross_up",
        f"{crossed('ema_9', 'ema_21', False)} AS ema_9_21_cross_down",
        f"{sql_flag('bb_width < _q20')} AS bb_squeeze",
        "atr / (close + 1e-10) AS atr_ratio",
        "(atr - _atr_ma) / (_atr_sd + 1e-10) AS atr_z20",
        "(close / _p1 - 1) * log1p(volume) AS vol_price_momentum",
        "volume / (volume_sma + 1e-10) AS vol_spike",
    )


def regime_flag_columns(df: DataFrame) -> DataFrame:
    """The nine rule-based regime flags on chunked indicator rows."""
    keep = df.columns
    df = df.selectExpr("*", f"{lag('close')} AS _r1", f"{lag('close', 20)} AS _r20")
    df = df.selectExpr("*", "close / _r1 - 1 AS _ret")
    df = df.selectExpr("*", f"{rolling('stddev_samp(_ret)', 20, 1)} AS _rv")
    df = df.selectExpr(
        "*",
        f"{pct_rank('bb_width', 50, 19)} AS _width_rank",
        f"{pct_rank('_rv', 100, 20)} AS _rv_rank",
    )
    rules = {
        "regime_trending": "adx > 25",
        "regime_strong": "adx > 40",
        "regime_weak": "adx < 20",
        "regime_squeeze": "_width_rank < double(0.2)",
        "regime_expansion": "_width_rank > double(0.8)",
        "regime_high_vol": "_rv_rank > double(0.7)",
        "regime_low_vol": "_rv_rank < double(0.3)",
        "regime_bull_20": "close / _r20 - 1 > 0",
        "regime_bear_20": "close / _r20 - 1 < 0",
    }
    return df.selectExpr(*keep, *[f"{sql_flag(c)} AS {n}" for n, c in rules.items()])


def chunked_features(bars: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Indicators, engineered features and regime flags on chunked rows: one shuffle."""
    return regime_flag_columns(engineered_columns(chunked_indicators(bars, layout)))


def clean_features(df: DataFrame, keep: list[str], features: list[str] | None = None) -> DataFrame:
    """Project ``keep`` plus the features, with infinities turned into NULL."""
    features = features or BASE_FEATURES
    return df.selectExpr(
        *keep,
        *[
            x if x in INT_COLUMNS or x in keep else f"{sql_finite(x)} AS {x}"
            for x in features
            if x not in keep
        ],
    )


def with_features(bars: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Bars -> key, bar and the 120 own-timeframe features."""
    df = core_rows(chunked_features(bars, layout))
    return clean_features(df, [*KEYS, "ts", "pos", "open", "high", "low", "close", "volume"])


def htf_1h_columns(ind: DataFrame) -> DataFrame:
    """Hourly context of an indicator frame. Zones are closed on the right; 0 has no zone."""
    return ind.selectExpr(
        "symbol", "ts",
        "CASE WHEN ema_9 > ema_21 THEN 1 ELSE -1 END AS htf1h_trend",
        "rsi AS htf1h_rsi",
        "CASE WHEN rsi <= 0 THEN NULL WHEN rsi <= 30 THEN double(-2) WHEN rsi <= 45 THEN "
        "double(-1) WHEN rsi <= 55 THEN double(0) WHEN rsi <= 70 THEN double(1) "
        "WHEN rsi <= 100 THEN double(2) END AS htf1h_rsi_zone",
        "macd_hist AS htf1h_macd_hist",
        f"{sql_flag('macd_hist > 0')} AS htf1h_macd_bull",
        "adx AS htf1h_adx",
        f"{sql_flag('adx > 25')} AS htf1h_trending",
        "bb_pct AS htf1h_bb_pct",
        f"{sql_flag('close > ema_50')} AS htf1h_above_50ema",
    )


def htf_4h_columns(bars_4h: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Four-hour context: trend, strength and whether volatility is above its 20-bar mean."""
    df = chunked_indicators(bars_4h, layout)
    df = core_rows(
        df.selectExpr(
            "*",
            f"{rolling('avg(atr)', 20, 13)} AS _atr_mean",
            f"{rolling('avg(bb_width)', 20, 19)} AS _width_mean",
        )
    )
    return df.selectExpr(
        "symbol", "ts",
        "CASE WHEN ema_9 > ema_21 THEN 1 ELSE -1 END AS htf4h_trend",
        f"{sql_flag('close > ema_50')} AS htf4h_above_50ema",
        "rsi AS htf4h_rsi",
        "adx AS htf4h_adx",
        f"{sql_flag('adx > 25')} AS htf4h_trending",
        f"{sql_flag('atr > _atr_mean')} AS htf4h_vol_regime",
        f"{sql_flag('bb_width > _width_mean')} AS htf4h_expanding",
        f"{sql_flag('macd_hist > 0')} AS htf4h_macd_bull",
    )


def join_context(
    base: DataFrame, context: DataFrame, columns: list[str], timeframe: str, align: str = "open"
) -> DataFrame:
    """As-of join of higher-timeframe columns onto base bars.

    ``align='open'`` matches a coarse bar from its opening stamp on (the published behaviour,
    which sees into the still running bar); ``align='close'`` waits until it is complete.
    """
    if align not in ("open", "close"):
        raise ValueError("align must be 'open' or 'close'")
    shift = TIMEFRAME_SECONDS[timeframe] if align == "close" else 0
    return asof_backward(base, context, columns, shift_seconds=shift)


def merge_timeframes(
    primary: DataFrame, others: dict[str, DataFrame], align: str = "open"
) -> DataFrame:
    """Generic merge: named indicator columns of each timeframe, suffixed and as-of joined.

    Columns a frame does not have are skipped.
    """
    # fixed values: columns carried over from each higher timeframe
    wanted = ["rsi", "macd", "adx", "ema_20", "ema_50", "bb_upper", "bb_lower", "atr"]
    out = primary
    for tf, bars in others.items():
        ind = with_indicators(bars)
        have = [c for c in wanted if c in ind.columns]
        ctx = ind.selectExpr("symbol", "ts", *[f"{c} AS {c}_{tf}" for c in have])
        out = join_context(out, ctx, [f"{c}_{tf}" for c in have], tf, align)
    return out


def align_columns(df: DataFrame, expected: list[str], keep: list[str]) -> DataFrame:
    """Project to a saved feature list; features the frame lacks (or NULLs) become 0."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
            for c in expected
        ],
    )


def complete_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """Complete-case filter over the feature columns."""
    return df.dropna(subset=features)
