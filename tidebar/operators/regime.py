"""Market regime: raw state, two-bar confirmation, adjusted strategy parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.params import ADX_TREND, ATR_SPIKE, REGIMES
from tidebar.functions.scalar import num, sql_clip, sql_lookup
from tidebar.operators.indicators import chunked_indicators
from tidebar.operators.timeline import KEYS, LAYOUT, Layout, lag, over, prefix_scan

LOOK_BARS = 48


def regime_column(field: str, by: str = "regime") -> str:
    return sql_lookup({name: row[field] for name, row in REGIMES.items()}, by)


def raw_regime_columns(df: DataFrame) -> DataFrame:
    """ATR against its own recent mean and the unconfirmed regime, on chunked rows.

    The mean covers 48 ATR values, all of them if there are 6 to 47, and the ratio is 1 below
    that.  ATR exists from row 13 on, so the number of values seen is pos - 12.
    """
    mean48 = over("avg(atr)", f"ROWS BETWEEN {LOOK_BARS - 1} PRECEDING AND CURRENT ROW")
    df = df.selectExpr("*", f"{mean48} AS _atr_mean")
    df = df.selectExpr(
        "*",
        "CASE WHEN atr > 0 AND pos - 12 > 5 AND _atr_mean > 0 THEN atr / _atr_mean "
        "ELSE double(1) END AS regime_atr_ratio",
    ).drop("_atr_mean")
    return df.selectExpr(
        "*",
        f"CASE WHEN adx >= {num(ADX_TREND)} THEN 'TRENDING' WHEN regime_atr_ratio >= "
        f"{num(ATR_SPIKE)} THEN 'HIGH_VOLATILITY' ELSE 'RANGE' END AS raw_regime",
    )


def confirmed_regime(df: DataFrame) -> DataFrame:
    """Debounced regime of chunked rows carrying ``raw_regime``; returns core rows.

    A regime is confirmed once seen on two bars in a row and then held; before the first
    confirmation it is RANGE.  Holding has no bounded frame, so the last confirmation is
    carried along the series by a two-level scan over chunks.
    """
    kept = [c for c in df.columns if c not in ("core", "block")]
    df = df.selectExpr(
        *kept, "core",
        f"CASE WHEN raw_regime = {lag('raw_regime')} THEN raw_regime END AS _twice",
        f"{over('collect_list(raw_regime)', 'ROWS BETWEEN 3 PRECEDING AND CURRENT ROW')} AS _four",
    ).filter("core").drop("core")
    df = prefix_scan(df, {"_held": ("last", F.col("_twice"))}, KEYS, "chunk", ["pos"])
    df = df.selectExpr(*kept, "_four", "coalesce(_held, 'RANGE') AS regime")
    return df.selectExpr(
        *[c for c in kept if c != "chunk"], "regime",
        "size(filter(_four, r -> r = regime)) / size(_four) AS confirmation_pct",
    )


def with_regime(bars: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Bars with indicators, raw and confirmed regime."""
    return confirmed_regime(raw_regime_columns(chunked_indicators(bars, layout)))


def regime_params(df: DataFrame, base_sl: float = 2.0, base_tp: float = 3.0,
                  base_conf: float = 0.55) -> DataFrame:
    """Strategy parameters adjusted by the confirmed regime (a three-row constant table)."""
    conf = sql_clip(f"{num(base_conf)} + {regime_column('conf')}", 0.35, 0.75)
    return df.selectExpr(
        "*",
        f"{conf} AS conf_threshold",
        f"{conf} - {num(base_conf)} AS conf_delta",
        f"{num(base_sl)} * {regime_column('sl')} AS sl_mult",
        f"{num(base_tp)} * {regime_column('tp')} AS tp_mult",
        f"{regime_column('size')} AS size_scale",
        f"{regime_column('early_r')} AS early_profit_r",
        f"least({regime_column('timeout')}, 12) AS timeout_bars",
        "regime = 'TRENDING' AS require_agree",
    )
