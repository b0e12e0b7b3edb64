"""Signals: rule votes, hybrid with model probabilities, smoothing, entry gates, range setups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalar import num, sql_clip
from tidebar.session import cut_lineage
from tidebar.operators.timeline import (
    KEYS,
    Layout,
    asof_backward,
    chunked,
    core_rows,
    epoch,
    ewm,
    lag,
    positioned,
    rolling,
)

TECH_WEIGHT, ML_WEIGHT = 0.35, 0.65
SMOOTHING = 0.70
SMOOTH_LAYOUT = Layout(rows=32768, back=512, ahead=0, block=512)


def technical_votes(df: DataFrame) -> DataFrame:
    """Seven indicator votes and the resulting signal, for every bar of chunked rows.

    A missing indicator makes its comparisons false.
    """
    df = df.selectExpr("*", f"{lag('macd_hist')} AS _hist1")
    df = df.selectExpr(
        "*",
        "CASE WHEN rsi < 30 THEN double(1.5) WHEN rsi > 70 THEN double(-1.5) "
        "WHEN rsi < 45 OR rsi > 55 THEN double(0.5) ELSE double(0) END AS _v_rsi",
        "CASE WHEN macd > macd_signal AND _hist1 < 0 AND macd_hist >= 0 THEN double(2) "
        "WHEN macd < macd_signal AND _hist1 > 0 AND macd_hist <= 0 THEN double(-2) "
        "WHEN macd > macd_signal THEN double(0.8) WHEN macd < macd_signal THEN double(-0.8) "
        "ELSE double(0) END AS _v_macd",
        " + ".join(
            f"CASE WHEN {c} THEN double(0.5) ELSE double(-0.5) END"
            for c in ("close > ema_9", "ema_9 > ema_21", "close > ema_50")
        ) + " AS _v_ema",
        "CASE WHEN close <= bb_lower THEN double(1.5) WHEN close >= bb_upper THEN double(-1.5) "
        "WHEN close < bb_mid THEN double(-0.3) ELSE double(0.3) END AS _v_bb",
        "CASE WHEN stoch_k < 20 AND stoch_k > stoch_d THEN double(1.5) "
        "WHEN stoch_k > 80 AND stoch_k < stoch_d THEN double(-1.5) "
        "WHEN stoch_k < 20 THEN double(0.8) WHEN stoch_k > 80 THEN double(-0.8) "
        "ELSE double(0) END AS _v_stoch",
        "CASE WHEN adx > 25 THEN double(1) ELSE double(0.5) END AS _damp",
        "CASE WHEN adx > 25 THEN CASE WHEN adx_dmp > adx_dmn THEN double(1) ELSE double(-1) END "
        "ELSE double(0) END AS _v_adx",
        "CASE WHEN volume_ratio > double(1.5) THEN double(1.2) "
        "WHEN volume_ratio < double(0.5) THEN double(0.7) ELSE double(1) END AS _vol",
    )
    votes = ("_v_rsi", "_v_macd", "_v_ema", "_v_bb", "_v_stoch")
    df = df.selectExpr(
        "*",
        f"(({' + '.join(votes)}) * _damp + _v_adx) * _vol AS _score",
        f"(({' + '.join(f'abs({v})' for v in votes)}) * _damp + abs(_v_adx)) * _vol AS _most",
    )
    df = df.selectExpr("*", "_score / CASE WHEN _most = 0 THEN double(1) ELSE _most END AS _norm")
    # the first bar has no predecessor: no data, no opinion
    df = df.selectExpr(
        "*",
        "CASE WHEN pos = 0 THEN 'HOLD' WHEN _norm > double(0.2) THEN 'LONG' "
        "WHEN _norm < double(-0.2) THEN 'SHORT' ELSE 'HOLD' END AS tech_signal",
        "CASE WHEN pos = 0 THEN double(0) ELSE abs(_norm) END AS tech_confidence",
        f"CASE WHEN pos = 0 THEN double(0.33) ELSE {sql_clip('0.5D + _norm * 0.5D', 0.0, 1.0)} END "
        "AS tech_long",
        "CASE WHEN pos = 0 THEN double(0.33) ELSE 1 - "
        f"{sql_clip('0.5D + _norm * 0.5D', 0.0, 1.0)} END AS tech_short",
    )
    return df.drop("_hist1", *votes, "_damp", "_v_adx", "_vol", "_score", "_most", "_norm")


def _pick(long: str, short: str, hold: str) -> str:
    """Largest of three probabilities; ties go to LONG, then SHORT."""
    return (
        f"CASE WHEN {long} >= {short} AND {long} >= {hold} THEN 'LONG' "
        f"WHEN {short} >= {hold} THEN 'SHORT' ELSE 'HOLD' END"
    )


def hybrid(df: DataFrame) -> DataFrame:
    """Blend of rule and model probabilities (columns ``ml_long``, ``ml_short``, ``ml_signal``,
    NULL where no model scored the bar) and the agreement of the two."""
    df = df.selectExpr(
        "*",
        *[
            f"CASE WHEN ml_long IS NULL THEN tech_{s} ELSE tech_{s} * {num(TECH_WEIGHT)} "
            f"+ ml_{s} * {num(ML_WEIGHT)} END AS raw_{s}"
            for s in ("long", "short")
        ],
    )
    df = df.selectExpr("*", "greatest(double(0), 1 - raw_long - raw_short) AS raw_hold")
    return df.selectExpr(
        "*",
        f"{_pick('raw_long', 'raw_short', 'raw_hold')} AS raw_signal",
        "CASE WHEN ml_long IS NULL THEN 'TA_ONLY' "
        "WHEN tech_signal = ml_signal AND tech_signal <> 'HOLD' THEN 'AGREE' "
        "WHEN tech_signal = 'HOLD' AND ml_signal = 'HOLD' THEN 'BOTH_HOLD' "
        "ELSE 'SPLIT' END AS agreement",
    )


def smooth(df: DataFrame, bucket_seconds: int = 90 * 86400) -> DataFrame:
    """Conditional smoothing of the blended probabilities, then the confidence floors.

    Only bars with a directional blend (and the first bar) move the average; the others keep
    it.  The moving rows are renumbered and averaged on their own, and the result is carried
    back onto all rows as of their time.  ``df`` has ``pos`` but no chunk columns; it is read
    by several branches, so it is written once first.
    """
    df = cut_lineage(df, "blend")
    moving = df.filter(
        "pos = 0 OR (raw_signal <> 'HOLD' AND greatest(raw_long, raw_short) > raw_hold)"
    ).select(*KEYS, "ts", "raw_long", "raw_short")
    moving = chunked(
        positioned(moving, KEYS, F.floor(epoch() / bucket_seconds), ["ts"]), SMOOTH_LAYOUT
    )
    moving = core_rows(
        ewm(
            moving,
            {"ema_long": ("raw_long", SMOOTHING, 0, 1), "ema_short": ("raw_short", SMOOTHING, 0, 1)},
            layout=SMOOTH_LAYOUT,
        )
    ).select(*KEYS, "ts", "ema_long", "ema_short")
    df = asof_backward(df, moving, ["ema_long", "ema_short"], on=KEYS)
    df = df.selectExpr("*", "greatest(double(0), 1 - ema_long - ema_short) AS ema_hold")
    df = df.selectExpr(
        "*",
        f"{_pick('ema_long', 'ema_short', 'ema_hold')} AS _sig",
        "greatest(ema_long, ema_short, ema_hold) AS _conf",
    )
    split = "agreement = 'SPLIT' AND _sig <> 'HOLD' AND _conf < double(0.4)"
    return df.selectExpr(
        "*",
        f"CASE WHEN {split} OR _conf <= double(0.33) THEN 'HOLD' ELSE _sig END AS signal",
        f"CASE WHEN {split} THEN _conf * double(0.7) ELSE _conf END AS confidence",
    ).drop("_sig", "_conf")


def market_gate(df: DataFrame) -> DataFrame:
    """First reason why the market is not ready, on chunked rows (NULL = ready).

    The ratio is current ATR to its 20-value mean: 0 with fewer than 20 values.
    """
    df = df.selectExpr(
        "*",
        # ATR starts at row 13: 20 values from row 32, and their mean from the same row
        f"{rolling('avg(atr)', 20, 13)} AS _mean20",
        f"abs(close - {lag('close', 3)}) AS _move3",
    )
    df = df.selectExpr(
        "*",
        "CASE WHEN _mean20 IS NULL THEN double(0) WHEN _mean20 > 0 THEN atr / _mean20 "
        "ELSE double(1) END AS gate_atr_ratio",
    )
    return df.selectExpr(
        "*",
        "CASE WHEN gate_atr_ratio < double(0.9) THEN 'too quiet' "
        "WHEN gate_atr_ratio > double(2.5) THEN 'extreme spike' "
        "WHEN adx > 0 AND adx < 16 THEN 'adx too low' "
        "WHEN _mean20 IS NOT NULL AND atr > 0 AND _move3 < double(0.25) * atr THEN 'no momentum' "
        "END AS market_skip",
    ).drop("_mean20", "_move3")


def signal_gate(df: DataFrame, threshold: str = "double(0.55)") -> DataFrame:
    """First reason to skip a signal: hold, low confidence, or disagreement in a trend."""
    thr = sql_clip(threshold, 0.0, 0.95)
    return df.selectExpr(
        "*",
        "CASE WHEN signal = 'HOLD' THEN 'hold' "
        f"WHEN confidence < {thr} THEN 'low confidence' "
        "WHEN regime = 'TRENDING' AND agreement <> 'AGREE' "
        f"AND confidence < {thr} + double(0.2) THEN 'trend needs agreement' END AS signal_skip",
    )


def payoff_gate(df: DataFrame, fee: float = 0.0005, min_multiple: float = 2.5,
                min_rr: float = 1.20) -> DataFrame:
    """Fees against the best case: needs entry_price, take_profit, stop_loss, quantity and the
    regime multipliers ``sl_mult``/``tp_mult``."""
    df = df.selectExpr(
        "*",
        f"entry_price * quantity * {num(2 * fee)} AS roundtrip_fee",
        "abs(entry_price - stop_loss) * quantity * tp_mult / sl_mult AS expected_gross",
        "abs(take_profit - entry_price) * quantity AS _win",
        "abs(entry_price - stop_loss) * quantity AS _loss",
    )
    df = df.selectExpr("*", "(_win - roundtrip_fee) / (_loss + roundtrip_fee) AS net_rr")
    return df.selectExpr(
        "*",
        "CASE WHEN atr IS NULL OR atr <= 0 OR quantity <= 0 THEN NULL "
        f"WHEN expected_gross < roundtrip_fee * {num(min_multiple)} THEN 'payoff below fees' "
        f"WHEN _win - roundtrip_fee <= 0 OR net_rr < {num(min_rr)} THEN 'net reward too small' "
        "END AS payoff_skip",
    ).drop("_win", "_loss")


def range_setup(df: DataFrame, losses: str | None = None) -> DataFrame:
    """Mean-reversion setups at the Bollinger bands, scored; long is tried first.

    Chunked rows with ``regime_atr_ratio`` style ratio in ``atr_ratio_20``.  ``losses`` names a
    column with the current streak of losing range trades (penalised from 2 on).
    """
    kept = df.columns
    df = df.selectExpr(
        "*",
        f"{lag('close')} AS _prev",
        "coalesce(nullif(rsi, double(0)), double(50)) AS _rsi",
        "coalesce(nullif(stoch_k, double(0)), double(50)) AS _k",
        "coalesce(nullif(stoch_d, double(0)), double(50)) AS _d",
        "CASE WHEN atr_ratio_20 < double(0.8) THEN double(0.10) "
        "WHEN atr_ratio_20 < double(0.9) THEN double(0.05) ELSE double(0) END AS _quiet",
        "double(0) AS _malus" if losses is None else
        f"CASE WHEN {losses} >= 2 THEN double(0.15) * {losses} ELSE double(0) END AS _malus",
        # a setup needs 20 bars of history, valid bands and a market that is not breaking out
        "pos >= 19 AND bb_upper > 0 AND bb_lower > 0 AND atr > 0 "
        "AND atr_ratio_20 <= double(1.1) AS _able",
    )
    long_on = (
        "_able AND close <= bb_lower * (1 + double(0.003)) AND _rsi < 38 AND _k < 30 "
        "AND close <= _prev + double(0.5) * atr"
    )
    short_on = (
        "_able AND close >= bb_upper * (1 - double(0.003)) AND _rsi > 62 AND _k > 70 "
        "AND close >= _prev - double(0.5) * atr"
    )
    long_q = (
        "double(0.5) + CASE WHEN _rsi < 25 THEN double(0.2) WHEN _rsi < 30 THEN double(0.12) "
        "ELSE double(0) END + CASE WHEN _k > _d AND _k < 25 THEN double(0.15) "
        "WHEN _k < 20 THEN double(0.08) ELSE double(0) END + CASE WHEN close < bb_lower "
        "THEN double(0.15) ELSE double(0) END + _quiet - _malus"
    )
    short_q = (
        "double(0.5) + CASE WHEN _rsi > 75 THEN double(0.2) WHEN _rsi > 70 THEN double(0.12) "
        "ELSE double(0) END + CASE WHEN _k < _d AND _k > 75 THEN double(0.15) "
        "WHEN _k > 80 THEN double(0.08) ELSE double(0) END + CASE WHEN close > bb_upper "
        "THEN double(0.15) ELSE double(0) END + _quiet - _malus"
    )
    df = df.selectExpr(
        "*",
        f"CASE WHEN {long_on} THEN {sql_clip(long_q, 0.0, 1.0)} END AS _lq",
        f"CASE WHEN {short_on} THEN {sql_clip(short_q, 0.0, 1.0)} END AS _sq",
        "CASE WHEN bb_upper > bb_lower THEN (close - bb_lower) / (bb_upper - bb_lower) "
        "ELSE double(0.5) END AS bb_position",
    )
    return df.selectExpr(
        *kept,
        "CASE WHEN _lq >= double(0.55) THEN 'LONG' WHEN _sq >= double(0.55) THEN 'SHORT' "
        "ELSE 'NONE' END AS range_direction",
        "CASE WHEN _lq >= double(0.55) THEN _lq WHEN _sq >= double(0.55) THEN _sq "
        "ELSE double(0) END AS range_quality",
        "CASE WHEN _lq >= double(0.55) OR _sq >= double(0.55) THEN double(1.5) END AS range_sl_mult",
        "CASE WHEN _lq >= double(0.55) OR _sq >= double(0.55) THEN double(2.5) END AS range_tp_mult",
        "bb_position",
    )
