"""SQL statements that state, independently of the Spark code, what the bar, indicator,
feature, label, regime and signal queries must return. Used for checking only."""

from __future__ import annotations

W = "(PARTITION BY symbol ORDER BY ts)"
ANNUAL = "sqrt(252 * 96)"


def r(names: str | list[str], digits: int = 5) -> str:
    names = names.split() if isinstance(names, str) else names
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
KEY = f"symbol, {TS}"
TF = {"15m": "15 minute", "1h": "1 hour", "4h": "4 hour", "1d": "1 day"}


def bars(tf: str = "1h", symbol: str = "event_type", name: str = "bars") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT CAST({symbol} AS VARCHAR) AS symbol, time_bucket(INTERVAL {TF[tf]}, ts) AS ts,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE value > 0 GROUP BY 1, 2)"""


ORDER_BARS = """bars AS MATERIALIZED (
  SELECT o_orderpriority AS symbol, time_bucket(INTERVAL 1 day, o_orderdate) AS ts,
         arg_min(o_totalprice, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2)"""


def roll(agg: str, n: int, first: int = 0) -> str:
    return (f"CASE WHEN pos >= {first + n - 1} THEN {agg} OVER (PARTITION BY symbol ORDER BY ts "
            f"ROWS {n - 1} PRECEDING) END")


def ema(x: str, alpha: str, warm: int = 0) -> str:
    """Recursive average from the first non-null value; NULL before row ``warm``."""
    return (f"CASE WHEN pos >= {warm} THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) "
            f"OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), "
            f"lambda a, b: a + ({alpha}) * (b - a)) END")


def span(n: int) -> str:
    return f"CAST(2 AS DOUBLE) / {n + 1}"


WILD = "CAST(1 AS DOUBLE) / 14"


def rank(x: str, n: int, first: int) -> str:
    seen = f"list({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    return (f"CASE WHEN pos >= {first + n - 1} THEN (len(list_filter({seen}, lambda v: v < {x})) + "
            f"(len(list_filter({seen}, lambda v: v = {x})) + 1) / CAST(2 AS DOUBLE)) / {n} END")


def ind(source: str = "bars", p: str = "") -> str:
    """CTEs ending in ``{p}ind``: every indicator of the bars in ``source``."""
    return f"""{p}n AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS pos, lag(high) OVER w AS h1,
         lag(low) OVER w AS l1, lag(close) OVER w AS c1, lag(close, 3) OVER w AS c3,
         lag(close, 5) OVER w AS c5, lag(close, 10) OVER w AS c10, lag(close, 20) OVER w AS c20
  FROM {source} WINDOW w AS {W}),
{p}d AS (SELECT *, greatest(close - c1, 0) + c1 * 0 AS gain, greatest(c1 - close, 0) + c1 * 0 AS loss,
         CASE WHEN c1 IS NULL THEN high - low ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr,
         greatest(high - h1, 0) + h1 * 0 AS rise, greatest(l1 - low, 0) + l1 * 0 AS fall,
         ln(close / c1) AS lr, (high + low + close) / 3 * volume AS tpv,
         coalesce(sign(close - c1), 0) * volume AS sv FROM {p}n),
{p}d2 AS MATERIALIZED (SELECT *, CASE WHEN rise < fall THEN 0 ELSE rise END AS up,
         CASE WHEN fall < rise THEN 0 ELSE fall END AS down,
         sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv FROM {p}d),
{p}e AS MATERIALIZED (SELECT *, {ema('close', span(9))} AS ema_9, {ema('close', span(21))} AS ema_21,
         {ema('close', span(50))} AS ema_50, {ema('close', span(200))} AS ema_200,
         {ema('close', span(12))} - {ema('close', span(26))} AS macd,
         {ema('gain', WILD, 14)} AS ag, {ema('loss', WILD, 14)} AS al, {ema('tr', WILD, 13)} AS atr,
         {ema('up', WILD, 14)} AS su, {ema('down', WILD, 14)} AS sd,
         {ema('obv', span(20))} AS obv_ema FROM {p}d2),
{p}f AS (SELECT *, 100 - 100 / (1 + ag / (al + 1e-10)) AS rsi, 100 * su / (atr + 1e-10) AS adx_dmp,
         100 * sd / (atr + 1e-10) AS adx_dmn FROM {p}e),
{p}g AS (SELECT *, 100 * abs(adx_dmp - adx_dmn) / (adx_dmp + adx_dmn + 1e-10) AS dx FROM {p}f),
{p}h AS MATERIALIZED (SELECT *, {ema('macd', span(9))} AS macd_signal, {ema('dx', WILD, 27)} AS adx,
         {roll('avg(close)', 20)} AS sma_20, {roll('avg(close)', 50)} AS sma_50,
         {roll('avg(close)', 200)} AS sma_200, {roll('stddev_samp(close)', 20)} AS dev,
         {roll('min(low)', 14)} AS lo14, {roll('max(high)', 14)} AS hi14,
         {roll('min(low)', 20)} AS lo20, {roll('max(high)', 20)} AS hi20,
         {roll('avg(volume)', 20)} AS volume_sma, {roll('sum(tpv)', 20)} AS tpv20,
         {roll('sum(volume)', 20)} AS vol20,
         {roll('stddev_samp(lr)', 10, 1)} * {ANNUAL} AS vol_10,
         {roll('stddev_samp(lr)', 20, 1)} * {ANNUAL} AS vol_20 FROM {p}g),
{p}i AS MATERIALIZED (SELECT *, macd - macd_signal AS macd_hist, (close - lo14) / (hi14 - lo14 + 1e-10) * 100 AS stoch_k,
         close / c5 - 1 AS roc_5, close / c10 - 1 AS roc_10, close / c20 - 1 AS roc_20,
         sma_20 AS bb_mid, sma_20 + 2 * dev AS bb_upper, sma_20 - 2 * dev AS bb_lower,
         (4 * dev) / (sma_20 + 1e-10) AS bb_width, (close - (sma_20 - 2 * dev)) / (4 * dev + 1e-10) AS bb_pct,
         vol_10 / (vol_20 + 1e-10) AS vol_ratio, volume / (volume_sma + 1e-10) AS volume_ratio,
         close / (tpv20 / (vol20 + 1e-10) + 1e-10) - 1 AS vwap_ratio,
         (close - open) / open AS candle_body, abs(close - open) / (high - low + 1e-10) AS candle_body_ratio,
         (high - greatest(open, close)) / (high - low + 1e-10) AS candle_upper_wick,
         (least(open, close) - low) / (high - low + 1e-10) AS candle_lower_wick,
         CAST(close > open AS INTEGER) AS is_bullish,
         CAST(abs((close - open) / open) < 0.001 AS INTEGER) AS is_doji,
         (close - hi20) / hi20 AS pct_from_high, (close - lo20) / lo20 AS pct_from_low,
         (close - lo20) / (hi20 - lo20 + 1e-10) AS price_position,
         CAST(coalesce(high > h1, false) AS INTEGER) AS higher_high,
         CAST(coalesce(low < l1, false) AS INTEGER) AS lower_low,
         sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
         sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos
         FROM {p}h),
{p}ind AS MATERIALIZED (SELECT *, {roll('avg(stoch_k)', 3, 13)} AS stoch_d, {rank('vol_20', 100, 20)} AS vol_pct FROM {p}i)"""


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


HS = (1, 3, 5, 10, 20)
STATS = {"rsi": 14, "macd": 0, "adx": 27, "volume": 0}


def features() -> str:
    """CTEs after ``ind`` ending in ``feat``: engineered columns."""
    lags = ", ".join(f"lag({c}) OVER w AS b_{c}" for c in
                     ("rsi", "macd", "macd_signal", "macd_hist", "ema_9", "ema_21"))
    hl = ", ".join(f"lag(close, {p}) OVER w AS p{p}, {roll('max(high)', p)} AS hh{p}, "
                   f"{roll('min(low)', p)} AS ll{p}" for p in HS)
    st = ", ".join(f"{roll(f'avg({x})', n, f)} AS {x}_ma{n}, {roll(f'stddev_samp({x})', n, f)} AS {x}_std{n}"
                   for x, f in STATS.items() for n in (5, 10, 20))
    z = ", ".join(f"({x} - {x}_ma{n}) / ({x}_std{n} + 1e-10) AS {x}_z{n}" for x in STATS for n in (5, 10, 20))
    ret = ", ".join(f"close / p{p} - 1 AS return_{p}, ln(close / (p{p} + 1e-10)) AS log_ret_{p}, "
                    f"(hh{p} - ll{p}) / (close + 1e-10) AS hl_range_{p}" for p in HS)
    return f"""fa AS MATERIALIZED (SELECT *, {lags}, {hl}, {st},
   {roll('quantile_cont(bb_width, 0.2)', 20, 19)} AS q20, {roll('avg(atr)', 20, 13)} AS atr_ma,
   {roll('stddev_samp(atr)', 20, 13)} AS atr_sd FROM ind WINDOW w AS {W}),
feat AS (SELECT *, {ret}, {z}, {flag('rsi < 30')} AS rsi_oversold, {flag('rsi > 70')} AS rsi_overbought,
   {flag('rsi > 50 AND b_rsi <= 50')} AS rsi_mid_cross_up, {flag('rsi < 50 AND b_rsi >= 50')} AS rsi_mid_cross_down,
   {flag('macd > macd_signal AND b_macd <= b_macd_signal')} AS macd_cross_up,
   {flag('macd < macd_signal AND b_macd >= b_macd_signal')} AS macd_cross_down,
   {flag('macd > 0')} AS macd_positive, {flag('macd_hist > b_macd_hist')} AS macd_hist_rising,
   {flag('ema_9 > ema_21 AND b_ema_9 <= b_ema_21')} AS ema_9_21_cross_up,
   {flag('ema_9 < ema_21 AND b_ema_9 >= b_ema_21')} AS ema_9_21_cross_down,
   {flag('bb_width < q20')} AS bb_squeeze, atr / (close + 1e-10) AS atr_ratio,
   (atr - atr_ma) / (atr_sd + 1e-10) AS atr_z20, (close / p1 - 1) * ln(1 + volume) AS vol_price_momentum,
   volume / (volume_sma + 1e-10) AS vol_spike FROM fa)"""


REGIME_FLAGS = f"""ra AS (SELECT *, close / c1 - 1 AS ret FROM ind),
rb AS (SELECT *, {roll('stddev_samp(ret)', 20, 1)} AS rv FROM ra),
rc AS (SELECT *, {rank('bb_width', 50, 19)} AS wr, {rank('rv', 100, 20)} AS vr FROM rb),
flags AS (SELECT *, {flag('adx > 25')} AS regime_trending, {flag('adx > 40')} AS regime_strong,
  {flag('adx < 20')} AS regime_weak, {flag('wr < 0.2')} AS regime_squeeze, {flag('wr > 0.8')} AS regime_expansion,
  {flag('vr > 0.7')} AS regime_high_vol, {flag('vr < 0.3')} AS regime_low_vol,
  {flag('close / c20 - 1 > 0')} AS regime_bull_20, {flag('close / c20 - 1 < 0')} AS regime_bear_20 FROM rc)"""

HTF1 = f"""CASE WHEN ema_9 > ema_21 THEN 1 ELSE -1 END AS htf1h_trend, rsi AS htf1h_rsi,
  CASE WHEN rsi <= 0 THEN NULL WHEN rsi <= 30 THEN -2.0 WHEN rsi <= 45 THEN -1.0 WHEN rsi <= 55 THEN 0.0
       WHEN rsi <= 70 THEN 1.0 WHEN rsi <= 100 THEN 2.0 END::DOUBLE AS htf1h_rsi_zone,
  macd_hist AS htf1h_macd_hist, {flag('macd_hist > 0')} AS htf1h_macd_bull, adx AS htf1h_adx,
  {flag('adx > 25')} AS htf1h_trending, bb_pct AS htf1h_bb_pct, {flag('close > ema_50')} AS htf1h_above_50ema"""

HTF1_OUT = (f"{r('htf1h_rsi htf1h_macd_hist htf1h_adx htf1h_bb_pct htf1h_rsi_zone')}, CAST(htf1h_trend AS DOUBLE) AS htf1h_trend, "
            "CAST(htf1h_macd_bull AS DOUBLE) AS htf1h_macd_bull, CAST(htf1h_trending AS DOUBLE) AS htf1h_trending, CAST(htf1h_above_50ema AS DOUBLE) AS htf1h_above_50ema")


def htf(shift: str) -> str:
    return f"""WITH {bars('15m', name='base')}, {bars()}, {ind()},
ctx AS (SELECT symbol, ts + INTERVAL {shift} AS ts, {HTF1} FROM ind)
SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, {r('close', 2)}, {HTF1_OUT}
FROM base b ASOF LEFT JOIN ctx c ON b.symbol = c.symbol AND b.ts >= c.ts"""


def barrier(n: int, mult: str, atr: str = "atr") -> str:
    return f"""ba AS (SELECT *, list({{'h': high, 'l': low, 'c': close}}) OVER (PARTITION BY symbol ORDER BY ts
     ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS nxt, close + {mult} * {atr} AS top, close - {mult} * {atr} AS bot FROM ind),
bb AS (SELECT *, list_filter(nxt, lambda b: b.h >= top OR b.l <= bot)[1] AS hit FROM ba),
lab AS (SELECT *, CAST(CASE WHEN coalesce(len(nxt), 0) < {n} OR {atr} IS NULL OR {atr} <= 0 OR hit IS NULL THEN 0
   WHEN hit.h >= top AND hit.l <= bot THEN CASE WHEN hit.c >= close THEN 1 ELSE 2 END
   WHEN hit.h >= top THEN 1 ELSE 2 END AS INTEGER) AS label FROM bb)"""


DIST = """SELECT symbol, count(*) FILTER (WHERE label = 0) AS n_hold, count(*) FILTER (WHERE label = 1) AS n_long,
 count(*) FILTER (WHERE label = 2) AS n_short, count(*) AS n_total,
 round(100.0 * count(*) FILTER (WHERE label = 0) / count(*), 5) + 0.0 AS hold_pct,
 round(100.0 * count(*) FILTER (WHERE label = 1) / count(*), 5) + 0.0 AS long_pct,
 round(100.0 * count(*) FILTER (WHERE label = 2) / count(*), 5) + 0.0 AS short_pct,
 count(*) FILTER (WHERE label = 0) * 1.0 / count(*) < 0.2 AS hold_too_low FROM lab GROUP BY symbol"""

REGIME = f"""ga AS (SELECT *, CASE WHEN atr > 0 AND pos >= 18 THEN atr / avg(atr) OVER (PARTITION BY symbol ORDER BY ts ROWS 47 PRECEDING)
   ELSE 1.0 END AS regime_atr_ratio FROM ind),
gb AS (SELECT *, CASE WHEN adx >= 25 THEN 'TRENDING' WHEN regime_atr_ratio >= 1.5 THEN 'HIGH_VOLATILITY' ELSE 'RANGE' END AS raw_regime FROM ga),
gc AS (SELECT *, CASE WHEN raw_regime = lag(raw_regime) OVER {W} THEN raw_regime END AS twice,
   list(raw_regime) OVER (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING) AS four FROM gb),
reg AS MATERIALIZED (SELECT *, coalesce(last_value(twice IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 'RANGE') AS regime FROM gc)"""

VOTES = f"""va AS (SELECT *, lag(macd_hist) OVER {W} AS h0 FROM SRC),
vb AS (SELECT *, CASE WHEN rsi < 30 THEN 1.5 WHEN rsi > 70 THEN -1.5 WHEN rsi < 45 THEN 0.5 WHEN rsi > 55 THEN 0.5 ELSE 0 END::DOUBLE AS v1,
  CASE WHEN macd > macd_signal AND h0 < 0 AND macd_hist >= 0 THEN 2.0 WHEN macd < macd_signal AND h0 > 0 AND macd_hist <= 0 THEN -2.0
       WHEN macd > macd_signal THEN 0.8 WHEN macd < macd_signal THEN -0.8 ELSE 0 END::DOUBLE AS v2,
  (CASE WHEN close > ema_9 THEN 0.5 ELSE -0.5 END + CASE WHEN ema_9 > ema_21 THEN 0.5 ELSE -0.5 END + CASE WHEN close > ema_50 THEN 0.5 ELSE -0.5 END)::DOUBLE AS v3,
  CASE WHEN close <= bb_lower THEN 1.5 WHEN close >= bb_upper THEN -1.5 WHEN close < bb_mid THEN -0.3 ELSE 0.3 END::DOUBLE AS v4,
  CASE WHEN stoch_k < 20 AND stoch_k > stoch_d THEN 1.5 WHEN stoch_k > 80 AND stoch_k < stoch_d THEN -1.5 WHEN stoch_k < 20 THEN 0.8 WHEN stoch_k > 80 THEN -0.8 ELSE 0 END::DOUBLE AS v5,
  CASE WHEN adx > 25 THEN 1 ELSE 0.5 END::DOUBLE AS damp,
  CASE WHEN adx > 25 THEN CASE WHEN adx_dmp > adx_dmn THEN 1 ELSE -1 END ELSE 0 END::DOUBLE AS v6,
  CASE WHEN volume_ratio > 1.5 THEN 1.2 WHEN volume_ratio < 0.5 THEN 0.7 ELSE 1 END::DOUBLE AS amp FROM va),
vc AS (SELECT *, ((v1 + v2 + v3 + v4 + v5) * damp + v6) * amp AS score,
  ((abs(v1) + abs(v2) + abs(v3) + abs(v4) + abs(v5)) * damp + abs(v6)) * amp AS most FROM vb),
vd AS (SELECT *, score / CASE WHEN most = 0 THEN 1 ELSE most END AS norm FROM vc),
votes AS MATERIALIZED (SELECT *, CASE WHEN pos = 0 THEN 'HOLD' WHEN norm > 0.2 THEN 'LONG' WHEN norm < -0.2 THEN 'SHORT' ELSE 'HOLD' END AS tech_signal,
  CASE WHEN pos = 0 THEN 0 ELSE abs(norm) END AS tech_confidence,
  CASE WHEN pos = 0 THEN 0.33 ELSE greatest(0, least(1, 0.5 + norm * 0.5)) END AS tech_long,
  CASE WHEN pos = 0 THEN 0.33 ELSE 1 - greatest(0, least(1, 0.5 + norm * 0.5)) END AS tech_short FROM vd)"""

PICK = ("CASE WHEN {0}_long >= {0}_short AND {0}_long >= {0}_hold THEN 'LONG' "
        "WHEN {0}_short >= {0}_hold THEN 'SHORT' ELSE 'HOLD' END")

# stand-in model probabilities used by the hybrid queries on both sides
ML = """CASE WHEN pos >= 19 THEN 0.15 + 0.6 * (1 - price_position) END AS ml_long,
  CASE WHEN pos >= 19 THEN 0.15 + 0.5 * price_position END AS ml_short,
  CASE WHEN pos >= 19 THEN CASE WHEN price_position < 0.4 THEN 'LONG' WHEN price_position > 0.6 THEN 'SHORT' ELSE 'HOLD' END END AS ml_signal"""

HYBRID = f"""ya AS (SELECT *, {ML} FROM votes),
yb AS (SELECT *, CASE WHEN ml_long IS NULL THEN tech_long ELSE 0.35 * tech_long + 0.65 * ml_long END AS raw_long,
  CASE WHEN ml_long IS NULL THEN tech_short ELSE 0.35 * tech_short + 0.65 * ml_short END AS raw_short FROM ya),
yc AS (SELECT *, greatest(0, 1 - raw_long - raw_short) AS raw_hold FROM yb),
yd AS MATERIALIZED (SELECT *, {PICK.format('raw')} AS raw_signal, CASE WHEN ml_long IS NULL THEN 'TA_ONLY' WHEN tech_signal = ml_signal AND tech_signal <> 'HOLD' THEN 'AGREE'
  WHEN tech_signal = 'HOLD' AND ml_signal = 'HOLD' THEN 'BOTH_HOLD' ELSE 'SPLIT' END AS agreement FROM yc),
ym AS (SELECT *, raw_long AS _l FROM yd WHERE pos = 0 OR (raw_signal <> 'HOLD' AND greatest(raw_long, raw_short) > raw_hold)),
ys AS MATERIALIZED (SELECT symbol, ts, {ema('raw_long', '0.7')} AS ema_long, {ema('raw_short', '0.7')} AS ema_short FROM ym),
yh AS (SELECT yd.*, ys.ema_long, ys.ema_short, greatest(0, 1 - ys.ema_long - ys.ema_short) AS ema_hold
  FROM yd ASOF LEFT JOIN ys ON yd.symbol = ys.symbol AND yd.ts >= ys.ts),
yi AS (SELECT *, {PICK.format('ema')} AS sig0, greatest(ema_long, ema_short, ema_hold) AS conf0 FROM yh),
hyb AS MATERIALIZED (SELECT *, CASE WHEN (agreement = 'SPLIT' AND sig0 <> 'HOLD' AND conf0 < 0.4) OR conf0 <= 0.33 THEN 'HOLD' ELSE sig0 END AS signal,
  CASE WHEN agreement = 'SPLIT' AND sig0 <> 'HOLD' AND conf0 < 0.4 THEN conf0 * 0.7 ELSE conf0 END AS confidence FROM yi)"""

RANGE = """za AS (SELECT *, atr / avg(atr) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS ar FROM ind),
zb AS (SELECT *, CASE WHEN rsi = 0 OR rsi IS NULL THEN 50 ELSE rsi END AS rs, CASE WHEN stoch_k = 0 OR stoch_k IS NULL THEN 50 ELSE stoch_k END AS k,
  CASE WHEN stoch_d = 0 OR stoch_d IS NULL THEN 50 ELSE stoch_d END AS dd, CASE WHEN ar < 0.8 THEN 0.10 WHEN ar < 0.9 THEN 0.05 ELSE 0 END::DOUBLE AS quiet,
  pos >= 32 AND bb_upper > 0 AND bb_lower > 0 AND atr > 0 AND ar <= 1.1 AS able FROM za),
zc AS (SELECT *, CASE WHEN able AND close <= bb_lower * 1.003 AND rs < 38 AND k < 30 AND close <= c1 + 0.5 * atr THEN
   greatest(0, least(1, CAST(0.5 AS DOUBLE) + CASE WHEN rs < 25 THEN 0.2 WHEN rs < 30 THEN 0.12 ELSE 0 END::DOUBLE + CASE WHEN k > dd AND k < 25 THEN 0.15 WHEN k < 20 THEN 0.08 ELSE 0 END::DOUBLE
     + CASE WHEN close < bb_lower THEN 0.15 ELSE 0 END::DOUBLE + quiet)) END AS lq,
  CASE WHEN able AND close >= bb_upper * 0.997 AND rs > 62 AND k > 70 AND close >= c1 - 0.5 * atr THEN
   greatest(0, least(1, CAST(0.5 AS DOUBLE) + CASE WHEN rs > 75 THEN 0.2 WHEN rs > 70 THEN 0.12 ELSE 0 END::DOUBLE + CASE WHEN k < dd AND k > 75 THEN 0.15 WHEN k > 80 THEN 0.08 ELSE 0 END::DOUBLE
     + CASE WHEN close > bb_upper THEN 0.15 ELSE 0 END::DOUBLE + quiet)) END AS sq FROM zb)"""


def series_sql() -> dict[str, str]:
    head = f"WITH {bars()}, {ind()}"
    feat_cols = [f"{k}_{p}" for p in HS for k in ("return", "log_ret", "hl_range")]
    stat_cols = [f"{x}_{s}{n}" for x in STATS for n in (5, 10, 20) for s in ("ma", "std", "z")]
    q = {
        "bars_1h": f"WITH {bars()} SELECT {KEY}, open, high, low, close, volume FROM bars",
        "bars_4h_by_user": f"WITH {bars('4h', 'user_id')} SELECT {KEY}, open, high, low, close, volume FROM bars",
        "bars_daily_orders": f"WITH {ORDER_BARS} SELECT {KEY}, open, high, low, close, volume FROM bars",
        "bars_daily_lineitem": f"""SELECT l_returnflag AS symbol, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ts,
  round(arg_min(p, seq), 9) + 0.0 AS open, round(max(p), 9) + 0.0 AS high, round(min(p), 9) + 0.0 AS low, round(arg_max(p, seq), 9) + 0.0 AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p, l_shipdate::VARCHAR || lpad(l_orderkey::VARCHAR, 20, '0') || lpad(l_linenumber::VARCHAR, 4, '0') AS seq FROM lineitem) GROUP BY 1, l_shipdate, 2""",
        "bars_rolled_up_4h": f"WITH {bars('4h')} SELECT {KEY}, open, high, low, close, volume FROM bars",
        "bars_from_json_lists": f"WITH {bars()} SELECT {KEY}, open, high, low, close, volume FROM bars",
        "bars_from_json_objects": f"WITH {bars()} SELECT {KEY}, open, high, low, close, volume FROM bars",
        "bars_normalised": """SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 5) + 0.0 AS close,
  TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events WHERE value <> 0 AND (props NOT LIKE '%7%')""",
        "bars_upsert_keep_last": f"WITH {bars()} SELECT {KEY}, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN round(close + 1, 5) + 0.0 ELSE round(close, 5) + 0.0 END AS close, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 0.0 ELSE volume END::DOUBLE AS volume FROM bars",
        "bars_keep_first": "SELECT event_type AS symbol, strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS ts, arg_min(value, event_id) AS close, min(event_id) AS event_id FROM events GROUP BY 1, time_bucket(INTERVAL 1 hour, ts)",
        "bars_work_list": f"""WITH {bars('1h', 'user_id')}, m AS (SELECT symbol, max(ts) AS last_ts, count(*) AS bars FROM bars GROUP BY 1),
  a AS (SELECT TIMESTAMP '2024-02-01' AS now0) SELECT symbol, bars, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts, strftime(last_ts + INTERVAL 1 hour, '%Y-%m-%d %H:%M:%S') AS resume_ts,
  CAST(floor((epoch(now0) - epoch(last_ts)) / 3600) AS BIGINT) AS missing_bars, floor((epoch(now0) - epoch(last_ts)) / 3600) <= 1 AS up_to_date, floor((epoch(now0) - epoch(last_ts)) / 86400) < 2 AS fresh FROM m, a""",
        "bars_inventory": f"""WITH {bars('1h', 'user_id')}, m AS (SELECT symbol, min(ts) AS s, max(ts) AS e, count(*) AS bars FROM bars GROUP BY 1)
  SELECT symbol, bars, strftime(s, '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(e, '%Y-%m-%d %H:%M:%S') AS end_ts, CAST(floor((epoch(e) - epoch(s)) / 86400) AS BIGINT) AS days,
  CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(e)) / 86400) AS BIGINT) AS age_days, floor((epoch(TIMESTAMP '2024-02-01') - epoch(e)) / 86400) > 2 AS stale FROM m""",
        "indicators_trend": f"{head} SELECT {KEY}, pos, {r('ema_9 ema_21 ema_50 ema_200 sma_20 sma_50 sma_200 macd macd_signal macd_hist')} FROM ind",
        "indicators_momentum": f"{head} SELECT {KEY}, pos, {r('rsi stoch_k stoch_d roc_5 roc_10 roc_20')} FROM ind",
        "indicators_volatility": f"{head} SELECT {KEY}, pos, {r('atr bb_mid bb_upper bb_lower bb_width bb_pct vol_10 vol_20 vol_ratio vol_pct')} FROM ind",
        "indicators_direction": f"{head} SELECT {KEY}, pos, {r('adx adx_dmp adx_dmn')} FROM ind",
        "indicators_volume": f"{head} SELECT {KEY}, pos, {r('volume_sma volume_ratio obv obv_ema vwap_ratio')} FROM ind",
        "indicators_candles": f"{head} SELECT {KEY}, pos, {r('candle_body candle_body_ratio candle_upper_wick candle_lower_wick')}, is_bullish, is_doji FROM ind",
        "indicators_structure": f"{head} SELECT {KEY}, pos, {r('pct_from_high pct_from_low price_position hour_sin hour_cos dow_sin dow_cos')}, higher_high, lower_low FROM ind",
        "indicators_daily_orders": f"WITH {ORDER_BARS}, {ind()} SELECT {KEY}, pos, {r('sma_50 rsi atr bb_pct adx obv', 4)} FROM ind",
        "features_engineered": f"{head}, {features()} SELECT {KEY}, {r(feat_cols + stat_cols + ['atr_ratio', 'atr_z20', 'vol_price_momentum', 'vol_spike'], 4)}, rsi_oversold, rsi_overbought, rsi_mid_cross_up, rsi_mid_cross_down, macd_cross_up, macd_cross_down, macd_positive, macd_hist_rising, ema_9_21_cross_up, ema_9_21_cross_down, bb_squeeze FROM feat",
        "features_complete_rows": f"{head}, {features()} SELECT symbol, count(*) AS n_rows, min(pos) AS first_pos FROM feat WHERE vol_pct IS NOT NULL AND adx_z20 IS NOT NULL AND sma_50 IS NOT NULL GROUP BY 1",
        "features_regime_flags": f"{head}, {REGIME_FLAGS} SELECT {KEY}, regime_trending, regime_strong, regime_weak, regime_squeeze, regime_expansion, regime_high_vol, regime_low_vol, regime_bull_20, regime_bear_20 FROM flags",
        "features_context_1h": htf("0 hour"),
        "features_context_1h_closed": htf("1 hour"),
        "features_context_4h": f"""WITH {bars('1h', name='base')}, {bars('4h')}, {ind()},
ctx AS (SELECT symbol, ts, CASE WHEN ema_9 > ema_21 THEN 1 ELSE -1 END AS htf4h_trend, {flag('close > ema_50')} AS htf4h_above_50ema, rsi AS htf4h_rsi, adx AS htf4h_adx, {flag('adx > 25')} AS htf4h_trending,
  {flag('atr > ' + roll('avg(atr)', 20, 13))} AS htf4h_vol_regime, {flag('bb_width > ' + roll('avg(bb_width)', 20, 19))} AS htf4h_expanding, {flag('macd_hist > 0')} AS htf4h_macd_bull FROM ind)
SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, htf4h_trend, htf4h_above_50ema, {r('htf4h_rsi htf4h_adx')}, htf4h_trending, htf4h_vol_regime, htf4h_expanding, htf4h_macd_bull
FROM base b ASOF LEFT JOIN ctx c ON b.symbol = c.symbol AND b.ts >= c.ts""",
        "features_merged_timeframes": f"""WITH {bars('15m', name='base')}, {bars('1h', name='b1')}, {bars('4h', name='b4')}, {ind('b1', 'p1')}, {ind('b4', 'p4')}
SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, {', '.join(f'round({t}.{c}, 5) + 0.0 AS {c}_{n}' for t, n in (('p1ind', '1h'), ('p4ind', '4h')) for c in ('rsi', 'macd', 'adx', 'ema_50', 'bb_upper', 'bb_lower', 'atr'))}
FROM base b ASOF LEFT JOIN p1ind ON b.symbol = p1ind.symbol AND b.ts >= p1ind.ts ASOF LEFT JOIN p4ind ON b.symbol = p4ind.symbol AND b.ts >= p4ind.ts""",
        "labels_triple_barrier": f"{head}, {barrier(8, '1.5')} SELECT {KEY}, label FROM lab",
        "labels_barrier_without_atr": f"""WITH {bars()}, n AS (SELECT *, row_number() OVER w - 1 AS pos, ln(close / lag(close) OVER w) AS lr FROM bars WINDOW w AS {W}),
ind AS (SELECT *, {roll('stddev_samp(lr)', 14, 1)} * close AS wid FROM n), {barrier(8, '1.5', 'wid')} SELECT {KEY}, label FROM lab""",
        "labels_vol_adaptive": f"""WITH {bars()}, n AS (SELECT *, row_number() OVER w - 1 AS pos, CASE WHEN lag(close) OVER w IS NULL THEN 0 ELSE ln(close / (lag(close) OVER w + 1e-10)) END AS lr,
  ln(lead(close, 8) OVER w / (close + 1e-10)) AS fwd FROM bars WINDOW w AS {W}), t AS (SELECT *, coalesce({roll('stddev_samp(lr)', 20)}, 0) AS thr FROM n)
SELECT {KEY}, CAST(CASE WHEN fwd IS NULL OR thr <= 0 THEN 0 WHEN fwd > thr THEN 1 WHEN fwd < -thr THEN 2 ELSE 0 END AS INTEGER) AS label FROM t""",
        "labels_quantile": f"""WITH {bars()}, n AS (SELECT *, (lead(close, 8) OVER w - close) / close AS fwd FROM bars WINDOW w AS {W}),
c AS (SELECT symbol, quantile_cont(fwd, 0.33) AS lo, quantile_cont(fwd, 1 - 0.33) AS hi FROM n GROUP BY 1)
SELECT n.symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(CASE WHEN fwd >= hi THEN 1 WHEN fwd <= lo THEN 2 ELSE 0 END AS INTEGER) AS label FROM n JOIN c ON n.symbol = c.symbol""",
        "labels_fixed_threshold": f"WITH {bars()}, n AS (SELECT *, lead(close, 12) OVER w / close - 1 AS fwd FROM bars WINDOW w AS {W}) SELECT {KEY}, CAST(CASE WHEN fwd > 0.008 THEN 1 WHEN fwd < -0.008 THEN 2 ELSE 0 END AS INTEGER) AS label FROM n",
        "label_distribution": f"{head}, {barrier(12, '3.0')} {DIST}",
        "label_class_weights": f"{head}, {barrier(8, '1.5')}, k AS (SELECT symbol, label, count(*) AS n_class FROM lab GROUP BY 1, 2) SELECT symbol, label, n_class, round(sum(n_class) OVER (PARTITION BY symbol) * 1.0 / (count(*) OVER (PARTITION BY symbol) * n_class), 5) + 0.0 AS weight FROM k",
        "regime_confirmed": f"{head}, {REGIME} SELECT {KEY}, raw_regime, regime, {r('regime_atr_ratio')}, round(len(list_filter(four, lambda x: x = regime)) * 1.0 / len(four), 5) + 0.0 AS confirmation_pct FROM reg",
        "regime_parameters": f"""{head}, {REGIME}, t AS (SELECT * FROM (VALUES ('TRENDING', 0.03, 1.25, 1.2, 0.8, 0.8, 10), ('RANGE', 0.02, 1.0, 1.0, 1.0, 1.1, 8), ('HIGH_VOLATILITY', 0.05, 1.4, 1.1, 0.5, 0.65, 6)) v(name, cf, sl, tp, sz, er, tb))
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, regime, round(CAST(0.55 + cf AS DOUBLE), 5) + 0.0 AS conf_threshold, round(CAST(2.0 * sl AS DOUBLE), 5) + 0.0 AS sl_mult, round(CAST(3.0 * tp AS DOUBLE), 5) + 0.0 AS tp_mult, CAST(sz AS DOUBLE) AS size_scale, CAST(er AS DOUBLE) AS early_profit_r, CAST(tb AS INTEGER) AS timeout_bars, regime = 'TRENDING' AS require_agree FROM reg JOIN t ON name = regime""",
        "signals_technical": f"{head}, {VOTES.replace('SRC', 'ind')} SELECT {KEY}, tech_signal, {r('tech_confidence tech_long tech_short', 4)} FROM votes",
        "signals_hybrid": f"{head}, {VOTES.replace('SRC', 'ind')}, {HYBRID} SELECT {KEY}, agreement, raw_signal, signal, {r('ema_long ema_short confidence', 4)} FROM hyb",
        "signals_market_gate": f"""{head}, m AS (SELECT *, {roll('avg(atr)', 20, 13)} AS m20 FROM ind), s AS (SELECT *, CASE WHEN m20 IS NULL THEN 0 WHEN m20 > 0 THEN atr / m20 ELSE 1 END AS gate_atr_ratio FROM m)
SELECT {KEY}, {r('gate_atr_ratio')}, CASE WHEN gate_atr_ratio < 0.9 THEN 'too quiet' WHEN gate_atr_ratio > 2.5 THEN 'extreme spike' WHEN adx > 0 AND adx < 16 THEN 'adx too low' WHEN m20 IS NOT NULL AND atr > 0 AND abs(close - c3) < 0.25 * atr THEN 'no momentum' END AS market_skip FROM s""",
        "signals_entry_gate": f"""{head}, {REGIME}, {VOTES.replace('SRC', 'reg')}, {HYBRID}, gate AS (SELECT symbol, CASE WHEN signal = 'HOLD' THEN 'hold' WHEN confidence < 0.45 THEN 'low confidence' WHEN regime = 'TRENDING' AND agreement <> 'AGREE' AND confidence < 0.65 THEN 'trend needs agreement' ELSE 'enter' END AS outcome, regime FROM hyb)
SELECT symbol, regime, outcome, count(*) AS n FROM gate GROUP BY 1, 2, 3""",
        "records_signals": f"""{head}, {REGIME}, {VOTES.replace('SRC', 'reg')}, {HYBRID} SELECT symbol, lower(signal) AS signal, CASE WHEN agreement = 'AGREE' THEN 'AGREE' ELSE 'SPLIT' END AS signal_type, regime, strftime(ts, '%Y-%m-%d %H:%M:%S') AS signaled_at,
  round(confidence, 2) + 0.0 AS confidence, round(ema_long, 2) + 0.0 AS ema_long, round(ema_short, 2) + 0.0 AS ema_short, round(adx, 4) + 0.0 AS adx, round(regime_atr_ratio, 4) + 0.0 AS atr_ratio, round(close, 5) + 0.0 AS price_at_signal FROM hyb""",
        "bars_first_rows": f"WITH {bars()}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars) SELECT {KEY}, round(close, 5) + 0.0 AS close FROM n WHERE k <= 200",
        "signals_symbol_gate": f"""{head}, {REGIME}, {VOTES.replace('SRC', 'reg')}, {HYBRID}, named AS (SELECT *, CASE symbol WHEN 'click' THEN 'BTCUSDT' WHEN 'error' THEN 'ETHUSDT' WHEN 'purchase' THEN 'BNBUSDT' WHEN 'signup' THEN 'SOLUSDT' ELSE symbol END AS coin FROM hyb),
thr AS (SELECT *, CASE WHEN coin IN ('ETHUSDT', 'SOLUSDT') THEN 0.38 ELSE 0.42 END AS t FROM named)
SELECT coin, CASE WHEN signal = 'HOLD' THEN 'hold' WHEN confidence < t THEN 'low confidence' WHEN regime = 'TRENDING' AND agreement <> 'AGREE' AND confidence < t + 0.2 THEN 'trend needs agreement' ELSE 'enter' END AS outcome, count(*) AS n FROM thr GROUP BY 1, 2""",
        "bars_landed_files": "SELECT symbol, timeframe, symbol = 'signup' OR (symbol = 'view' AND timeframe = '4h') AS missing, NOT (symbol = 'signup' OR (symbol = 'view' AND timeframe = '4h')) AS landed, NOT (symbol = 'signup' OR (symbol = 'view' AND timeframe = '4h')) AS filled FROM (SELECT DISTINCT event_type AS symbol FROM events), (SELECT unnest(['1h', '4h']) AS timeframe)",
        "signals_range_setup": f"{head}, {RANGE} SELECT {KEY}, CASE WHEN lq >= 0.55 THEN 'LONG' WHEN sq >= 0.55 THEN 'SHORT' ELSE 'NONE' END AS range_direction, round(CASE WHEN lq >= 0.55 THEN lq WHEN sq >= 0.55 THEN sq ELSE 0 END, 4) + 0.0 AS range_quality, CASE WHEN lq >= 0.55 OR sq >= 0.55 THEN CAST(1.5 AS DOUBLE) END AS range_sl_mult FROM zc",
    }
    return q
