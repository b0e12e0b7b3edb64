"""Sizing, loss limits, streaks, rolling trade windows and throttles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.params import LOT_STEP
from tidebar.functions.scalar import num, sql_clip, sql_lookup
from tidebar.operators.selection import greedy_select
from tidebar.operators.timeline import (
    Layout,
    chunked,
    core_rows,
    lag,
    over,
    positioned,
    prefix_scan,
)

TRADE_LAYOUT = Layout(rows=32768, back=64, ahead=0, block=2048)
SIDE_KEYS = ("symbol", "side")


def numbered_trades(trades: DataFrame, keys=SIDE_KEYS, order=("ts", "trade_id"),
                    bucket_seconds: int = 86400) -> DataFrame:
    """Trades numbered per key and cut into chunks for the windows below."""
    bucket = F.floor(F.unix_seconds(F.col(order[0])) / bucket_seconds)
    return chunked(positioned(trades, keys, bucket, list(order)), TRADE_LAYOUT)


def rolling_win_rate(trades: DataFrame, window: int = 20, min_trades: int = 6) -> DataFrame:
    """Win rate of the last trades per (symbol, side) and the threshold adjustment in points.

    Below 35 % +4, above 60 % -2, linear in between, nothing with fewer than six trades.
    """
    frame = f"ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW"
    df = numbered_trades(trades).selectExpr(
        "*",
        f"{over('avg(CASE WHEN won THEN double(1) ELSE double(0) END)', frame, SIDE_KEYS)} "
        "AS win_rate",
        f"{over('count(1)', frame, SIDE_KEYS)} AS n_recent",
    )
    adj = (
        f"CASE WHEN n_recent < {min_trades} THEN double(0) WHEN win_rate < double(0.35) THEN "
        "double(4) WHEN win_rate > double(0.6) THEN double(-2) ELSE double(4) - double(6) * "
        "((win_rate - double(0.35)) / (double(0.6) - double(0.35))) END"
    )
    return core_rows(df).selectExpr("*", f"{sql_clip(adj, -6.0, 6.0)} AS threshold_adj")


def recalibration_summary(trades: DataFrame) -> DataFrame:
    """Latest rolling state per (symbol, side)."""
    df = rolling_win_rate(trades)
    return df.groupBy("symbol", "side").agg(
        *[F.max_by(c, "pos").alias(c) for c in ("n_recent", "win_rate", "threshold_adj")]
    )


def streaks(trades: DataFrame, keys=SIDE_KEYS) -> DataFrame:
    """Length of the current run of wins (positive) or losses (negative) after each trade.

    The last trade of the other outcome is carried along by a two-level scan; the run length is
    the distance to it.
    """
    df = core_rows(numbered_trades(trades, keys)).withColumn("__g", F.floor(F.col("pos") / 32768))
    df = prefix_scan(
        df,
        {
            "__win": ("max", F.when(F.col("won"), F.col("pos"))),
            "__loss": ("max", F.when(~F.col("won"), F.col("pos"))),
        },
        keys, "__g", ["pos"],
    )
    return df.selectExpr(
        *[c for c in df.columns if not c.startswith("__")],
        "CASE WHEN won THEN pos - coalesce(__loss, -1) ELSE -(pos - coalesce(__win, -1)) END "
        "AS streak",
    )


def loss_blocks(trades: DataFrame, losses: int = 3, bars: int = 8, keys=SIDE_KEYS) -> DataFrame:
    """Entry blocks: after each third (or later) straight loss, ``bars`` bars are closed."""
    return streaks(trades, keys).filter(F.col("streak") <= -losses).select(
        *keys, F.col("exit_bar").alias("block_from"), (F.col("exit_bar") + bars).alias("block_to")
    )


def blocked_entries(candidates: DataFrame, blocks: DataFrame, keys=SIDE_KEYS,
                    bar: str = "pos") -> DataFrame:
    """Candidates with ``blocked``: does any block cover the bar?

    A block closes only a few bars, so blocks are expanded to the distinct closed bars and
    matched by equality instead of by range.
    """
    closed = blocks.selectExpr(
        *keys, f"explode(sequence(block_from, block_to - 1)) AS {bar}"
    ).distinct().withColumn("__hit", F.lit(True))
    return candidates.join(closed, [*keys, bar], "left").selectExpr(
        *candidates.columns, "coalesce(__hit, false) AS blocked"
    )


def session_loss(trades: DataFrame, keys=("symbol", "session"), order=("ts", "trade_id"),
                 limit_pct: float = 5.0, balance: float = 10_000.0,
                 limit_usdt: float = 0.0) -> DataFrame:
    """Outstanding loss with floor 0 per session: L = max(0, L + loss - profit).

    With S the running sum of losses minus profits, L = S - min(0, running min of S): two
    scans instead of a loop.  The limit is a share of the balance or an absolute amount.
    """
    df = trades.withColumn("__g", F.floor(F.unix_seconds(F.col(order[0])) / 3600))
    df = prefix_scan(df, {"__s": ("sum", -F.col("pnl_net"))}, keys, "__g", order)
    df = prefix_scan(df, {"__m": ("min", F.col("__s"))}, keys, "__g", order)
    hit = f"open_loss / {num(balance)} * 100 >= {num(limit_pct)}"
    if limit_usdt > 0:
        hit += f" OR open_loss >= {num(limit_usdt)}"
    return df.selectExpr(
        *trades.columns, "__s - least(double(0), __m) AS open_loss"
    ).selectExpr("*", f"{hit} AS limit_hit")


def recovery_ledger(trades: DataFrame, wait_bars: int = 6, keys=("symbol",),
                    order=("exit_bar", "trade_id")) -> DataFrame:
    """Outstanding loss to recover, with write-off after ``wait_bars`` bars without a loss.

    A gap longer than the wait since the last loss starts a new episode: episodes are numbered
    by a scan, and inside an episode the floor-at-zero sum is the session formula.
    """
    span = 32768
    df = trades.withColumn("__g", F.floor(F.col(order[0]) / span))
    # last losing bar strictly before this trade
    df = df.withColumn("__prev_loss", F.when(F.col("pnl_net") < 0, F.col(order[0])))
    df = prefix_scan(df, {"__last": ("max", F.col("__prev_loss"))}, keys, "__g", order)
    df = chunked(
        positioned(df, keys, F.col("__g"), list(order)), TRADE_LAYOUT
    )
    df = core_rows(df.selectExpr("*", f"{lag('__last', 1, keys)} AS __before"))
    df = df.withColumn(
        "__new", F.when(F.col(order[0]) - F.col("__before") >= wait_bars, 1).otherwise(0).cast("long")
    )
    df = prefix_scan(df, {"episode": ("sum", F.col("__new"))}, keys, "__g", order)
    ep = [*keys, "episode"]
    df = prefix_scan(df, {"__s": ("sum", -F.col("pnl_net"))}, ep, "__g", order)
    df = prefix_scan(df, {"__m": ("min", F.col("__s"))}, ep, "__g", order)
    return df.selectExpr(
        *trades.columns, "episode", "__s - least(double(0), __m) AS to_recover"
    ).selectExpr("*", "to_recover > 0 AS in_recovery")


def recovery_multiplier(attempt: str = "attempt") -> str:
    """Size factor of the k-th recovery attempt: 1.5^(k-1), at most 3."""
    return f"least(power(double(1.5), {attempt} - 1), double(3))"


def kelly_inputs(trades: DataFrame, window: int = 50, min_trades: int = 10,
                 keys=("symbol",), order=("ts", "trade_id")) -> DataFrame:
    """Win rate, mean win and mean loss of the trades before each one.

    Defaults stay (0.5, 100, 80) until ten trades with wins and losses are seen.
    """
    frame = f"ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING"

    def w(agg: str) -> str:
        return over(agg, frame, keys)

    df = numbered_trades(trades, keys, order).selectExpr(
        "*",
        f"{w('count(1)')} AS _n",
        f"{w('count_if(pnl_net > 0)')} AS _wins",
        f"{w('avg(CASE WHEN pnl_net > 0 THEN pnl_net END)')} AS _win",
        f"{w('avg(CASE WHEN pnl_net < 0 THEN pnl_net END)')} AS _loss",
    )
    ok = f"_n >= {min_trades} AND _win IS NOT NULL AND _loss IS NOT NULL"
    return core_rows(df).selectExpr(
        *trades.columns,
        f"CASE WHEN {ok} THEN _wins / _n ELSE double(0.5) END AS win_rate",
        f"CASE WHEN {ok} THEN _win ELSE double(100) END AS avg_win",
        f"CASE WHEN {ok} THEN abs(_loss) ELSE double(80) END AS avg_loss",
    )


def kelly_fraction(p: str = "win_rate", win: str = "avg_win", loss: str = "avg_loss") -> str:
    """Full Kelly fraction in [0, 0.25]; 0.01 for degenerate inputs."""
    b = f"({win} / ({loss} + 1e-10))"
    q = sql_clip(p, 0.01, 0.99)
    return (
        f"CASE WHEN {loss} <= 0 OR {p} <= 0 OR {p} >= 1 THEN double(0.01) ELSE "
        f"least(greatest(({q} * {b} - (1 - {q})) / ({b} + 1e-10), double(0)), double(0.25)) END"
    )


def position_size(df: DataFrame, method: str = "half_kelly", max_risk: float = 0.015,
                  max_position: float = 0.25) -> DataFrame:
    """Size a request row: equity, entry, stop, leverage, win statistics -> STRUCT ``size``.

    Methods: fixed_fractional, kelly, half_kelly, vol_scaled.
    """
    kelly = f"({kelly_fraction()})"
    raw = {
        "fixed_fractional": num(max_risk),
        "kelly": kelly,
        "half_kelly": f"{kelly} * double(0.5)",
        "vol_scaled": f"CASE WHEN current_atr > 0 THEN {num(max_risk)} * (1 / greatest("
                      f"double(0.5), current_atr / entry_price / double(0.005))) ELSE "
                      f"{num(max_risk)} END",
    }.get(method)
    if raw is None:
        raise ValueError(f"unknown sizing method: {method!r}")
    if "kelly" in method:
        raw += f" * {sql_clip('confidence / 0.65D', 0.3, 1.0)}"
    d = df.selectExpr(
        "*",
        "greatest(abs(entry_price - stop_price) / entry_price, double(0.001)) AS _stop",
        f"greatest(least({raw}, {num(max_risk)}), double(0.001)) AS _frac",
        f"{kelly} AS _kelly",
    )
    d = d.selectExpr("*", "account_equity * _frac / (_stop * entry_price) AS _q")
    d = d.selectExpr(
        "*", f"least(_q, account_equity * {num(max_position)} / entry_price) AS _capped"
    )
    d = d.selectExpr(
        "*",
        "CASE WHEN quantity_step > 0 THEN floor(_capped / quantity_step) * quantity_step "
        "ELSE round(_capped, 6) END AS _qty",
    )
    reason = (
        "CASE WHEN account_equity <= 0 THEN 'no account equity' WHEN entry_price <= 0 THEN "
        "'invalid entry price' WHEN stop_price <= 0 THEN 'invalid stop price' "
        "WHEN _qty <= 0 THEN 'quantity rounds to 0' END"
    )
    d = d.selectExpr("*", f"{reason} AS _why")

    def value(expr: str) -> str:
        return f"CASE WHEN _why IS NULL THEN {expr} ELSE double(0) END"

    return d.selectExpr(
        *df.columns,
        "named_struct("
        f"'quantity', {value('_qty')}, 'notional_usdt', {value('_qty * entry_price')}, "
        f"'risk_usdt', {value('_qty * entry_price * _stop')}, "
        f"'risk_pct', {value('_qty * entry_price * _stop / account_equity')}, "
        f"'kelly_fraction', {value('_kelly')}, "
        "'approved', _why IS NULL, 'reject_reason', _why) AS size",
    )


def size_trade(df: DataFrame, risk_pct: float = 0.5, leverage: int = 10, max_open: int = 5,
               tp_pct: float = 1.5, sl_pct: float = 1.0, max_daily_loss_pct: float = 5.0,
               max_daily_loss: float = 0.0, max_same_direction: int = 1) -> DataFrame:
    """Risk-based quantity, take-profit and stop with the ordered reject reasons.

    Request columns: symbol, side (long/short), entry_price, available_balance, open_trades,
    atr, sl_atr_mult, tp_atr_mult, size_scale. Optional ones: ``blocked``; ``same_direction``,
    the open positions of that side; ``daily_loss`` and ``session_balance``, for the daily limits
    in percent and (above 0) in currency; and per request ``risk_pct``, ``leverage``, ``tp_pct``
    and ``sl_pct``, where null or 0 means the setting.  Small orders are bumped
    to the 100 notional minimum if the stop then risks at most 5 % of the balance; the final
    quantity is capped so that the stop loses no more than the configured risk.
    """
    given = set(df.columns)
    blocked = "coalesce(blocked, false)" if "blocked" in given else "false"
    same = "coalesce(same_direction, 0)" if "same_direction" in given else "0"
    lost = "coalesce(daily_loss, double(0))" if "daily_loss" in given else "double(0)"
    limits = []
    if "daily_loss" in given and "session_balance" in given:
        limits.append(f"(session_balance > 0 AND {lost} / session_balance * 100 >= "
                      f"{num(max_daily_loss_pct)})")
        if max_daily_loss > 0:
            limits.append(f"(session_balance > 0 AND {lost} >= {num(max_daily_loss)})")

    def own(name: str, setting: str) -> str:
        return f"coalesce(nullif({name}, 0), {setting})" if name in given else setting

    risk_share, lever = own("risk_pct", num(risk_pct)), own("leverage", str(leverage))
    tp_share, sl_share = own("tp_pct", num(tp_pct)), own("sl_pct", num(sl_pct))
    step = sql_lookup(LOT_STEP, "symbol", 0.001)
    d = df.selectExpr(
        "*",
        f"{step} AS _step",
        f"available_balance * ({risk_share} / 100) * size_scale AS _risk",
        f"{lever} AS _lever",
    )
    d = d.selectExpr("*", "_risk * _lever / entry_price AS _raw",
                     "greatest(0, -floor(log10(_step))) AS _digits")
    d = d.selectExpr(
        "*",
        "CASE WHEN floor(_raw * 1000) / 1000 > 0 THEN floor(_raw * 1000) / 1000 "
        "ELSE ceil(_raw * 1000) / 1000 END AS _q0",
        "CASE WHEN atr > 0 THEN atr * coalesce(sl_atr_mult, double(2)) END AS _sl_atr",
        "CASE WHEN atr > 0 THEN atr * coalesce(tp_atr_mult, double(3)) END AS _tp_atr",
        "ceil(100 / entry_price / _step) * _step AS _min_qty",
    )
    sign = "CASE WHEN side = 'long' THEN 1 ELSE -1 END"
    d = d.selectExpr(
        "*",
        "_q0 * entry_price < 100 AS _small",
        f"round(entry_price + {sign} * coalesce(_tp_atr, entry_price * ({tp_share} / 100)), 4) "
        "AS _tp",
        f"round(entry_price - {sign} * coalesce(_sl_atr, entry_price * ({sl_share} / 100)), 4) "
        "AS _sl",
        "_min_qty * coalesce(_sl_atr, entry_price * double(0.02)) AS _min_risk",
    )
    allowed = "_risk"
    if max_daily_loss > 0:
        allowed = f"least(_risk, greatest(double(0), {num(max_daily_loss)} - {lost}))"
    d = d.selectExpr(
        "*",
        "CASE WHEN _small THEN _min_qty ELSE _q0 END AS _q1",
        "abs(entry_price - _sl) AS _dist",
        f"{allowed} AS _allowed",
    )
    d = d.selectExpr(
        "*",
        "_q1 * _dist > _allowed AS _over",
        "floor((_allowed / _dist) / _step) * _step AS _cap_qty",
    )
    reason = " ".join(
        [
            "CASE",
            f"WHEN open_trades >= {max_open} THEN 'max open trades'",
            "WHEN available_balance <= 0 THEN 'no available balance'",
            *([f"WHEN {' OR '.join(limits)} THEN 'daily loss limit'"] if limits else []),
            f"WHEN {blocked} THEN 'direction blocked'",
            f"WHEN {same} >= {max_same_direction} THEN 'direction full'",
            "WHEN _q0 <= 0 THEN 'quantity is 0'",
            "WHEN _small AND _min_risk > available_balance * double(0.05) THEN "
            "'minimum notional too risky'",
            "WHEN (side = 'long' AND _tp <= entry_price) OR (side = 'short' AND _tp >= "
            "entry_price) THEN 'take profit on wrong side'",
            "WHEN _dist < entry_price * double(0.0005) THEN 'stop too tight'",
            "WHEN _allowed <= 0 THEN 'risk cap is 0'",
            "WHEN _over AND _cap_qty <= 0 THEN 'risk cap too small'",
            "WHEN _over AND _cap_qty * entry_price < 100 THEN 'risk cap below minimum notional'",
            "WHEN abs(entry_price - _tp) / _dist < 1 THEN 'reward below risk'",
            "END",
        ]
    )
    d = d.selectExpr("*", f"{reason} AS reject_reason",
                     "CASE WHEN _over THEN _cap_qty ELSE _q1 END AS _qty")
    ok = "reject_reason IS NULL"
    return d.selectExpr(
        *[c for c in df.columns if c != "leverage"],
        f"{ok} AS approved",
        "reject_reason",
        f"CASE WHEN {ok} THEN _qty ELSE double(0) END AS quantity",
        f"CASE WHEN {ok} THEN _lever ELSE 1 END AS leverage",
        f"CASE WHEN {ok} THEN _tp ELSE entry_price END AS take_profit",
        f"CASE WHEN {ok} THEN _sl ELSE entry_price END AS stop_loss",
        f"CASE WHEN {ok} THEN _qty * entry_price ELSE double(0) END AS position_size_usdt",
        f"CASE WHEN {ok} THEN _qty * _dist ELSE double(0) END AS risk_amount_usdt",
    )


def throttle(events: DataFrame, min_gap: int = 6, max_per_day: int = 4,
             keys=("symbol",), bar: str = "pos", ts: str = "ts") -> DataFrame:
    """Greedy rate limit: at least ``min_gap`` bars apart and ``max_per_day`` per UTC day."""
    df = events.withColumn("__free", F.col(bar) + min_gap)
    day = F.floor(F.unix_seconds(F.col(ts)) / 86400)
    return greedy_select(
        df, keys, bar, "__free", min_gap, group=day, limit=max_per_day
    ).drop("__free")
