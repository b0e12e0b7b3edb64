"""Signal outcomes: the first exit of every candidate entry, its P&L, and the trade ledger."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.params import COOLDOWN_BARS, COOLDOWN_DEFAULT, REGIMES
from tidebar.functions.scalar import num, sql_clip, sql_lookup
from tidebar.operators.labels import ahead
from tidebar.operators.regime import regime_column
from tidebar.operators.selection import greedy_select
from tidebar.operators.timeline import KEYS, LAYOUT, Layout, chunked, core_rows, over, prefix_scan

CAPITAL, LEVERAGE, RISK = 10_000.0, 10, 0.01
TAKER_FEE, SLIPPAGE = 0.0004, 0.0002


def intrabar_exits(
    df: DataFrame,
    max_bars: int = 48,
    tp: float = 2.0,
    sl: float = 1.0,
    tp_pct: float = 0.02,
    sl_pct: float = 0.01,
    min_conf: float = 0.60,
    use_atr: bool = True,
    fee: float = TAKER_FEE,
    slip: float = SLIPPAGE,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Score each signal (1 long, 2 short; confidence >= min_conf) by its own first exit.

    ``df``: numbered bars with ``signal``, ``confidence`` and, for ``use_atr``, ``atr``.
    Levels are touched by highs and lows, take-profit first; otherwise the position closes at
    the close of bar ``max_bars`` (MAX_BARS) or of the last bar of the series (END).  Every
    signal is sized from the same fixed capital.
    """
    atr = f"coalesce(atr, close * {num(sl_pct)})" if use_atr else f"close * {num(sl_pct)}"
    df = chunked(df, replace(layout, back=0, ahead=max_bars))
    df = df.selectExpr(
        "*",
        f"{ahead('struct(pos AS b, high AS h, low AS l, close AS c)', max_bars)} AS _next",
        f"{atr} AS _atr",
        "CASE signal WHEN 1 THEN 1 WHEN 2 THEN -1 END AS direction",
    )
    df = core_rows(df).filter(
        f"direction IS NOT NULL AND confidence >= {num(min_conf)} AND size(_next) > 0"
    )
    df = df.selectExpr("*", f"close * (1 + {num(slip)} * direction) AS entry_price")
    if use_atr:
        levels = (f"entry_price + direction * {num(tp)} * _atr",
                  f"entry_price - direction * {num(sl)} * _atr")
    else:
        levels = (f"entry_price * (1 + direction * {num(tp_pct)})",
                  f"entry_price * (1 - direction * {num(sl_pct)})")
    df = df.selectExpr("*", f"{levels[0]} AS tp_price", f"{levels[1]} AS sl_price")
    won = "CASE WHEN direction = 1 THEN b.h >= tp_price ELSE b.l <= tp_price END"
    lost = "CASE WHEN direction = 1 THEN b.l <= sl_price ELSE b.h >= sl_price END"
    df = df.selectExpr(
        "*",
        f"get(filter(_next, b -> {won} OR {lost}), 0) AS _hit",
        "element_at(_next, -1) AS _last",
        f"{num(CAPITAL * RISK * LEVERAGE)} / greatest(_atr * {num(sl)} / close, double(0.001)) "
        "/ entry_price AS quantity",
    )
    won, lost = won.replace("b.", "_hit."), lost.replace("b.", "_hit.")
    df = df.selectExpr(
        "*",
        f"CASE WHEN _hit IS NOT NULL AND {won} THEN 'TP' WHEN _hit IS NOT NULL THEN 'SL' "
        f"WHEN size(_next) < {max_bars} THEN 'END' ELSE 'MAX_BARS' END AS exit_reason",
        "coalesce(_hit.b, _last.b) AS exit_bar",
        f"CASE WHEN _hit IS NOT NULL AND {won} THEN tp_price WHEN _hit IS NOT NULL THEN sl_price "
        "ELSE _last.c END AS _raw_exit",
    )
    return trade_pnl(df, fee, slip).selectExpr(
        *KEYS, "ts", "pos AS entry_bar", "exit_bar", "direction", "entry_price", "exit_price",
        "quantity", f"{LEVERAGE} AS leverage", "pnl_gross", "pnl_net", "fee_paid",
        "slippage_cost", "exit_reason", "confidence",
    )


def trade_pnl(df: DataFrame, fee: float = TAKER_FEE, slip: float = SLIPPAGE) -> DataFrame:
    """Exit slippage, gross and net P&L, taker fee on both legs (from ``_raw_exit``)."""
    df = df.selectExpr("*", f"_raw_exit * (1 - {num(slip)} * direction) AS exit_price")
    df = df.selectExpr(
        "*",
        "direction * (exit_price - entry_price) * quantity AS pnl_gross",
        f"(entry_price + exit_price) * quantity * {num(fee)} AS fee_paid",
        f"(abs(_raw_exit - exit_price) + abs(entry_price * {num(slip)})) * quantity "
        "AS slippage_cost",
    )
    return df.selectExpr("*", "pnl_gross - fee_paid AS pnl_net")


def close_only_exits(
    df: DataFrame,
    max_bars: int = 32,
    tp: float = 0.02,
    sl: float = 0.01,
    fee: float = TAKER_FEE,
    slip: float = SLIPPAGE,
    risk_usd: float = 100.0,
    min_conf: str = "double(0.42)",
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Fixed-risk scoring on closes: R-multiple clamped to [-1, 2].

    An entry that the series ends on has no ``exit_bar``; it stays, as it blocks later entries.
    """
    df = chunked(df, replace(layout, back=0, ahead=max_bars))
    df = df.selectExpr(
        "*",
        f"{ahead('struct(pos AS b, close AS c)', max_bars)} AS _next",
        "CASE signal WHEN 1 THEN 1 WHEN 2 THEN -1 END AS direction",
    )
    df = core_rows(df).filter(f"direction IS NOT NULL AND confidence >= {min_conf}")
    df = df.selectExpr("*", f"close * (1 + {num(slip)} * direction) AS entry_price")
    move = "direction * (b.c - entry_price) / entry_price"
    df = df.selectExpr(
        "*",
        f"get(filter(_next, b -> {move} >= {num(tp)} OR {move} <= -{num(sl)} "
        f"OR b.b - pos >= {max_bars}), 0) AS _hit",
    )
    df = df.selectExpr(
        "*",
        f"{move.replace('b.c', '_hit.c')} AS _move",
        f"_hit.c * (1 - {num(slip)} * direction) AS exit_price",
    )
    df = df.selectExpr(
        "*",
        sql_clip(
            f"(direction * (exit_price - entry_price) / entry_price - {num(2 * fee)}) / {num(sl)}",
            -1.0, 2.0,
        ) + " AS r_mult",
    )
    return df.selectExpr(
        *KEYS, "ts", "pos AS entry_bar", "_hit.b AS exit_bar", "direction", "entry_price",
        "exit_price", "confidence", "r_mult", f"r_mult * {num(risk_usd)} AS pnl_net",
        f"CASE WHEN _move >= {num(tp)} THEN 'TP' WHEN _move <= -{num(sl)} THEN 'SL' "
        "WHEN _hit IS NOT NULL THEN 'TIMEOUT' END AS exit_reason",
    )


def resolved(outcomes: DataFrame) -> DataFrame:
    """Outcomes whose exit lies within the series."""
    return outcomes.filter("exit_bar IS NOT NULL")


def fold_exits(
    df: DataFrame,
    keys=KEYS,
    max_bars: int = 10,
    tp: float = 0.0063,
    sl: float = 0.0042,
    fee: float = 0.0005,
    slip: float = 0.0002,
    layout: Layout = LAYOUT,
) -> DataFrame:
    """Per-signal net return as the fold evaluation sees it: closes only, and a hold or an
    opposite signal also ends the position.  The last bar of a series is never acted on, and an
    entry without an exit before it stays without ``exit_bar``, as it blocks later entries."""
    df = chunked(df, replace(layout, back=0, ahead=max_bars + 1))
    nxt = over(
        "collect_list(struct(pos AS b, close AS c, signal AS s))",
        f"ROWS BETWEEN 1 FOLLOWING AND {max_bars + 1} FOLLOWING", keys,
    )
    df = df.selectExpr(
        "*", f"{nxt} AS _next", "CASE signal WHEN 1 THEN 1 WHEN 2 THEN -1 END AS direction")
    df = core_rows(df).filter("direction IS NOT NULL")
    df = df.selectExpr("*", f"close * (1 + {num(slip)} * direction) AS entry_price")
    move = "direction * (b.c - entry_price) / entry_price"
    df = df.selectExpr(
        "*",
        # the final bar of the series has no successor and is left out
        f"get(filter(CASE WHEN size(_next) <= {max_bars} THEN slice(_next, 1, "
        f"greatest(size(_next) - 1, 0)) ELSE slice(_next, 1, {max_bars}) END, "
        f"b -> {move} >= {num(tp)} OR {move} <= -{num(sl)} OR b.b - pos >= {max_bars} "
        "OR b.s = 0 OR (direction = 1 AND b.s = 2) OR (direction = -1 AND b.s = 1)), 0) AS _hit",
    )
    df = df.selectExpr("*", f"{move.replace('b.c', '_hit.c')} AS _move")
    return df.selectExpr(
        *keys, "pos AS entry_bar", "_hit.b AS exit_bar", "direction",
        f"CASE WHEN _move >= {num(tp)} THEN {num(tp)} WHEN _move <= -{num(sl)} THEN -{num(sl)} "
        f"ELSE _move END - {num(2 * fee)} AS net_return",  # null without an exit
        # only a reversal may re-enter on its own exit bar
        f"CASE WHEN _move < {num(tp)} AND _move > -{num(sl)} AND _hit.b - pos < {max_bars} "
        "AND _hit.s <> 0 THEN _hit.b ELSE _hit.b + 1 END AS free_from",
    )


def ledger(outcomes: DataFrame, max_bars: int = 48, keys=KEYS, same_bar: bool = True,
           free: str | None = None) -> DataFrame:
    """Non-overlapping trades: keep a candidate only if the previous kept one has closed.

    A candidate without an exit keeps its series busy to the end and is then left out itself.
    ``max_bars`` is at least what the exits were made with; a longer hold is an error.
    """
    expr = free or ("exit_bar" if same_bar else "exit_bar + 1")
    # such an entry has fewer than max_bars bars after it, so this lies beyond the series
    open_end = F.col("entry_bar") + max_bars + 1
    df = outcomes.withColumn("__free", F.coalesce(F.expr(expr), open_end))
    return resolved(greedy_select(df, keys, "entry_bar", "__free", max_bars + 1).drop("__free"))


def equity_curve(bars: DataFrame, trades: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Equity per bar: initial capital + realised + current unrealised P&L.

    Trades do not overlap, so each bar has at most one open position: the trade whose entry
    was last seen.  Both the realised sum and the open trade come from two-level scans.
    """
    b = bars.select(*KEYS, "ts", "pos", "close").withColumn("__g", F.floor(F.col("pos") / 32768))
    opened = trades.select(
        *KEYS, F.col("entry_bar").alias("pos"),
        F.struct("entry_bar", "exit_bar", "direction", "entry_price", "quantity").alias("__open"),
    )
    closed = trades.groupBy(*KEYS, F.col("exit_bar").alias("pos")).agg(
        F.sum("pnl_net").alias("__real")
    )
    b = b.join(opened, [*KEYS, "pos"], "left").join(closed, [*KEYS, "pos"], "left")
    b = prefix_scan(
        b, {"__cur": ("last", F.col("__open")), "__sum": ("sum", F.col("__real"))},
        KEYS, "__g", ["pos"],
    )
    return b.selectExpr(
        *KEYS, "ts", "pos AS bar_ix",
        f"{num(capital)} + coalesce(__sum, double(0)) + CASE WHEN pos < __cur.exit_bar THEN "
        "__cur.direction * (close - __cur.entry_price) * __cur.quantity ELSE double(0) END "
        "AS equity",
    )


def split_leg_pnl(df: DataFrame, fee: float = 0.0005) -> DataFrame:
    """Net P&L and fees of a position closed in two legs (a partial exit and the rest)."""
    sign = "CASE WHEN side = 'long' THEN 1 ELSE -1 END"
    df = df.selectExpr(
        "*",
        f"{sign} * (partial_price - entry_price) * partial_qty "
        f"+ {sign} * (exit_price - entry_price) * (quantity - partial_qty) AS pnl_gross",
        f"(entry_price * quantity + partial_price * partial_qty "
        f"+ exit_price * (quantity - partial_qty)) * {num(fee)} AS fee_usdt",
    )
    return df.selectExpr("*", "pnl_gross - fee_usdt AS pnl_net")


def exit_events(positions: DataFrame, bars: DataFrame, layout: Layout = LAYOUT,
                horizon: int = 12, fee: float = 0.0005) -> DataFrame:
    """First exit event of each open position by the ordered exit rules.

    ``positions``: key, entry_bar, side, entry_price, stop_loss, take_profit, quantity.
    ``bars``: numbered bars with ``close``, ``regime`` and optionally ``signal``/``agreement``.
    Every position meets at most ``horizon`` following bars (the hard time limit), each through
    an equi-join on (key, bar).  State along the position (best R,
    armed profit lock, moved stop) are running values over its own few bars.
    """
    signal = "signal" if "signal" in bars.columns else "NULL AS signal"
    agree = "agreement" if "agreement" in bars.columns else "NULL AS agreement"
    b = bars.selectExpr(*KEYS, "pos", "close", "regime", signal, agree)
    p = positions.selectExpr(
        "*", f"explode(sequence(entry_bar + 1, entry_bar + {horizon})) AS pos")
    df = p.join(b, [*KEYS, "pos"])
    long = "side = 'long'"
    df = df.selectExpr(
        "*", "pos - entry_bar AS bars_held",
        f"CASE WHEN {long} THEN close - entry_price ELSE entry_price - close END AS _gain",
    )
    df = df.selectExpr(
        "*", "_gain / abs(entry_price - stop_loss) AS r_now",
        f"_gain * quantity / (entry_price * quantity * {num(2 * fee)}) AS _fees",
        f"{regime_column('early_r')} AS _early",
        f"least({regime_column('timeout')}, {horizon}) AS _max_bars",
    )
    w = (f"OVER (PARTITION BY {', '.join(KEYS)}, entry_bar, side ORDER BY pos "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND {})")
    upto, before = w.format("CURRENT ROW"), w.format("1 PRECEDING")
    taken = "bars_held >= 3 AND r_now >= double(1.5)"
    df = df.selectExpr(
        "*",
        f"coalesce(max(CASE WHEN {taken} THEN 1 END) {before}, 0) AS _partial_before",
        f"max(CASE WHEN r_now >= double(1.5) THEN 1 END) {before} AS _even_before",
        f"min(CASE WHEN {taken} THEN pos END) {upto} AS _partial_pos",
    )
    # the lock arms once the early target is met in a trend with the fees covered
    arms = (
        "_partial_before = 0 AND _partial_pos IS NULL AND bars_held >= 3 AND r_now >= _early "
        "AND abs(_fees) >= double(2.5)"
    )
    df = df.selectExpr(
        "*", f"min(CASE WHEN {arms} AND regime = 'TRENDING' THEN pos END) {before} AS _armed_pos",
        # it arms in a trend alone, and its floor is fixed when it does
        f"{num(max(0.5, REGIMES['TRENDING']['early_r'] * 0.7))} AS _lock_floor",
    )
    df = df.selectExpr(
        "*",
        f"max(CASE WHEN _armed_pos IS NOT NULL OR ({arms} AND regime = 'TRENDING') THEN r_now END) "
        f"{upto} AS _peak",
        # the stop moves to the entry after 1.5 R
        f"CASE WHEN _even_before = 1 THEN entry_price + CASE WHEN {long} THEN double(0.0001) "
        "ELSE double(-0.0001) END ELSE stop_loss END AS _stop",
    )
    locked = "_armed_pos IS NOT NULL AND _partial_pos IS NULL"
    df = df.selectExpr(
        "*",
        f"CASE WHEN bars_held >= {horizon} THEN 'HARD_TIMEOUT' "
        f"WHEN CASE WHEN {long} THEN close >= take_profit ELSE close <= take_profit END THEN 'TP' "
        f"WHEN CASE WHEN {long} THEN close <= _stop ELSE close >= _stop END THEN 'SL' "
        f"WHEN {locked} AND (_peak - r_now >= double(0.35) OR r_now <= _lock_floor) "
        "THEN 'EARLY_PROFIT_LOCK' "
        f"WHEN _armed_pos IS NULL AND {arms} AND regime <> 'TRENDING' THEN 'EARLY_PROFIT' "
        "WHEN _partial_pos IS NULL AND bars_held = 4 AND r_now >= 0 AND r_now < double(0.25) "
        "THEN 'STALL' "
        f"WHEN bars_held >= 3 AND agreement = 'AGREE' AND r_now > 0 AND signal = "
        f"CASE WHEN {long} THEN 'SHORT' ELSE 'LONG' END THEN 'REVERSAL' "
        "WHEN bars_held >= _max_bars THEN 'TIMEOUT' END AS exit_reason",
    ).filter("exit_reason IS NOT NULL")
    keep = [c for c in positions.columns]
    first = df.groupBy(*KEYS, "entry_bar", "side").agg(
        F.min_by(
            F.struct(*[c for c in keep if c not in (*KEYS, "entry_bar", "side")],
                     F.col("pos").alias("exit_bar"), F.col("close").alias("exit_price"),
                     "bars_held", F.col("r_now").alias("pnl_r"), "exit_reason", "regime",
                     (F.col("_partial_pos") < F.col("pos")).alias("partial_taken")),
            "pos",
        ).alias("e")
    )
    return first.select(*KEYS, "entry_bar", "side", "e.*").withColumn(
        "partial_taken", F.coalesce("partial_taken", F.lit(False))
    )


def cooldown_until(trades: DataFrame) -> DataFrame:
    """First bar at which a new entry is allowed again, by exit reason."""
    wait = sql_lookup(COOLDOWN_BARS, "exit_reason", COOLDOWN_DEFAULT)
    return trades.selectExpr("*", f"{wait} AS cooldown_bars", f"exit_bar + {wait} AS ready_bar")
