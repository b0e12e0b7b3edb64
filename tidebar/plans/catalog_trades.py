"""Registered queries over signals, trades, positions, journals, news and logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.scalar import normal_symbol
from tidebar.operators import book as bk
from tidebar.operators import evaluation as ev
from tidebar.operators import features as ft
from tidebar.operators import labels as lb
from tidebar.operators import ledger as lg
from tidebar.operators import news as nw
from tidebar.operators import outcomes as oc
from tidebar.operators import portfolio as pf
from tidebar.operators import quality as ql
from tidebar.operators import regime as rg
from tidebar.operators import risk as rk
from tidebar.operators import signals as sg
from tidebar.operators.indicators import chunked_indicators
from tidebar.operators.timeline import KEYS, LAYOUT, core_rows
from tidebar.plans.catalog_series import rounded, stamp
from tidebar.session import cut_lineage
from tidebar.sources import bars as src
from tidebar.sources import journal as jr

Query = Callable[[SparkSession, str], DataFrame]
OHLC = ["open", "high", "low", "close", "volume"]
#: Words that occur in the given texts: those of a warning, then those of caution.
HEADLINE_WORDS = (["ond", "zz"], ["ation", "the"])


def scored_bars(s: SparkSession, d: str, regime: bool = False) -> DataFrame:
    """Numbered hourly bars with ATR and the rule signal as 0/1/2."""
    df = sg.technical_votes(chunked_indicators(src.event_bars(s, d)))
    df = rg.confirmed_regime(rg.raw_regime_columns(df)) if regime else core_rows(df)
    return df.selectExpr(
        *KEYS, "ts", "pos", *OHLC, "atr", *(["regime"] if regime else []),
        "CASE tech_signal WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN 2 ELSE 0 END AS signal",
        "tech_confidence AS confidence",
    )


def hourly_trades(s: SparkSession, d: str) -> DataFrame:
    """Ledger of the rule signals. Written once, as every report reads it."""
    return cut_lineage(oc.ledger(oc.intrabar_exits(scored_bars(s, d))), "trades")


def hourly_equity(s: SparkSession, d: str, trades: DataFrame | None = None) -> DataFrame:
    trades = hourly_trades(s, d) if trades is None else trades
    bars = src.numbered(src.event_bars(s, d))
    return cut_lineage(oc.equity_curve(bars, trades), "equity")


def order_trades(s: SparkSession, d: str) -> DataFrame:
    """A long, hot-keyed trade journal read from ``orders``: five symbols, two sides."""
    return src.table(s, d, "orders").selectExpr(
        "o_orderpriority AS symbol",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side",
        "cast(o_orderdate AS timestamp) AS ts", "o_orderkey AS trade_id",
        "o_totalprice > 180000 AS won", "round(o_totalprice - 180000, 2) AS pnl_net",
        "datediff(o_orderdate, date '1995-01-01') AS exit_bar",
        "CASE o_orderstatus WHEN 'F' THEN 'TRENDING' WHEN 'O' THEN 'RANGE' "
        "ELSE 'HIGH_VOLATILITY' END AS regime",
    )


def user_positions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Our and the exchange's position snapshot and the latest prices, one row per user."""
    e = src.table(s, d, "events").filter("value > 0")
    per = e.groupBy("user_id").agg(
        F.min_by("value", "event_id").alias("entry_price"), F.count(F.lit(1)).alias("quantity"))
    per = per.selectExpr(
        "concat('usr', user_id, '/USDT:USDT') AS raw", "entry_price",
        "cast(quantity AS double) AS quantity", "user_id",
        "CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side",
    ).withColumn("symbol", normal_symbol("raw"))
    sign = "CASE WHEN side = 'long' THEN 1 ELSE -1 END"
    ours = per.filter("quantity >= 60").selectExpr(
        "symbol", "side", "entry_price", "quantity", "10 AS leverage",
        f"entry_price * (1 + {sign} * 0.5D) AS take_profit",
        f"entry_price * (1 - {sign} * 0.25D) AS stop_loss")
    theirs = per.filter("quantity <= 75").select("symbol", "side", "quantity")
    prices = e.select(
        normal_symbol(F.concat(F.lit("usr"), "user_id", F.lit("/USDT:USDT"))).alias("symbol"),
        F.col("event_id").alias("ts"), F.col("value").alias("close"))
    return ours, theirs, prices


def predictions(s: SparkSession, d: str, flags: bool = False) -> DataFrame:
    """Rule signals against triple-barrier labels, one row per bar."""
    df = sg.technical_votes(chunked_indicators(src.event_bars(s, d), replace(LAYOUT, ahead=8)))
    df = lb.triple_barrier(df, 8)
    if flags:
        df = ft.regime_flag_columns(df)
    return core_rows(df).selectExpr(
        "symbol", "timeframe", "ts", "pos", "close", "label AS y_true",
        "CASE tech_signal WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN 2 ELSE 0 END AS y_pred",
        "greatest(tech_long, tech_short) AS confidence", *(ft.REGIME_FLAGS if flags else []),
    )


def trade_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    outcome_cols = "quantity pnl_gross pnl_net fee_paid slippage_cost"

    def exits(**kw) -> Query:
        return lambda s, d: oc.intrabar_exits(scored_bars(s, d), **kw).selectExpr(
            "symbol", stamp(), "entry_bar", "exit_bar", "direction", "exit_reason",
            *rounded("entry_price exit_price", 6), *rounded(outcome_cols, 4))

    q["outcomes_atr_levels"] = exits()
    q["outcomes_percent_levels"] = exits(use_atr=False, tp_pct=0.5, sl_pct=0.25)
    q["outcomes_close_only"] = lambda s, d: oc.resolved(oc.close_only_exits(
        scored_bars(s, d), tp=0.6, sl=0.3
    )).selectExpr("symbol", stamp(), "entry_bar", "exit_bar", "direction", "exit_reason",
                 *rounded("entry_price exit_price", 6), *rounded("r_mult pnl_net", 4))
    q["outcomes_fold_returns"] = lambda s, d: oc.resolved(oc.fold_exits(
        scored_bars(s, d), tp=0.6, sl=0.4
    )).selectExpr("symbol", "entry_bar", "exit_bar", "direction", "free_from",
                 *rounded("net_return"))

    q["ledger_trades"] = lambda s, d: hourly_trades(s, d).selectExpr(
        "symbol", "entry_bar", "exit_bar", "direction", "exit_reason", *rounded("pnl_net", 4))
    q["ledger_metrics"] = lambda s, d: lg.trade_metrics(hourly_trades(s, d)).selectExpr(
        "symbol", "n_trades", "n_wins", "n_losses", "n_longs", "n_shorts", "min_hold_bars",
        "max_hold_bars",
        *rounded("win_rate_pct avg_win avg_loss largest_win largest_loss avg_trade_pnl "
                 "profit_factor total_fees_paid expectancy avg_hold_bars", 4))
    q["ledger_exit_reasons"] = lambda s, d: lg.exit_reason_counts(hourly_trades(s, d))
    q["ledger_totals"] = lambda s, d: lg.ledger_totals(hourly_trades(s, d)).selectExpr(
        "symbol", "trades", "wins", *rounded("realized_pnl fees return_pct", 4))

    def r_report(s: SparkSession, d: str) -> DataFrame:
        kept = oc.ledger(oc.close_only_exits(scored_bars(s, d), tp=0.6, sl=0.3), 32,
                         same_bar=False)
        return lg.r_metrics(kept).selectExpr(
            "symbol", "n_trades", "n_longs", "n_shorts", "tp_exits", "sl_exits", "timeout_exits",
            *rounded("win_rate long_wr short_wr expectancy_r avg_r_win avg_r_loss profit_factor "
                     "avg_bars_held total_pnl total_return", 4))

    q["ledger_r_report"] = r_report

    def compound(s: SparkSession, d: str) -> DataFrame:
        kept = oc.ledger(oc.fold_exits(scored_bars(s, d)), 11, free="free_from")
        return lg.compound_metrics(kept, ["symbol"]).selectExpr(
            "symbol", "n", *rounded("sharpe profit_factor win_rate total_return max_drawdown", 4))

    q["ledger_compound_metrics"] = compound
    q["ledger_cooldowns"] = lambda s, d: oc.cooldown_until(hourly_trades(s, d)).selectExpr(
        "symbol", "exit_bar", "exit_reason", "cooldown_bars", "ready_bar")

    def ladder(s: SparkSession, d: str) -> DataFrame:
        df = cut_lineage(scored_bars(s, d, regime=True), "scored")
        sign = "CASE signal WHEN 1 THEN 1 ELSE -1 END"
        pos = df.filter("signal > 0 AND atr IS NOT NULL").selectExpr(
            *KEYS, "pos AS entry_bar", "CASE signal WHEN 1 THEN 'long' ELSE 'short' END AS side",
            "close AS entry_price", f"close - {sign} * 2 * atr AS stop_loss",
            f"close + {sign} * 3 * atr AS take_profit", "1D AS quantity")
        bars = df.selectExpr(
            *KEYS, "pos", "close", "regime",
            "CASE signal WHEN 1 THEN 'LONG' WHEN 2 THEN 'SHORT' ELSE 'HOLD' END AS signal",
            "'AGREE' AS agreement")
        return oc.exit_events(pos, bars).selectExpr(
            "symbol", "entry_bar", "side", "exit_bar", "exit_reason", "partial_taken",
            *rounded("pnl_r", 4))

    q["outcomes_exit_ladder"] = ladder

    def legs(s: SparkSession, d: str) -> DataFrame:
        li = src.table(s, d, "lineitem").selectExpr(
            "l_orderkey", "l_linenumber",
            "CASE WHEN l_linestatus = 'F' THEN 'long' ELSE 'short' END AS side",
            "l_extendedprice / 100 AS entry_price", "l_extendedprice / 100 + l_tax AS exit_price",
            "l_extendedprice / 100 + l_discount AS partial_price", "l_quantity AS quantity",
            "l_quantity / 4 AS partial_qty")
        return oc.split_leg_pnl(li).groupBy("side").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl_gross"), 1).alias("pnl_gross"),
            F.round(F.sum("fee_usdt"), 1).alias("fee_usdt"),
            F.round(F.sum("pnl_net"), 1).alias("pnl_net"))

    q["outcomes_two_leg_pnl"] = legs

    q["equity_curve"] = lambda s, d: hourly_equity(s, d).selectExpr(
        "symbol", "bar_ix", *rounded("equity", 4))
    q["equity_drawdown"] = lambda s, d: lg.drawdown_curve(hourly_equity(s, d)).selectExpr(
        "symbol", "bar_ix", *rounded("peak", 4), *rounded("drawdown", 5))
    q["equity_drawdown_runs"] = lambda s, d: lg.drawdown_runs(hourly_equity(s, d)).selectExpr(
        "symbol", "max_drawdown_bars", "n_drawdowns", *rounded("avg_drawdown_bars", 4))

    def performance(s: SparkSession, d: str) -> DataFrame:
        trades = hourly_trades(s, d)
        df = lg.performance(hourly_equity(s, d, trades), trades)
        return df.selectExpr(
            "symbol", "n_bars", "n_trades", "grade",
            *rounded("final_capital total_return_pct max_drawdown_pct max_drawdown_usdt "
                     "sharpe_ratio sortino_ratio profit_factor", 3))

    q["performance_grades"] = performance

    q["portfolio_equity"] = lambda s, d: pf.portfolio_equity(hourly_equity(s, d)).selectExpr(
        "bar_ix", "n_symbols", *rounded("equity", 4))
    q["portfolio_equity_correlation"] = lambda s, d: pf.equity_correlation(
        hourly_equity(s, d)).selectExpr("symbol_a", "symbol_b", "n", *rounded("corr", 5))

    def totals(s: SparkSession, d: str) -> DataFrame:
        ours, _, prices = user_positions(s, d)
        return pf.account_totals(pf.mark_to_market(ours, prices)).selectExpr(
            "positions", *rounded("unrealized_pnl used_margin total_balance available_balance", 4))

    q["positions_mark_to_market"] = totals

    def reconciled(s: SparkSession, d: str) -> DataFrame:
        ours, theirs, prices = user_positions(s, d)
        latest = prices.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
        df = pf.reconcile(ours, theirs, prices).join(latest, "symbol", "left")
        df = df.selectExpr("symbol", "state", "price", *[
            f"ours.{c} AS {c}" for c in ("side", "entry_price", "take_profit", "stop_loss")])
        closed = pf.external_close(df)
        vanished = "state = 'B'"
        return closed.selectExpr(
            "symbol", "state", f"CASE WHEN {vanished} THEN exit_reason END AS exit_reason",
            f"round(CASE WHEN {vanished} THEN pnl_r END, 4) + 0D AS pnl_r")

    q["positions_reconciled"] = reconciled

    q["equity_annualised"] = lambda s, d: lg.equity_metrics(hourly_equity(s, d), periods=8760).selectExpr(
        "symbol", "n_bars", "least(annualized_return_pct, 1e6D) AS annualized_return_pct",
        "least(calmar_ratio, 1e6D) AS calmar_ratio", "initial_capital", "total_return_x").selectExpr(
        "symbol", "n_bars", *rounded("annualized_return_pct calmar_ratio initial_capital", 2), *rounded("total_return_x", 6))

    # --- risk ---------------------------------------------------------------------------
    q["risk_rolling_win_rate"] = lambda s, d: rk.rolling_win_rate(order_trades(s, d)).selectExpr(
        "symbol", "side", "trade_id", "n_recent", *rounded("win_rate threshold_adj"))
    q["risk_recalibration"] = lambda s, d: rk.recalibration_summary(order_trades(s, d)).selectExpr(
        "symbol", "side", "n_recent", *rounded("win_rate threshold_adj"))
    q["risk_streaks"] = lambda s, d: rk.streaks(order_trades(s, d)).selectExpr(
        "symbol", "side", "trade_id", "streak")

    def blocked(s: SparkSession, d: str) -> DataFrame:
        t = order_trades(s, d)
        days = t.selectExpr("symbol", "side", "trade_id", "exit_bar AS pos")
        df = rk.blocked_entries(days, rk.loss_blocks(t, losses=9))
        return df.groupBy("symbol", "side", "blocked").agg(F.count(F.lit(1)).alias("n"))

    q["risk_blocked_entries"] = blocked
    q["risk_loss_blocks"] = lambda s, d: rk.loss_blocks(order_trades(s, d))
    q["risk_session_loss"] = lambda s, d: rk.session_loss(
        order_trades(s, d).withColumn("session", F.to_date("ts")), balance=10_000_000.0
    ).selectExpr("symbol", "trade_id", *rounded("open_loss", 3), "limit_hit")

    def recovery(s: SparkSession, d: str) -> DataFrame:
        t = hourly_trades(s, d).withColumn("trade_id", F.col("entry_bar"))
        return rk.recovery_ledger(t).selectExpr(
            "symbol", "entry_bar", "episode", *rounded("to_recover", 3), "in_recovery")

    q["risk_recovery_ledger"] = recovery

    def book_candidates(s: SparkSession, d: str) -> DataFrame:
        """The rule signals of all symbols as candidates of one book, in hours."""
        ends = src.numbered(src.event_bars(s, d)).selectExpr(
            "symbol", "pos AS exit_bar", "unix_seconds(ts) div 3600 AS exit_at")
        return oc.intrabar_exits(scored_bars(s, d)).join(ends, ["symbol", "exit_bar"], "left").selectExpr(
            "'all' AS book", "symbol", "ts", "unix_seconds(ts) div 3600 AS at", "exit_at", "direction",
            "pnl_net", "confidence")

    booking = ["symbol", stamp(), "entered", "coalesce(reject_reason, '') AS reject_reason", "open_trades"]
    q["risk_book_entries"] = lambda s, d: bk.booked(book_candidates(s, d)).selectExpr(*booking)
    q["risk_book_capacity"] = lambda s, d: bk.booked(
        book_candidates(s, d), bk.BookRules(max_open=3, per_direction=2, losses=0)).selectExpr(*booking)

    def closed_loop(s: SparkSession, d: str) -> DataFrame:
        rows = oc.intrabar_exits(scored_bars(s, d)).selectExpr(
            "symbol", "entry_bar AS at", "exit_bar AS exit_at", "direction", "pnl_net", "confidence")
        return bk.booked(rows, bk.BookRules(recovery=True), keys=["symbol"], order=["at"]).selectExpr(
            "symbol", "at AS entry_bar", "entered", "coalesce(reject_reason, '') AS reject_reason",
            *rounded("size_factor", 4), *rounded("to_recover pnl_taken", 3))

    q["risk_closed_loop"] = closed_loop
    q["risk_kelly_inputs"] = lambda s, d: rk.kelly_inputs(order_trades(s, d)).selectExpr(
        "symbol", "trade_id", *rounded("win_rate", 5), *rounded("avg_win avg_loss", 7))

    def sizing(method: str) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            k = rk.kelly_inputs(order_trades(s, d)).selectExpr(
                "trade_id", "10000D AS account_equity", "abs(pnl_net) / 100 + 1 AS entry_price",
                "(abs(pnl_net) / 100 + 1) * 0.98D AS stop_price", "10 AS leverage",
                "win_rate", "avg_win", "avg_loss", "abs(pnl_net) / 10000 AS current_atr",
                "0.4D + (trade_id % 50) / 100 AS confidence", "0.001D AS quantity_step")
            return rk.position_size(k, method).selectExpr(
                "trade_id", "size.approved AS approved", "size.reject_reason AS reject_reason",
                "round(size.quantity, 3) + 0D AS quantity",
                "round(size.risk_usdt, 3) + 0D AS risk_usdt",
                "round(size.kelly_fraction, 5) + 0D AS kelly_fraction")
        return run

    for m in ("fixed_fractional", "kelly", "half_kelly", "vol_scaled"):
        q[f"risk_size_{m}"] = sizing(m)

    def sized(s: SparkSession, d: str, *more: str, **kw) -> DataFrame:
        df = rg.regime_params(scored_bars(s, d, regime=True)).filter("signal > 0")
        return rk.size_trade(df.selectExpr(
            "symbol", "ts", "CASE signal WHEN 1 THEN 'long' ELSE 'short' END AS side",
            "close AS entry_price", "1000D + 100D * (pos % 40) AS available_balance",
            "cast(pos % 6 AS int) AS open_trades", "atr", "sl_mult AS sl_atr_mult",
            "tp_mult AS tp_atr_mult", "size_scale", "sl_mult", "tp_mult", *more), risk_pct=5.0,
            **kw)

    q["risk_sized_trades"] = lambda s, d: sized(s, d).selectExpr(
        "symbol", stamp(), "side", "approved", "reject_reason",
        *rounded("take_profit stop_loss", 4), *rounded("quantity", 3))
    q["risk_gated_trades"] = lambda s, d: sized(
        s, d, "CASE WHEN pos % 3 = 0 THEN 20 END AS leverage",
        "CASE WHEN pos % 4 = 0 THEN 3D WHEN pos % 4 = 1 THEN 0D END AS risk_pct",
        "double(pos % 70) AS daily_loss", "1000D AS session_balance",
        "cast(pos % 7 = 0 AS int) AS same_direction", "pos % 11 = 0 AS blocked",
        max_daily_loss=48.0,
    ).selectExpr("symbol", stamp(), "side", "approved", "reject_reason", "leverage",
                 *rounded("take_profit stop_loss", 4), *rounded("quantity", 3))
    q["signals_payoff_gate"] = lambda s, d: sg.payoff_gate(
        sized(s, d).filter("approved")).selectExpr(
        "symbol", stamp(), "side", "payoff_skip", *rounded("net_rr", 4))

    def throttled(s: SparkSession, d: str) -> DataFrame:
        return rk.throttle(scored_bars(s, d).filter("signal > 0")).selectExpr(
            "symbol", stamp(), "pos", "signal")

    q["risk_throttled_entries"] = throttled

    # --- evaluation ---------------------------------------------------------------------
    q["folds_membership"] = lambda s, d: ev.assign_folds(
        src.numbered(src.event_bars(s, d)), n_splits=3, min_train=60
    ).groupBy("symbol", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"))

    def fold_metrics(s: SparkSession, d: str) -> DataFrame:
        return ev.fold_report(ev.assign_folds(
            predictions(s, d), n_splits=3, min_train=60).filter("role = 'test'"))

    q["evaluation_folds"] = lambda s, d: fold_metrics(s, d).selectExpr(
        "symbol", "fold", "n", *rounded(
            "accuracy precision_long recall_long f1_long precision_short recall_short f1_short "
            "f1_macro hold_pct long_pct short_pct", 4))

    def summary(s: SparkSession, d: str) -> DataFrame:
        p = cut_lineage(ev.assign_folds(predictions(s, d), n_splits=3, min_train=60)
                        .filter("role = 'test'"), "folds")
        keys = ["symbol", "fold"]
        rows = oc.fold_exits(p.withColumnRenamed("y_pred", "signal"), keys=keys)
        money = lg.compound_metrics(oc.ledger(rows, 11, keys, free="free_from"), keys)
        both = ev.fold_report(p).join(money.drop("n"), keys)
        return ev.fold_summary(both).selectExpr(
            "symbol", "n_folds", "accepted", "recommendation",
            *rounded("mean_accuracy mean_f1_macro mean_sharpe mean_profit_factor mean_win_rate "
                     "std_sharpe consistency", 4))

    q["evaluation_fold_summary"] = summary
    q["evaluation_classes"] = lambda s, d: ev.class_report(predictions(s, d)).selectExpr(
        "symbol", "label", "support", *rounded("precision recall f1", 5))
    q["evaluation_predictions"] = lambda s, d: ev.prediction_report(predictions(s, d)).selectExpr(
        "symbol", "n_samples", "concat_ws(';', issues) AS issues", *rounded(
            "hold_pct long_pct short_pct accuracy f1_macro mean_conf conf_p25 conf_p50 conf_p75 "
            "conf_p90", 4))
    q["evaluation_regimes"] = lambda s, d: ev.regime_accuracy(
        predictions(s, d, flags=True)).selectExpr(
        "symbol", "regime_group", "n", *rounded("accuracy", 5))
    q["evaluation_document_labels"] = lambda s, d: ev.class_report(
        src.table(s, d, "labels").join(src.table(s, d, "documents").select("doc_id", "lang"),
                                       "doc_id")
        .selectExpr("lang AS symbol", "quality AS y_true", "toxic AS y_pred"), classes=(0, 1)
    ).selectExpr("symbol", "label", "support", *rounded("precision recall f1", 5))
    q["evaluation_holdout"] = lambda s, d: ev.holdout(
        src.numbered(src.event_bars(s, d))).groupBy("symbol", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    q["bars_last_rows"] = lambda s, d: ev.last_rows(
        src.numbered(src.event_bars(s, d)), 200).selectExpr("symbol", stamp(), "close")
    q["bars_latest"] = lambda s, d: ev.latest(
        src.event_bars(s, d, "1h", "user_id")).selectExpr("symbol", stamp(), "close", "volume")
    q["labels_issues"] = lambda s, d: ev.label_issues(lb.label_distribution(
        lb.with_labels(src.event_bars(s, d)))).selectExpr(
        "symbol", "concat_ws(';', label_issues) AS label_issues", "balanced", "abort_training")

    # --- quality, journal, news, logs -----------------------------------------------------
    q["quality_report"] = lambda s, d: ql.quality_report(
        src.event_bars(s, d), min_bars={"1h": 500}).selectExpr(
        "symbol", "bars", "days", "null_values", "bad_prices", "duplicates", "spikes", "up_days",
        "down_days", "ok", *rounded("high_vol_share low_vol_share up_share zero_volume "
                                    "median_price", 4),
        "concat_ws(';', transform(filter(checks, c -> NOT c.passed), c -> c.name)) AS failed",
        "concat_ws(';', warnings) AS warnings")

    def journal(s: SparkSession, d: str) -> DataFrame:
        return order_trades(s, d).withColumnRenamed("pnl_net", "pnl_usdt")

    q["journal_regimes"] = lambda s, d: jr.regime_performance(journal(s, d)).selectExpr(
        "symbol", "regime", "trades", "wins", *rounded("net_pnl", 2), *rounded("win_rate", 5))
    q["journal_struggling"] = lambda s, d: jr.struggling_symbols(
        jr.regime_performance(journal(s, d)), poor=0.63)
    q["journal_recent"] = lambda s, d: jr.recent_trades(
        journal(s, d), F.expr("timestamp '2001-08-01 00:00:00'"), 30)

    def parsed(s: SparkSession, d: str) -> DataFrame:
        raw = src.table(s, d, "orders").selectExpr(
            "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS timestamp",
            "CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS symbol",
            "CASE WHEN o_orderkey % 3 = 0 THEN 'LONG' WHEN o_orderkey % 3 = 1 THEN 'short' "
            "ELSE 'flat' END AS side",
            "CASE WHEN o_totalprice > 180000 THEN 'True' ELSE '0' END AS won",
            "'' AS confidence", "cast(o_totalprice AS string) AS pnl_usdt",
            "CASE WHEN o_orderstatus = 'O' THEN 'n/a' ELSE '1.5' END AS pnl_r",
            "'3.0' AS bars_held", "cast(NULL AS string) AS exit_reason",
            "'RANGE' AS regime")
        return jr.parse_journal(raw).groupBy("symbol", "side", "exit_reason", "bars_held").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("won").alias("n_won"),
            F.round(F.sum("pnl_r"), 2).alias("pnl_r"), F.max("confidence").alias("confidence"))

    q["journal_parsed"] = parsed

    def due(s: SparkSession, d: str) -> DataFrame:
        j = order_trades(s, d)
        state = j.groupBy("symbol").agg(F.max("ts").alias("last_retrain")).filter(
            "symbol <> '5-LOW'").selectExpr(
            "symbol", "CASE WHEN symbol = '1-URGENT' THEN timestamp '2001-08-10 00:00:00' "
            "ELSE last_retrain END AS last_retrain")
        return jr.retrain_due(j, state, j, F.expr("timestamp '2001-08-12 00:00:00'"))

    q["journal_retrain_due"] = due

    def closes(s: SparkSession, d: str) -> DataFrame:
        j = order_trades(s, d).selectExpr(
            "symbol", "upper(side) AS side", "ts", "trade_id", "pnl_net + 200000 AS exit_price",
            "pnl_net AS pnl_usdt", "pnl_net / 7 AS pnl_r", "'TP' AS exit_reason",
            "3 AS bars_held", "abs(pnl_net) / 1000 AS fee_usdt")
        r = jr.trade_close_records(j)
        return r.groupBy("symbol", "side").agg(
            F.count(F.lit(1)).alias("n"), F.max("pnl_r").alias("max_r"),
            F.min("pnl_r").alias("min_r"), F.round(F.sum("net_pnl"), 2).alias("net_pnl"),
            F.max("closed_at").alias("last_close"))

    q["records_trade_close"] = closes
    q["records_trade_open"] = lambda s, d: jr.trade_open_records(hourly_trades(s, d).selectExpr(
        "symbol", "CASE WHEN direction = 1 THEN 'LONG' ELSE 'SHORT' END AS side", "entry_price", "quantity", "leverage",
        "entry_price * (1 + direction * 0.02D) AS take_profit", "entry_price * (1 - direction * 0.01D) AS stop_loss",
        "confidence", "exit_reason AS regime", "ts")).selectExpr(
        "symbol", "side", "leverage", "regime", "opened_at", *rounded("entry_price quantity tp_price sl_price", 7),
        *rounded("confidence", 2))

    words = HEADLINE_WORDS

    def headlines(s: SparkSession, d: str) -> DataFrame:
        docs = src.table(s, d, "documents")
        text = nw.headline_text("source", "text")
        return nw.classify_headlines(docs, text, *words)

    q["news_headlines"] = lambda s, d: headlines(s, d).select("doc_id", "news_state", "news_word")
    q["news_default_words"] = lambda s, d: nw.classify_headlines(
        src.table(s, d, "documents"), F.lower("text")
    ).groupBy("news_state", F.coalesce("news_word", F.lit("")).alias("news_word")).agg(
        F.count(F.lit(1)).alias("n"))
    q["news_batches"] = lambda s, d: nw.batch_state(headlines(s, d), ["source"], *words)

    def from_payload(s: SparkSession, d: str) -> DataFrame:
        api = src.table(s, d, "documents").select(
            "doc_id", F.to_json(F.struct(F.array(F.struct(
                F.col("lang").alias("title"), F.col("text").alias("content"))).alias("data")))
            .alias("payload"))
        a = nw.parse_headlines(api, "payload")
        return nw.classify_headlines(a, nw.headline_text("title", "content"), *words).groupBy(
            "news_state").agg(F.count(F.lit(1)).alias("n"))

    q["news_payloads"] = from_payload

    def sentiment(s: SparkSession, d: str) -> DataFrame:
        day = F.date_format("ts", "yyyy-MM-dd")
        fng = src.table(s, d, "events").groupBy(day.alias("day")).agg(
            F.max_by(F.get_json_object("props", "$.k").cast("int"), "event_id")
            .alias("fng_value"))
        docs = headlines(s, d).withColumn(
            "day", F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 30 + 1).cast("string"),
                                                      2, "0")))
        state = nw.batch_state(nw.newest(docs, ["day"], "doc_id"), ["day"], *words)
        # a day without a reading counts as neutral
        df = nw.combined_sentiment(nw.fear_greed(
            state.join(fng, "day", "left").fillna(50, ["fng_value"]), "fng_value"))
        return df.select("day", "fng_value", "news_state", "fng_state", "sentiment",
                         "sentiment_reason")

    q["news_sentiment"] = sentiment

    def logs(s: SparkSession, d: str) -> DataFrame:
        raw = src.table(s, d, "documents").selectExpr(
            "CASE lang WHEN 'en' THEN 'INFO' WHEN 'fr' THEN 'WARNING' WHEN 'de' THEN 'DEBUG' "
            "ELSE 'ERROR' END AS level",
            "CASE source WHEN 'src0' THEN 'core.trader.x' WHEN 'src1' THEN 'core.exchange' WHEN "
            "'src2' THEN 'core.market.news' WHEN 'src3' THEN 'asyncio' ELSE 'other' END AS logger",
            "text AS message", "map('doc', cast(doc_id AS string)) AS context",
            "'2024-01-01 00:00:00' AS logged_at", "doc_id")
        return jr.route_logs(raw).selectExpr(
            "level", "channel", "length(message) AS chars", "cast(context['doc'] AS bigint) AS doc_id")

    q["logs_routed"] = logs
    return q
