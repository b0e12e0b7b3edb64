"""Trade, equity and drawdown metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalar import EPS, clip, first_of
from tidebar.operators.timeline import prefix_scan

BARS_PER_YEAR = 35040
RISK_FREE = 0.05


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def trade_metrics(trades: DataFrame, by=("symbol",)) -> DataFrame:
    """Counts, win rate, averages, profit factor, fees, expectancy, sides and hold times."""
    p = F.col("pnl_net")
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    hold = F.col("exit_bar") - F.col("entry_bar")
    df = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count(win).alias("n_wins"),
        F.count(loss).alias("n_losses"),
        _zero(F.avg(win)).alias("avg_win"),
        _zero(F.avg(loss)).alias("avg_loss"),
        _zero(F.max(win)).alias("largest_win"),
        _zero(F.min(loss)).alias("largest_loss"),
        F.avg(p).alias("avg_trade_pnl"),
        _zero(F.sum(win)).alias("gross_profit"),
        F.coalesce(-F.sum(loss), F.lit(EPS)).alias("gross_loss"),
        F.sum("fee_paid").alias("total_fees_paid"),
        F.count_if(F.col("direction") == 1).alias("n_longs"),
        F.count_if(F.col("direction") == -1).alias("n_shorts"),
        F.avg(hold).alias("avg_hold_bars"),
        F.min(hold).alias("min_hold_bars"),
        F.max(hold).alias("max_hold_bars"),
    )
    wr = F.col("n_wins") / F.col("n_trades")
    return df.select(
        "*",
        (wr * 100).alias("win_rate_pct"),
        F.least(F.col("gross_profit") / (F.col("gross_loss") + EPS), F.lit(99.0)).alias(
            "profit_factor"),
        (wr * F.col("avg_win") + (1 - wr) * F.col("avg_loss")).alias("expectancy"),
    ).drop("gross_profit", "gross_loss")


def exit_reason_counts(trades: DataFrame, by=("symbol",)) -> DataFrame:
    return trades.groupBy(*by, "exit_reason").agg(F.count(F.lit(1)).alias("n"))


def exit_reason_map(trades: DataFrame, by=("symbol",)) -> DataFrame:
    """One MAP<reason, count> per key."""
    return exit_reason_counts(trades, by).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("exit_reason", "n"))).alias("exit_reasons")
    )


def drawdown_curve(equity: DataFrame, keys=("symbol",), group_bars: int = 32768) -> DataFrame:
    """Running peak and drawdown of each equity curve."""
    g = equity.withColumn("__g", F.floor(F.col("bar_ix") / group_bars))
    g = prefix_scan(g, {"peak": ("max", F.col("equity"))}, keys, "__g", ["bar_ix"])
    return g.drop("__g").withColumn(
        "drawdown", (F.col("equity") - F.col("peak")) / (F.col("peak") + EPS)
    )


def equity_returns(equity: DataFrame, keys=("symbol",), group_bars: int = 32768) -> DataFrame:
    """Per-bar returns. Each group of bars also receives the last bar of the group before."""
    part = ", ".join(keys)
    g = equity.selectExpr(
        "*",
        f"explode(filter(array(floor(bar_ix / {group_bars}), CASE WHEN bar_ix % {group_bars} = "
        f"{group_bars - 1} THEN floor(bar_ix / {group_bars}) + 1 END), g -> g IS NOT NULL)) AS __g",
    )
    g = g.selectExpr(
        "*", f"lag(equity) OVER (PARTITION BY {part}, __g ORDER BY bar_ix) AS _prev"
    ).filter(f"__g = floor(bar_ix / {group_bars})")
    return g.selectExpr(*equity.columns, "(equity - _prev) / (_prev + 1e-10) AS bar_return")


def equity_metrics(equity: DataFrame, keys=("symbol",), periods: int = BARS_PER_YEAR,
                   risk_free: float = RISK_FREE) -> DataFrame:
    """Return, annualised return, Calmar, drawdown, Sharpe and Sortino per equity curve.

    Deviations are population ones; Sortino needs at least two bars below the risk-free rate.
    """
    rfr = (1 + risk_free) ** (1.0 / periods) - 1.0
    root = periods ** 0.5
    dd = drawdown_curve(equity, keys).groupBy(*keys).agg(
        F.min_by("equity", "bar_ix").alias("initial_capital"),
        F.max_by("equity", "bar_ix").alias("final_capital"),
        F.count(F.lit(1)).alias("n_bars"),
        (F.min("drawdown") * 100).alias("max_drawdown_pct"),
        F.min(F.col("equity") - F.col("peak")).alias("max_drawdown_usdt"),
    )
    ex = F.col("bar_return") - rfr
    down = F.when(ex < 0, ex)
    ratios = equity_returns(equity, keys).groupBy(*keys).agg(
        F.when(F.stddev_pop("bar_return") > EPS, F.avg(ex) / F.stddev_pop(ex) * root)
        .otherwise(0.0).alias("sharpe_ratio"),
        F.when(F.count(down) > 1, F.avg(ex) / (F.stddev_pop(down) + EPS) * root)
        .otherwise(0.0).alias("sortino_ratio"),
    )
    growth = F.col("final_capital") / F.col("initial_capital")
    years = F.greatest(F.col("n_bars") / periods, F.lit(1e-6))
    df = dd.join(ratios, list(keys)).withColumn("_ann", F.pow(growth, 1.0 / years) - 1.0)
    return df.select(
        *keys, "n_bars", "initial_capital", "final_capital",
        ((growth - 1) * 100).alias("total_return_pct"),
        growth.alias("total_return_x"),
        "max_drawdown_pct", "max_drawdown_usdt",
        (F.col("_ann") * 100).alias("annualized_return_pct"),
        (F.col("_ann") / (F.abs(F.col("max_drawdown_pct") / 100) + EPS)).alias("calmar_ratio"),
        "sharpe_ratio", "sortino_ratio",
    )


def drawdown_runs(equity: DataFrame, keys=("symbol",), depth: float = -0.001) -> DataFrame:
    """Average and longest run of bars below the peak by more than 0.1 %.

    A run is numbered by how many bars outside any run came before it, so its length is a
    plain count; no run ever has to sit in one task.
    """
    dd = drawdown_curve(equity, keys).withColumn("__in", F.col("drawdown") < depth)
    dd = dd.withColumn("__g", F.floor(F.col("bar_ix") / 32768))
    runs = prefix_scan(
        dd, {"__run": ("sum", F.when(F.col("__in"), 0).otherwise(1).cast("long"))},
        keys, "__g", ["bar_ix"],
    ).groupBy(*keys, "__run").agg(F.count_if("__in").alias("bars"))
    return runs.groupBy(*keys).agg(
        _zero(F.avg(F.when(F.col("bars") > 0, F.col("bars")))).alias("avg_drawdown_bars"),
        F.max("bars").alias("max_drawdown_bars"),
        F.count_if(F.col("bars") > 0).alias("n_drawdowns"),
    )


def grade(df: DataFrame) -> DataFrame:
    """Letter grade of a metrics row."""
    sh, pf, wr = F.col("sharpe_ratio"), F.col("profit_factor"), F.col("win_rate_pct")
    dd = F.abs("max_drawdown_pct")
    # fixed values: grade, Sharpe, profit factor, win rate, drawdown limits
    scale = [("A+", 2.0, 2.0, 60, 15), ("A", 1.5, 1.8, 55, 20),
             ("B", 1.0, 1.5, 50, 25), ("C", 0.5, 1.2, 45, 35)]
    rules = [((sh > s) & (pf > p) & (wr > w) & (dd < d), g) for g, s, p, w, d in scale]
    return df.withColumn("grade", first_of(*rules, ((sh > 0) & (pf > 1.0), "D"), default="F"))


def performance(equity: DataFrame, trades: DataFrame, keys=("symbol",)) -> DataFrame:
    """Equity and trade metrics with a grade; keys without trades get zeroes."""
    eq = equity_metrics(equity, keys)
    df = eq.join(trade_metrics(trades, keys), list(keys), "left")
    fill = {c: 0 for c in df.columns if c not in keys}
    return grade(df.fillna(fill))


def ledger_totals(trades: DataFrame, capital: float = 10_000.0, by=("symbol",)) -> DataFrame:
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(F.col("pnl_net") > 0).alias("wins"),
        F.sum("pnl_net").alias("realized_pnl"),
        F.sum("fee_paid").alias("fees"),
        (F.sum("pnl_net") / capital * 100).alias("return_pct"),
    )


def r_metrics(trades: DataFrame, by=("symbol",), capital: float = 10_000.0) -> DataFrame:
    """Fixed-risk report: win rates by side, exits by kind, R expectancy, holding time."""
    p, r, d = F.col("pnl_net"), F.col("r_mult"), F.col("direction")
    won = F.when(p > 0, 1.0).otherwise(0.0)
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg(won).alias("win_rate"),
        _zero(F.avg(F.when(d == 1, won))).alias("long_wr"),
        _zero(F.avg(F.when(d == -1, won))).alias("short_wr"),
        F.count_if(d == 1).alias("n_longs"),
        F.count_if(d == -1).alias("n_shorts"),
        *[F.count_if(F.col("exit_reason") == k).alias(n) for k, n in
          (("TP", "tp_exits"), ("SL", "sl_exits"), ("TIMEOUT", "timeout_exits"))],
        F.avg(r).alias("expectancy_r"),
        _zero(F.avg(F.when(p > 0, r))).alias("avg_r_win"),
        _zero(F.avg(F.when(p <= 0, r))).alias("avg_r_loss"),
        (_zero(F.sum(F.when(p > 0, r)))
         / (F.abs(_zero(F.sum(F.when(p <= 0, r)))) + EPS)).alias("profit_factor"),
        F.avg(F.col("exit_bar") - F.col("entry_bar")).alias("avg_bars_held"),
        F.sum(p).alias("total_pnl"),
        (F.sum(p) / capital).alias("total_return"),
    )


def compound_metrics(returns: DataFrame, keys, order: str = "entry_bar") -> DataFrame:
    """Metrics of a sequence of trade returns: clipped trade Sharpe, compounded drawdown.

    Fewer than three trades give zeroes.  The compounded curve is exp of a running sum.
    """
    df = returns.withColumn("__g", F.floor(F.col(order) / 32768)).withColumn(
        "__lr", F.log1p("net_return"))
    df = prefix_scan(df, {"__log": ("sum", F.col("__lr"))}, keys, "__g", [order])
    df = df.withColumn("__eq", F.exp("__log"))
    df = prefix_scan(df, {"__peak": ("max", F.col("__eq"))}, keys, "__g", [order])
    r = F.col("net_return")
    std, mean = F.stddev_pop(r), F.avg(r)
    flat = F.signum(mean) * F.least(F.abs(mean) * 10, F.lit(3.0))
    losses = -F.sum(F.when(r < 0, r))
    wins = _zero(F.sum(F.when(r > 0, r)))
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(r).alias("total_return"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.least(F.when(losses.isNull(), wins).otherwise(wins / (losses + EPS)), F.lit(99.0)).alias(
            "profit_factor"),
        clip(F.when(std < 1e-6, flat).otherwise(mean / std * F.sqrt(F.count(F.lit(1)))),
             -10.0, 10.0).alias("sharpe"),
        F.min((F.col("__eq") - F.col("__peak")) / (F.col("__peak") + EPS)).alias("max_drawdown"),
    )
    out = ("sharpe", "profit_factor", "win_rate", "total_return", "max_drawdown")
    return agg.select(
        *keys, "n", *[F.when(F.col("n") < 3, 0.0).otherwise(F.col(c)).alias(c) for c in out]
    )
