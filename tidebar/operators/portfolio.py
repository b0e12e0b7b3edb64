"""Portfolio equity, return correlation, mark-to-market and position reconciliation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalar import num
from tidebar.operators.ledger import equity_returns


def common_length(equity: DataFrame) -> DataFrame:
    """Cut every curve to the length of the shortest (a one-row aggregate, broadcast)."""
    shortest = equity.groupBy("symbol").agg(F.max("bar_ix").alias("__last")).agg(
        F.min("__last").alias("__cut"))
    return equity.join(F.broadcast(shortest), F.col("bar_ix") <= F.col("__cut")).drop("__cut")


def allocations(equity: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Share per symbol: normalised weights, or equal shares."""
    names = equity.select("symbol").distinct()
    if weights is None:
        n = names.agg(F.count(F.lit(1)).alias("__n"))
        return names.join(F.broadcast(n)).select("symbol", (1.0 / F.col("__n")).alias("alloc"))
    whole = sum(weights.values())
    pairs = F.create_map(*[F.lit(v) for k, w in weights.items() for v in (k, w / whole)])
    return names.select("symbol", F.coalesce(F.element_at(pairs, F.col("symbol")), F.lit(0.0))
                        .alias("alloc"))


def portfolio_equity(equity: DataFrame, weights: dict[str, float] | None = None,
                     double_weighting: bool = False) -> DataFrame:
    """Equity of the portfolio per bar.

    Each curve is scaled by its share once; ``double_weighting`` reproduces the published sum,
    where the curve's own capital was already scaled.
    """
    df = common_length(equity).join(allocations(equity, weights), "symbol")
    factor = F.col("alloc") * (F.col("alloc") if double_weighting else F.lit(1.0))
    return df.groupBy("bar_ix").agg(
        F.sum(F.col("equity") * factor).alias("equity"), F.count(F.lit(1)).alias("n_symbols")
    )


def _gram(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairwise sums of one slice of bars: one matrix product instead of all pairs per bar."""
    wide = pdf.pivot(index="bar", columns="symbol", values="x")
    x = wide.to_numpy()
    m = (~np.isnan(x)).astype(float)
    x = np.nan_to_num(x)
    names = wide.columns.to_numpy()
    i, j = np.triu_indices(len(names))
    return pd.DataFrame({
        "symbol_a": names[i], "symbol_b": names[j],
        "n": (m.T @ m)[i, j].astype("int64"), "sxy": (x.T @ x)[i, j],
        "sx": (x.T @ m)[i, j], "sy": (m.T @ x)[i, j],
        "sxx": ((x * x).T @ m)[i, j], "syy": (m.T @ (x * x))[i, j],
    })


def return_correlation(returns: DataFrame, value: str = "bar_return", on: str = "bar_ix",
                       bars_per_slice: int = 512) -> DataFrame:
    """Pearson correlation of every pair of series, aligned on an integer bar key.

    Each slice of bars contributes one row of sums per pair, so the shuffle holds slices x
    pairs rows, never one row per bar and pair.  A slice holds at most ``bars_per_slice`` values
    per series.
    """
    d = returns.select("symbol", F.col(on).alias("bar"), F.col(value).alias("x")).dropna()
    parts = d.groupBy(F.floor(F.col("bar") / bars_per_slice).alias("slice")).applyInPandas(
        lambda pdf: _gram(pdf),
        "symbol_a string, symbol_b string, n long, sxy double, sx double, sy double, "
        "sxx double, syy double",
    )
    sums = parts.groupBy("symbol_a", "symbol_b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sxy", "sx", "sy", "sxx", "syy")])
    return sums.filter("n > 0").selectExpr(
        "symbol_a", "symbol_b", "n",
        "try_divide(sxy - sx * sy / n, sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))) AS corr")


def equity_correlation(equity: DataFrame) -> DataFrame:
    return return_correlation(equity_returns(common_length(equity)))


def mark_to_market(positions: DataFrame, prices: DataFrame, wallet: float = 10_000.0
                   ) -> DataFrame:
    """Value each open position at the latest price of its symbol.

    Latest prices are one row per symbol (a map-side aggregate); no broadcast is forced, the
    runtime statistics decide.
    """
    latest = prices.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return positions.join(latest, "symbol").selectExpr(
        "*",
        "CASE WHEN side = 'long' THEN 1 ELSE -1 END * (price - entry_price) * quantity "
        "AS unrealized_pnl",
        "entry_price * quantity / leverage AS margin",
    )


def account_totals(marked: DataFrame, wallet: float = 10_000.0) -> DataFrame:
    return marked.agg(
        F.count(F.lit(1)).alias("positions"),
        F.sum("unrealized_pnl").alias("unrealized_pnl"),
        F.sum("margin").alias("used_margin"),
    ).selectExpr(
        "*", f"{num(wallet)} + unrealized_pnl AS total_balance",
        f"{num(wallet)} - used_margin AS available_balance",
    )


def external_close(df: DataFrame) -> DataFrame:
    """Why a position vanished, from the current price, and its R (clamped to +/-9999)."""
    long = "side = 'long'"
    return df.selectExpr(
        "*",
        "CASE WHEN stop_loss IS NULL OR take_profit IS NULL OR entry_price IS NULL THEN "
        "'EXTERNALLY_CLOSED' "
        f"WHEN CASE WHEN {long} THEN price >= take_profit ELSE price <= take_profit END THEN "
        "'TP_EXTERNAL' "
        f"WHEN CASE WHEN {long} THEN price <= stop_loss ELSE price >= stop_loss END THEN "
        "'SL_EXTERNAL' ELSE 'EXTERNALLY_CLOSED' END AS exit_reason",
        "greatest(double(-9999), least(double(9999), coalesce("
        f"CASE WHEN {long} THEN price - entry_price ELSE entry_price - price END "
        "/ CASE WHEN entry_price = stop_loss THEN double(1e-9) ELSE abs(entry_price - stop_loss) "
        "END, double(0)))) AS pnl_r",
    )


def reconcile(internal: DataFrame, exchange: DataFrame, symbols: DataFrame | None = None
              ) -> DataFrame:
    """Full outer match of two position snapshots on the normalised symbol.

    A both open, B only ours (closed outside), C only the exchange's (rogue), D neither (only
    with the list of watched ``symbols``).
    """
    i = internal.select("symbol", F.struct(*[c for c in internal.columns if c != "symbol"])
                        .alias("ours"))
    x = exchange.select("symbol", F.struct(*[c for c in exchange.columns if c != "symbol"])
                        .alias("theirs"))
    df = i.join(x, "symbol", "full_outer")
    if symbols is not None:
        df = df.join(symbols.select("symbol").distinct(), "symbol", "full_outer")
    return df.withColumn(
        "state",
        F.when(F.col("ours").isNotNull() & F.col("theirs").isNotNull(), "A")
        .when(F.col("ours").isNotNull(), "B")
        .when(F.col("theirs").isNotNull(), "C")
        .otherwise("D"),
    )
