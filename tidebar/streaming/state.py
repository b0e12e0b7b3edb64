"""Keyed state over streams: averages, confirmed regime, smoothing, recent trades.

The keyed input is bars or trades, already reduced from ticks, and a micro-batch is bounded
in size (see ``table_stream``), so a hot symbol hands a bounded number of rows to its state
task at a time. State is a few numbers per key. History is loaded with the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that are taken from a batch and emitted at once.
SLICE = 10_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPANS = (9, 21, 50)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def ordered(rows: Iterator[pd.DataFrame], columns: list[str], by: list[str]) -> Iterator[pd.DataFrame]:
    """Some columns of all rows of one key in this micro-batch, in time order, ``SLICE`` rows at a time.

    Only these columns are held, a few bytes a row; what a row emits leaves with its slice.
    """
    parts = [pdf[columns] for pdf in rows]
    pdf = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
    parts.clear()
    if len(pdf):
        pdf = pdf.sort_values(by)
    for lo in range(0, len(pdf), SLICE):
        yield pdf.iloc[lo : lo + SLICE]


class AverageState(StatefulProcessor):
    """Exponential averages of the close, carried from bar to bar."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState(
            "averages", ", ".join(f"e{n} double" for n in SPANS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.value.get()) if self.value.exists() else None
        for pdf in ordered(rows, ["symbol", "ts", "close"], ["ts"]):
            seen = []
            for close in pdf["close"]:
                state = [close] * len(SPANS) if state is None else [
                    e + 2.0 / (n + 1) * (close - e) for e, n in zip(state, SPANS)]
                seen.append(state)
            out = pd.DataFrame(seen, columns=[f"ema_{n}" for n in SPANS])
            yield pd.concat([pdf.reset_index(drop=True), out], axis=1)
        self.value.update(tuple(float(x) for x in state))

    def close(self) -> None:
        pass


class SignalState(StatefulProcessor):
    """Two-bar regime confirmation and conditional smoothing of the blended probabilities."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState(
            "signal", "ema_long double, ema_short double, last_raw string, regime string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        el, es, last, regime = (
            self.value.get() if self.value.exists() else (None, None, None, "RANGE"))
        columns = ["symbol", "ts", "raw_long", "raw_short", "raw_signal", "raw_regime"]
        for pdf in ordered(rows, columns, ["ts"]):
            out = []
            for r in pdf.itertuples():
                hold = max(0.0, 1.0 - r.raw_long - r.raw_short)
                if el is None:
                    el, es = r.raw_long, r.raw_short
                elif r.raw_signal != "HOLD" and max(r.raw_long, r.raw_short) > hold:
                    el, es = 0.7 * r.raw_long + 0.3 * el, 0.7 * r.raw_short + 0.3 * es
                if r.raw_regime == last:
                    regime = last
                last = r.raw_regime
                out.append((r.symbol, r.ts, float(el), float(es), regime))
            yield pd.DataFrame(out, columns=["symbol", "ts", "ema_long", "ema_short", "regime"])
        self.value.update((float(el), float(es), last, regime))

    def close(self) -> None:
        pass


class TradeState(StatefulProcessor):
    """Last 20 results per (symbol, side): win rate, count, streak of losses, loss to recover."""

    window = 20

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "won boolean")
        self.money = handle.getValueState("money", "losses int, to_recover double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        losses, owed = self.money.get() if self.money.exists() else (0, 0.0)
        for pdf in ordered(rows, ["ts", "trade_id", "won", "pnl_net"], ["ts", "trade_id"]):
            out = []
            for r in pdf.itertuples():
                recent = (recent + [bool(r.won)])[-self.window:]
                losses = 0 if r.won else losses + 1
                owed = max(0.0, owed - r.pnl_net)
                out.append((*key, r.trade_id, sum(recent) / len(recent), len(recent),
                            losses, losses >= 3, owed))
            yield pd.DataFrame(out, columns=["symbol", "side", "trade_id", "win_rate", "n_recent",
                                             "losses", "blocked", "to_recover"])
        self.recent.put([(w,) for w in recent])
        self.money.update((int(losses), float(owed)))

    def close(self) -> None:
        pass


def stream_averages(bars: DataFrame) -> DataFrame:
    use_rocksdb(bars.sparkSession)
    schema = "symbol string, ts timestamp, close double, " + ", ".join(
        f"ema_{n} double" for n in SPANS)
    return bars.groupBy("symbol").transformWithStateInPandas(
        AverageState(), schema, "Append", "None")


def stream_signals(blend: DataFrame) -> DataFrame:
    """``blend``: symbol, ts, raw_long, raw_short, raw_signal, raw_regime."""
    use_rocksdb(blend.sparkSession)
    return blend.groupBy("symbol").transformWithStateInPandas(
        SignalState(),
        "symbol string, ts timestamp, ema_long double, ema_short double, regime string",
        "Append", "None")


def stream_trades(trades: DataFrame) -> DataFrame:
    """``trades``: symbol, side, ts, trade_id, won, pnl_net."""
    use_rocksdb(trades.sparkSession)
    return trades.groupBy("symbol", "side").transformWithStateInPandas(
        TradeState(),
        "symbol string, side string, trade_id long, win_rate double, n_recent int, losses int, "
        "blocked boolean, to_recover double", "Append", "None")
