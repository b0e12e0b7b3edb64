"""Keyed state by event time: rows wait for the watermark, so the order of arrival does not matter.

A row that arrives is kept in list state and a timer is set for its time. When the watermark has passed,
all rows before it are handed over in time order, together with what falls due between them (a block that
ends, a loss that is written off, ...), which has a timer too and so happens without a later row. A stream
gives the rows of the batch operators for all times before its watermark, whatever files came first, as long
as no row is later than the delay.

A key's state is a few numbers and the rows younger than the watermark. These wait packed, some thousands to an
entry of a map state in Arrow's format, as a state call takes about as long for an entry as for a row. It can be started from a table that
the batch operators made of stored history, so a restarted stream reads new rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebar.streaming.state import SLICE, use_rocksdb

DAY_MS = 86_400_000
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


class Waiting(StatefulProcessor):
    """Base of processors that see their rows in time order. A subclass states its columns and steps.

    ``row``: DDL of a waiting row, its time ``at`` in milliseconds first; rows are ordered by their first
    ``order`` columns. ``held``: DDL of the value that is carried on; ``out``: DDL of an emitted row.
    """

    row: str
    held: str
    out: str
    order = 1
    start: tuple

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._packs = handle.getMapState("packs", "n bigint", "rows binary")
        self._n_packs = handle.getValueState("n_packs", "n bigint")
        self._value = handle.getValueState("value", self.held)
        self._schema = pa.schema([(c, ARROW[kind]) for c, kind in (x.split() for x in self.row.split(", "))])

    def step(self, key: tuple, value: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        """The value after a row, and what the row emits."""
        raise NotImplementedError

    def due(self, value: tuple) -> int | None:
        """When something falls due without a row, if anything does."""
        return None

    def fall_due(self, key: tuple, value: tuple) -> tuple[tuple, list[tuple]]:
        """The value after the next thing that falls due, and what it emits."""
        raise NotImplementedError

    def first(self, row: pd.Series) -> tuple:
        """The value that a row of the initial state stands for."""
        raise NotImplementedError

    # -- what Spark calls -------------------------------------------------------------------------

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for _, row in initialState.iterrows():
            value = self.first(row)
            self._value.update(value)
            self._set_timer(None, value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            new = pa.Table.from_arrays([pa.array(pdf[f.name], f.type, from_pandas=True) for f in self._schema], schema=self._schema)
            if new.num_rows:
                self._laid_by(new)
                at = _earliest(new)
                earliest = at if earliest is None else min(at, earliest)
        if earliest is not None:
            self._handle.registerTimer(earliest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rest = self._woken()
        early = pc.less(rest.column("at"), now)
        ready, rest = rest.filter(early), rest.filter(pc.invert(early))
        self._laid_by(rest)
        least = _earliest(rest)
        del rest, early
        ready = ready.sort_by([(c, "ascending") for c in self._schema.names[: self.order]])
        value = tuple(self._value.get()) if self._value.exists() else self.start
        out: list[tuple] = []

        def fall(until: int, strictly: bool) -> None:
            nonlocal value
            while (at := self.due(value)) is not None and (at < until or at == until and not strictly):
                value, new = self.fall_due(key, value)
                out.extend(new)

        for lo in range(0, ready.num_rows, SLICE):
            for row in zip(*(c.to_pylist() for c in ready.slice(lo, SLICE).columns)):
                fall(row[0], strictly=False)
                value, new = self.step(key, value, row)
                out.extend(new)
            if len(out) >= SLICE:
                yield self._emitted(out)
                out.clear()
        fall(now, strictly=True)
        self._value.update(value)
        self._set_timer(least, value)
        if out:
            yield self._emitted(out)

    def close(self) -> None:
        pass

    def _emitted(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[c.split()[0] for c in self.out.split(", ")])

    def _set_timer(self, least: int | None, value: tuple) -> None:
        times = [t for t in (least, self.due(value)) if t is not None]
        if times:
            self._handle.registerTimer(min(times))

    # -- waiting rows ---------------------------------------------------------------------------------

    def _laid_by(self, rows: pa.Table) -> None:
        """Put rows into the state, ``SLICE`` of them in an entry."""
        if not rows.num_rows:
            return
        n = self._n_packs.get()[0] if self._n_packs.exists() else 0
        for batch in rows.combine_chunks().to_batches(max_chunksize=SLICE):
            self._packs.updateValue((n,), (batch.serialize().to_pybytes(),))
            n += 1
        self._n_packs.update((n,))

    def _woken(self) -> pa.Table:
        """All waiting rows in their order of arrival, taken out of the state."""
        found = []
        for n in range(self._n_packs.get()[0] if self._n_packs.exists() else 0):
            found.append(pa.ipc.read_record_batch(pa.py_buffer(bytes(self._packs.getValue((n,))[0])), self._schema))
            self._packs.removeKey((n,))
        self._n_packs.clear()
        return pa.Table.from_batches(found, self._schema)


def _earliest(rows: pa.Table) -> int | None:
    if rows.column("at").null_count:
        raise ValueError("a row without a time")
    return pc.min(rows.column("at")).as_py()


def in_time(rows: DataFrame, keys: Sequence[str], ts: str, delay: str, processor: Waiting,
            initial: DataFrame | None = None) -> DataFrame:
    """Run a processor over a stream by the event time ``ts``; emitted times are timestamps."""
    use_rocksdb(rows.sparkSession)
    marked = rows.withColumn("at", F.unix_millis(ts)).withWatermark(ts, delay)
    out = marked.groupBy(*keys).transformWithStateInPandas(
        processor, processor.out, "Append", "EventTime",
        initialState=initial.groupBy(*keys) if initial is not None else None)
    return out.withColumn("at", F.timestamp_millis("at")).withColumnRenamed("at", "ts")


# -- trades: streaks, entry blocks, losses to recover ----------------------------------------------------

class TradeClock(Waiting):
    """Closed trades of a symbol: losses in a row per side, entry blocks and the loss to recover, by bar time.

    After ``losses`` straight losses (and each further one) a side is blocked for ``bars`` bars; an
    outstanding loss is written off ``wait`` bars after the last loss. Both happen at their time.
    """

    row = "at bigint, trade_id bigint, side string, pnl_net double"
    held = ("long_losses int, short_losses int, long_until bigint, short_until bigint, owed double, last_loss bigint")
    out = "symbol string, kind string, side string, at bigint, trade_id bigint, to_recover double, blocked boolean"
    order = 2
    start = (0, 0, None, None, 0.0, None)

    def __init__(self, bar_ms: int = DAY_MS, losses: int = 3, bars: int = 8, wait: int = 6):
        self._block, self._wait, self._losses = bars * bar_ms, wait * bar_ms, losses

    def due(self, value):
        _, _, long_until, short_until, _, last_loss = value
        times = [t for t in (long_until, short_until) if t is not None]
        return min([*times, last_loss + self._wait] if last_loss is not None else times, default=None)

    def fall_due(self, key, value):
        a, b, long_until, short_until, owed, last_loss = value
        at = self.due(value)
        out = []
        if last_loss is not None and last_loss + self._wait == at:
            if owed > 0:
                out.append((key[0], "WRITTEN_OFF", None, at, None, owed, None))
            owed, last_loss = 0.0, None
        for side, until in (("long", long_until), ("short", short_until)):
            if until == at:
                out.append((key[0], "UNBLOCKED", side, at, None, None, False))
        long_until = None if long_until == at else long_until
        short_until = None if short_until == at else short_until
        return (a, b, long_until, short_until, owed, last_loss), out

    def step(self, key, value, row):
        at, trade_id, side, pnl = row
        streak, until, owed, last_loss = list(value[:2]), list(value[2:4]), value[4], value[5]
        k = 0 if side == "long" else 1
        owed = max(0.0, owed - pnl)
        if pnl < 0:
            last_loss = at
            streak[k] += 1
            if streak[k] >= self._losses:
                until[k] = at + self._block
        else:
            streak[k] = 0
        out = (key[0], "CLOSE", side, at, trade_id, owed, until[k] is not None)
        return (*streak, *until, owed, last_loss), [out]


def trade_clock(trades: DataFrame, delay: str = "1 day", **settings) -> DataFrame:
    """``trades``: symbol, side, ts, trade_id, pnl_net; rows: closes, ends of blocks, write-offs."""
    rows = trades.select("symbol", "side", "ts", "trade_id", F.col("pnl_net").cast("double").alias("pnl_net"))
    return in_time(rows, ["symbol"], "ts", delay, TradeClock(**settings))


# -- the last reading of another stream ------------------------------------------------------------------

class LastReading(Waiting):
    """Bars with the newest reading at or before their time."""

    row = "at bigint, kind int, seq bigint, label string, close double"
    held = "label string, since bigint"
    out = "symbol string, at bigint, close double, label string, since bigint"
    order = 3
    start = (None, None)

    def step(self, key, value, row):
        at, kind, _, label, close = row
        if kind == 0:
            return (label, at), []
        return value, [(key[0], at, close, *value)]

    def first(self, row):
        return row["label"], int(row["since"])


def asof_streams(bars: DataFrame, readings: DataFrame, delay: str = "1 hour",
                 initial: DataFrame | None = None) -> DataFrame:
    """As-of join of two streams: ``bars`` (symbol, ts, close), ``readings`` (symbol, ts, seq, label).

    One watermark, that of the slower stream, holds both back. Rows: symbol, ts, close, label, since.
    ``initial``: (symbol, label, since in milliseconds), the readings known before the streams begin.
    """
    def side(df: DataFrame, kind: int, seq: Column, label: Column, close: Column) -> DataFrame:
        return df.select("symbol", "ts", F.lit(kind).alias("kind"), seq.cast("bigint").alias("seq"),
                         label.cast("string").alias("label"), close.cast("double").alias("close")
                         ).withWatermark("ts", delay)

    null = F.lit(None)
    rows = side(readings, 0, F.col("seq"), F.col("label"), null).unionByName(
        side(bars, 1, F.lit(0), null, F.col("close")))
    use_rocksdb(rows.sparkSession)
    processor = LastReading()
    out = rows.withColumn("at", F.unix_millis("ts")).groupBy("symbol").transformWithStateInPandas(
        processor, processor.out, "Append", "EventTime",
        initialState=initial.groupBy("symbol") if initial is not None else None)
    return out.select("symbol", F.timestamp_millis("at").alias("ts"), "close", "label",
                      F.timestamp_millis("since").alias("since"))


# -- signals: smoothing and regime, started from history ---------------------------------------------------

class SignalClock(Waiting):
    """Conditional smoothing of the blended probabilities and the two-bar regime confirmation."""

    row = "at bigint, raw_long double, raw_short double, raw_signal string, raw_regime string"
    held = "ema_long double, ema_short double, last_raw string, regime string"
    out = "symbol string, at bigint, ema_long double, ema_short double, regime string"
    start = (None, None, None, "RANGE")

    def first(self, row):
        return (float(row["ema_long"]), float(row["ema_short"]), row["last_raw"], row["regime"])

    def step(self, key, value, row):
        at, long, short, signal, raw = row
        ema_long, ema_short, last, regime = value
        if ema_long is None:
            ema_long, ema_short = long, short
        elif signal != "HOLD" and max(long, short) > max(0.0, 1.0 - long - short):
            ema_long, ema_short = 0.7 * long + 0.3 * ema_long, 0.7 * short + 0.3 * ema_short
        regime = raw if raw == last else regime
        return (ema_long, ema_short, raw, regime), [(key[0], at, ema_long, ema_short, regime)]


def signal_clock(blend: DataFrame, initial: DataFrame | None = None, delay: str = "2 hours") -> DataFrame:
    """``blend``: symbol, ts, raw_long, raw_short, raw_signal, raw_regime; ``initial`` from ``signal_state``."""
    return in_time(blend, ["symbol"], "ts", delay, SignalClock(), initial)


def signal_state(smoothed: DataFrame) -> DataFrame:
    """The state after stored bars that the batch operators have smoothed: one row a symbol.

    ``smoothed``: symbol, ts, ema_long, ema_short, raw_regime, regime.
    """
    return smoothed.groupBy("symbol").agg(
        *[F.max_by(a, "ts").alias(b) for a, b in (
            ("ema_long", "ema_long"), ("ema_short", "ema_short"), ("raw_regime", "last_raw"), ("regime", "regime"))])
