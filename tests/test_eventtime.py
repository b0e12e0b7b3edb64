import random

import numpy as np
import pandas as pd
from helpers import walk

from tidebar.operators import signals as sg
from tidebar.streaming import bars as sb
from tidebar.streaming import eventtime as et
from tidebar.streaming import state as st

DAY = pd.Timedelta(days=1)
START = pd.Timestamp("2024-01-01")


def files(spark, pdf, schema, path, parts, seed=1):
    """Rows dealt at random to files that a stream reads one by one."""
    rng = random.Random(seed)
    pdf = pdf.assign(_part=[rng.randrange(parts) for _ in range(len(pdf))])
    for k, part in pdf.groupby("_part"):
        spark.createDataFrame(part.drop(columns="_part"), schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


TRADES = "symbol string, side string, ts timestamp, trade_id long, pnl_net double"


def trades(n=150, seed=3):
    rng = random.Random(seed)
    rows = []
    for symbol in ("A", "B"):
        at = 0
        for i in range(n):
            at += rng.choice([0, 1, 1, 2, 9])
            rows.append((symbol, rng.choice(["long", "short"]), START + at * DAY, i, float(rng.choice([-30, -20, -10, 5, 25]))))
    return pd.DataFrame(rows, columns=["symbol", "side", "ts", "trade_id", "pnl_net"])


def plain_clock(pdf, until, bars=8, wait=6, losses=3):
    """Day by day: what ends on the morning of a day, then the day's trades."""
    out = []
    for symbol, g in pdf.groupby("symbol"):
        owed, last, streak, blocked = 0.0, None, {"long": 0, "short": 0}, {"long": None, "short": None}
        for day in pd.date_range(START, until - DAY):
            if last is not None and day == last + wait * DAY:
                if owed > 0:
                    out.append((symbol, "WRITTEN_OFF", None, day, None, owed, None))
                owed, last = 0.0, None
            for side in ("long", "short"):
                if blocked[side] == day:
                    out.append((symbol, "UNBLOCKED", side, day, None, None, False))
                    blocked[side] = None
            for r in g[g.ts == day].sort_values("trade_id").itertuples():
                owed = max(0.0, owed - r.pnl_net)
                if r.pnl_net < 0:
                    last = day
                    streak[r.side] += 1
                    if streak[r.side] >= losses:
                        blocked[r.side] = day + bars * DAY
                else:
                    streak[r.side] = 0
                out.append((symbol, "CLOSE", r.side, day, r.trade_id, owed, blocked[r.side] is not None))
    return sorted(out, key=str)


def test_shuffled_files_give_the_rows_of_a_plain_loop(spark, tmp_path):
    pdf = trades()
    end = pdf.ts.max() + 1000 * DAY
    stream = files(spark, pdf, TRADES, str(tmp_path / "in"), 6)
    # a late row of another symbol moves the watermark on, so that all waiting rows come out
    spark.createDataFrame([("Z", "long", end.to_pydatetime(), 0, 1.0)], TRADES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    delay = f"{(pdf.ts.max() - START).days + 1} days"
    got = sb.drain(et.trade_clock(stream, delay), "clock").collect()
    assert all(r.symbol != "Z" for r in got)
    until = end - pd.Timedelta(delay)
    key = [(r.symbol, r.kind, r.side, pd.Timestamp(r.ts), r.trade_id, r.to_recover, r.blocked) for r in got]
    want = plain_clock(pdf, until)
    assert sorted(key, key=str) == want
    assert {k for _, k, *_ in want} == {"CLOSE", "UNBLOCKED", "WRITTEN_OFF"}


def test_things_fall_due_without_a_later_row(spark, tmp_path):
    """Three losses and nothing more of the symbol: the block ends and the loss is written off all the same."""
    rows = [("A", "long", START + i * DAY, i, -10.0) for i in range(3)] + [("B", "long", START + 60 * DAY, 9, 1.0)]
    pdf = pd.DataFrame(rows, columns=["symbol", "side", "ts", "trade_id", "pnl_net"])
    got = sb.drain(et.trade_clock(files(spark, pdf, TRADES, str(tmp_path / "in"), 1), "1 day"), "clock").collect()
    found = {(r.kind, (pd.Timestamp(r.ts) - START).days): r.to_recover for r in got if r.kind != "CLOSE"}
    assert found == {("WRITTEN_OFF", 8): 30.0, ("UNBLOCKED", 10): None}


def test_asof_of_two_streams(spark, tmp_path):
    rng = np.random.default_rng(4)
    ticks = START + pd.to_timedelta(np.sort(rng.choice(5000, 300, replace=False)), unit="min")
    bars = pd.DataFrame({"symbol": rng.choice(["A", "B"], 300), "ts": ticks, "close": rng.normal(size=300)})
    at = START + pd.to_timedelta(rng.choice(5000, 80), unit="min")
    news = pd.DataFrame({"symbol": rng.choice(["A", "B"], 80), "ts": at, "seq": np.arange(80), "label": [f"n{i}" for i in range(80)]})
    news.loc[0, "ts"] = bars.ts[7]
    news.loc[0, "symbol"] = bars.symbol[7]
    end = START + 30 * DAY
    one = files(spark, bars, "symbol string, ts timestamp, close double", str(tmp_path / "bars"), 3)
    two = files(spark, news, "symbol string, ts timestamp, seq long, label string", str(tmp_path / "news"), 4)
    spark.createDataFrame([("Z", end.to_pydatetime(), 0.0)], "symbol string, ts timestamp, close double").write.mode("append").parquet(str(tmp_path / "bars"))
    spark.createDataFrame([("Z", end.to_pydatetime(), 0, "z")], "symbol string, ts timestamp, seq long, label string").write.mode("append").parquet(str(tmp_path / "news"))
    known = spark.createDataFrame([("A", "old", 0), ("B", "old", 0)], "symbol string, label string, since long")
    got = sb.drain(et.asof_streams(one, two, "4 days", known), "asof").toPandas()
    news = news.sort_values(["ts", "seq"]).drop_duplicates(["symbol", "ts"], keep="last")
    want = pd.merge_asof(bars, news, on="ts", by="symbol").fillna({"label": "old"})
    assert len(got) == 300
    both = got.merge(want, on=["symbol", "ts"])
    assert len(both) == 300 and (both.label_x == both.label_y).all() and (both.close_x == both.close_y).all()


def test_signals_continue_from_stored_history(spark, tmp_path):
    n = 120
    rng = np.random.default_rng(4)
    pdf = walk(n=n)[["symbol", "timeframe", "ts"]]
    pdf["pos"] = np.tile(np.arange(n), 2)
    pdf["raw_long"], pdf["raw_short"] = rng.uniform(0.1, 0.6, 2 * n), rng.uniform(0.1, 0.4, 2 * n)
    pdf["raw_regime"] = rng.choice(["RANGE", "TRENDING"], 2 * n)
    df = spark.createDataFrame(pdf).selectExpr("*", "greatest(0D, 1 - raw_long - raw_short) AS raw_hold")
    df = df.selectExpr("*", f"{sg._pick('raw_long', 'raw_short', 'raw_hold')} AS raw_signal", "'AGREE' AS agreement")
    batch = sg.smooth(df).toPandas().sort_values(["symbol", "ts"])
    regimes = []
    for _, g in batch.groupby("symbol"):
        held, last = "RANGE", None
        for r in g.raw_regime:
            held, last = (r if r == last else held), r
            regimes.append(held)
    batch["regime"] = regimes
    cut = sorted(pdf.ts.unique())[80]
    stored = spark.createDataFrame(batch[batch.ts < cut][["symbol", "ts", "ema_long", "ema_short", "raw_regime", "regime"]])
    schema = "symbol string, ts timestamp, raw_long double, raw_short double, raw_signal string, raw_regime string"
    fresh = df.filter(df.ts >= cut).select("symbol", "ts", "raw_long", "raw_short", "raw_signal", "raw_regime").toPandas()
    path = str(tmp_path / "in")
    stream = files(spark, fresh, schema, path, 4)
    spark.createDataFrame([("Z", (fresh.ts.max() + 400 * DAY).to_pydatetime(), 0.2, 0.2, "HOLD", "RANGE")], schema).write.mode("append").parquet(path)
    got = sb.drain(et.signal_clock(stream, et.signal_state(stored), "300 days"), "signals").toPandas()
    got = got.sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = batch[batch.ts >= cut].reset_index(drop=True)
    assert len(got) == len(want) == 80
    np.testing.assert_allclose(got.ema_long, want.ema_long, rtol=1e-9)
    np.testing.assert_allclose(got.ema_short, want.ema_short, rtol=1e-9)
    assert got.regime.tolist() == want.regime.tolist()


class Cell:
    """Value or map state in memory that counts its calls."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def exists(self):
        return bool(self.data)

    def get(self):
        return self.data.get(None)

    def update(self, value):
        self.updateValue(None, value)

    def getValue(self, key):
        self.calls += 1
        return self.data[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.data[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.data[key]

    def clear(self):
        self.data.clear()


class Handle:
    def __init__(self):
        self.cells, self.timers = {}, []

    def getMapState(self, name, *schemas):
        return self.cells.setdefault(name, Cell())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)


def test_waiting_rows_cost_few_state_calls_and_leave_in_slices():
    n, day = 45_000, 86_400_000
    rng = random.Random(2)
    at = [rng.randrange(0, 500) * day for _ in range(n)]
    pdf = pd.DataFrame({"at": at, "trade_id": range(n), "side": rng.choices(["long", "short"], k=n), "pnl_net": rng.choices([-5.0, 4.0], k=n)})
    clock, handle = et.TradeClock(), Handle()
    clock.init(handle)
    times = type("Times", (), {"getCurrentWatermarkInMs": lambda self: 400 * day})()
    parts = [pdf.iloc[lo : lo + 9000] for lo in range(0, n, 9000)]
    assert list(clock.handleInputRows(("A",), iter(parts), times)) == []
    out = list(clock.handleExpiredTimer(("A",), times, None))
    assert sum(c.calls for c in handle.cells.values()) < 50
    assert len(out) > 2 and max(map(len, out)) < 21_000
    closed = pd.concat(out).query("kind == 'CLOSE'")
    early = pdf[pdf["at"] < 400 * day].sort_values(["at", "trade_id"])
    assert closed.trade_id.astype(int).tolist() == early.trade_id.tolist()
    assert handle.timers[-1] <= min(a for a in at if a >= 400 * day)
    assert clock._woken().num_rows == n - len(early)


def test_rows_of_a_batch_are_held_without_their_strings_and_leave_in_slices():
    parts = [pd.DataFrame({"symbol": "A", "side": "long", "ts": START + i * DAY, "trade_id": range(9000), "won": True, "pnl_net": 1.0})
             for i in (2, 0, 1)]
    state, handle = st.TradeState(), Handle()
    handle.getListState = lambda *a: type("Rows", (Cell,), {"put": Cell.update})()
    state.init(handle)
    out = list(state.handleInputRows(("A", "long"), iter(parts), None))
    assert max(map(len, out)) <= st.SLICE and sum(map(len, out)) == 27_000
    assert pd.concat(out).trade_id.tolist() == [*range(9000)] * 3
    assert all("symbol" not in x for x in st.ordered(iter(parts), ["ts", "won"], ["ts"]))
