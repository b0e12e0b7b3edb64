import numpy as np
import pandas as pd
import pytest
from helpers import bars, series, walk
from pyspark.sql import functions as F

from tidebar.functions.params import REGIMES
from tidebar.operators import ledger as lg
from tidebar.operators import outcomes as oc
from tidebar.operators import portfolio as pf
from tidebar.operators import quality as ql
from tidebar.operators import risk as rk
from tidebar.sources import bars as src
from tidebar.sources import journal as jr


def ladder(p, b, start):
    """Plain loop over the bars after the entry."""
    long = p.side == "long"
    stop, partial, armed, peak, floor = p.stop_loss, False, False, -9e9, 0.0
    even = False
    for held in range(1, 13):
        if start + held >= len(b):
            return None
        bar = b.iloc[start + held]
        gain = bar.close - p.entry_price if long else p.entry_price - bar.close
        r = gain / abs(p.entry_price - p.stop_loss)
        fees = gain * p.quantity / (p.entry_price * p.quantity * 0.001)
        reg = REGIMES[bar.regime]
        if held >= 12:
            return start + held, "HARD_TIMEOUT"
        if bar.close >= p.take_profit if long else bar.close <= p.take_profit:
            return start + held, "TP"
        if bar.close <= stop if long else bar.close >= stop:
            return start + held, "SL"
        if not partial and held >= 3 and r >= 1.5:
            partial, armed, even = True, False, True
        if not even and r >= 1.5:
            even = True
        if even:
            stop = p.entry_price + (0.0001 if long else -0.0001)
        if armed:
            peak = max(peak, r)
            if peak - r >= 0.35 or r <= floor:
                return start + held, "EARLY_PROFIT_LOCK"
        if held >= 3 and r >= reg["early_r"] and not partial and not armed and abs(fees) >= 2.5:
            if bar.regime == "TRENDING":
                armed, peak, floor = True, r, max(0.5, reg["early_r"] * 0.7)
            else:
                return start + held, "EARLY_PROFIT"
        if not partial and held == 4 and 0 <= r < 0.25:
            return start + held, "STALL"
        if held >= 3 and bar.signal == ("SHORT" if long else "LONG") and r > 0:
            return start + held, "REVERSAL"
        if held >= reg["timeout"]:
            return start + held, "TIMEOUT"
    return None


def test_exit_ladder_against_loop(spark):
    rng = np.random.default_rng(11)
    pdf = walk(n=1500, symbols=("A",))
    pdf["pos"] = np.arange(len(pdf))
    pdf["regime"] = np.repeat(rng.choice(list(REGIMES), 150), 10)
    pdf["signal"] = rng.choice(["LONG", "SHORT", "HOLD"], len(pdf), p=[0.03, 0.03, 0.94])
    pdf["agreement"] = "AGREE"
    rows = []
    for i in range(0, 1480, 7):
        s = 1 if rng.random() < 0.5 else -1
        e = float(pdf.close[i])
        rows.append(("A", "1h", i, "long" if s > 0 else "short", e, e * (1 - s * 0.015),
                     e * (1 + s * 0.05), 2.0))
    cols = ["symbol", "timeframe", "entry_bar", "side", "entry_price", "stop_loss",
            "take_profit", "quantity"]
    pos = pd.DataFrame(rows, columns=cols)
    got = oc.exit_events(spark.createDataFrame(pos), spark.createDataFrame(pdf)).toPandas()
    got = {r.entry_bar: (r.exit_bar, r.exit_reason) for r in got.itertuples()}
    want = {p.entry_bar: ladder(p, pdf, p.entry_bar) for p in pos.itertuples()}
    want = {k: v for k, v in want.items() if v}
    assert got == want
    assert len({v[1] for v in want.values()}) >= 6


def trades_fixture(spark, n=800):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({
        "symbol": rng.choice(["A", "B"], n, p=[0.8, 0.2]),
        "side": rng.choice(["long", "short"], n), "trade_id": np.arange(n),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 3, unit="h"),
        "pnl_net": rng.normal(0, 50, n).round(2),
        "exit_bar": np.cumsum(rng.integers(1, 4, n)),
    })
    pdf["won"] = pdf.pnl_net > 0
    return pdf, spark.createDataFrame(pdf)


def test_streaks_and_rolling_rates(spark):
    pdf, df = trades_fixture(spark)
    got = rk.streaks(df).toPandas().set_index("trade_id").streak
    rate = rk.rolling_win_rate(df).toPandas().set_index("trade_id").win_rate
    for _, g in pdf.groupby(["symbol", "side"]):
        run, last = 0, None
        for r in g.itertuples():
            run = run + 1 if r.won == last else 1
            last = r.won
            assert got[r.trade_id] == (run if r.won else -run)
        want = g.won.astype(float).rolling(20, min_periods=1).mean()
        np.testing.assert_allclose(rate[g.trade_id], want)


def test_session_loss_and_recovery(spark):
    pdf, df = trades_fixture(spark)
    day = df.withColumn("session", F.to_date("ts"))
    got = rk.session_loss(day).toPandas().set_index("trade_id").open_loss
    rec = rk.recovery_ledger(df).toPandas().set_index("trade_id").to_recover
    for _, g in pdf.groupby(["symbol", pdf.ts.dt.date]):
        owed = 0.0
        for r in g.itertuples():
            owed = max(0.0, owed - r.pnl_net)
            assert got[r.trade_id] == pytest.approx(owed, abs=1e-6)
    for _, g in pdf.groupby("symbol"):
        owed, lost = 0.0, None
        for r in g.itertuples():
            if lost is not None and r.exit_bar - lost >= 6:
                owed = 0.0
            owed = max(0.0, owed - r.pnl_net)
            if r.pnl_net < 0:
                lost = r.exit_bar
            assert rec[r.trade_id] == pytest.approx(owed, abs=1e-6)


def test_sizing_methods(spark):
    row = spark.createDataFrame(
        [(10000.0, 100.0, 98.0, 10, 0.6, 100.0, 80.0, 0.5, 0.65, 0.001),
         (0.0, 100.0, 98.0, 10, 0.6, 100.0, 80.0, 0.5, 0.65, 0.001)],
        "account_equity double, entry_price double, stop_price double, leverage int, "
        "win_rate double, avg_win double, avg_loss double, current_atr double, "
        "confidence double, quantity_step double")
    fixed = rk.position_size(row, "fixed_fractional").orderBy("account_equity").collect()
    assert not fixed[0]["size"]["approved"] and fixed[0]["size"]["reject_reason"]
    # the 25 % position cap binds before the 1.5 % risk does
    assert fixed[1]["size"]["quantity"] == pytest.approx(25.0)
    with pytest.raises(ValueError):
        rk.position_size(row, "martingale")


def test_empty_and_one_sided_ledgers(spark):
    eq = spark.createDataFrame([("A", i, 100.0 + i) for i in range(20)],
                               "symbol string, bar_ix long, equity double")
    schema = ("symbol string, entry_bar long, exit_bar long, direction int, pnl_net double, "
              "fee_paid double, exit_reason string")
    none = lg.performance(eq, spark.createDataFrame([], schema)).first()
    assert none["n_trades"] == 0 and none["profit_factor"] == 0 and none["grade"] == "F"
    wins = spark.createDataFrame([("A", 1, 3, 1, 5.0, 0.1, "TP")] * 3, schema)
    m = lg.trade_metrics(wins).first()
    assert m["profit_factor"] == 99.0 and m["avg_loss"] == 0 and m["n_losses"] == 0
    losses = wins.withColumn("pnl_net", -F.col("pnl_net"))
    m = lg.trade_metrics(losses).first()
    assert m["profit_factor"] == 0 and m["win_rate_pct"] == 0


def test_drawdown_plateau_across_groups(spark):
    rng = np.random.default_rng(2)
    e = 1000 + np.cumsum(rng.normal(0, 5, 700))
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(e)],
                               "symbol string, bar_ix long, equity double")
    p = lg.drawdown_curve(df, group_bars=50).toPandas().sort_values("bar_ix")
    np.testing.assert_allclose(p["peak"], np.maximum.accumulate(e))
    assert (p["drawdown"] <= 0).all()
    r = lg.equity_returns(df, group_bars=50).toPandas().sort_values("bar_ix").bar_return
    np.testing.assert_allclose(r.iloc[1:], np.diff(e) / e[:-1], rtol=1e-9)
    runs = lg.drawdown_runs(df).first()
    inside, lengths, n = p["drawdown"].to_numpy() < -0.001, [], 0
    for v in [*inside, False]:
        if v:
            n += 1
        elif n:
            lengths.append(n)
            n = 0
    assert runs["max_drawdown_bars"] == max(lengths)
    assert runs["avg_drawdown_bars"] == pytest.approx(np.mean(lengths))


def test_reconcile_states(spark):
    ours = spark.createDataFrame([("A", "long"), ("B", "long")], "symbol string, side string")
    theirs = spark.createDataFrame([("A", "long"), ("C", "short")], "symbol string, side string")
    watched = spark.createDataFrame([("A",), ("D",)], "symbol string")
    got = {r.symbol: r.state for r in pf.reconcile(ours, theirs, watched).collect()}
    assert got == {"A": "A", "B": "B", "C": "C", "D": "D"}


def test_quality_report_flags(spark):
    pdf = walk(n=600, symbols=("A", "BTC"))
    pdf.loc[3, "volume"] = np.nan
    df = bars(spark, pd.concat([pdf, pdf.iloc[[10]]])).withColumn(
        "volume", F.nanvl("volume", F.lit(None).cast("double")))
    rep = {r.symbol: r for r in ql.quality_report(df, min_bars={"1h": 100}).collect()}
    assert rep["A"]["duplicates"] == 1 and rep["A"]["null_values"] == 1 and not rep["A"]["ok"]
    # price and regime coverage are asked of five-minute series alone
    assert rep["BTC"]["ok"]
    fine = bars(spark, pdf[pdf.symbol == "BTC"].assign(
        timeframe="5m", ts=pd.date_range("2024-01-01", periods=600, freq="5min")))
    report = ql.quality_report(fine, min_bars={"5m": 100}).first()
    assert "plausible_price" in {c["name"] for c in report["checks"] if not c["passed"]}


def plain_trades(close, signal, tp, sl, max_bars, slip):
    """Bar by bar: while a position is open, signals pass unseen."""
    kept, at = [], 0
    while at < len(close):
        if signal[at] not in (1, 2):
            at += 1
            continue
        d = 1 if signal[at] == 1 else -1
        entry = close[at] * (1 + slip * d)
        for i in range(at + 1, len(close)):
            move = d * (close[i] - entry) / entry
            if move >= tp or move <= -sl or i - at >= max_bars:
                kept.append((at, i))
                at = i + 1
                break
        else:
            break  # open to the end of the series: no trade, and none after it
    return kept


def test_open_entries_block_later_ones(spark):
    rng = np.random.default_rng(5)
    close = np.r_[100 * np.exp(np.cumsum(rng.normal(0, 0.004, 180))), np.full(20, 100.0)]
    close[-3:] = [100.0, 101.5, 102.5]
    pdf = walk(n=200, symbols=("A",)).assign(close=close)
    pdf["pos"], pdf["signal"], pdf["confidence"] = np.arange(200), 0, 0.9
    pdf.loc[pdf.index % 3 == 0, "signal"] = 1
    pdf.loc[pdf.index >= 180, "signal"] = 0
    pdf.loc[[182, 186, 198], "signal"] = [2, 1, 1]
    out = oc.close_only_exits(bars(spark, pdf), tp=0.03, sl=0.03)
    assert out.filter("exit_bar IS NULL").count() > 0
    got = {(r.entry_bar, r.exit_bar) for r in oc.ledger(out, 32, same_bar=False).collect()}
    want = plain_trades(close, pdf.signal.tolist(), 0.03, 0.03, 32, oc.SLIPPAGE)
    assert got == set(want) and (186, 199) not in got and len(got) > 3


def test_holds_beyond_the_reach_are_refused(spark):
    df = spark.sql("SELECT 'A' AS symbol, '1h' AS timeframe, 0L AS entry_bar, 96L AS exit_bar")
    with pytest.raises(Exception, match="holds its key"):
        oc.ledger(df, 48).collect()


def test_profit_lock_keeps_its_floor(spark):
    """Armed at 0.85 R in a trend; 0.60 R in a range is above the floor of 0.56."""
    closes = [100, 100.1, 100.2, 100.85, 100.60, 100.5, 100.5]
    regimes = ["TRENDING"] * 4 + ["RANGE"] * 3
    pdf = walk(n=7, symbols=("A",)).assign(close=np.array(closes, float), pos=np.arange(7), regime=regimes)
    pos = spark.createDataFrame(
        [("A", "1h", 0, "long", 100.0, 99.0, 105.0, 2.0)],
        "symbol string, timeframe string, entry_bar long, side string, entry_price double, "
        "stop_loss double, take_profit double, quantity double")
    got = oc.exit_events(pos, bars(spark, pdf)).first()
    assert (got["exit_reason"], got["exit_bar"]) == ("EARLY_PROFIT_LOCK", 5)


def test_bar_storage_roundtrip(spark, tmp_path):
    df = bars(spark, walk(n=60))
    path = str(tmp_path / "bars")
    src.write_bars(df, path)
    changed = df.filter("symbol = 'A'").withColumn("close", F.col("close") + 1)
    src.write_bars(src.upsert(df.filter("symbol = 'A'"), changed), path)
    back = src.read_bars(spark, path)
    assert back.count() == 120
    np.testing.assert_allclose(series(back)["close"], series(df)["close"] + 1)
    np.testing.assert_allclose(series(back, "B")["close"], series(df, "B")["close"])
    work = {r.symbol: r for r in src.work_list(back, F.expr("timestamp '2024-01-03 12:00:00'"))
            .collect()}
    assert work["A"]["missing_bars"] == 1 and work["A"]["up_to_date"]


def test_dirty_bars(spark):
    raw = spark.createDataFrame(
        [("2024-01-01 00:00:00", "1.5", "x"), ("2024-01-01 01:00:00", "bad", "3"),
         ("2024-01-01 02:00:00", "NaN", "3"), ("never", "2", "3")],
        "` Date ` string, `CLOSE` string, Volume string")
    got = src.normalise_bars(raw, "A", "1h").collect()
    assert len(got) == 1 and got[0]["close"] == 1.5 and got[0]["volume"] is None


def test_journal_roundtrip(spark, tmp_path):
    df = spark.sql(
        "SELECT timestamp '2024-01-01' AS ts, 'A' AS symbol, 'LONG' AS side, true AS won, "
        "0.51239D AS confidence, 1.0D AS pnl_usdt, 0.5D AS pnl_r, 4 AS bars_held, "
        "'TP' AS exit_reason, 'RANGE' AS regime")
    path = str(tmp_path / "journal")
    jr.append_journal(df, path)
    jr.append_journal(df.withColumn("side", F.lit("flat")), path)
    got = jr.read_journal(spark, path).collect()
    assert len(got) == 1 and got[0]["side"] == "long" and got[0]["won"]
    assert got[0]["confidence"] == 0.5124
