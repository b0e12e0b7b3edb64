import random

import pytest

from tidebar.operators import book as bk

COLUMNS = "book string, symbol string, at long, exit_at long, direction int, pnl_net double, confidence double"


def candidates(n=700, seed=1, books=("x", "y")):
    rng = random.Random(seed)
    rows = []
    for book in books:
        at = 0
        for i in range(n):
            at += rng.choice([1, 1, 1, 2, 2, 9])  # at most one candidate at a time: order is total
            exit_at = None if i == n - 5 else at + rng.randrange(1, 12)
            rows.append((book, rng.choice("ABCDEFGH"), at, exit_at, rng.choice([1, -1]), float(rng.choice([-30, -20, -10, 5, 25])), rng.choice([0.6, 0.65, 0.75, 0.9])))
    return rows


def plain(rows, rules):
    """Bar by bar: what closes at a bar, what is written off, then the bar's candidate."""
    out = []
    for book in sorted({r[0] for r in rows}):
        own = {r[2]: r for r in rows if r[0] == book}
        open_, streak, until, owed = [], {1: 0, -1: 0}, {1: 0, -1: 0}, {}
        for bar in range(max(own) + 1):
            for symbol in list(owed):
                if bar - owed[symbol]["since"] >= rules.wait:
                    del owed[symbol]
            for p in sorted([p for p in open_ if p["exit"] == bar], key=lambda p: p["at"]):
                open_.remove(p)
                if p["pnl"] < 0:
                    if rules.recovery:
                        o = owed.setdefault(p["symbol"], {"loss": 0.0})
                        o.update(loss=o["loss"] - p["pnl"], since=bar, attempts=0)
                    streak[p["direction"]] += 1
                    if rules.losses and streak[p["direction"]] >= rules.losses:
                        until[p["direction"]] = bar + rules.block
                else:
                    streak[p["direction"]] = 0
                    if p["symbol"] in owed:
                        owed[p["symbol"]]["loss"] -= p["pnl"]
                        if owed[p["symbol"]]["loss"] <= 0:
                            del owed[p["symbol"]]
            if bar not in own:
                continue
            _, symbol, at, exit_at, direction, pnl, confidence = own[bar]
            debt = owed.get(symbol)
            size = 1.0
            if len(open_) >= rules.max_open:
                why = "max open trades"
            elif symbol in [p["symbol"] for p in open_]:
                why = "symbol is open"
            elif [p["direction"] for p in open_].count(direction) >= rules.per_direction:
                why = "direction is open"
            elif bar < until[direction]:
                why = "loss streak"
            elif debt and confidence < rules.confident:
                why = "recovery wait"
            else:
                why = None
            held, loss = len(open_), debt["loss"] if debt else 0.0
            if why is None:
                if debt:
                    size = min(rules.growth ** debt["attempts"], rules.most)
                    debt["attempts"] += 1
                    debt["since"] = bar
                open_.append({"exit": exit_at, "at": at, "symbol": symbol, "direction": direction, "pnl": pnl * size})
            out.append((book, at, why is None, why, held, size, loss, pnl * size if why is None else 0.0))
    return out


@pytest.mark.parametrize("rules", [
    bk.BookRules(), bk.BookRules(per_direction=5, losses=0), bk.BookRules(max_open=3, per_direction=2, losses=2, block=15, recovery=True, wait=40),
])
@pytest.mark.parametrize("chunk", [2048, 37])
def test_book_equals_a_bar_by_bar_loop(spark, rules, chunk):
    rows = candidates()
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = bk.booked(df, rules, chunk_rows=chunk).select(
        "book", "at", "entered", "reject_reason", "open_trades", "size_factor", "to_recover", "pnl_taken").collect()
    want = plain(rows, rules)
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want
    reasons = {w[3] for w in want}
    assert "symbol is open" in reasons and (not rules.recovery or {"recovery wait", "loss streak", "max open trades"} <= reasons)
    if rules.recovery:
        assert {w[5] for w in want} >= {1.0, 1.5}


def test_empty_book(spark):
    assert bk.booked(spark.createDataFrame([], COLUMNS)).collect() == []
