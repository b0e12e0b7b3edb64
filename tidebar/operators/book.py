"""Positions of a book: entries that depend on trades really kept, across symbols and in a closed loop.

Whether a candidate is entered depends on what was entered before: open positions, their number and
directions, losses in a row of the kept trades, and the loss still to recover. That state is too wide to
tabulate, so it is found by a fixed point: the candidates of a book are cut into chunks, all chunks are folded at once from an
empty state, and a chunk is folded again only while the state that its predecessor ends in is not the one it
started from. A state forgets (positions close, streaks end, losses are written off), so after a few
rounds nothing changes, and then every chunk started from the true state. The result is that of one
pass over the whole book, however many rounds it takes.

A task holds one chunk; along a book only one short row for each chunk is ordered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidebar.operators.timeline import positioned
from tidebar.session import cut_lineage

CHUNK_ROWS = 2048


def chained_fold(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
    fold: Callable[[str, list[dict]], tuple[str, list[dict]]], out: T.StructType, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """All rows of each key folded in order; the columns of ``out`` are added to each row.

    ``fold(state, rows of a chunk)`` gives the next state, a text, and a dictionary for each row; the state in front of a
    key's first row is empty. ``bucket`` is a coarse function of the order, see ``positioned``.
    """
    keys = list(keys)
    numbered = cut_lineage(
        positioned(rows, keys, bucket, order, out="__pos").withColumn("__chunk", F.floor(F.col("__pos") / chunk_rows)), "book")
    place = [*keys, "__chunk"]
    fields = [f for f in numbered.schema.fields if f.name in place]
    state = T.StructType([*fields, T.StructField("__start", T.StringType()), T.StructField("__end", T.StringType())])
    result = T.StructType([f for f in numbered.schema.fields if not f.name.startswith("__")] + out.fields)
    carried = [f.name for f in result.fields if f.name not in out.names]

    def run(table: pa.Table) -> tuple[str, str, pa.Table, list[dict]]:
        table = table.sort_by("__pos")
        start = table.column("__start")[0].as_py()
        end, found = fold(start, table.to_pylist())
        return start, end, table, found

    def ends(table: pa.Table) -> pa.Table:
        start, end, table, _ = run(table)
        return pa.table({c: table.column(c)[:1] for c in place} | {"__start": [start], "__end": [end]})

    def emitted(table: pa.Table) -> pa.Table:
        _, _, table, found = run(table)
        new = {f.name: pa.array([r[f.name] for r in found], _arrow(f.dataType)) for f in out.fields}
        return pa.table({c: table.column(c) for c in carried} | new)

    todo = cut_lineage(numbered.select(*place).distinct().withColumn("__start", F.lit("")), "starts")
    known: DataFrame | None = None
    while True:
        new = numbered.join(todo, place).groupBy(*place).applyInArrow(ends, state)
        known = cut_lineage(new if known is None else known.join(todo.select(*place), place, "left_anti").unionByName(new), "ends")
        before = F.lag("__end", 1, "").over(Window.partitionBy(*keys).orderBy("__chunk"))  # a row for each chunk
        todo = cut_lineage(
            known.withColumn("__true", before).filter("__true <> __start").select(*place, F.col("__true").alias("__start")), "starts")
        if todo.isEmpty():
            break
    return numbered.join(known.select(*place, "__start"), place).groupBy(*place).applyInArrow(emitted, result)


def _arrow(t: T.DataType) -> pa.DataType:
    kinds = {T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.DoubleType: pa.float64(), T.IntegerType: pa.int32()}
    return kinds[type(t)]


@dataclass(frozen=True)
class BookRules:
    """Limits of a book; times are in the unit of ``at`` and ``exit_at``.

    ``per_direction``: open positions in one direction; ``losses`` straight losses of kept trades in a
    direction (0: never) close it for ``block``; ``recovery``: a symbol with a loss to recover takes only
    entries of at least ``confident``, each ``growth`` times larger than the one before (``most`` at most),
    until the loss is earned back or ``wait`` has passed since the last loss or recovery entry.
    """

    max_open: int = 5
    per_direction: int = 1
    losses: int = 3
    block: int = 8
    recovery: bool = False
    confident: float = 0.7
    growth: float = 1.5
    most: float = 3.0
    wait: int = 6


class Book:
    """The state of a book and the decision on one candidate after the other."""

    def __init__(self, rules: BookRules, text: str = ""):
        self.rules = rules
        state = json.loads(text) if text else {}
        #: [exit, entry number, symbol, direction, profit]
        self.open: list[list] = state.get("open", [])
        self.streak: dict[str, int] = state.get("streak", {})
        self.until: dict[str, int] = state.get("until", {})
        #: symbol -> [loss to recover, since, attempts]
        self.owed: dict[str, list] = state.get("owed", {})

    def text(self, at: int | None) -> str:
        """What later candidates depend on, as of the last one."""
        until = {d: t for d, t in self.until.items() if at is None or t > at}
        streak = {d: min(n, self.rules.losses) for d, n in self.streak.items() if n}
        return json.dumps({"open": self.open, "streak": streak, "until": until, "owed": self.owed}, sort_keys=True)

    def _write_off(self, symbol: str, now: int) -> None:
        if symbol in self.owed and self.owed[symbol][1] + self.rules.wait <= now:
            del self.owed[symbol]

    def _close(self, now: int) -> None:
        done = sorted(p for p in self.open if p[0] is not None and p[0] <= now)
        self.open = [p for p in self.open if p not in done]
        for at, _, symbol, direction, profit in done:
            key = str(direction)
            if self.rules.recovery:
                self._write_off(symbol, at)
                owed, since, attempts = self.owed.get(symbol, [0.0, at, 0])
                if profit < 0:
                    self.owed[symbol] = [owed - profit, at, 0]
                elif owed > profit:
                    self.owed[symbol] = [owed - profit, since, attempts]
                else:
                    self.owed.pop(symbol, None)
            self.streak[key] = self.streak.get(key, 0) + 1 if profit < 0 else 0
            if self.rules.losses and self.streak[key] >= self.rules.losses:
                self.until[key] = at + self.rules.block

    def decide(self, row: dict) -> dict:
        """Enter a candidate (at, exit_at, symbol, direction, pnl_net, confidence, __pos) or say why not."""
        rules, at, symbol, direction = self.rules, row["at"], row["symbol"], row["direction"]
        self._close(at)
        self._write_off(symbol, at)
        held = len(self.open)
        owed, _, attempts = self.owed.get(symbol, [0.0, None, 0])
        reason, factor = None, 1.0
        if held >= rules.max_open:
            reason = "max open trades"
        elif any(p[2] == symbol for p in self.open):
            reason = "symbol is open"
        elif sum(p[3] == direction for p in self.open) >= rules.per_direction:
            reason = "direction is open"
        elif at < self.until.get(str(direction), at):
            reason = "loss streak"
        elif owed > 0 and row["confidence"] < rules.confident:
            reason = "recovery wait"
        else:
            if owed > 0:
                factor = min(rules.growth**attempts, rules.most)
                self.owed[symbol] = [owed, at, attempts + 1]
            self.open.append([row["exit_at"], row["__pos"], symbol, direction, row["pnl_net"] * factor])
        return {
            "entered": reason is None, "reject_reason": reason, "open_trades": held, "size_factor": factor,
            "to_recover": owed, "pnl_taken": row["pnl_net"] * factor if reason is None else 0.0,
        }


BOOK_COLUMNS = T.StructType([
    T.StructField("entered", T.BooleanType()), T.StructField("reject_reason", T.StringType()),
    T.StructField("open_trades", T.IntegerType()), T.StructField("size_factor", T.DoubleType()),
    T.StructField("to_recover", T.DoubleType()), T.StructField("pnl_taken", T.DoubleType()),
])


def booked(candidates: DataFrame, rules: BookRules | None = None, keys: Sequence[str] = ("book",),
           order: Sequence[str] = ("at", "symbol"), bucket_width: int = 4096, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every candidate with ``entered``, ``reject_reason``, ``open_trades``, ``size_factor``, ``to_recover``, ``pnl_taken``.

    ``candidates``: the keys of their book, at (long), exit_at (long; null: never), symbol, direction,
    pnl_net, confidence. The order must be total in a book.
    """
    settings = asdict(rules or BookRules())

    def fold(state: str, rows: list[dict]) -> tuple[str, list[dict]]:
        book = Book(BookRules(**settings), state)
        found = [book.decide(r) for r in rows]
        return book.text(rows[-1]["at"]), found

    return chained_fold(candidates, keys, list(order), F.floor(F.col("at") / bucket_width), fold, BOOK_COLUMNS, chunk_rows)
