"""Small column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


# --- SQL text helpers: wide layers are written as selectExpr lists, one driver call each ---


def num(x: float) -> str:
    """A DOUBLE literal (a bare decimal literal would be DECIMAL)."""
    return f"double({x!r})" if x == x else "double('NaN')"


def sql_flag(cond: str) -> str:
    """0/1 column; an unknown comparison counts as 0."""
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def sql_finite(name: str) -> str:
    """NaN and infinities become NULL."""
    return f"CASE WHEN abs({name}) < double('Infinity') THEN {name} END"


def sql_clip(c: str, low: float, high: float) -> str:
    return f"CASE WHEN ({c}) IS NOT NULL THEN least(greatest({c}, {num(low)}), {num(high)}) END"


def sql_lookup(table: dict, key: str, default=None) -> str:
    """Dictionary lookup as a CASE over a constant table."""
    def lit(v):
        return num(v) if isinstance(v, float) else (repr(v) if isinstance(v, str) else str(v))

    arms = " ".join(f"WHEN {k!r} THEN {lit(v)}" for k, v in table.items())
    tail = "" if default is None else f" ELSE {lit(default)}"
    return f"CASE {key} {arms}{tail} END"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def flag(cond: Column) -> Column:
    """A 0/1 column; an unknown comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL stays NULL (greatest/least alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def first_of(*rules: tuple[Column, Column | str | float], default=None) -> Column:
    """First matching (condition, value) rule; NULL conditions do not match."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if default is None else out.otherwise(
        default if isinstance(default, Column) else F.lit(default)
    )


def normal_symbol(c: Column | str) -> Column:
    """``BTC/USDT:USDT`` and ``btcusdt`` both become ``BTCUSDT``."""
    out = F.upper(col(c))
    for token in (":USDT", ":BTC", "/"):
        out = F.replace(out, F.lit(token), F.lit(""))
    return out


def floor_step(c: Column, step: Column | float) -> Column:
    """Round down to a lot step."""
    step = step if isinstance(step, Column) else F.lit(float(step))
    return F.floor(c / step) * step


def ceil_step(c: Column, step: Column | float) -> Column:
    """Round up to a lot step."""
    step = step if isinstance(step, Column) else F.lit(float(step))
    return F.ceil(c / step) * step


def argmax3(p: Column) -> Column:
    """Index of the largest entry of a probability array; first wins on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def issues(*pairs: tuple[Column, str | Column]) -> Column:
    """ARRAY<STRING> of the messages whose condition holds."""
    picked = [F.when(cond, m if isinstance(m, Column) else F.lit(m)) for cond, m in pairs]
    return F.filter(F.array(*picked), lambda m: m.isNotNull())
