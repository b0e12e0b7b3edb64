"""Greedy interval selection without a sequential pass over a whole key.

Candidates of a key come in bar order; one is kept if its bar is not before the point from
which the previous kept one leaves the key free.  The only thing earlier candidates pass on
is that free point, and it lies at most ``reach`` bars ahead.  So each group of bars is folded
once per possible free point (a small map), the maps are composed along the key in two
levels, and each group is then folded once more from its true free point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.session import cut_lineage


def greedy_select(
    df: DataFrame,
    keys: Sequence[str],
    bar: str,
    free: str,
    reach: int,
    group: Column | None = None,
    limit: int | None = None,
    fan: int = 256,
) -> DataFrame:
    """Rows kept by the greedy rule.

    ``bar`` is unique per key; ``free`` is the first bar at which a new row may be kept once
    this one is; free - bar beyond ``reach`` is an error.  ``limit`` caps the rows kept per group (a day, for
    example); without it ``group`` only sets the work size and defaults to 1024 bars.
    """
    cols = df.columns
    item = F.struct(
        F.col(bar).cast("long").alias("e"),
        F.when(F.col(free) - F.col(bar) <= reach, F.col(free).cast("long"))
        .otherwise(F.raise_error(F.lit(f"a row holds its key for more than {reach} bars")))
        .cast("long").alias("f"),
        F.struct(*cols).alias("row"),
    )
    if group is None:
        group = F.floor(F.col(bar) / 1024)
    groups = cut_lineage(
        df.withColumn("__g", group)
        .groupBy(*keys, "__g")
        .agg(F.array_sort(F.collect_list(item)).alias("__items")),
        "groups",
    )
    may = "x.e >= s.free" + ("" if limit is None else f" AND s.n < {limit}")

    def fold(start: str, finish: str = "s -> s.free", emit: bool = False) -> str:
        keep = ", 'out', concat(s.out, array(x.row))" if emit else ""
        zero = ", 'out', filter(transform(__items, i -> i.row), r -> false)" if emit else ""
        return (
            f"aggregate(__items, named_struct('free', {start}, 'n', 0{zero}), "
            f"(s, x) -> CASE WHEN {may} THEN named_struct('free', x.f, 'n', s.n + 1{keep}) "
            f"ELSE s END, {finish})"
        )

    maps = groups.selectExpr(
        *keys, "__g", "__items[0].e AS e0",
        f"transform(sequence(0, {reach}), o -> {fold('__items[0].e + o')}) AS ends",
    )

    def step(state: str) -> str:
        return f"get(x.ends, cast(greatest(0, least({reach}, {state} - x.e0)) AS int))"

    spans = maps.groupBy(*keys, F.floor(F.col("__g") / fan).alias("__s")).agg(
        F.array_sort(F.collect_list(F.struct("__g", "e0", "ends"))).alias("__maps")
    )
    composed = spans.selectExpr(
        *keys, "__s", "__maps[0].e0 AS e0",
        f"transform(sequence(0, {reach}), o -> aggregate(__maps, __maps[0].e0 + o, "
        f"(free, x) -> {step('free')})) AS ends",
    )

    def spread(array: str, start: str, name: str) -> str:
        """Free point in front of each element of ``array``."""
        return (
            f"inline(aggregate({array}, named_struct('free', {start}, 'out', "
            f"cast(array() AS array<struct<{name}:bigint,free0:bigint>>)), (a, x) -> "
            f"named_struct('free', {step('a.free')}, 'out', concat(a.out, "
            f"array(named_struct('{name}', x.{name}, 'free0', a.free)))), a -> a.out))"
        )

    heads = (
        composed.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("__s", "e0", "ends"))).alias("__maps"))
        .selectExpr(*keys, spread("__maps", "__maps[0].e0", "__s"))
    )
    entries = spans.join(heads, [*keys, "__s"]).selectExpr(
        *keys, spread("__maps", "free0", "__g")
    )
    return (
        groups.join(entries, [*keys, "__g"])
        .selectExpr(f"inline({fold('free0', 's -> s.out', emit=True)})")
        .select(*cols)
    )
