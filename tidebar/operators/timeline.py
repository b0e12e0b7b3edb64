"""Ordered-series building blocks.

A series is the rows of one key (symbol, timeframe) in time order.  One key may hold a
large share of all rows, so nothing here puts a whole key into one task:

* ``positioned`` numbers the rows of each key in two levels (rank inside a time bucket plus
  the running count of earlier buckets);
* ``chunked`` cuts a numbered series into fixed-size chunks and copies the few rows a
  look-back or look-ahead needs into the neighbouring chunk, so that ROWS windows over
  (key, chunk) give the same answer as over the key;
* ``prefix_scan`` does unbounded running sums, maxima and last values in two levels;
* ``ewm`` evaluates exponential averages as rescaled running sums inside a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.scalar import col, num

KEYS = ("symbol", "timeframe")


@dataclass(frozen=True)
class Layout:
    """Chunk geometry in rows: chunk size, copied look-back and look-ahead, restart block.

    The default look-back lets an exponential average over 200 bars forget everything
    older (weight below 1e-18) and covers every bounded frame of the library.
    """

    rows: int = 32768
    back: int = 4352
    ahead: int = 0
    block: int = 2048


LAYOUT = Layout()


def epoch(ts: Column | str = "ts") -> Column:
    return F.unix_seconds(col(ts))


def time_bucket(seconds: int, ts: Column | str = "ts") -> Column:
    return F.floor(epoch(ts) / F.lit(int(seconds)))


def prefix_scan(
    df: DataFrame,
    scans: dict[str, tuple[str, Column]],
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
) -> DataFrame:
    """Running aggregates over the whole key, inclusive of the current row.

    ``scans`` maps an output name to (op, expression) with op one of ``sum``, ``max``,
    ``min``, ``last`` (last non-null).  Rows are shuffled by (key, bucket); only one summary
    row per bucket is combined along the key.
    """
    local = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)

    def over(op: str, c: Column, w: WindowSpec) -> Column:
        if op == "last":
            return F.last(c, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max, "min": F.min}[op](c).over(w)

    def whole(op: str, c: Column) -> Column:
        if op == "last":
            return F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))
        return {"sum": F.sum, "max": F.max, "min": F.min}[op](c)

    rows = df.select(
        "*", *[over(op, c, local).alias(f"__l_{n}") for n, (op, c) in scans.items()]
    )
    summary = df.groupBy(*keys, bucket).agg(
        *[whole(op, c).alias(f"__b_{n}") for n, (op, c) in scans.items()]
    )
    carried = summary.select(
        *keys,
        bucket,
        *[over(op, F.col(f"__b_{n}"), before).alias(f"__c_{n}") for n, (op, _) in scans.items()],
    )

    def combine(op: str, n: str) -> Column:
        here, earlier = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        if op == "sum":
            zero = F.when(here.isNotNull() | earlier.isNotNull(), F.lit(0))
            return F.coalesce(earlier, zero) + F.coalesce(here, zero)
        if op == "last":
            return F.coalesce(here, earlier)
        return (F.greatest if op == "max" else F.least)(here, earlier)

    return rows.join(carried, [*keys, bucket]).select(
        *df.columns, *[combine(op, n).alias(n) for n, (op, _) in scans.items()]
    )


def positioned(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    out: str = "pos",
) -> DataFrame:
    """Add the 0-based position of each row in its key's total order."""
    return (
        prefix_scan(
            df.withColumn("__bucket", bucket),
            {out: ("sum", F.lit(1).cast("long"))},
            keys,
            "__bucket",
            order,
        )
        .withColumn(out, F.col(out) - 1)
        .drop("__bucket")
    )


def chunked(df: DataFrame, layout: Layout = LAYOUT, pos: str = "pos") -> DataFrame:
    """Assign rows to chunks of ``layout.rows`` positions, with copies for the neighbours.

    Adds ``chunk``, ``block`` and ``core``; only rows with ``core`` are results, the others
    are copies that feed the windows of a neighbouring chunk.
    """
    rows, back, ahead = layout.rows, layout.back, layout.ahead
    if back > rows or ahead > rows:
        raise ValueError("look-back and look-ahead must fit into one chunk")
    home = F.floor(F.col(pos) / F.lit(rows))
    targets = [home]
    if back:
        targets.append(F.when(F.col(pos) >= (home + 1) * rows - back, home + 1))
    if ahead:
        targets.append(F.when((home > 0) & (F.col(pos) < home * rows + ahead), home - 1))
    targets = F.filter(F.array(*targets), lambda t: t.isNotNull())
    return (
        df.withColumn("__home", home)
        .withColumn("chunk", F.explode(targets))
        .withColumn("core", F.col("chunk") == F.col("__home"))
        .withColumn("block", F.floor(F.col(pos) / F.lit(layout.block)))
        .drop("__home")
    )


def core_rows(df: DataFrame, *extra: str) -> DataFrame:
    """Drop the copies and the helper columns."""
    return df.filter("core").drop("core", "chunk", "block", *extra)


def over(agg: str, frame: str = "", keys: Sequence[str] = KEYS) -> str:
    """SQL text of a window call inside a chunk.

    ``block`` leads the order so that one sort serves every window of a chunked plan.
    """
    return f"{agg} OVER (PARTITION BY {', '.join(keys)}, chunk ORDER BY block, pos {frame})"


def lag(x: str, n: int = 1, keys: Sequence[str] = KEYS) -> str:
    return over(f"lag({x}, {n})", keys=keys)


def rolling(agg: str, n: int, first: int = 0, keys: Sequence[str] = KEYS) -> str:
    """A trailing n-row aggregate, NULL unless all n rows have a value.

    ``agg`` is a call whose first argument is the input; ``first`` is the position of the first
    non-null input of the series.
    """
    frame = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    x = agg[agg.index("(") + 1 : -1].split(",")[0]
    seen = over(f"count({x})", frame, keys)
    return f"CASE WHEN pos >= {first + n - 1} AND {seen} = {n} THEN {over(agg, frame, keys)} END"


def pct_rank(x: str, n: int, first: int, keys: Sequence[str] = KEYS) -> str:
    """Share of the last n values up to the current one, ties at their average rank; NULL unless
    all n rows have a value."""
    seen = over(f"collect_list({x})", f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW", keys)
    return (
        f"CASE WHEN pos >= {first + n - 1} AND size({seen}) = {n} THEN aggregate({seen}, double(0), "
        f"(a, v) -> a + CASE WHEN v < {x} THEN double(1) WHEN v = {x} THEN double(0.5) "
        f"ELSE double(0) END, a -> (a + double(0.5)) / {n}) END"
    )


def ewm(
    df: DataFrame,
    specs: dict[str, tuple[str, float, int, int]],
    keys: Sequence[str] = KEYS,
    layout: Layout = LAYOUT,
    gaps: Sequence[str] = (),
) -> DataFrame:
    """Recursive averages y[t] = (1-a) y[t-1] + a x[t], y[first] = x[first], on chunked rows.

    ``specs``: output name -> (input, a, first position, values needed before non-null).
    With q = 1-a, y is q^j times the running sum of a*x*q^-j, which is an ordinary window
    sum.  For fast decay the sum restarts every block of rows (so q^-j stays in range) and
    the end value of the block before is carried in; older blocks weigh less than 1e-18.

    ``gaps`` names the outputs whose inputs may be null. Over null inputs their value is carried
    along, and the next input, g rows after the last one, is weighted against what is left of the
    average: y = (q^g y' + a x) / (q^g + a). The exponent j is then a running sum of what each row
    decays, and the values needed before non-null are counted. A block of rows that are nearly all
    null forgets what lies before the block in front of it.
    """
    part = ", ".join(keys)
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    by_block = f"OVER (PARTITION BY {part}, chunk, block ORDER BY pos {upto})"
    by_chunk = f"OVER (PARTITION BY {part}, chunk ORDER BY block, pos {upto})"
    # end value of the block before: the last block end seen so far
    before = (
        f"OVER (PARTITION BY {part}, chunk ORDER BY block, pos "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    ends = f"(pos + 1) % {layout.block} = 0"
    in_block = f"(pos - block * {layout.block})"
    in_chunk = f"(pos - greatest(chunk * {layout.rows} - {layout.back}, 0))"

    kept, gap_specs = df.columns, []
    sums, carries, finals = [], [], []
    for out, (x, alpha, first, warm) in specs.items():
        decay = -math.log(1.0 - alpha)
        wide = decay * (layout.rows + layout.back) < 600
        if wide and decay * layout.back < 41:
            # a chunk starts its sum anew; what that forgets must weigh under 1e-17
            raise ValueError(f"smoothing factor {alpha} needs a longer look-back than {layout.back}")
        if not wide and not (42 / decay <= layout.block <= 650 / decay):
            raise ValueError(f"smoothing factor {alpha} does not fit blocks of {layout.block}")
        if out in gaps:
            gap_specs.append((out, x, alpha, first, warm, wide))
            continue
        j = in_chunk if wide else in_block
        term = f"CASE WHEN pos = {first} THEN {x} WHEN pos > {first} THEN {x} * {num(alpha)} END"
        sums.append(
            f"sum({term} * exp({j} * {num(decay)})) {by_chunk if wide else by_block}"
            f" * exp(-{j} * {num(decay)}) AS __s_{out}"
        )
        value = f"__s_{out}"
        if not wide:
            carries.append(
                f"last(CASE WHEN {ends} THEN __s_{out} END, true) {before} AS __p_{out}"
            )
            tail = f"coalesce(__p_{out}, double(0)) * exp(-({j} + 1) * {num(decay)})"
            value = f"coalesce(__s_{out}, double(0)) + {tail}"
        finals.append(f"CASE WHEN pos >= {first + max(warm, 1) - 1} THEN {value} END AS {out}")
    since, decays, ages = [], [], []
    for out, x, alpha, first, warm, wide in gap_specs:
        decay, frame = -math.log(1.0 - alpha), by_chunk if wide else by_block
        has = f"({x} IS NOT NULL AND pos >= {first})"
        since += [f"pos - last(CASE WHEN {has} THEN pos END, true) {before} AS __g_{out}",
                  f"count(CASE WHEN {has} THEN 1 END) {by_chunk} AS __n_{out}"]
        left = f"exp(-__g_{out} * {num(decay)})"
        # what a row decays more or less than one step; rows without gaps add exact zeros
        decays += [f"CASE WHEN NOT {has} THEN {num(-decay)} WHEN __g_{out} > 1 THEN (__g_{out} - 1) * {num(decay)} "
                   f"+ ln({left} + {num(alpha)}) ELSE double(0) END AS __d_{out}",
                   f"CASE WHEN {has} THEN CASE WHEN __g_{out} IS NULL THEN {x} WHEN __g_{out} = 1 THEN {x} * {num(alpha)} "
                   f"ELSE {x} * {num(alpha)} / ({left} + {num(alpha)}) END END AS __x_{out}"]
        ages.append(f"{in_chunk if wide else in_block} * {num(decay)} + sum(__d_{out}) {frame} AS __a_{out}")
        sums.append(f"sum(__x_{out} * exp(__a_{out})) {frame} * exp(-__a_{out}) AS __s_{out}")
        value = f"__s_{out}"
        if not wide:
            carries.append(
                f"last(CASE WHEN {ends} THEN coalesce(__s_{out}, double(0)) END, true) {before} AS __p_{out}")
            value = f"coalesce(__s_{out}, double(0)) + coalesce(__p_{out}, double(0)) * exp(-__a_{out} - {num(decay)})"
        finals.append(f"CASE WHEN __n_{out} >= {max(warm, 1)} THEN {value} END AS {out}")
    if gap_specs:
        df = df.selectExpr("*", *since).selectExpr("*", *decays).selectExpr("*", *ages)
    return df.selectExpr("*", *sums).selectExpr("*", *carries).selectExpr(*kept, *finals)


def asof_backward(
    base: DataFrame,
    other: DataFrame,
    value_cols: Sequence[str],
    on: Sequence[str] = ("symbol",),
    ts: str = "ts",
    shift_seconds: int = 0,
    bucket_seconds: int = 30 * 86400,
) -> DataFrame:
    """Each base row takes the last ``other`` row of its key with other.ts + shift <= base.ts.

    One union and a two-level last-value scan instead of a range join.  Equal stamps match
    (``other`` sorts first).  ``shift_seconds`` = the bar length removes the look-ahead of
    bars stamped with their opening time.
    """
    held = [c for c in base.columns if c not in (*on, ts)]
    left = base.select(
        *on, F.col(ts), F.lit(1).alias("__side"), F.struct(*held).alias("__base"),
    )
    right = other.select(
        *on,
        (F.col(ts) + F.make_dt_interval(secs=F.lit(shift_seconds))).alias(ts),
        F.lit(0).alias("__side"),
        F.struct(*value_cols).alias("__other"),
    )
    both = left.unionByName(right, allowMissingColumns=True).withColumn(
        "__when", time_bucket(bucket_seconds, ts)
    )
    filled = prefix_scan(
        both, {"__match": ("last", F.col("__other"))}, on, "__when", [ts, "__side"]
    ).filter("__side = 1")
    return filled.select(
        *on, ts, *[F.col(f"__base.{c}").alias(c) for c in held],
        *[F.col(f"__match.{c}").alias(c) for c in value_cols],
    )
