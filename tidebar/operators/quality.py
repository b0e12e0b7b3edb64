"""Data-quality report of stored bars, one row per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalar import num
from tidebar.operators.quantiles import exact_quantiles
from tidebar.operators.timeline import KEYS, Layout, chunked, core_rows, lag, rolling
from tidebar.session import cut_lineage
from tidebar.sources.bars import OHLCV, numbered

# fixed values: minimum bars and days per timeframe (others: 1000 bars, 14 days)
MIN_BARS = {"5m": 10_000, "1h": 1_500}
MIN_DAYS = {"5m": 35}


def _limit(table: dict, default: int) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CASE timeframe {arms} ELSE {default} END"


def quality_report(bars: DataFrame, present: list[str] | None = None,
                   min_bars: dict | None = None) -> DataFrame:
    """Ten checks per (symbol, timeframe) as ARRAY<STRUCT<name, passed, detail>>.

    One pass with the previous close and a 20-bar return deviation, written once for the
    aggregates and the exact quantile cuts, and a daily roll-up for the up/down day balance.
    """
    present = present or [c for c in OHLCV if c in bars.columns]
    missing = [c for c in OHLCV if c not in present]
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in present)
    df = chunked(numbered(bars), Layout(back=64))
    df = df.selectExpr("*", f"close / {lag('close')} - 1 AS _ret")
    df = core_rows(df.selectExpr("*", f"{rolling('stddev_samp(_ret)', 20, 1)} AS _vol"))
    df = cut_lineage(df, "quality")
    distinct = bars.groupBy(*KEYS, "ts").count().groupBy(*KEYS).agg(
        F.sum(F.col("count") - 1).alias("duplicates"))
    base = df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("bars"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.sum(F.expr(nulls)).alias("null_values"),
        F.count_if(F.col("close") <= 0).alias("bad_prices"),
        F.count_if(F.abs("_ret") > 0.20).alias("spikes"),
        F.count("_vol").alias("n_vol"),
        F.avg(F.when(F.col("volume") == 0, 1.0).otherwise(0.0)).alias("zero_volume"),
    )
    cuts = exact_quantiles(df, KEYS, "_vol", {"_q3": 0.3, "_q7": 0.7})
    median = exact_quantiles(df, KEYS, "close", {"median_price": 0.5})
    shares = df.select(*KEYS, "_vol").join(cuts, list(KEYS)).groupBy(*KEYS).agg(
        F.count_if(F.col("_vol") > F.col("_q7")).alias("_high"),
        F.count_if(F.col("_vol") < F.col("_q3")).alias("_low"),
    )
    daily = bars.groupBy(*KEYS, F.to_date("ts").alias("day")).agg(
        F.max_by("close", "ts").alias("close"))
    # one row per day of a series, so this window is bounded by the calendar; days without bars
    # count as unchanged
    daily = daily.selectExpr(
        "*", f"lag(close) OVER (PARTITION BY {', '.join(KEYS)} ORDER BY day) AS _prev"
    )
    days = daily.groupBy(*KEYS).agg(
        F.count_if(F.col("close") > F.col("_prev")).alias("up_days"),
        F.count_if(F.col("close") < F.col("_prev")).alias("down_days"),
    )
    df = base.join(shares, list(KEYS), "left").join(days, list(KEYS))
    df = df.join(distinct, list(KEYS)).join(median, list(KEYS), "left")
    df = df.selectExpr(
        "*",
        "floor((unix_seconds(end_ts) - unix_seconds(start_ts)) / 86400) AS days",
        f"{_limit(min_bars or MIN_BARS, 1000)} AS need_bars",
        f"{_limit(MIN_DAYS, 14)} AS need_days",
        "coalesce(_high / nullif(n_vol, 0), double(0)) AS high_vol_share",
        "coalesce(_low / nullif(n_vol, 0), double(0)) AS low_vol_share",
        "coalesce(up_days / nullif(up_days + down_days, 0), double(0.5)) AS up_share",
    )
    checks = [
        ("min_bars", "bars >= need_bars", "concat(bars, ' of ', need_bars)"),
        ("min_days", "days >= need_days", "concat(days, ' of ', need_days)"),
        ("ohlcv_columns", "false" if missing else "true", f"'{', '.join(missing) or 'OK'}'"),
        ("no_nulls", "null_values = 0", "cast(null_values AS string)"),
        ("positive_prices", "bad_prices = 0", "cast(bad_prices AS string)"),
        ("no_duplicate_ts", "duplicates = 0", "cast(duplicates AS string)"),
        ("no_price_spikes", "true", "cast(spikes AS string)"),
        ("regime_coverage",
         # asked of long five-minute series alone
         f"timeframe <> '5m' OR bars <= 100 OR (high_vol_share > {num(0.1)} "
         f"AND low_vol_share > {num(0.1)})",
         "concat(up_days, ' up, ', down_days, ' down')"),
        ("volume_non_zero", "zero_volume < double(0.01)", "cast(zero_volume AS string)"),
        ("plausible_price",
         "timeframe <> '5m' OR NOT ((symbol LIKE '%BTC%' AND median_price < 1000) "
         "OR (symbol LIKE '%ETH%' AND median_price < 100))", "cast(median_price AS string)"),
    ]
    structs = ", ".join(
        f"named_struct('name', '{n}', 'passed', {cond}, 'detail', {detail})"
        for n, cond, detail in checks
    )
    df = df.selectExpr("*", f"array({structs}) AS checks")
    return df.selectExpr(
        *KEYS, "bars", "days", "start_ts", "end_ts", "null_values", "bad_prices", "duplicates",
        "spikes", "high_vol_share", "low_vol_share", "up_days", "down_days", "up_share",
        "zero_volume", "median_price", "checks", "forall(checks, c -> c.passed) AS ok",
        "filter(array("
        "CASE WHEN spikes > 0 THEN 'price spikes' END, "
        "CASE WHEN up_share > double(0.7) THEN 'mostly rising days' END, "
        "CASE WHEN up_share < double(0.35) THEN 'mostly falling days' END, "
        "CASE WHEN zero_volume > double(0.005) THEN 'zero-volume bars' END), "
        "w -> w IS NOT NULL) AS warnings",
    )
