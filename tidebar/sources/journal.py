"""Trade journal, trade records, log routing and retrain state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.params import LOG_CHANNELS, LOG_LEVELS, LOG_SKIP
from tidebar.functions.scalar import clip

JOURNAL_COLUMNS = [
    "timestamp", "symbol", "side", "won", "confidence", "pnl_usdt", "pnl_r", "bars_held",
    "exit_reason", "regime",
]


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """CSV journal: rows without symbol or side are skipped, blanks count as 0."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in JOURNAL_COLUMNS)).csv(
        path, header=True)
    return parse_journal(raw)


def parse_journal(raw: DataFrame) -> DataFrame:
    def number(c: str) -> str:
        return f"coalesce(try_cast(nullif(trim({c}), '') AS double), double(0)) AS {c}"

    return raw.selectExpr(
        "try_to_timestamp(timestamp) AS ts", "symbol", "lower(side) AS side",
        "coalesce(won IN ('1', 'true', 'True'), false) AS won",
        number("confidence"), number("pnl_usdt"), number("pnl_r"),
        "cast(coalesce(try_cast(nullif(trim(bars_held), '') AS double), double(0)) AS int) "
        "AS bars_held",
        "coalesce(exit_reason, 'UNKNOWN') AS exit_reason", "coalesce(regime, 'UNKNOWN') AS regime",
    ).filter("symbol <> '' AND side IN ('long', 'short')")


def journal_rows(trades: DataFrame) -> DataFrame:
    """Text form of journal rows: numbers with four decimals, ``won`` as 0/1."""
    return trades.selectExpr(
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS timestamp", "symbol", "lower(side) AS side",
        "cast(won AS int) AS won",
        *[f"format_string('%.4f', {c}) AS {c}" for c in ("confidence", "pnl_usdt", "pnl_r")],
        "bars_held", "exit_reason", "regime",
    )


def append_journal(trades: DataFrame, path: str) -> None:
    journal_rows(trades).write.mode("append").option("header", True).csv(path)


def trade_open_records(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "symbol", "lower(side) AS side", "entry_price", "quantity", "leverage",
        "take_profit AS tp_price", "stop_loss AS sl_price", "round(confidence, 2) AS confidence",
        "regime", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS opened_at",
    )


def trade_close_records(df: DataFrame) -> DataFrame:
    """R clamped to +/-9999, P&L and fee at four decimals, net = gross - fee."""
    return df.select(
        "symbol", F.lower("side").alias("side"), "exit_price",
        F.round("pnl_usdt", 4).alias("pnl_usdt"),
        F.round(clip("pnl_r", -9999.0, 9999.0), 4).alias("pnl_r"),
        "exit_reason", "bars_held",
        F.round("fee_usdt", 4).alias("fee_usdt"),
        F.round(F.col("pnl_usdt") - F.col("fee_usdt"), 4).alias("net_pnl"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("closed_at"),
    )


def signal_records(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "symbol", "lower(signal) AS signal", "round(confidence, 2) AS confidence",
        "CASE WHEN agreement = 'AGREE' THEN 'AGREE' ELSE 'SPLIT' END AS signal_type", "regime",
        "round(adx, 4) AS adx", "round(atr_ratio, 4) AS atr_ratio",
        "round(ema_long, 2) AS ema_long", "round(ema_short, 2) AS ema_short",
        "close AS price_at_signal", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS signaled_at",
    )


def route_logs(logs: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Keep info and above, drop noise, derive the channel from the logger name prefix.

    The formatted message is ``logger — message``, cut to ``max_chars``.
    """
    text = F.concat_ws(" — ", "logger", "message")
    noise = F.lit(False)
    for p in LOG_SKIP:
        noise = noise | text.contains(p)
    channel: Column | None = None
    for prefix, name in LOG_CHANNELS.items():
        cond = F.col("logger").startswith(prefix)
        channel = F.when(cond, name) if channel is None else channel.when(cond, name)
    return logs.filter(F.lower("level").isin(LOG_LEVELS) & ~noise).select(
        F.lower("level").alias("level"),
        channel.otherwise("bot").alias("channel"),
        F.substring(text, 1, max_chars).alias("message"),
        "context",
        "logged_at",
    )


def regime_performance(journal: DataFrame) -> DataFrame:
    return journal.groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if("won").alias("wins"),
        F.sum("pnl_usdt").alias("net_pnl"),
        (F.count_if("won") / F.count(F.lit(1))).alias("win_rate"),
    )


def struggling_symbols(stats: DataFrame, min_trades: int = 8, poor: float = 0.30) -> DataFrame:
    return stats.filter(
        (F.col("trades") >= min_trades) & (F.col("win_rate") < poor)
    ).select("symbol").distinct()


def recent_trades(journal: DataFrame, asof: Column, days: int = 7) -> DataFrame:
    """Trades of the last days over all symbols (one count, as the scheduler uses it)."""
    cutoff = F.unix_seconds(asof) - days * 86400
    return journal.agg(F.count_if(F.unix_seconds("ts") >= cutoff).alias("recent_trades"))


def retrain_due(symbols: DataFrame, state: DataFrame, journal: DataFrame, asof: Column,
                force: bool = False, every_days: int = 7, min_trades: int = 30) -> DataFrame:
    """Which symbols to retrain and why: seven days since the last run and 30 trades, or forced.

    ``state``: symbol, last_retrain.  Never-trained symbols count as overdue.
    """
    counts = journal.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"))
    df = symbols.select("symbol").distinct().join(state.select("symbol", "last_retrain"),
                                                   "symbol", "left").join(counts, "symbol", "left")
    df = df.select(
        "symbol",
        F.coalesce(
            F.floor((F.unix_seconds(asof) - F.unix_seconds("last_retrain")) / 86400),
            F.lit(9999),
        ).alias("days_since"),
        F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
    )
    due = F.lit(force) | (
        (F.col("days_since") >= every_days) & (F.col("n_trades") >= min_trades))
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("days_since") < every_days, "not due")
        .when(F.col("n_trades") < min_trades, "too few trades")
        .otherwise("scheduled")
    )
    return df.withColumn("due", due).withColumn("reason", reason)


def update_retrain_state(state: DataFrame, trained: DataFrame, asof: Column) -> DataFrame:
    """New (symbol, last_retrain, retrain_count) table after a run."""
    done = trained.select("symbol").distinct().withColumn("__done", F.lit(True))
    return state.join(done, "symbol", "full_outer").select(
        "symbol",
        F.when(F.col("__done"), asof).otherwise(F.col("last_retrain")).alias("last_retrain"),
        (F.coalesce("retrain_count", F.lit(0)) + F.when(F.col("__done"), 1).otherwise(0)).alias(
            "retrain_count"),
    )
