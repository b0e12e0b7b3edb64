"""Registered streaming queries: each drains the stored table as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators import news as nw
from tidebar.plans.catalog_series import OHLCV, hybrid_signals, out, rounded, stamp
from tidebar.plans.catalog_trades import HEADLINE_WORDS
from tidebar.session import cut_lineage
from tidebar.sources import bars as src
from tidebar.streaming import bars as sb
from tidebar.streaming import eventtime as et
from tidebar.streaming import state as st

Query = Callable[[SparkSession, str], DataFrame]


def closed_bars(s: SparkSession, d: str) -> DataFrame:
    return sb.stream_bars(sb.table_stream(s, d, "events"), "event_type", "value", "ts",
                          "event_id", "1h")


def stream_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["stream_closed_bars"] = lambda s, d: out(sb.drain(closed_bars(s, d), "closed"), OHLCV)

    def deduped(s: SparkSession, d: str) -> DataFrame:
        one = sb.table_stream(s, d, "events").selectExpr(
            "event_type AS symbol", "'1m' AS timeframe", "cast(ts AS timestamp) AS ts", "value")
        # every candle arrives twice
        twice = one.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
        kept = sb.drain(sb.dedupe_candles(twice), "dedupe")
        return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.sum("value"), 2).alias("total"))

    q["stream_deduped_candles"] = deduped
    q["stream_averages"] = lambda s, d: out(
        sb.drain(st.stream_averages(closed_bars(s, d)), "averages"), "",
        "ema_9 ema_21 ema_50", 5)

    def trades(s: SparkSession, d: str) -> DataFrame:
        orders = sb.table_stream(s, d, "orders").selectExpr(
            "o_orderpriority AS symbol",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side",
            "cast(o_orderdate AS timestamp) AS ts", "o_orderkey AS trade_id",
            "o_totalprice > 180000 AS won", "round(o_totalprice - 180000, 2) AS pnl_net")
        return sb.drain(st.stream_trades(orders), "trades").selectExpr(
            "symbol", "side", "trade_id", "cast(n_recent AS bigint) AS n_recent", "blocked",
            *rounded("win_rate"))

    q["stream_trade_windows"] = trades

    def sentiment(s: SparkSession, d: str) -> DataFrame:
        docs = sb.table_stream(s, d, "documents").selectExpr(
            "timestamp_seconds(1704067200 + doc_id * 60) AS ts", "source AS title", "text")
        return sb.drain(sb.sentiment_windows(docs, "ts", "title", "text"), "sentiment").groupBy(
            "news_state").agg(F.count(F.lit(1)).alias("n_windows"),
                              F.sum("headlines").alias("n_headlines"))

    q["stream_sentiment_windows"] = sentiment

    def clock(s: SparkSession, d: str) -> DataFrame:
        orders = sb.table_stream(s, d, "orders").selectExpr(
            "o_orderpriority AS symbol",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side",
            "cast(o_orderdate AS timestamp) AS ts", "o_orderkey AS trade_id",
            "round(o_totalprice - 180000, 2) AS pnl_net")
        return sb.drain(et.trade_clock(orders), "clock").selectExpr(
            "symbol", "kind", "coalesce(side, '') AS side", stamp(), "coalesce(trade_id, -1) AS trade_id",
            "coalesce(blocked, false) AS blocked", *rounded("to_recover", 2))

    q["stream_trade_clock"] = clock

    def bar_sentiment(s: SparkSession, d: str) -> DataFrame:
        bars = sb.stored_stream(src.event_bars(s, d).select("symbol", "ts", "close"), "bars")
        # each text is a headline about one of the five symbols
        docs = sb.table_stream(s, d, "documents").filter("doc_id IS NOT NULL").selectExpr(
            "element_at(array('click', 'error', 'purchase', 'signup', 'view'), cast(doc_id % 5 AS int) + 1) AS symbol",
            "timestamp_seconds(1704067200 + doc_id * 1500) AS ts", "doc_id AS seq", "source", "text")
        news = nw.classify_headlines(docs, nw.headline_text("source", "text"), *HEADLINE_WORDS)
        read = et.asof_streams(bars, news.withColumnRenamed("news_state", "label"))
        return sb.drain(read, "asof").selectExpr(
            "symbol", stamp(), "label AS news_state", "date_format(since, 'yyyy-MM-dd HH:mm:ss') AS read_at",
            *rounded("close"))

    q["stream_bar_sentiment"] = bar_sentiment

    def resumed(s: SparkSession, d: str) -> DataFrame:
        bars = cut_lineage(hybrid_signals(s, d, with_regime=True), "hybrid")
        old, new = "ts < timestamp '2024-01-15'", "ts >= timestamp '2024-01-15'"
        blend = bars.filter(new).select("symbol", "ts", "raw_long", "raw_short", "raw_signal", "raw_regime")
        signals = et.signal_clock(sb.stored_stream(blend, "blend"), et.signal_state(bars.filter(old)))
        return sb.drain(signals, "resumed").selectExpr(
            "symbol", stamp(), "regime", *rounded("ema_long ema_short", 4))

    q["stream_signals_resumed"] = resumed
    return q


