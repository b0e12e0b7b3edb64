"""Registered queries over bars: ingestion, indicators, features, labels, regimes, signals."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.params import CONF_DEFAULT, CONF_THRESHOLD
from tidebar.functions.scalar import sql_lookup
from tidebar.operators import evaluation as ev
from tidebar.operators import features as ft
from tidebar.operators import labels as lb
from tidebar.operators import regime as rg
from tidebar.operators import signals as sg
from tidebar.operators.indicators import chunked_indicators, with_indicators
from tidebar.operators.timeline import core_rows, rolling
from tidebar.session import checkpoint_folder
from tidebar.sources import bars as src
from tidebar.sources import journal as jr

Query = Callable[[SparkSession, str], DataFrame]

# the hybrid queries need model probabilities; this stand-in is a plain function of the bar
STAND_IN_MODEL = [
    "CASE WHEN pos >= 19 THEN 0.15D + 0.6D * (1 - price_position) END AS ml_long",
    "CASE WHEN pos >= 19 THEN 0.15D + 0.5D * price_position END AS ml_short",
    "CASE WHEN pos >= 19 THEN CASE WHEN price_position < 0.4D THEN 'LONG' "
    "WHEN price_position > 0.6D THEN 'SHORT' ELSE 'HOLD' END END AS ml_signal",
]


def asof() -> Column:
    """Fixed reference time of the staleness reports."""
    return F.expr("timestamp '2024-02-01 00:00:00'")


def stamp(c: str = "ts") -> str:
    return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss') AS {c}"


def rounded(names: str | list[str], digits: int = 5) -> list[str]:
    names = names.split() if isinstance(names, str) else names
    return [f"round({n}, {digits}) + 0D AS {n}" for n in names]


def out(df: DataFrame, plain: str = "", values: str | list[str] = "", digits: int = 5
        ) -> DataFrame:
    return df.selectExpr("symbol", stamp(), *plain.split(), *rounded(values, digits))


OHLCV = "open high low close volume"


def series_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}

    def ind(values: str, plain: str = "pos", digits: int = 5, bars=src.event_bars) -> Query:
        return lambda s, d: out(with_indicators(bars(s, d)), plain, values, digits)

    q["bars_1h"] = lambda s, d: out(src.event_bars(s, d), OHLCV)
    q["bars_4h_by_user"] = lambda s, d: out(src.event_bars(s, d, "4h", "user_id"), OHLCV)
    q["bars_daily_orders"] = lambda s, d: out(src.order_bars(s, d), OHLCV)
    q["bars_daily_lineitem"] = lambda s, d: out(
        src.lineitem_bars(s, d), "volume", "open high low close", 9)
    q["bars_rolled_up_4h"] = lambda s, d: out(src.roll_up(src.event_bars(s, d), "4h"), OHLCV)

    def json_bars(shape: str) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            bars = src.event_bars(s, d).withColumn("ms", F.unix_millis("ts"))
            item = (
                "array(cast(ms AS double), open, high, low, close, volume)" if shape == "list"
                else "named_struct('timestamp', ms, 'open', open, 'high', high, 'low', low, "
                     "'close', close, 'volume', volume)"
            )
            # one payload per symbol and day: at most 24 hourly candles
            pages = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(
                F.to_json(F.collect_list(F.expr(item))).alias("payload"))
            return out(src.bars_from_json(pages, "payload", "symbol", "1h"), OHLCV)
        return run

    q["bars_from_json_lists"] = json_bars("list")
    q["bars_from_json_objects"] = json_bars("object")

    def normalised(s: SparkSession, d: str) -> DataFrame:
        raw = src.table(s, d, "events").selectExpr(
            "event_type AS Symbol", "ts AS ` Open_Time `",
            "CASE WHEN value = 0 THEN 'n/a' WHEN props LIKE '%7%' THEN 'bad' "
            "ELSE cast(value AS string) END AS `CLOSE`",
            "get_json_object(props, '$.k') AS Volume",
        )
        return out(src.normalise_bars(raw, timeframe="1h"), "volume", "close")

    q["bars_normalised"] = normalised

    def upserted(s: SparkSession, d: str) -> DataFrame:
        old = src.event_bars(s, d)
        fresh = old.filter("ts >= timestamp '2024-01-20'").withColumns(
            {"close": F.col("close") + 1, "volume": F.lit(0.0)})
        return out(src.upsert(old, fresh), "volume", "close")

    q["bars_upsert_keep_last"] = upserted

    def first_kept(s: SparkSession, d: str) -> DataFrame:
        e = src.table(s, d, "events").selectExpr(
            "event_type AS symbol", "date_trunc('HOUR', cast(ts AS timestamp)) AS ts",
            "value AS close", "event_id")
        return out(src.keep_one(e, ["symbol", "ts"], "event_id", last=False), "close event_id")

    q["bars_keep_first"] = first_kept

    def work(s: SparkSession, d: str) -> DataFrame:
        df = src.work_list(src.event_bars(s, d, "1h", "user_id"), asof())
        return df.selectExpr("symbol", "bars", stamp("last_ts"), stamp("resume_ts"),
                             "missing_bars", "up_to_date", "fresh")

    q["bars_work_list"] = work
    q["bars_inventory"] = lambda s, d: src.inventory(
        src.event_bars(s, d, "1h", "user_id"), asof()
    ).selectExpr("symbol", "bars", stamp("start_ts"), stamp("end_ts"), "days", "age_days", "stale")

    q["indicators_trend"] = ind(
        "ema_9 ema_21 ema_50 ema_200 sma_20 sma_50 sma_200 macd macd_signal macd_hist")
    q["indicators_momentum"] = ind("rsi stoch_k stoch_d roc_5 roc_10 roc_20")
    q["indicators_volatility"] = ind(
        "atr bb_mid bb_upper bb_lower bb_width bb_pct vol_10 vol_20 vol_ratio vol_pct")
    q["indicators_direction"] = ind("adx adx_dmp adx_dmn")
    q["indicators_volume"] = ind("volume_sma volume_ratio obv obv_ema vwap_ratio")
    q["indicators_candles"] = ind(
        "candle_body candle_body_ratio candle_upper_wick candle_lower_wick",
        "pos is_bullish is_doji")
    q["indicators_structure"] = ind(
        "pct_from_high pct_from_low price_position hour_sin hour_cos dow_sin dow_cos",
        "pos higher_high lower_low")
    q["indicators_daily_orders"] = ind(
        "sma_50 rsi atr bb_pct adx obv", digits=4, bars=src.order_bars)

    real = [c for c in ft.ENGINEERED if c not in ft.FLAGS]
    q["features_engineered"] = lambda s, d: out(
        ft.with_features(src.event_bars(s, d)), " ".join(ft.FLAGS), real, 4)
    q["features_complete_rows"] = lambda s, d: ft.complete_rows(
        ft.with_features(src.event_bars(s, d)), ft.BASE_FEATURES
    ).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"))
    q["features_regime_flags"] = lambda s, d: out(
        core_rows(ft.regime_flag_columns(chunked_indicators(src.event_bars(s, d)))),
        " ".join(ft.REGIME_FLAGS))

    def context_1h(align: str) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            base = src.event_bars(s, d, "15m").select("symbol", "ts", "close")
            ctx = ft.htf_1h_columns(with_indicators(src.event_bars(s, d)))
            df = ft.join_context(base, ctx, ft.HTF_1H, "1h", align)
            return df.selectExpr(
                "symbol", stamp(), *rounded("close", 2),
                *rounded("htf1h_rsi htf1h_macd_hist htf1h_adx htf1h_bb_pct htf1h_rsi_zone"),
                *[f"cast({c} AS double) AS {c}" for c in (
                    "htf1h_trend", "htf1h_macd_bull", "htf1h_trending", "htf1h_above_50ema")])
        return run

    q["features_context_1h"] = context_1h("open")
    q["features_context_1h_closed"] = context_1h("close")

    def context_4h(s: SparkSession, d: str) -> DataFrame:
        base = src.event_bars(s, d).select("symbol", "ts", "close")
        df = ft.join_context(base, ft.htf_4h_columns(src.event_bars(s, d, "4h")), ft.HTF_4H, "4h")
        return out(df, "htf4h_trend htf4h_above_50ema htf4h_trending htf4h_vol_regime "
                       "htf4h_expanding htf4h_macd_bull", "htf4h_rsi htf4h_adx")

    q["features_context_4h"] = context_4h

    def merged(s: SparkSession, d: str) -> DataFrame:
        df = ft.merge_timeframes(
            src.event_bars(s, d, "15m").select("symbol", "ts", "close"),
            {"1h": src.event_bars(s, d), "4h": src.event_bars(s, d, "4h")})
        names = [f"{c}_{t}" for t in ("1h", "4h") for c in
                 ("rsi", "macd", "adx", "ema_50", "bb_upper", "bb_lower", "atr")]
        return out(df, "", names)

    q["features_merged_timeframes"] = merged

    def label(**kw) -> Query:
        return lambda s, d: out(lb.with_labels(src.event_bars(s, d), **kw), "label")

    q["labels_triple_barrier"] = label(method="triple_barrier")
    q["labels_barrier_without_atr"] = lambda s, d: out(
        lb.std_fallback_labels(src.event_bars(s, d)), "label")
    q["labels_vol_adaptive"] = label(method="vol_adaptive")
    q["labels_quantile"] = label(method="quantile")
    q["labels_fixed_threshold"] = label(method="fixed", future_bars=12)
    q["label_distribution"] = label_distribution
    q["label_class_weights"] = lambda s, d: lb.class_weights(
        lb.with_labels(src.event_bars(s, d))
    ).selectExpr("symbol", "label", "n_class", *rounded("weight"))

    q["regime_confirmed"] = lambda s, d: out(
        rg.with_regime(src.event_bars(s, d)), "raw_regime regime",
        "regime_atr_ratio confirmation_pct")
    q["regime_parameters"] = lambda s, d: out(
        rg.regime_params(rg.with_regime(src.event_bars(s, d))),
        "regime size_scale early_profit_r timeout_bars require_agree",
        "conf_threshold sl_mult tp_mult")

    q["signals_technical"] = lambda s, d: out(
        core_rows(sg.technical_votes(chunked_indicators(src.event_bars(s, d)))),
        "tech_signal", "tech_confidence tech_long tech_short", 4)

    q["signals_hybrid"] = lambda s, d: out(
        hybrid_signals(s, d), "agreement raw_signal signal", "ema_long ema_short confidence", 4)
    q["signals_market_gate"] = lambda s, d: out(
        core_rows(sg.market_gate(chunked_indicators(src.event_bars(s, d)))),
        "market_skip", "gate_atr_ratio")

    def entry_gate(s: SparkSession, d: str) -> DataFrame:
        df = sg.signal_gate(hybrid_signals(s, d, with_regime=True), "0.45D")
        return df.groupBy("symbol", "regime", F.coalesce("signal_skip", F.lit("enter"))
                          .alias("outcome")).agg(F.count(F.lit(1)).alias("n"))

    q["signals_entry_gate"] = entry_gate

    def symbol_gate(s: SparkSession, d: str) -> DataFrame:
        """Thresholds of the symbols themselves; the events' symbols stand for four known ones and another."""
        known = "map('click', 'BTCUSDT', 'error', 'ETHUSDT', 'purchase', 'BNBUSDT', 'signup', 'SOLUSDT')"
        df = hybrid_signals(s, d, with_regime=True).withColumn("coin", F.expr(f"coalesce({known}[symbol], symbol)"))
        df = sg.signal_gate(df, sql_lookup(CONF_THRESHOLD, "coin", CONF_DEFAULT))
        return df.groupBy("coin", F.coalesce("signal_skip", F.lit("enter")).alias("outcome")).agg(
            F.count(F.lit(1)).alias("n"))

    q["signals_symbol_gate"] = symbol_gate
    q["records_signals"] = lambda s, d: jr.signal_records(
        hybrid_signals(s, d, with_regime=True).withColumnRenamed("regime_atr_ratio", "atr_ratio")).selectExpr(
        "symbol", "signal", "signal_type", "regime", "signaled_at", *rounded("confidence ema_long ema_short", 2),
        *rounded("adx atr_ratio", 4), *rounded("price_at_signal"))
    q["bars_first_rows"] = lambda s, d: ev.first_rows(src.numbered(src.event_bars(s, d)), 200).selectExpr(
        "symbol", stamp(), *rounded("close"))

    def landed(s: SparkSession, d: str) -> DataFrame:
        """Series that are expected but not among the files of a landing folder, and what the others hold."""
        folder = f"{checkpoint_folder(s).rstrip('/')}/landing-{uuid.uuid4().hex}"
        bars = src.event_bars(s, d).unionByName(src.event_bars(s, d, "4h"))
        src.write_bars(bars.filter("symbol <> 'signup' AND NOT (symbol = 'view' AND timeframe = '4h')"), folder)
        wanted = src.table(s, d, "events").select(F.col("event_type").alias("symbol")).distinct().crossJoin(
            F.broadcast(s.createDataFrame([("1h",), ("4h",)], "timeframe string")))
        files = src.landed_files(s, folder)
        return src.missing_files(wanted, files).selectExpr("symbol", "timeframe", "missing", "files > 0 AS landed", "bytes > 0 AS filled")

    q["bars_landed_files"] = landed

    def ranges(s: SparkSession, d: str) -> DataFrame:
        df = chunked_indicators(src.event_bars(s, d))
        df = df.selectExpr("*", f"atr / {rolling('avg(atr)', 20, 13)} AS atr_ratio_20")
        return out(core_rows(sg.range_setup(df)), "range_direction range_sl_mult",
                   "range_quality", 4)

    q["signals_range_setup"] = ranges
    return q


def label_distribution(s: SparkSession, d: str) -> DataFrame:
    """Events -> hourly bars -> indicators -> triple-barrier labels -> class shares per symbol."""
    df = lb.with_labels(src.event_bars(s, d), "triple_barrier", 12, None)
    return lb.label_distribution(df).selectExpr(
        "symbol", "n_hold", "n_long", "n_short", "n_total",
        *rounded("hold_pct long_pct short_pct"), "hold_too_low")


def hybrid_signals(s: SparkSession, d: str, with_regime: bool = False) -> DataFrame:
    """Smoothed hybrid signal of every bar of ``events``."""
    df = sg.technical_votes(chunked_indicators(src.event_bars(s, d)))
    df = rg.confirmed_regime(rg.raw_regime_columns(df)) if with_regime else core_rows(df)
    keep = ["symbol", "timeframe", "ts", "pos", "open", "high", "low", "close", "volume", "atr",
            "adx", "tech_signal", "tech_long", "tech_short",
            *(["raw_regime", "regime", "regime_atr_ratio"] if with_regime else [])]
    return sg.smooth(sg.hybrid(df.selectExpr(*keep, *STAND_IN_MODEL)))
