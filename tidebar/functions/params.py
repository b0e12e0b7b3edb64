"""Fixed parameter tables. Every value here must equal the published strategy settings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: timeframe -> seconds -------------------------------------------------
TIMEFRAME_SECONDS = {
    "1m": 60,
    "3m": 180,
    "5m": 300,
    "15m": 900,
    "1h": 3600,
    "4h": 14400,
    "1d": 86400,
}

# --- fixed values: market regime -> adjustments -----------------------------------------
REGIMES = {
    "TRENDING": dict(conf=0.03, sl=1.25, tp=1.20, size=0.80, early_r=0.80, timeout=10),
    "RANGE": dict(conf=0.02, sl=1.00, tp=1.00, size=1.00, early_r=1.10, timeout=8),
    "HIGH_VOLATILITY": dict(conf=0.05, sl=1.40, tp=1.10, size=0.50, early_r=0.65, timeout=6),
}
ADX_TREND = 25.0
ATR_SPIKE = 1.5

# --- fixed values: symbol -> label width, confidence threshold --------------------------
LABEL_ATR_MULT = {"BTCUSDT": 3.0, "ETHUSDT": 3.0, "BNBUSDT": 2.5, "SOLUSDT": 2.8}
CONF_THRESHOLD = {"BTCUSDT": 0.42, "ETHUSDT": 0.38, "BNBUSDT": 0.42, "SOLUSDT": 0.38}
CONF_DEFAULT = 0.42

# --- fixed values: symbol -> exchange lot step ------------------------------------------
LOT_STEP = {
    "BTCUSDT": 0.001,
    "ETHUSDT": 0.001,
    "BNBUSDT": 0.001,
    "SOLUSDT": 0.1,
    "XRPUSDT": 1.0,
    "ADAUSDT": 1.0,
    "DOGEUSDT": 1.0,
    "AVAXUSDT": 0.1,
    "LINKUSDT": 0.01,
    "DOTUSDT": 0.1,
    "LTCUSDT": 0.001,
    "TRXUSDT": 1.0,
}

# --- fixed values: exit reason -> bars to wait ------------------------------------------
COOLDOWN_BARS = {
    "SL": 5,
    "TIMEOUT": 2,
    "STALL": 1,
    "EARLY_PROFIT": 2,
    "TP": 2,
    "REVERSAL": 3,
    "HARD_TIMEOUT": 3,
    "EXTERNALLY_CLOSED": 3,
}
COOLDOWN_DEFAULT = 3

# --- fixed values: headline keywords ----------------------------------------------------
AVOID_WORDS = [
    "hack", "exploit", "stolen", "heist", "ban", "illegal", "prohibit", "shutdown",
    "crash", "collapse", "insolvent", "bankrupt", "sec charges", "doj", "arrest",
    "flash crash", "circuit breaker",
]
CAUTION_WORDS = [
    "sec", "cftc", "regulation", "regulatory", "investigation", "lawsuit", "fine",
    "inflation", "fed rate", "federal reserve", "liquidation", "delisting",
]

# --- fixed values: log routing ----------------------------------------------------------
LOG_LEVELS = ["info", "warning", "error", "critical"]
LOG_CHANNELS = {
    "core.trader": "bot",
    "core.exchange": "trade",
    "core.market": "signal",
    "core.models": "signal",
    "core.risk": "bot",
    "core.strategy": "bot",
    "__main__": "bot",
}
LOG_SKIP = ["[Reporter]", "ccxt", "aiohttp", "asyncio"]


def lookup(table: dict, key: Column, default=None) -> Column:
    """Dictionary lookup as a literal map (constant size, no join)."""
    mapping = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    found = F.element_at(mapping, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def regime_value(field: str, regime: Column) -> Column:
    return lookup({name: row[field] for name, row in REGIMES.items()}, regime)
