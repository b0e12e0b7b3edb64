"""Seeded fixtures."""

import numpy as np
import pandas as pd


def walk(n=400, symbols=("A", "B"), seed=7, timeframe="1h", start="2024-01-01"):
    rng = np.random.default_rng(seed)
    parts = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        open_ = np.r_[close[0], close[:-1]]
        high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.004, n))
        low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.004, n))
        parts.append(pd.DataFrame({
            "symbol": s, "timeframe": timeframe,
            "ts": pd.date_range(start, periods=n, freq="h"),
            "open": open_, "high": high, "low": low, "close": close,
            "volume": rng.integers(1, 100, n).astype(float),
        }))
    return pd.concat(parts, ignore_index=True)


def bars(spark, pdf):
    return spark.createDataFrame(pdf)


def series(df, symbol="A"):
    pdf = df.filter(f"symbol = '{symbol}'").toPandas()
    return pdf.sort_values("ts").reset_index(drop=True)
