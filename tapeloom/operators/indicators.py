"""Indicators on closed candles of one timeframe. Simple returns; a value is null until its window is full."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETURNS, AVERAGES, PERIOD = (1, 3, 5, 10, 20), (10, 20, 50), 20


def _bars():
    return Window.partitionBy("symbol").orderBy("start_time")


def _full(value, n: int, column: str):
    """value, if the last n rows all have the column."""
    return F.when(F.count(column).over(_bars().rowsBetween(-(n - 1), 0)) == n, value)


def _last(n: int):
    return _bars().rowsBetween(-(n - 1), 0)


def windowed(candles: DataFrame) -> DataFrame:
    """candles with returns, moving averages with distance and slope, deviation, Bollinger width and %B, volume ratio and
    z-score; one sort by symbol serves them all."""
    out = candles
    for n in RETURNS:
        out = out.withColumn(f"ret_{n}", F.col("close") / F.lag("close", n).over(_bars()) - 1)
    for n in AVERAGES:
        out = out.withColumn(f"sma_{n}", _full(F.avg("close").over(_last(n)), n, "close"))
    out = out.withColumns({f"dist_{n}": F.col("close") / F.col(f"sma_{n}") - 1 for n in AVERAGES})
    out = out.withColumns({f"slope_{n}": F.col(f"sma_{n}") / F.lag(f"sma_{n}").over(_bars()) - 1 for n in AVERAGES})
    out = out.withColumn("std_20", _full(F.stddev_samp("ret_1").over(_last(PERIOD)), PERIOD, "ret_1"))
    out = out.withColumn("_dev", _full(F.stddev_pop("close").over(_last(PERIOD)), PERIOD, "close"))
    low, high = F.col("sma_20") - 2 * F.col("_dev"), F.col("sma_20") + 2 * F.col("_dev")
    out = out.withColumn("bb_width", (high - low) / F.col("sma_20")).withColumn("bb_pct", F.when(high > low, (F.col("close") - low) / (high - low)))
    mean, dev = F.avg("volume").over(_last(PERIOD)), F.stddev_pop("volume").over(_last(PERIOD))
    out = out.withColumn("vol_ratio", _full(F.when(mean != 0, F.col("volume") / mean), PERIOD, "volume"))
    return out.withColumn("vol_z", _full(F.when(dev > 0, (F.col("volume") - mean) / dev), PERIOD, "volume")).drop("_dev")


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's average: the mean of the first n values, from there on (n - 1) parts old and one part new."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


def recursive_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    """EMA 12 and 26 (from the first close on), MACD with signal 9, RSI 14 and ATR 14 (Wilder) of one symbol's candles."""
    pdf = pdf.sort_values("start_time")
    close = pdf["close"].to_numpy(float)
    ema = lambda x, n: pd.Series(x).ewm(span=n, adjust=False).mean().to_numpy()
    e12, e26 = ema(close, 12), ema(close, 26)
    macd = e12 - e26
    signal = ema(macd, 9)
    step = np.diff(close)
    up, down = wilder(np.maximum(step, 0), 14), wilder(np.maximum(-step, 0), 14)
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(down == 0, np.where(up == 0, 50.0, 100.0), 100 - 100 / (1 + up / down))
    rsi = np.concatenate([[np.nan], np.where(np.isnan(up), np.nan, rsi)]) if len(close) else np.zeros(0)
    high, low = pdf["high"].to_numpy(float), pdf["low"].to_numpy(float)
    before = np.concatenate([close[:1], close[:-1]])
    atr = wilder(np.maximum(high - low, np.maximum(abs(high - before), abs(low - before))), 14)
    made = {"ema_12": e12, "ema_26": e26, "macd": macd, "macd_signal": signal, "macd_hist": macd - signal, "rsi_14": rsi, "atr_14": atr}
    return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "start_time": pdf["start_time"].to_numpy()} | made)


def recursive(candles: DataFrame) -> DataFrame:
    """(symbol, start_time, ema_12, ... atr_14). Each value depends on the one before, so a symbol's candles, which are few
    beside its ticks, are walked through together. NaN stands where a window is not yet full."""
    names = "ema_12, ema_26, macd, macd_signal, macd_hist, rsi_14, atr_14".split(", ")
    schema = "symbol string, start_time timestamp, " + ", ".join(f"{n} double" for n in names)
    out = candles.select("symbol", "start_time", "high", "low", "close").groupBy("symbol").applyInPandas(recursive_frame, schema)
    return out.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})


def indicators(candles: DataFrame) -> DataFrame:
    return windowed(candles).join(recursive(candles), ["symbol", "start_time"])
