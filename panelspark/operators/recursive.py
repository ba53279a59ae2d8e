"""Indicators with memory of all earlier rows: exponential and Wilder smoothing.

A recursive filter is no frame aggregate, so these run as grouped maps over Arrow, one ticker
at a time; a ticker has one row a day at most, which bounds a group by the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelspark.session import ship_package


def ema(x: np.ndarray, alpha: float, seed: int = 1) -> np.ndarray:
    """Recursive mean, nulls (NaN) skipped; the first ``seed`` values start it as their mean
    and have no result themselves, except the last of them."""
    out = np.full(len(x), np.nan)
    kept: list[float] = []
    y = np.nan
    for i, v in enumerate(x):
        if np.isnan(v):
            if not np.isnan(y):
                out[i] = y
            continue
        if np.isnan(y):
            kept.append(v)
            if len(kept) == seed:
                y = float(np.mean(kept))
                out[i] = y
            continue
        y = y + alpha * (v - y)
        out[i] = y
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return ema(x, 1.0 / n)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    prev = np.r_[np.nan, close[:-1]]
    return np.fmax(high - low, np.fmax(np.abs(high - prev), np.abs(low - prev)))


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    move = np.r_[np.nan, np.diff(close)]
    up, down = wilder(np.where(np.isnan(move), np.nan, np.maximum(move, 0)), n), wilder(np.where(np.isnan(move), np.nan, np.maximum(-move, 0)), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(up + down > 0, 100 * (up / (up + down)), np.nan)


def directional_index(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    """Spread of the directional movements over their sum, in percent."""
    up, down = np.r_[np.nan, np.diff(high)], np.r_[np.nan, -np.diff(low)]
    plus = np.where(np.isnan(up), np.nan, np.where((up > down) & (up > 0), up, 0.0))
    minus = np.where(np.isnan(down), np.nan, np.where((down > up) & (down > 0), down, 0.0))
    tr = wilder(true_range(high, low, close), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        p, m = wilder(plus, n) / tr, wilder(minus, n) / tr
        return np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), np.nan)


def recursive_indicators(df: DataFrame, *, ema_n: int = 20, rsi_n: int = 14, atr_n: int = 14, macd: tuple[int, int, int] = (12, 26, 9), dx_n: int = 30, seeded: bool = False) -> DataFrame:
    """(ticker, date, ema, macd, macd_signal, macd_hist, rsi, atr, atr_pct, dx).

    Null prices are skipped: averages hold their last value over them. seeded: exponential
    means start as the mean of their first n values, with nulls before, instead of at the
    first value. Columns are named by what they hold: hist = macd - signal.
    """
    ship_package(df.sparkSession)
    cols = ["open", "high", "low", "close"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        high, low, close = (part[c].to_numpy(float) for c in ("high", "low", "close"))
        mean = lambda x, n: ema(x, 2.0 / (n + 1), n if seeded else 1)
        line = mean(close, macd[0]) - mean(close, macd[1])
        signal = mean(line, macd[2])
        atr = wilder(true_range(high, low, close), atr_n)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(close > 0, atr / close, np.nan)
        return pd.DataFrame({"ticker": part["ticker"], "date": part["date"], "ema": mean(close, ema_n), "macd": line, "macd_signal": signal, "macd_hist": line - signal, "rsi": rsi(close, rsi_n), "atr": atr, "atr_pct": share, "dx": directional_index(high, low, close, dx_n)})

    schema = "ticker string, date date, " + ", ".join(f"{c} double" for c in ("ema", "macd", "macd_signal", "macd_hist", "rsi", "atr", "atr_pct", "dx"))
    return df.select("ticker", "date", *cols).groupBy("ticker").applyInPandas(run, schema)
