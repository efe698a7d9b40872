"""Path-dependent simulators: one series a group, its bars in the order of time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import lag

_OUT = "symbol string, time timestamp, equity double, position double, pnl double, side string"


def _simulate(df: DataFrame, step: Callable[[pd.DataFrame], list[tuple[float, float, float, str | None]]]) -> DataFrame:
    """equity before the bar's action, position after it, profit and side of a trade closed at it (else null)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time")
        out = pd.DataFrame(step(rows), columns=["equity", "position", "pnl", "side"], index=rows.index)
        return pd.concat([rows[["symbol", "time"]], out], axis=1)

    return df.groupBy("symbol").applyInPandas(run, _OUT).replace(float("nan"), None, ["pnl"])


def event_backtest(df: DataFrame, cash: float = 100_000.0, units: float = 10_000.0) -> DataFrame:
    """df (close, signal): flat series act on buy and sell_short, long ones on sell, short ones on buy_to_cover, at the close.
    Equity is marked before the action."""

    def step(rows: pd.DataFrame) -> list[tuple]:
        money, held, entry, out = cash, 0.0, 0.0, []
        for price, signal in zip(rows["close"], rows["signal"], strict=True):
            equity, pnl, side = money + (price - entry) * held, np.nan, None
            if held == 0 and signal in ("buy", "sell_short"):
                held, entry = (units if signal == "buy" else -units), price
            elif (held > 0 and signal == "sell") or (held < 0 and signal == "buy_to_cover"):
                pnl, side = (price - entry) * held, "long" if held > 0 else "short"
                money, held, entry = money + pnl, 0.0, 0.0
            out.append((equity, held, pnl, side))
        return out

    return _simulate(df, step)


def crossover_signals(df: DataFrame, fast: str = "ema_50", slow: str = "ema_200") -> DataFrame:
    """buy where the fast mean crosses over the slow one, sell where it crosses under."""
    a, b, c, d = F.col(fast), F.col(slow), lag(fast), lag(slow)
    return df.withColumn("signal", F.when((a > b) & (c <= d), "buy").when((a < b) & (c >= d), "sell"))


def hold_signals(df: DataFrame, long_threshold: float, short_threshold: float | None, hold: int) -> DataFrame:
    """df (long_label[, short_label]): enters where a probability is over its threshold (long first) and leaves after `hold`
    bars; the bar that leaves does not enter."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "signal string"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time")
        shorts = rows["short_label"] if short_threshold is not None else pd.Series(np.nan, rows.index)
        at, kind, out = -1, None, []
        for i, (p, q) in enumerate(zip(rows["long_label"], shorts, strict=True)):
            signal = None
            if kind and i - at >= hold:
                signal, kind = ("sell" if kind == "long" else "buy_to_cover"), None
            elif kind is None and p > long_threshold:
                signal, kind, at = "buy", "long", i
            elif kind is None and short_threshold is not None and q > short_threshold:
                signal, kind, at = "sell_short", "short", i
            out.append(signal)
        return rows.assign(signal=out)

    return df.groupBy("symbol").applyInPandas(run, schema)


def atr_backtest(df: DataFrame, threshold: float, stop: float, target: float, share: float, cash: float = 100_000.0) -> DataFrame:
    """df (close, atr, win_prob, side): enters at the close where win_prob is over the threshold, with `share` of equity, and
    leaves at a close beyond entry -/+ multiples of the ATR at entry. A bar may close one trade and open the next."""

    def step(rows: pd.DataFrame) -> list[tuple]:
        money, held, entry, low, high, equity, out = cash, 0.0, 0.0, 0.0, 0.0, cash, []
        for i, (price, atr, p, side) in enumerate(zip(rows["close"], rows["atr"], rows["win_prob"], rows["side"], strict=True)):
            pnl, name = np.nan, None
            if i:
                equity = money + (price - entry) * held if held else money
                if held and not low < price < high:
                    pnl, name = (price - entry) * held, "long" if held > 0 else "short"
                    money, held = money + pnl, 0.0
                    equity = money
                if not held and atr == atr and p > threshold and side:
                    held, entry = np.sign(side) * equity * share / price, price
                    below, above = (stop, target) if side > 0 else (target, stop)
                    low, high = price - below * atr, price + above * atr
            out.append((equity, held, pnl, name))
        return out

    return _simulate(df, step)


def fixed_hold_backtest(df: DataFrame, threshold: float = 0.214, hold: int = 12, cash: float = 10_000.0) -> DataFrame:
    """df (close, win_prob): all cash goes in where win_prob is over the threshold and comes out `hold` bars later; that bar
    may enter again."""

    def step(rows: pd.DataFrame) -> list[tuple]:
        money, held, entry, at, out = cash, 0.0, 0.0, 0, []
        for i, (price, p) in enumerate(zip(rows["close"], rows["win_prob"], strict=True)):
            pnl, name = np.nan, None
            if held and i - at >= hold:
                pnl, name = (price - entry) * held, "long"
                money, held = money + pnl, 0.0
            equity = money + (price - entry) * held
            if not held and p > threshold:
                held, entry, at = money / price, price, i
            out.append((equity, held, pnl, name))
        return out

    return _simulate(df, step)
