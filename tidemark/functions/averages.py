"""Exponential and Wilder averages as states that are carried on: one step at a time, for many series at once.

A state holds its value, the weight that the past still has, and how many values it has seen; a missing value lets the weight decay and leaves
the rest, as in an average with adjust=False. The same steps serve a stream (one key), a forecast (all series of a batch) and the tests.
"""

from __future__ import annotations

import numpy as np

#: Averages of the recursive features: name -> (decay of a new value, values before it counts).
AVERAGES = {
    **{f"ema_{n}": (2 / (n + 1), n) for n in (7, 12, 14, 21, 26, 50)},
    "signal": (2 / 10, 9),
    **{name: (1 / 14, 14) for name in ("up", "down", "atr", "plus", "minus", "adx")},
}
BEFORE = ("close", "high", "low")
FEATURES = ["EMA_12_rel", "RSI_14", "MACD", "MACD_signal", "MACD_diff", "NATR_14", "ADX_14", *(f"EMA_{n}_rel" for n in (7, 14, 21, 50))]
#: Numbers in the state of one series.
SIZE = 3 * len(AVERAGES) + len(BEFORE)


def empty(n: int) -> np.ndarray:
    """States of n series that have seen nothing: one column a series."""
    out = np.full((SIZE, n), np.nan)
    out[1 : 3 * len(AVERAGES) : 3] = 1.0
    out[2 : 3 * len(AVERAGES) : 3] = 0.0
    return out


def _average(state: np.ndarray, name: str, x: np.ndarray) -> np.ndarray:
    """Take x into an average of the state; its value, nan until it counts."""
    at = 3 * list(AVERAGES).index(name)
    new, least = AVERAGES[name]
    value, weight, seen = state[at], state[at + 1], state[at + 2]
    there, begun = ~np.isnan(x), ~np.isnan(value)
    weight[begun] *= 1 - new
    both = there & begun
    value[both] = (weight[both] * value[both] + new * x[both]) / (weight[both] + new)
    value[there & ~begun] = x[there & ~begun]
    weight[there] = 1.0
    seen[there] += 1
    return np.where(seen >= least, value, np.nan)


def step(state: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> dict[str, np.ndarray]:
    """The features of each series' next bar; the state moves on. A series whose close is nan has no bar and stays as it is."""
    before = state.copy()
    last_close, last_high, last_low = state[-3:]
    here = ~np.isnan(close)
    with np.errstate(invalid="ignore", divide="ignore"):
        change, rise, fall = close - last_close, high - last_high, last_low - low
        up = _average(state, "up", np.where(np.isnan(change), np.nan, np.maximum(change, 0)))
        down = _average(state, "down", np.where(np.isnan(change), np.nan, np.maximum(-change, 0)))
        spread = np.fmax(high - low, np.fmax(np.abs(high - last_close), np.abs(low - last_close)))
        atr = _average(state, "atr", spread)
        plus = 100 * _average(state, "plus", np.where((rise > fall) & (rise > 0), rise, 0.0)) / atr
        minus = 100 * _average(state, "minus", np.where((fall > rise) & (fall > 0), fall, 0.0)) / atr
        adx = _average(state, "adx", 100 * np.abs(plus - minus) / (plus + minus))
        emas = {n: _average(state, f"ema_{n}", close) for n in (7, 12, 14, 21, 26, 50)}
        line = emas[12] - emas[26]
        signal = _average(state, "signal", line)
        out = {"RSI_14": 100 * up / (up + down), "MACD": line / close, "MACD_signal": signal / close, "MACD_diff": (line - signal) / close, "NATR_14": atr / close, "ADX_14": adx}
        out |= {f"EMA_{n}_rel": close / emas[n] - 1 for n in (7, 12, 14, 21, 50)}
    state[-3:] = close, high, low
    state[:, ~here] = before[:, ~here]
    return out
