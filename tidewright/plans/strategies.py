"""Strategies as plain callbacks over a bar history, for live sessions."""

from __future__ import annotations

import math
from statistics import stdev


def per_bar_momentum(
    lookback: float = 20,
    vol_window: float = 90,
    min_vol_observations: float = 30,
    z_scale: float = 1.5,
    max_weight: float = 1.0,
):
    """The momentum rule bar by bar; history rows are (t, open, high, low, close, volume)."""
    k, deep, least = int(lookback), int(vol_window), int(min_vol_observations)

    def weight(history: list[tuple]) -> float | None:
        closes = [r[4] for r in history[-(k + deep + 1) :]]
        moves = [math.log(closes[i] / closes[i - k]) for i in range(k, len(closes))]
        if len(moves) - 1 < max(least, 2):
            return None
        scale = stdev(moves[:-1])
        return None if scale <= 0 else max(-max_weight, min(max_weight, moves[-1] / scale / z_scale))

    return weight


def per_bar_sma(fast: float = 20, slow: float = 100, allow_short: float = 0):
    n, m = int(fast), int(slow)

    def weight(history: list[tuple]) -> float | None:
        closes = [r[4] for r in history[-m:]]
        if len(closes) < m:
            return None
        up = sum(closes[-n:]) / n > sum(closes) / m
        return 1.0 if up else -1.0 if allow_short else 0.0

    return weight


def live_rule(spark, spec, params: dict):
    """A strategy's rule for live sessions: the built-in ones as callbacks, any other by its own plan over the bars so far."""
    known = {"momentum": per_bar_momentum, "sma": per_bar_sma}
    if spec.name in known:
        return known[spec.name](**params)

    def weight(history: list[tuple]) -> float | None:
        bars = spark.createDataFrame(
            [(0, "LIVE", *map(float, r[1:]), int(r[0])) for r in history],
            "span_id long, symbol string, open double, high double, low double, close double, volume double, t int",
        )
        last = spec.build(bars, params).where(f"t = {int(history[-1][0])}").orderBy("seq").collect()
        return float(last[-1]["target_weight"]) if last else None

    return weight
