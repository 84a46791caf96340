"""Position sizing and strategy parameters: column expressions, and validation on the driver for a handful of numbers."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Strategy:
    """The live strategy."""

    positive: float = 0.3
    least_dims: int = 2
    diversity: int = 2
    override: float = 0.40
    min_score: float = 0.30
    positions: int = 10
    stop: float = -0.10
    target: float = 0.15
    max_hold: int = 90
    weights: tuple[float, ...] = (0.3411, 0.0, 0.3411, 0.2636, 0.0543, 0.0, 0.0, 0.0)

    def with_changes(self, **delta) -> Strategy:
        """A changed copy; unknown names, revived zero weights and weights that do not sum to 1 are refused."""
        known = {f.name for f in fields(self)}
        if unknown := set(delta) - known:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        if "weights" in delta:
            stale = stale_dimensions(self.weights, delta["weights"])
            if stale or abs(sum(delta["weights"]) - 1) > 0.01:
                raise ValueError(f"weights refused; revived dimensions {stale}")
        return replace(self, **delta)


def stale_dimensions(now: tuple[float, ...], proposed: tuple[float, ...]) -> list[int]:
    """Dimensions that a proposal would revive though they are switched off now."""
    return [i for i, (a, b) in enumerate(zip(now, proposed, strict=True)) if a == 0 and b != 0]


def bounded_weights(now: list[float], t: list[float], n: list[int], days: list[int], step: float = 0.10, bound: float = 0.5) -> list[float]:
    """A step up or down where the evidence is strong (t >= 2, 30 trades, 10 days), within the bound, the pinned rest kept, renormalised to the old sum."""
    moved = [w * (1 + step * (1 if x > 0 else -1)) if w and abs(x) >= 2 and k >= 30 and d >= 10 else w for w, x, k, d in zip(now, t, n, days, strict=True)]
    moved = [min(max(m, w * (1 - bound)), w * (1 + bound)) for m, w in zip(moved, now, strict=True)]
    pinned = sum(w for m, w in zip(moved, now, strict=True) if m == w)
    free = sum(m for m, w in zip(moved, now, strict=True) if m != w)
    scale = (sum(now) - pinned) / free if free else 1.0
    return [m * scale if m != w else w for m, w in zip(moved, now, strict=True)]


def tier_pct(score: Column) -> Column:
    """Strict tiers of 8, 5 and 2 percent."""
    return F.when(score > 0.6, 8.0).when(score > 0.45, 5.0).otherwise(2.0)


def throttle(drawdown: Column) -> Column:
    """1 up to 5 % drawdown, then down in a line to a floor of 0.25 at 20 %."""
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), 1 - (drawdown - 0.05) / 0.15 * 0.75))


def risk_size(equity: Column, atr_pct: Column, drawdown: Column, edge: Column, risk: float = 0.005, cap: float = 0.08) -> Column:
    """Dollars: risk budget over a stop of 3 ATR kept within 3 to 15 %, throttled, times half Kelly (at most 3), capped for a ticker."""
    stop = F.greatest(F.lit(0.03), F.least(F.lit(0.15), 3 * atr_pct))
    kelly = F.greatest(F.lit(0.0), F.least(F.lit(3.0), edge / 2))
    return F.least(equity * risk * throttle(drawdown) * kelly / stop, equity * cap)


def blended_entry(shares: Column, entry: Column, more: Column, price: Column) -> Column:
    """Share-weighted basis after adding to a position."""
    return F.try_divide(shares * entry + more * price, shares + more)


def stops(entry: Column, extreme: Column, atr: Column, short: Column) -> Column:
    """The tighter of the hard floor (10 %) and the trail (3 ATR from the extreme), mirrored for short positions."""
    return F.when(short, F.least(entry * 1.10, extreme + 3 * atr)).otherwise(F.greatest(entry * 0.90, extreme - 3 * atr))
