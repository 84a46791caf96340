"""Weights that learn: bounded moves from the results of each source, and batches of proposals that are applied or refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import latest

#: Evidence that a move needs, its step, how far from the default a weight may go, and rounds of renormalising.
MIN_SIGNALS, MIN_DAYS, MIN_T, STEP, BOUND, ROUNDS = 30, 10, 2.0, 0.10, 0.5, 16
SAME = 1e-6


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def moved(current: Column, defaults: Column, n: Column, days: Column, t: Column) -> Column:
    """array<double>: current weights, each moved a step up or down where its evidence is strong, inside its band around the default, summing to 1.

    All arguments are arrays in the order of the dimensions. Dimensions that are switched off (default 0) never move. After the moves all weights
    are scaled to a sum of 1; those that would leave their band are pinned at its edge, and the rest shares what is left, until none does. If no vector inside all
    bands sums to 1, or nothing moved, the current weights stay. Four decimals; what rounding leaves goes to the largest weight (the last of equal ones).
    """
    at = lambda xs, i: F.get(xs, i)
    low, high = (lambda i: at(defaults, i) * (1 - BOUND)), (lambda i: at(defaults, i) * (1 + BOUND))
    clamp = lambda x, i: F.least(F.greatest(x, low(i)), high(i))

    def move(w: Column, i: Column) -> Column:
        strong = (at(defaults, i) > 0) & (at(n, i) >= MIN_SIGNALS) & (at(days, i) >= MIN_DAYS) & (F.abs(at(t, i)) >= MIN_T)
        to = clamp(w * F.when(at(t, i) > 0, 1 + STEP).otherwise(1 - STEP), i)
        return F.when(F.coalesce(strong, F.lit(False)) & (F.abs(to - w) > SAME), to).otherwise(w)

    def renormalised(first: Column) -> Column:
        state = lambda w, pinned, done: F.struct(w.alias("w"), pinned.alias("pinned"), done.alias("done"))

        def step(s: Column, _: Column) -> Column:
            fixed = _sum(F.transform(s["w"], lambda x, i: F.when(at(s["pinned"], i), x).otherwise(0.0)))
            free = _sum(F.transform(s["w"], lambda x, i: F.when(at(s["pinned"], i), 0.0).otherwise(x)))
            scaled = _let((1 - fixed) / F.when(free > 0, free), lambda k: F.transform(s["w"], lambda x, i: F.when(at(s["pinned"], i), x).otherwise(x * k)))

            def bounded(v: Column) -> Column:
                left = F.transform(v, lambda x, i: ~at(s["pinned"], i) & (at(defaults, i) > 0) & ((x < low(i)) | (x > high(i))))
                return _let(left, lambda gone: state(F.transform(v, lambda x, i: F.when(at(gone, i), clamp(x, i)).otherwise(x)), F.zip_with(s["pinned"], gone, lambda p, g: p | g), ~F.exists(gone, lambda g: g)))

            return F.when(s["done"] | (free <= 0), state(s["w"], s["pinned"], F.lit(True))).otherwise(_let(scaled, bounded))

        start = state(first, F.transform(first, lambda x: F.lit(False)), F.lit(False))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["w"])

    def finished(w: Column) -> Column:
        rounded = F.transform(w, lambda x: F.round(x, 4))
        largest = lambda v: F.size(v) - F.array_position(F.reverse(v), F.array_max(v)).cast("int")
        nudged = _let(rounded, lambda v: _let(largest(v), lambda k: F.transform(v, lambda x, i: F.when(i == k, x + (1 - _sum(v))).otherwise(x))))
        return F.when(F.abs(_sum(w) - 1) <= SAME, nudged).otherwise(current)

    first = F.transform(current, move)
    return _let(first, lambda f: F.when(F.exists(F.zip_with(f, current, lambda a, b: a != b), lambda x: x), _let(renormalised(f), finished)).otherwise(current))


def stale(old: Column, new: Column, default: Column) -> Column:
    """Why a row of a proposal may not be applied: it would revive a dimension that is switched off, or was computed from a default that is no more; null if it may."""
    return F.when((F.abs(default) < SAME) & (F.abs(new) >= SAME), "revives_zeroed").when(F.abs(old - default) >= SAME, "superseded")


def applied(proposals: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """(key, batch, status, n_stale, weights) of each account's latest pending batch: applied, or refused as a whole if any of its rows is stale.

    proposals: key, batch, computed_at, dimension, old, new, status; defaults: dimension, default. weights: array<struct<dimension, new>>, null if refused; dimensions that are not
    known are never stale; rows that are equal as a whole count once.
    """
    newest = latest(proposals.where("status = 'pending'").select(key, "batch", "computed_at").distinct(), [key], [F.desc("computed_at"), F.desc("batch")]).select(key, "batch")
    rows = proposals.where("status = 'pending'").select(key, "batch", "dimension", "old", "new").distinct().join(newest, [key, "batch"], "left_semi").join(F.broadcast(defaults), "dimension", "left")  # a row for each dimension
    a = rows.groupBy(key, "batch").agg(F.count(stale(F.col("old"), F.col("new"), F.col("default"))).alias("n_stale"), F.sort_array(F.collect_list(F.struct("dimension", "new"))).alias("w"))
    good = F.col("n_stale") == 0
    return a.select(key, "batch", F.when(good, "applied").otherwise("refused").alias("status"), "n_stale", F.when(good, F.col("w")).alias("weights"))
