"""Signals that fade, told apart from a source that fell silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import as_of

#: Days after which a reading is stale, days whose output is normal, the share of a normal day that counts as running, and when a score has decayed.
STALE, NORMAL, HEALTHY, LEFT, FLOOR = 3, 30, 0.25, 0.3, 0.05


def output_health(readings: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """(as_of, recent, median, healthy) of each as_of in ``days``.

    recent: rows of the last STALE days; median: the upper median of the daily counts of the last NORMAL days that have any. Healthy if recent is
    a quarter of that or more; without any output nothing is known, so it is not. A day's count goes to each as_of day that it matters to: a count
    for each day, however many readings.
    """
    counts = readings.where(F.col(day).isNotNull()).groupBy(day).agg(F.count("*").alias("n"))
    each = counts.select("n", F.col(day), F.explode(F.sequence(F.col(day), F.date_add(day, NORMAL))).alias("as_of"))
    fresh = F.date_diff("as_of", F.col(day)) <= STALE
    known = each.groupBy("as_of").agg(F.coalesce(F.sum(F.when(fresh, F.col("n"))), F.lit(0)).alias("recent"), F.sort_array(F.collect_list("n")).alias("ns"))  # at most NORMAL + 1 numbers
    known = known.select("as_of", "recent", F.get("ns", F.floor(F.size("ns") / 2).cast("int")).alias("median"))
    out = days.select("as_of").distinct().join(F.broadcast(known), "as_of", "left")
    return out.select("as_of", F.coalesce("recent", F.lit(0)).alias("recent"), "median", F.coalesce(F.col("recent") >= F.col("median") * HEALTHY, F.lit(False)).alias("healthy"))


def has_decayed(original: Column, latest: Column, healthy: Column) -> Column:
    """Whether what is left of a score (nothing, if there is no fresh reading) is under its share and floor; never while the source is not healthy."""
    return healthy & (F.coalesce(latest, F.lit(0.0)) < F.greatest(original * LEFT, F.lit(FLOOR)))


def decay(readings: DataFrame, positions: DataFrame, order: str = "id") -> DataFrame:
    """positions (key, as_of, original) with latest (the last reading of the key in the last STALE days, null if none), healthy and decayed.

    readings: key, day, score and a column that orders those of one day.
    """
    daily = readings.groupBy("key", "day").agg(F.max_by("score", order).alias("score"))
    seen = as_of(positions.select("key", "as_of", "original"), daily, "key", "as_of", "day", ["score"], prefix="last_")
    latest = F.when(F.date_diff("as_of", "last_at") <= STALE, F.col("last_score"))
    told = seen.join(F.broadcast(output_health(readings, positions).select("as_of", "healthy")), "as_of")  # one row a day
    return told.select("key", "as_of", "original", latest.alias("latest"), "healthy", has_decayed(F.col("original"), latest, F.col("healthy")).alias("decayed"))
