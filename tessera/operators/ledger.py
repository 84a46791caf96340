"""Trades and markets: the return of a whole trade, fresh events to act on, markets worth showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events that sell, and the event that replaces all sells before it by those it lists.
SALES, RESYNC = ["half_close", "partial_sale", "stop_sale"], "resync"


def whole_trade_pct(trades: DataFrame, events: DataFrame) -> DataFrame:
    """(trade_id, pct): all booked dollars over everything that was held at cost, in percent; null where no earlier leg is known.

    trades: trade_id, entry (price), realized (dollars before the last leg), pnl and qty of the last leg; events: trade_id, id, kind, qty, detail. Sold before: the first numbers of the lists under
    ``sells`` in the last resync's detail (none, if that is no JSON), and the quantities of sales after it, or of all sales if there is none.
    """
    last = events.where(F.col("kind") == RESYNC).groupBy("trade_id").agg(F.max("id").alias("at"), F.max_by("detail", "id").alias("detail"))
    lists = F.from_json("detail", "struct<sells:array<array<double>>>")["sells"]
    told = F.aggregate(F.coalesce(lists, F.array().cast("array<array<double>>")), F.lit(0.0), lambda a, x: a + F.coalesce(F.get(x, F.lit(0)), F.lit(0.0)))
    last = last.select("trade_id", "at", told.alias("told"))
    sales = events.where(F.col("kind").isin(SALES)).join(last.select("trade_id", "at"), "trade_id", "left").where(F.col("id") > F.coalesce("at", F.lit(0))).groupBy("trade_id").agg(F.sum("qty").alias("later"))
    x = trades.join(last, "trade_id", "left").join(sales, "trade_id", "left").withColumn("sold", F.coalesce("told", F.lit(0.0)) + F.coalesce("later", F.lit(0.0)))
    pct = (F.col("realized") + F.col("pnl")) / (F.col("entry") * (F.col("qty") + F.col("sold"))) * 100
    return x.select("trade_id", F.when((F.col("sold") > 0) & (F.col("entry") > 0) & (F.col("qty") + F.col("sold") > 0), pct).alias("pct"))


def event_candidates(events: DataFrame, held: DataFrame, acted: DataFrame, as_of: Column, slow: str, directions: list[str], traded: list[str], most: int = 10) -> DataFrame:
    """The ``most`` strongest events to act on (ties by id).

    events: id, kind, ticker, day, detected, direction, strength. Fresh is what happened or was detected since yesterday; of the kind ``slow`` also what was detected in the last four days.
    Left out: tickers in ``held``, and events that a trade of their kind (``acted``: ticker, kind, entry) came at or after.
    """
    fresh = (F.col("day") >= F.date_sub(as_of, 1)) | (F.col("detected") >= F.date_sub(as_of, 1)) | ((F.col("kind") == slow) & (F.col("detected") >= F.date_sub(as_of, 4)))
    wanted = events.where(fresh & F.col("direction").isin(directions) & F.col("kind").isin(traded)).join(held.select("ticker").distinct(), "ticker", "left_anti")
    latest = acted.groupBy("ticker", "kind").agg(F.max("entry").alias("entry"))  # only the last trade of a kind can matter
    left = wanted.join(latest, ["ticker", "kind"], "left").where(F.col("entry").isNull() | (F.col("entry") < F.col("day"))).drop("entry")
    return left.orderBy(F.desc("strength"), "id").limit(most)


#: Dollars a day and in the book that a price needs, the change that is a move, and the band of open questions.
MIN_VOLUME, MIN_LIQUIDITY, MOVE, OPEN = 10_000.0, 10_000.0, 0.05, (0.03, 0.97)


def novelty() -> Column:
    """Bets on how often someone posts, or on what a speech will contain; of question and event_title."""
    q, e = F.lower("question"), F.lower(F.coalesce("event_title", F.lit("")))
    says = F.contains(q, F.lit(' say "')) | F.contains(q, F.lit(" say “")) | F.contains(q, F.lit(" say '"))
    return F.contains(q, F.lit(" tweets")) | F.contains(e, F.lit(" tweets")) | says | (F.startswith(e, F.lit("what will")) & F.contains(e, F.lit(" say")))


def worth_showing() -> Column:
    """Enough money behind the price, no novelty, and either it moved or it is still open."""
    moved = F.coalesce(F.abs("change_1d") >= MOVE, F.lit(False))
    return (F.col("volume_24h") >= MIN_VOLUME) & (F.col("liquidity") >= MIN_LIQUIDITY) & ~novelty() & (moved | F.col("probability").between(*OPEN))
