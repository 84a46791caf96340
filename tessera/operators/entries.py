"""The entry gate chain: which candidates are bought, in rank order, and why the others are not.

Gates that depend on the candidate alone are columns. Those that depend on what was bought before in the same run
(positions, risk, cash, exposure by industry) are a scan of the run's candidates in rank order: rows stream through, partitioned by
run and sorted, and a task holds the book of one run at a time. Cash and caps are shared within a run only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions import dates, sizing


@dataclass(frozen=True)
class Rules:
    """The live entry rules."""

    insider_veto: float = -1_000_000.0
    positions: int = 40
    blackout_days: int = 3
    volume: float = 10_000_000.0
    volume_bars: int = 20
    price: float = 5.0
    atr: float = 0.03
    atr_bars: int = 14
    floor: float = 50.0
    order_cap: float = 20_000.0
    ticker_cap: float = 0.08
    risk: float = 0.005
    heat: float = 0.10
    sector: float = 0.30
    stop_atr: float = 3.0
    least_stop: float = 0.03
    most_stop: float = 0.15


#: The reasons, in the order of their gates; the first that fails names the reason.
REASONS = [
    "insider_selling", "universe", "max_positions", "earnings", "no_bars", "too_thin", "new_listing", "too_calm", "no_cash", "untracked_holding", "ticker_cap",
    "no_risk_room", "open_order", "price", "not_shortable", "sector_full",
]


def bar_features(bars: DataFrame, rules: Rules) -> DataFrame:
    """(ticker, day, last, adv, atr_pct) of each bar: last close, mean dollar volume and mean true range over the price; null with too few bars."""
    w = Window.partitionBy("ticker").orderBy("day")
    before = F.lag("close").over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    x = bars.withColumn("tr", F.when(before.isNotNull(), true_range)).withColumn("dollars", F.col("close") * F.col("volume")).withColumn("k", F.row_number().over(w))
    mean = lambda c, n: F.avg(c).over(w.rowsBetween(1 - n, 0))
    adv = F.when(F.col("k") >= rules.volume_bars, mean("dollars", rules.volume_bars))
    atr = F.when(F.col("k") > rules.atr_bars, F.try_divide(mean("tr", rules.atr_bars), F.col("close")))
    return x.select("ticker", "day", F.col("close").alias("last"), adv.alias("adv"), atr.alias("atr_pct"))


def early_reason(rules: Rules) -> Column:
    """Gates before the limit of positions."""
    return F.when(~F.col("short") & (F.col("insider_usd") < rules.insider_veto), "insider_selling").when(~F.coalesce("eligible", F.lit(False)), "universe")


def notional(rules: Rules) -> Column:
    """Dollars of an order by its score's tier, before the caps; null if the cash is below the least order."""
    sized = F.least(F.greatest(F.col("equity") * sizing.tier_pct(F.col("score")) / 100, F.lit(rules.floor)), F.lit(rules.order_cap), F.col("cash"))
    return F.when((F.col("cash") >= rules.floor) & (sized >= rules.floor), sized * F.col("unit"))


def late_reason(rules: Rules) -> Column:
    """Gates after the limit of positions that do not depend on the run. Missing bars and unknown volumes fail."""
    room = F.least(notional(rules), F.greatest(F.col("equity") * rules.ticker_cap - F.col("holding"), F.lit(0.0)))
    gates = [
        (dates.in_blackout(F.col("day"), F.col("report"), rules.blackout_days), "earnings"),
        (F.col("last").isNull(), "no_bars"),
        (F.col("adv").isNull() | (F.col("adv") < rules.volume) | (F.col("last") < rules.price), "too_thin"),
        (F.col("atr_pct").isNull(), "new_listing"),
        (F.col("atr_pct") < rules.atr, "too_calm"),
        (notional(rules).isNull(), "no_cash"),
        (F.col("holding") > 0, "untracked_holding"),
        (room < rules.floor, "ticker_cap"),
    ]
    return F.coalesce(*[F.when(failed, reason) for failed, reason in gates])


class Book:
    """One run's book as it grows."""

    def __init__(self, rules: Rules, n_open: int, cash: float, open_risk: float):
        self.rules, self.n_open, self.cash, self.risk = rules, n_open, cash, open_risk
        self.bought: dict[str | None, float] = {}
        self.stopped = False

    def decide(self, early, late, equity, stop, unit, open_order, last, shortable, industry, held) -> tuple[str, int, float]:
        """(reason, shares, dollars) of the next candidate; "ok" if it is bought."""
        r = self.rules
        if self.stopped:
            return "max_positions", 0, 0.0
        if early is not None:
            return early, 0, 0.0
        if self.n_open >= r.positions:
            self.stopped = True  # the run ends here
            return "max_positions", 0, 0.0
        if late is not None:
            return late, 0, 0.0
        risk = min(equity * r.risk * unit, max(equity * r.heat - max(self.risk, 0.0), 0.0))
        dollars = min(risk / stop, equity * r.ticker_cap, max(self.cash, 0.0))
        if dollars < r.floor:
            return "no_risk_room", 0, 0.0
        if open_order:
            return "open_order", 0, 0.0
        shares = math.floor(dollars / last)
        if last < r.price or not shares:
            return "price", 0, 0.0
        if not shortable:
            return "not_shortable", 0, 0.0
        cost = shares * last
        if industry is not None and held + self.bought.get(industry, 0.0) + cost > equity * r.sector:
            return "sector_full", 0, 0.0
        self.n_open += 1
        self.cash -= dollars
        self.risk += dollars * stop
        self.bought[industry] = self.bought.get(industry, 0.0) + cost
        return "ok", shares, cost


SCANNED = ["early", "late", "equity", "stop", "unit", "open_order", "last", "shortable", "industry", "held"]


def admit(candidates: DataFrame, run: str, order: list[str], rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Adds reason, shares and dollars to candidates.

    Each has the run's book at its start (equity, cash, n_open, open_risk, held: what the run holds of its industry) and its own score, day, short,
    insider_usd, eligible, report, last, adv, atr_pct, unit (a factor of the size), holding (shares that no trade tracks), open_order, can_short,
    easy (to borrow) and industry (null: no cap). ``order`` must be total within a run; a run without candidates has no rows.
    """
    stop = F.least(F.greatest(rules.stop_atr * F.col("atr_pct"), F.lit(rules.least_stop)), F.lit(rules.most_stop))
    ready = candidates.withColumns({"early": early_reason(rules), "late": late_reason(rules), "stop": stop, "shortable": ~F.col("short") | (F.col("can_short") & F.col("easy"))})
    names = [run, "n_open", "cash", "open_risk", *SCANNED]
    fields = ready.drop("early", "late", "stop", "shortable").schema.fields
    schema = T.StructType([*fields, T.StructField("reason", T.StringType()), T.StructField("shares", T.LongType()), T.StructField("dollars", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = book = None
        for b in batches:
            done = []
            for key, n_open, cash, risk, *row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if book is None or at != [key]:
                    at, book = [key], Book(rules, n_open, cash, risk)
                done.append(book.decide(*row))
            keep = b.drop_columns(["early", "late", "stop", "shortable"])
            yield pa.record_batch(
                [*keep.columns, *(pa.array(x, t) for x, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.float64()), strict=True))], names=[*keep.schema.names, "reason", "shares", "dollars"]
            )

    return ready.repartition(run).sortWithinPartitions(run, *order).mapInArrow(scan, schema)
