"""Operators whose result depends on what was kept before.

Series stream through in order, partitioned by key and sorted: a task holds a few numbers (or the
items taken) for the key at hand, however long its series is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _stream(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], Callable], added: str | None = None) -> DataFrame:
    """Rows of each key in order through the function that start() gives; it gets the row's columns.

    Rows for which it is true are kept, or its value becomes the column ``added`` (long).
    """
    names = df.columns
    at = [names.index(c) for c in columns]
    at_key = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list = []
        step = None
        for b in batches:
            out = []
            for k, *values in zip(b.column(at_key).to_pylist(), *(b.column(i).to_pylist() for i in at), strict=True):
                if step is None or current != [k]:
                    current, step = [k], start()
                out.append(step(*values))
            if added:
                yield pa.record_batch([*b.columns, pa.array(out, pa.int64())], names=[*names, added])
            else:
                yield b.filter(pa.array(out, pa.bool_()))

    schema = T.StructType([*df.schema.fields, T.StructField(added, T.LongType())]) if added else df.schema
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def cooldown(df: DataFrame, key: str, index: str, gap: int) -> DataFrame:
    """Rows of each key that lie ``gap`` or more after the last kept one (not after the last one)."""

    def start() -> Callable:
        last = None

        def step(x: int) -> bool:
            nonlocal last
            if last is not None and x - last < gap:
                return False
            last = x
            return True

        return step

    return _stream(df, key, [index], [index], start)


def token_batches(df: DataFrame, group: str, order: str, tokens: str, budget: int, most: int) -> DataFrame:
    """Greedy contiguous batches of each group under a token budget and a count; adds ``batch``."""

    def start() -> Callable:
        batch = used = n = 0

        def step(t: int) -> int:
            nonlocal batch, used, n
            if n and (used + t > budget or n >= most):
                batch, used, n = batch + 1, 0, 0
            used, n = used + t, n + 1
            return batch

        return step

    return _stream(df, group, [order], [tokens], start, "batch")


def claim(df: DataFrame, group: str, order: list[str], item: str, title: str, cap: int) -> DataFrame:
    """Rows in priority order; each item and each title is taken once in a group, at most ``cap`` rows of a group are kept."""

    def start() -> Callable:
        items, titles = set(), set()

        def step(i, t) -> bool:
            if len(items) >= cap or i in items or t in titles:
                return False
            items.add(i)
            titles.add(t)
            return True

        return step

    return _stream(df, group, order, [item, title], start)


def admissible(signals: DataFrame, group: str, slots: int, hold: int) -> DataFrame:
    """The rows that a simulation with so many slots can look at, and the last day of the whole group (``end``).

    On one day at most ``slots`` tickers are bought and at most as many are held, so only the best 2 * ``slots``
    scores of a day can be; each is followed for ``hold`` bars. What is left grows with the days, not with the tickers.
    """
    best = Window.partitionBy(group, "day").orderBy(F.col("score").desc_nulls_last(), "ticker")
    path = Window.partitionBy(group, "ticker").orderBy("day")
    rows = signals.withColumn("_best", F.col("score").isNotNull() & (F.row_number().over(best) <= 2 * slots)).withColumn("_bar", F.row_number().over(path))
    since = F.last(F.when(F.col("_best"), F.col("_bar")), ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_since", F.col("_bar") - since).where(F.col("_since") <= hold)
    ends = signals.groupBy(group).agg(F.max("day").alias("end"))  # one row for each scenario
    return rows.drop("_best", "_bar", "_since").join(F.broadcast(ends), group)


def walk(pdf: pd.DataFrame, group: str, slots: int, capital: float, stop: float, target: float, hold: int, cost: float) -> pd.DataFrame:
    """One scenario's trades, from its rows (group, day, ticker, score, close, end)."""
    pdf = pdf.sort_values(["day", "ticker"])
    name, end = pdf[group].iloc[0], pdf["end"].iloc[0]
    cash, held, out = capital, {}, []
    last: dict = {}

    def close(t: int, day, price: float, reason: str) -> None:
        nonlocal cash
        p = held.pop(t)
        cash += p["qty"] * price * (1 - cost)
        out.append((name, t, p["day"], day, reason, price / p["price"] - 1))

    for day, bars in pdf.groupby("day", sort=True):
        price = dict(zip(bars["ticker"], bars["close"], strict=True))
        last.update(price)
        for t in [t for t in sorted(held) if t in price]:
            held[t]["bars"] += 1
            ret = price[t] / held[t]["price"] - 1
            reason = "stop" if ret <= -stop else "target" if ret >= target else "max_hold" if held[t]["bars"] >= hold else None
            if reason:
                close(t, day, price[t], reason)
        wanted = bars[bars["score"].notna()].sort_values(["score", "ticker"], ascending=[False, True])
        for t in wanted["ticker"]:
            if len(held) >= slots:
                break
            if t not in held:
                size = cash / (slots - len(held))
                held[t] = {"qty": size * (1 - cost) / price[t], "price": price[t], "day": day, "bars": 0}
                cash -= size
    for t in sorted(held):
        close(t, end, last[t], "data_end")
    return pd.DataFrame(out, columns=["group", "ticker", "entry_day", "exit_day", "reason", "ret"])


def simulate(signals: DataFrame, group: str, slots: int, capital: float, stop: float, target: float, hold: int, cost: float = 0.0) -> DataFrame:
    """Calendar walk over one scenario's price path with shared capital: exits first, then entries by score.

    signals: group, day, ticker, score (null: no signal), close. A scenario is sequential, scenarios
    run in parallel, each on its admissible rows only. Positions close at the stop, the target, after ``hold`` bars or, marked
    ``data_end``, with the last bar. Rows: group, ticker, entry_day, exit_day, reason, ret.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return walk(pdf, group, slots, capital, stop, target, hold, cost)

    rows = admissible(signals.select(group, "day", "ticker", "score", "close"), group, slots, hold)
    return rows.groupBy(group).applyInPandas(run, "group string, ticker bigint, entry_day date, exit_day date, reason string, ret double")


def distinct_results(df: DataFrame, group: str, rank: str, most: int = 2, overlap: float = 0.75, near: float = 0.85) -> DataFrame:
    """Results of each query in rank order, without those too like a kept one.

    df: group, rank, source, headline, embedding. A result goes if its headline words overlap with a
    kept one's by more than ``overlap`` (of their union), if its vector lies nearer than ``near`` to a
    kept one of another source, or if its source has ``most`` kept ones. A group is one result list,
    bounded by the limit of the search; lists of three or fewer stay as they are.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank)
        if len(pdf) <= 3:
            return pdf
        kept: list[tuple[str, set, np.ndarray]] = []
        good = []
        for source, headline, v in zip(pdf["source"], pdf["headline"], pdf["embedding"], strict=True):
            words = set((headline or "").lower().split())
            v = np.zeros(0) if v is None else np.asarray(v, dtype=np.float64)

            def like(other: tuple[str, set, np.ndarray], source=source, words=words, v=v) -> bool:
                union = len(words | other[1])
                if words and other[1] and len(words & other[1]) / union > overlap:
                    return True
                norm = np.linalg.norm(v) * np.linalg.norm(other[2]) if len(v) == len(other[2]) else 0.0
                return source != other[0] and norm > 0 and float(v @ other[2]) / norm > near

            take = sum(k[0] == source for k in kept) < most and not any(like(k) for k in kept)
            good.append(take)
            if take:
                kept.append((source, words, v))
        return pdf[good]

    return df.groupBy(group).applyInPandas(pick, df.schema)
