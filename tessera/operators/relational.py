"""Relational building blocks: latest rows, as-of and interval joins, upserts, caps, set operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources import scratch

#: Numbers of one run of rows, and of one block of runs (a multiple): a task of ``permuted_sums`` holds two blocks of doubles.
SEGMENT, BLOCK = 1 << 14, 1 << 23


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def as_of(probes: DataFrame, facts: DataFrame, key: str, at: str, fact_at: str, values: list[str], forward: bool = False, prefix: str = "asof_") -> DataFrame:
    """Each probe with the values of the last fact at or before (or, forward, the first at or after) its time.

    One union, one shuffle by key and one sort: no range join. Facts must be unique on (key, fact_at).
    """
    probe_cols = probes.columns
    fact = F.struct(F.col(fact_at).alias("at"), *values)
    left = probes.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1 - int(forward)).alias("_side"), F.struct(*probe_cols).alias("_p"), F.lit(None).cast(facts.select(fact).schema[0].dataType).alias("_f"))
    right = facts.select(F.col(key).alias("_k"), F.col(fact_at).alias("_t"), F.lit(int(forward)).alias("_side"), F.lit(None).cast(probes.select(F.struct(*probe_cols)).schema[0].dataType).alias("_p"), fact.alias("_f"))
    w = Window.partitionBy("_k").orderBy("_t", "_side")
    w = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    seen = (F.first if forward else F.last)("_f", ignorenulls=True).over(w)
    out = left.unionByName(right).withColumn("_seen", seen).where("_p is not null")
    return out.select(*[F.col(f"_p.{c}").alias(c) for c in probe_cols], F.col("_seen.at").alias(f"{prefix}at"), *[F.col(f"_seen.{v}").alias(f"{prefix}{v}") for v in values])


def interval_join(left: DataFrame, right: DataFrame, on: list[str], l_at: str, r_at: str, low: int, high: int) -> DataFrame:
    """Pairs with low <= days(r_at - l_at) <= high, by day buckets as wide as the interval.

    Every left row goes to the two buckets that its interval can touch, so the join is an equi-join.
    """
    width = max(1, high - low + 1)
    bucket = lambda c: F.floor(F.unix_date(c) / width)
    first = F.date_add(F.col(l_at), low)
    l = left.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(first), bucket(F.date_add(F.col(l_at), high))))))  # noqa: E741
    r = right.withColumn("_b", bucket(F.col(r_at)))
    return l.join(r, [*on, "_b"]).where(F.date_diff(F.col(r_at), F.col(l_at)).between(low, high)).drop("_b")


def following(entries: DataFrame, rows: DataFrame, key: str, i: str, n: int, values: list[str]) -> DataFrame:
    """entries with each of the up to ``n`` rows that follow in their key's numbering: adds after (1 to n) and the rows' values.

    Rows lie in blocks of n numbers; an entry reaches into two of them, so the join is by key and block.
    """
    block = lambda x: F.floor(x / n)
    at = F.col(i)
    e = entries.withColumn("_b", F.explode(F.array_distinct(F.array(block(at + 1), block(at + n)))))
    r = rows.select(key, at.alias("_i"), block(at).alias("_b"), *[F.col(v).alias(f"_{v}") for v in values])
    met = e.join(r, [key, "_b"]).withColumn("after", F.col("_i") - at).where(F.col("after").between(1, n))
    return met.select(*entries.columns, "after", *[F.col(f"_{v}").alias(v) for v in values])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str] = (), add: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """old merged with new: ``overwrite`` columns take new's value, ``add`` columns sum, ``fill`` columns only fill nulls."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    pick = lambda a, b: F.coalesce(F.col(a), F.col(b))
    cols = [pick(f"n.{k}", f"o.{k}").alias(k) for k in keys]
    cols += [pick(f"n.{c}", f"o.{c}").alias(c) for c in overwrite]
    cols += [(F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"n.{c}"), F.lit(0))).alias(c) for c in add]
    cols += [pick(f"o.{c}", f"n.{c}").alias(c) for c in fill]
    return joined.select(*cols)


def upsert_changed(old: DataFrame, new: DataFrame, keys: list[str], watched: list[str], others: list[str]) -> DataFrame:
    """Like upsert, but an existing row changes only if a watched column differs; adds a flag ``changed``."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    is_new = F.col(f"o.{keys[0]}").isNull()
    take = F.col(f"n.{keys[0]}").isNotNull() & (is_new | differs)
    return joined.select(
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys],
        *[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in [*watched, *others]],
        take.alias("changed"),
    )


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected edges as two directed ones (a union instead of an OR join)."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def other_end(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, other, ...): for each end of an undirected edge the end across it; an edge from a node to itself counts once.

    What a join on CASE WHEN a = node THEN b ELSE a END gives, as a union of both directions.
    """
    rest = [c for c in edges.columns if c not in (a, b)]
    back = edges.where(~F.col(a).eqNullSafe(F.col(b))).select(F.col(b).alias("node"), F.col(a).alias("other"), *rest)
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(back).where("node is not null")


def linked(rows: DataFrame, stories: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """rows with the lowest id of the stories with the same keys, null if there is none. Null keys link nothing."""
    lowest = stories.groupBy(*keys).agg(F.min(id_).alias(id_))
    return rows.join(lowest, keys, "left")


def with_retry(wanted: DataFrame, scores: DataFrame, retry: DataFrame, keys: list[str], id_: str, order: str) -> DataFrame:
    """scores whose ids were wanted, and those of the retry for ids that they lack, of each the first in ``order``; adds ``recovered``.

    Scores of ids that nobody asked for are dropped from both; repeated scores of the first answer stay as they are.
    """
    at = [*keys, id_]
    first = scores.join(wanted.select(*at).distinct(), at, "left_semi")
    missing = wanted.select(*at).distinct().join(first.select(*at).distinct(), at, "left_anti")
    again = latest(retry.join(missing, at, "left_semi"), at, [F.col(order)])
    return first.withColumn("recovered", F.lit(False)).unionByName(again.withColumn("recovered", F.lit(True)))


#: Minutes after midnight until which a trade is of the open, and of the close.
MIDDAY, CLOSING = 12 * 60 + 45, 16 * 60


def at_session(trades: DataFrame, sessions: DataFrame, key: str, when: str) -> DataFrame:
    """trades with ``price``: of the session on that day the open before MIDDAY, the close before CLOSING, else the next session's open.

    sessions: key, day, open, close, one row for each day of trade. They become a calendar of times from which a price holds (a session's
    close from its midday, the next one's open from its closing), so an as-of lookup answers all cases: a weekend or a holiday lies between a closing
    and the next midday. After the last closing the price is null. Times are the market's.
    """
    w = Window.partitionBy(key).orderBy("day")
    start = F.col("day").cast("timestamp_ntz")
    at = lambda minutes: start + F.make_dt_interval(mins=F.lit(minutes))
    first = F.when(F.row_number().over(w) == 1, F.struct(F.lit("0001-01-01").cast("timestamp_ntz").alias("at"), F.col("open").alias("price")))
    steps = F.array(first, F.struct(at(MIDDAY).alias("at"), F.col("close").alias("price")), F.struct(at(CLOSING).alias("at"), F.lead("open").over(w).alias("price")))
    calendar = sessions.select(key, F.array_compact(steps).alias("steps")).select(key, F.explode("steps").alias("step")).select(key, F.col("step.at").alias("_from"), "step.price")
    return as_of(trades, calendar, key, when, "_from", ["price"], prefix="").drop("at")


def cap(df: DataFrame, caps: list[tuple[list[str], int]], order: list[Column], total: int | None = None) -> DataFrame:
    """Rows in rank order with at most so many of each key, one cap after another, then overall."""
    for keys, n in caps:
        df = latest(df, keys, order, n)
    return df.orderBy(*order).limit(total) if total else df


def upper_median(df: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """The value at offset floor(n / 2) of each group (not interpolated)."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("median"))


def dense_index(df: DataFrame, order: str, name: str = "i") -> DataFrame:
    """Adds the rows' numbers from 1 in the order of a unique column, without sorting the table in one task.

    Rows are dealt into ranges and written once; a range's first number follows from the counts of those before it,
    one number for each range.
    """
    parts = scratch.written(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    first = [(p, sum(n for _, n in counts[:k])) for k, (p, _) in enumerate(counts)]
    starts = df.sparkSession.createDataFrame(first, "_part int, _first bigint")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("_n", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_n") + F.col("_first")).drop("_part", "_n", "_first")


def coprime_powers(n: int, count: int, base: int = 2654435761) -> list[int]:
    """Powers of a prime modulo n, for shuffles i -> (i * power + k) mod n; the prime does not divide n."""
    while n % base == 0:
        base = {2654435761: 4294967291, 4294967291: 1000003}[base]  # all three together exceed 64 bits
    return [pow(base, k, n) for k in range(1, count + 1)]


def permuted_sums(rows: DataFrame, i: str, left: str, right: str, count: int) -> DataFrame:
    """(k, total): for each k from 1 to ``count`` the sum of left of row i times right of row ((i - 1) * P^k + k) mod n + 1, with P of ``coprime_powers``.

    rows: numbers from 1 to n without gaps, and two doubles; products with a null add nothing. Rows are packed into runs of SEGMENT numbers, runs into blocks of BLOCK
    numbers. Each pair of a block of left values and one of right values is a group, which adds up what its rows give to all k: every row is shuffled once for each block, not once for
    each k, and a group holds two blocks.
    """
    n = rows.count()
    powers, blocks = coprime_powers(max(n, 1), count), max(1, -(-n // BLOCK))
    at = F.col(i) - 1
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    placed = F.sort_array(F.collect_list(F.struct(at.alias("at"), value(left).alias("x"), value(right).alias("y"))))
    runs = rows.groupBy(F.floor(at / SEGMENT).alias("run")).agg(placed.alias("v"))
    runs = scratch.written(runs.select((F.col("run") * SEGMENT).alias("first"), F.floor(F.col("run") * SEGMENT / BLOCK).alias("block"), "v.x", "v.y"), "runs")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = runs.select(F.col("block").cast("int").alias("a"), every.alias("b"), "first", F.col("x").alias("v"))
    b = runs.select(every.alias("a"), F.col("block").cast("int").alias("b"), "first", F.col("y").alias("v"))

    def whole(t: pa.Table) -> tuple[int, np.ndarray]:
        pieces = sorted(zip(t.column("first").to_pylist(), (x.values.to_numpy() for x in t.column("v")), strict=True), key=lambda x: x[0])
        return (pieces[0][0], np.concatenate([v for _, v in pieces])) if pieces else (0, np.zeros(0))

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        (a0, x), (b0, y) = whole(a), whole(b)
        total = []
        for k, power in enumerate(powers, 1):
            steps, s = np.array([i * power % n for i in range(min(SEGMENT, len(x)))], np.int64), 0.0
            for lo in range(0, len(x), SEGMENT):
                part = x[lo : lo + SEGMENT]
                j = steps[: len(part)] + ((a0 + lo) * power + k) % n
                j -= np.where(j >= n, n, 0) + b0
                if blocks > 1:
                    inside = (j >= 0) & (j < len(y))
                    part, j = part[inside], j[inside]
                s += float(part @ y[j])
            total.append(s)
        return pa.table({"k": pa.array(range(1, count + 1), pa.int32()), "total": pa.array(total, pa.float64())})

    pairs = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(sums, "k int, total double")
    return pairs.groupBy("k").agg(F.sum("total").alias("total"))
