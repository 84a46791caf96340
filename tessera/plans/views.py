"""Domain views over the generic tables: mentions, bars, trades, stories.

Each view exists twice: as a DataFrame and as the text of a SQL common table
expression with the same rows, which the oracles use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import load

#: Reference day of every look-back; nothing reads the clock.
AS_OF = "2024-01-30"


#: Bars between two entries of the studies that follow a price from an entry on: a parameter of theirs, as their SQL has it.
EVERY = 12


def today() -> Column:
    return F.lit(AS_OF).cast("date")


def by_day():
    """The window of a ticker's bars in order."""
    return Window.partitionBy("ticker").orderBy("day")


MENTIONS = """mentions AS (
  SELECT event_id AS mention_id, user_id AS entity_id, event_type AS sector, CAST(ts AS DATE) AS day, ts,
         (value - 20.0) / 20.0 AS sentiment, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity mentions: entity = user, sector = event type."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("mention_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("sector"),
        F.to_date("ts").alias("day"), "ts", ((F.col("value") - 20.0) / 20.0).alias("sentiment"),
        F.expr("try_cast(get_json_object(props, '$.k') AS int)").alias("k"),
    )


BARS = """ticks AS (
  SELECT l_partkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_extendedprice / l_quantity AS price,
         l_quantity AS qty, row_number() OVER (PARTITION BY l_partkey, date_trunc('month', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i,
         row_number() OVER (PARTITION BY l_partkey, date_trunc('month', l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS j
  FROM lineitem),
bars AS (
  SELECT ticker, day, max(CASE WHEN i = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
         max(CASE WHEN j = 1 THEN price END) AS close, sum(qty) AS volume
  FROM ticks GROUP BY ticker, day)"""


def bars(spark: SparkSession, sf_dir: str, by_ticker: bool = False) -> DataFrame:
    """Monthly price bars of every part. by_ticker: lines are shuffled by part, so that windows over a part's bars need no shuffle of their own."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = load(spark, sf_dir, "lineitem")
    return (
        (lines.repartition("l_partkey") if by_ticker else lines)
        .groupBy(F.col("l_partkey").alias("ticker"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum("l_quantity").alias("volume"))
    )


TRADES = """trades AS (
  SELECT o_orderkey AS trade_id, o_custkey AS account, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS entry_day,
         CAST(max(l_shipdate) AS DATE) AS exit_day, sum(l_extendedprice) AS invested,
         sum(l_extendedprice * (l_discount - l_tax)) AS pnl, min(l_partkey) AS ticker, count(*) AS fills
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: an order is the entry, its last shipment the exit."""
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")  # noqa: E741
    return (
        l.groupBy("l_orderkey").agg(
            F.to_date(F.max("l_shipdate")).alias("exit_day"), F.sum("l_extendedprice").alias("invested"),
            F.sum(F.expr("l_extendedprice * (l_discount - l_tax)")).alias("pnl"), F.min("l_partkey").alias("ticker"), F.count("*").alias("fills"),
        )
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_orderkey").alias("trade_id"), F.col("o_custkey").alias("account"), F.col("o_orderstatus").alias("status"),
                F.to_date("o_orderdate").alias("entry_day"), "exit_day", "invested", "pnl", "ticker", "fills")
    )


STORIES = """stories AS (
  SELECT doc_id AS story_id, lang AS sector, source AS source_name, text AS summary, n_chars,
         CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS DATE) AS day,
         1 + (doc_id * 7) % 10 AS importance FROM documents)"""


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated news stories."""
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("story_id"), F.col("lang").alias("sector"), F.col("source").alias("source_name"), F.col("text").alias("summary"), "n_chars",
        F.expr("date_add(DATE'2024-01-01', cast(doc_id % 60 as int))").alias("day"), F.expr("1 + (doc_id * 7) % 10").alias("importance"),
    )


ARTICLES = r"""articles AS (
  SELECT doc_id, coalesce(string_split(text, '.')[1], '') AS headline, coalesce(text, '') AS summary, coalesce(string_split(text, chr(10))[-1], '') AS key_facts,
         coalesce(string_split(text, '.')[2], '') AS why_it_matters, coalesce(source, '') AS context_prefix
  FROM documents WHERE doc_id IS NOT NULL)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stories with the fields of a search: first and second sentence, whole text, last line, source."""
    sentences, lines = F.split("text", r"\."), F.split("text", "\n")
    return load(spark, sf_dir, "documents").where("doc_id is not null").select(
        "doc_id", *[F.coalesce(c, F.lit("")).alias(n) for n, c in {
            "headline": F.get(sentences, F.lit(0)), "summary": F.col("text"), "key_facts": F.get(lines, F.size(lines) - 1), "why_it_matters": F.get(sentences, F.lit(1)), "context_prefix": F.col("source"),
        }.items()],
    )
