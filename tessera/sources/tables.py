"""Table sources and sinks: price panels, tab-separated filings, headlines, upserts, retention, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.relational import upsert

BARS = "sym string, date date, o double, h double, l double, c double, v double"
#: Ids up to this many (8 bytes each) are broadcast by ``by_ids``; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def bars(spark: SparkSession, path: str) -> DataFrame:
    """Long daily bars; partition pruning by sym if the folder is partitioned so."""
    return spark.read.schema(BARS).parquet(path)


def save_bars(df: DataFrame, path: str) -> None:
    """One folder for each symbol; what is there already stays (resumable)."""
    df.repartition("sym").write.mode("ignore").partitionBy("sym").parquet(path)


def liquid_panel(df: DataFrame, least: float = 1e7, days: int = 20) -> DataFrame:
    """All bars of symbols whose mean dollar volume of ``days`` bars ever reached ``least``; stays long."""
    w = Window.partitionBy("sym").orderBy("date").rowsBetween(-(days - 1), 0)
    dollar = df.withColumn("d", F.avg(F.col("c") * F.col("v")).over(w))
    return dollar.withColumn("m", F.max("d").over(Window.partitionBy("sym"))).where(F.col("m") >= least).drop("d", "m")


def wide(df: DataFrame, symbols: list[str], value: str = "c") -> DataFrame:
    """One column for each of a short list of symbols, one row a date."""
    return df.where(F.col("sym").isin(symbols)).groupBy("date").pivot("sym", symbols).agg(F.max(value))


def preload(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Bars of the listed tickers, the high standing in for itself or the close: a join, where single statements would need chunks of ids."""
    return by_ids(df, tickers, "sym").withColumn("h", F.coalesce("h", "c")).withColumn("l", F.coalesce("l", "c"))


def insider_features(trades: DataFrame) -> DataFrame:
    """Per symbol and filing day: net dollars bought, number of buyers, of officers among them, largest ownership change, mean lag."""
    buy = F.col("code") == "P"
    return trades.where(F.col("code").isin("P", "S")).groupBy("sym", "filed").agg(
        F.sum(F.when(buy, F.col("usd")).otherwise(-F.col("usd"))).alias("net_usd"), F.count_distinct(F.when(buy, F.col("owner"))).alias("buyers"),
        F.count_distinct(F.when(buy & F.col("is_officer"), F.col("owner"))).alias("officers"), F.max(F.when(buy, F.col("own_chg"))).alias("own_chg"), F.avg("lag_days").alias("lag"),
    )


def insider_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Three tab-separated tables of ownership forms, joined on the accession number, with ownership change and filing lag."""
    read = lambda n, schema: spark.read.option("sep", "\t").option("header", True).schema(schema).csv(f"{folder}/{n}")
    sub = read("SUBMISSION.tsv", "ACCESSION_NUMBER string, FILING_DATE string, ISSUERTRADINGSYMBOL string")
    own = read("REPORTINGOWNER.tsv", "ACCESSION_NUMBER string, RPTOWNERCIK string, RPTOWNER_RELATIONSHIP string")
    tra = read("NONDERIV_TRANS.tsv", "ACCESSION_NUMBER string, TRANS_DATE string, TRANS_CODE string, TRANS_SHARES double, TRANS_PRICEPERSHARE double, SHRS_OWND_FOLWNG_TRANS double")
    day = lambda c: F.try_to_date(F.col(c), "dd-MMM-yyyy")
    x = tra.join(sub, "ACCESSION_NUMBER").join(own, "ACCESSION_NUMBER")
    before = F.col("SHRS_OWND_FOLWNG_TRANS") - F.col("TRANS_SHARES")
    role = lambda r: F.coalesce(F.lower("RPTOWNER_RELATIONSHIP").contains(r), F.lit(False))
    return x.select(
        F.col("ISSUERTRADINGSYMBOL").alias("sym"), day("FILING_DATE").alias("filed"), day("TRANS_DATE").alias("traded"), F.col("TRANS_CODE").alias("code"),
        (F.col("TRANS_SHARES") * F.col("TRANS_PRICEPERSHARE")).alias("usd"), F.col("TRANS_SHARES").alias("shares"), F.try_divide("TRANS_SHARES", before).alias("own_chg"),
        F.col("RPTOWNERCIK").alias("owner"), role("director").alias("is_director"), role("officer").alias("is_officer"), F.date_diff(day("FILING_DATE"), day("TRANS_DATE")).alias("lag_days"),
    )


def single_ticker_headlines(df: DataFrame, col: str = "stocks") -> DataFrame:
    """Headlines that name exactly one ticker."""
    return df.where(F.size(F.split(F.col(col), ",")) == 1).withColumn("sym", F.trim(col))


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; a list of a checked, small size is broadcast."""
    few = ids.select(key).distinct()
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, key, "left_semi")


def upsert_sink(path: str, keys: list[str], **kinds: list[str]):
    """A foreachBatch function that merges each batch into a Parquet table by writing a new version beside it.

    Versions are numbered by batch, so a batch that is run again writes the same version: exactly once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{epoch - 1}") if epoch else spark.createDataFrame([], batch.schema)
        upsert(old, batch, keys, **kinds).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return write


def replace_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replace the partitions of the days in df, leaving the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def retain(df: DataFrame, day: Column, as_of: Column, days: int = 180) -> DataFrame:
    """Rows of the last so many days."""
    return df.where(day >= F.date_sub(as_of, days))


def snapshot(df: DataFrame, path: str) -> None:
    """JSON lines; the committer makes the folder appear whole or not at all."""
    df.write.mode("overwrite").json(path)
