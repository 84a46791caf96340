"""A keyed table that takes upserts: rows lie in buckets of their key's hash, and a batch rewrites only the buckets it touches.

    table/data/epoch=E/bucket=B/   the rows of bucket B as batch E left them
    table/manifest/vE/             (bucket, epoch): which epoch of each bucket makes up the table after batch E

Batch E starts from manifest E - 1 and writes folders of its own, so running it again gives the same table: exactly once. A version is there
when its manifest is, which Spark commits last. The manifest has a row for each bucket, however large the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import upsert, upsert_changed

BUCKETS = 64


@dataclass(frozen=True)
class Merge:
    """What a batch does to a row of the same key: overwrite with the latest value, add up, or fill only where null."""

    keys: list[str]
    overwrite: list[str] = field(default_factory=list)
    add: list[str] = field(default_factory=list)
    fill: list[str] = field(default_factory=list)


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def folded(batch: DataFrame, merge: Merge, order: Column) -> DataFrame:
    """One row a key from a batch, as if its rows had been merged one after another in ``order``."""
    told = lambda c: F.when(F.col(c).isNotNull(), order)  # noqa: E731  a null neither overwrites nor fills, as in ``upsert``
    last = [F.max_by(c, told(c)).alias(c) for c in merge.overwrite]
    total = [F.sum(c).alias(c) for c in merge.add]
    first = [F.min_by(c, told(c)).alias(c) for c in merge.fill]
    return batch.dropna(subset=merge.keys).groupBy(*merge.keys).agg(*last, *total, *first)


def manifest(spark: SparkSession, path: str, epoch: int) -> dict[int, int]:
    """Bucket to epoch after a batch; before the first batch the table is empty."""
    return {r["bucket"]: r["epoch"] for r in spark.read.parquet(f"{path}/manifest/v{epoch}").collect()} if epoch >= 0 else {}


def _rows(spark: SparkSession, path: str, parts: dict[int, int], schema) -> DataFrame:
    folders = [f"{path}/data/epoch={e}/bucket={b}" for b, e in sorted(parts.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _rewrite(new: DataFrame, path: str, epoch: int, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int) -> list[int]:
    """Version ``epoch`` of the table from one row a key: old rows of the touched buckets merged with the new ones."""
    spark = new.sparkSession
    columns = new.columns
    new = new.withColumn("bucket", _bucket(keys, buckets)).persist()
    try:
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        before = manifest(spark, path, epoch - 1)
        rows = new.drop("bucket")
        old = _rows(spark, path, {b: e for b, e in before.items() if b in set(touched)}, rows.schema)
        merge(old, rows).select(*columns).withColumn("bucket", _bucket(keys, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
        after = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(after.items()), "bucket int, epoch int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{epoch}")
    finally:
        new.unpersist()
    return touched


def apply(batch: DataFrame, path: str, epoch: int, merge: Merge, order: Column, buckets: int = BUCKETS) -> list[int]:
    """Merge a batch into the table as its version ``epoch`` (from 0, one after another); returns the buckets that were rewritten.

    Rows with a null in their key are left out. Every batch must have the same columns.
    """
    return _rewrite(folded(batch, merge, order), path, epoch, merge.keys, lambda old, new: upsert(old, new, merge.keys, merge.overwrite, merge.add, merge.fill), buckets)


def apply_changed(batch: DataFrame, path: str, epoch: int, keys: list[str], watched: list[str], others: list[str], buckets: int = BUCKETS) -> list[int]:
    """The same for rows that change, with all their columns, only if a watched one does. A batch has each key once."""
    return _rewrite(batch.dropna(subset=keys), path, epoch, keys, lambda old, new: upsert_changed(old, new, keys, watched, others), buckets)


def read(spark: SparkSession, path: str, epoch: int, schema) -> DataFrame:
    """The table as batch ``epoch`` left it."""
    return _rows(spark, path, manifest(spark, path, epoch), schema)


def sink(path: str, merge: Merge, order: Column, buckets: int = BUCKETS):
    """A foreachBatch function."""
    return lambda batch, epoch: apply(batch, path, epoch, merge, order, buckets) and None
