"""Folders for intermediate files that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir. Only a local master without that setting (tests) gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(named)
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing will read again, and let Spark drop the shuffles that nothing refers to."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table._folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    sc._jvm.System.gc()  # Spark's cleaner only sees that a shuffle is unreachable when the JVM collects


def dropped(lines: DataFrame, name: str, by: str | None = None) -> str:
    """The path of text files of a column of lines, one folder for each value of ``by``: how a service would leave them."""
    path = folder(lines.sparkSession, name)
    (lines.write.partitionBy(by) if by else lines.write).text(path)
    return path
