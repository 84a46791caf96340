"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch handed to Python. Documents can be very long, so a
#: batch ends with the row that exceeds either.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators by rows and bytes.

    The session keeps this setting: Spark reads it when the query runs, not when it is made.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master without that setting (tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Folders written by ``materialize`` in this process and not deleted yet.
written: list[str] = []
_gathering: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("gathering", default=None)


@contextlib.contextmanager
def gathered() -> Iterator[list[str]]:
    """The folders that ``materialize`` writes inside the block, in this thread alone: what the block's owner may delete."""
    mine: list[str] = []
    token = _gathering.set(mine)
    try:
        yield mine
    finally:
        _gathering.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage like checkpoint(), survives lost executors, and computes df
    once (a reliable checkpoint() computes its last stage twice).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written.append(path)
    if (mine := _gathering.get()) is not None:
        mine.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again, and let Spark drop the shuffles behind them."""
    delete([t._folder for t in tables])


def delete(folders: list[str]) -> None:
    """Delete folders in the shared folder, and let Spark drop the shuffles that nothing refers to."""
    sc = SparkSession.active().sparkContext
    jvm, hadoop = sc._jvm, sc._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
        if folder in written:
            written.remove(folder)
    gc.collect()
    jvm.System.gc()  # Spark's cleaner only sees that a shuffle is unreachable when the JVM collects


def release() -> None:
    """Give memory that Python no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def freed(run: Callable) -> Callable:
    """A function for mapInArrow that needs no large model: the worker drops the one it holds, and gives memory back after the task.

    Workers outlive their tasks and stages, and two of them share an executor's memory with its JVM.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()  # by name: a nested function that is sent to workers takes copies of this module's variables along
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def vacate() -> None:
    """Drop the model held for ``resident``."""
    _resident.clear()


_resident: dict[tuple, object] = {}


def resident(key: tuple, build: Callable[[], object]):
    """What build() gives, kept in this process until another key is asked for.

    Python workers outlive their tasks; only the one large model in use stays in memory.
    """
    if key not in _resident:
        if _resident:
            _resident.clear()
            release()
        _resident[key] = build()
    return _resident[key]
