"""The bucketed upsert table: what a batch rewrites, and that a batch run twice changes nothing."""

import glob
import random

from pyspark.sql import functions as F

from tessera.sources import buckets

MERGE = buckets.Merge(["k"], overwrite=["a"], add=["n"], fill=["f"])
SCHEMA = "t int, k string, a string, n bigint, f string"
OUT = "k string, a string, n bigint, f string"


def put(spark, path, epoch, rows, n=8):
    return buckets.apply(spark.createDataFrame(rows, SCHEMA), path, epoch, MERGE, F.col("t"), n)


def rows(spark, path, epoch):
    return sorted(tuple(r) for r in buckets.read(spark, path, epoch, spark.createDataFrame([], OUT).schema).collect())


def test_overwrite_add_and_fill(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, 0, [(1, "x", "a1", 1, None), (2, "x", "a2", 2, None), (1, "y", "b", 5, "first"), (1, None, "no", 1, "no")])
    assert rows(spark, path, 0) == [("x", "a2", 3, None), ("y", "b", 5, "first")]
    put(spark, path, 1, [(3, "x", None, 1, "late"), (4, "x", "a4", 1, "later"), (3, "y", None, 1, "second"), (3, "z", "c", 0, None)])
    assert rows(spark, path, 1) == [("x", "a4", 5, "late"), ("y", "b", 6, "first"), ("z", "c", 0, None)]
    assert rows(spark, path, 0) == [("x", "a2", 3, None), ("y", "b", 5, "first")]  # the version before is still there


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    for epoch in (0, 1, 1, 1):
        put(spark, path, epoch, [(1, f"k{i % 5}", f"v{epoch}", 1, None) for i in range(10)])
    assert rows(spark, path, 1) == [(f"k{i}", "v1", 4, None) for i in range(5)]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    every = put(spark, path, 0, [(1, f"k{i}", "old", 1, None) for i in range(200)], 16)
    assert len(every) == 16
    touched = put(spark, path, 1, [(2, "k7", "new", 1, None)], 16)
    assert len(touched) == 1 and len(glob.glob(f"{path}/data/epoch=1/bucket=*")) == 1
    now = buckets.manifest(spark, path, 1)
    assert sum(e == 1 for e in now.values()) == 1 and sum(e == 0 for e in now.values()) == 15
    assert sum(r[1] == "new" for r in rows(spark, path, 1)) == 1 and len(rows(spark, path, 1)) == 200


def test_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, 0, [(1, "x", "a", 1, None)])
    assert put(spark, path, 1, []) == [] and rows(spark, path, 1) == [("x", "a", 1, None)]


def test_against_a_dictionary(spark, tmp_path):
    rng, path, want = random.Random(3), str(tmp_path / "t"), {}
    for epoch in range(4):
        batch = [(i, f"k{rng.randrange(30)}", rng.choice([None, f"a{epoch}{i}"]), rng.randrange(5), rng.choice([None, None, f"f{i}"])) for i in range(40)]
        put(spark, path, epoch, batch, 4)
        for _, k, a, n, f in batch:
            old = want.get(k, (None, 0, None))
            want[k] = (a if a is not None else old[0], old[1] + n, old[2] if old[2] is not None else f)
        assert rows(spark, path, epoch) == sorted((k, *v) for k, v in want.items())


def test_as_a_stream_sink(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    for i in range(3):
        spark.createDataFrame([(i, f"k{j}", f"v{i}", 1, None) for j in range(4)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream.writeStream.foreachBatch(buckets.sink(path, MERGE, F.col("t"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    assert [(r[0], r[2]) for r in rows(spark, path, last)] == [(f"k{j}", 3) for j in range(4)]
