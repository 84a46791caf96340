import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import registry, resample
from tessera.llm.plainwords import plain_words
from tests.llm.helpers import AWKWARD, SF, documents, table
from tests.oracle import connect, difference

UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, longest=1):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)], len(ws)


def brute(docs, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    """(doc_id, n_features, weight, score, rank) of each document, by sorting them all."""
    b = lambda f: zlib.crc32(f.encode()) % buckets
    of = [Counter(b(f) for _, t in rows for f in features(t, longest)[0]) for rows in (docs, target)]
    s, t = (sum(c.values()) for c in of)
    gain = lambda k: math.floor(1000 * math.log((of[1][k] + 1.0) * (s + buckets) / ((of[0][k] + 1.0) * (t + buckets))))
    rows = []
    for d, text in docs:
        fs, n = features(text, longest)
        weight = sum(gain(b(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(docs, target, **options):
    return sorted((tuple(r) for r in resample.drawn(docs, target, ["doc_id"], **options).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def target(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


TEXTS = [(100 + i, " ".join(f"w{(i * k) % 17} É{k % 5}" for k in range(i))) for i in range(60)]


@pytest.mark.parametrize("options", [{}, {"percent": 50, "least": 1}, {"longest": 3, "buckets": 97, "percent": 100, "least": 0}, {"percent": 0}, {"seed": 7, "least": 10**6}])
def test_awkward_against_brute_force(spark, options):
    rows, wanted = [*AWKWARD, *TEXTS], [(1, "plain words É1 w3"), (2, None), (3, "w5 " * 40)]
    assert got(table(spark, rows), target(spark, wanted), **options) == brute(rows, wanted, **options)


def test_whole_table_against_sql(spark):
    assert difference(spark, connect(SF), SF, registry.op12_resampling, resample.ORACLE) is None


def test_whole_table_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    wanted = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in registry.op12_resampling(spark, SF).collect()), key=repr) == brute(docs, wanted)


def test_ranks_over_many_bins_and_ties(spark, monkeypatch):
    # few wide bins, many equal scores: every rank once, in the order of score and doc_id
    monkeypatch.setattr(resample, "BINS", 3)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.pmod(F.col("id") * 7919, F.lit(401)) - 200).alias("score"), (F.col("id") % 4 > 0).alias("fit"))
    rows = resample.materialize(rows, "ranks")
    out = resample.ranked(rows, F.col("fit"), lambda n: n // 3).collect()
    assert len(out) == 20_000
    want = sorted((r for r in out if r["fit"]), key=lambda r: (-r["score"], r["doc_id"]))
    assert [r["rank"] for r in want] == list(range(1, 5001)) + [None] * 10_000
    assert all(r["rank"] is None for r in out if not r["fit"])


def test_a_third_of_all_rows_with_one_score(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 10).cast("bigint").alias("score"))
    out = resample.ranked(resample.materialize(rows, "ranks"), F.lit(True), lambda n: n).collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 9001))


def test_empty_tables(spark):
    none = target(spark, [])
    assert resample.drawn(table(spark, []), none, ["doc_id"]).count() == 0
    assert got(table(spark, TEXTS), none) == brute(TEXTS, [])


def test_extra_columns_stay_and_do_not_clash(spark):
    docs = table(spark, TEXTS).withColumns({c: F.lit(i) for i, c in enumerate(["weight", "score", "rank", "features", "words", "bin", "bucket", "n_words"])})
    out = resample.drawn(docs, target(spark, [(1, "w1 w2")]), docs.columns)
    assert out.select("row.*").columns == docs.columns and out.count() == len(TEXTS)


def test_words_of_plain_words(spark):
    texts = [t for _, t in AWKWARD] + ["ÀÉ AbC İI", "a\x00b\x1cC", "x" * 200_000 + " Y", "À" * 3, "A1_b2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", plain_words(F.col("t")).alias("w"))
    for r in df.collect():
        assert r["w"] == features(texts[r["i"]])[0]
