"""Importance resampling towards a target distribution, with exact ranks from a histogram of integer scores.

Features are runs of 1 to ``longest`` consecutive words, hashed into ``buckets``. Counted over all documents and over all
target texts, they give each bucket an integer gain (the floor of 1000 times the logarithm of the smoothed ratio of
its shares). The gains are one array, so a document's weight is a sum of array look-ups within its row: texts are
never shuffled. Adding noise that depends on the seed and the doc_id only (an integer Gumbel variate) makes the highest
scores a draw without replacement, in proportion to the weights.

Ranks come from the histogram of scores, not from a sort of the documents:

* the range of scores is cut into at most ``BINS`` bins; counts of the bins, summed from the top, say how many documents lie
  above each bin, and which bin holds the cutoff (a list of at most BINS numbers on the driver);
* within each bin from there on, the counts of its scores are summed from the top likewise, all bins side by side: a
  score's offset is the number of documents above it. The lowest score with an offset below the number drawn is the cutoff;
* a document's rank is its score's offset plus its row number, by doc_id, among those of the same score.

So a task orders the documents of one score, or the scores of one bin: at most the range of scores over BINS.

Defined cases: null text has no words; a null doc_id is the empty string in the noise, and comes last among ties; rows repeated as
a whole get ranks one after another; texts with fewer than ``least`` words are scored but never drawn; an empty target
has no features (all its counts are 0); an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import plainwords
from tessera.llm.common import documents, materialize
from tessera.llm.plainwords import plain_words

BUCKETS, LONGEST, SEED, LEAST, PERCENT = 10_000, 1, 2024, 20, 10
BINS = 4096


def features(words: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to ``longest`` words, joined by one space."""
    if longest == 1:
        return words
    runs = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(runs(n), none) for n in range(1, longest + 1)])


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def counted(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all texts."""
    each = texts.select(F.explode(features(plain_words(texts["text"]), longest)).alias("feature"))
    return each.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """The gain of every bucket, from all texts of both tables. The list has one number a bucket, however large the tables."""
    spark = docs.sparkSession
    source, wanted = counted(docs, buckets, longest).withColumnRenamed("n", "s"), counted(target, buckets, longest).withColumnRenamed("n", "t")
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(source, "bucket", "left").join(wanted, "bucket", "left").fillna(0)
    both = both.crossJoin(F.broadcast(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))
    x = lambda c: F.col(c).cast("double")
    ratio = ((x("t") + 1) * (x("all_s") + buckets)) / ((x("s") + 1) * (x("all_t") + buckets))
    rows = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """An integer Gumbel variate (thousandths) of a doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, by_bucket: list[int], keep: list[str], longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(row: struct of the columns ``keep``, doc_id, n_words, n_features, weight, score) of every row; needs doc_id and text."""
    array = F.split(F.lit(",".join(map(str, by_bucket))), ",").cast("array<bigint>")  # folded into one constant
    x = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs["doc_id"].alias("doc_id"), plain_words(docs["text"]).alias("words"))
    x = x.withColumn("features", features(F.col("words"), longest))
    weight = F.aggregate("features", F.lit(0).cast("bigint"), lambda a, w: a + F.get(array, bucket(w, len(by_bucket))))
    x = x.select("row", "doc_id", F.size("words").cast("bigint").alias("n_words"), F.size("features").cast("bigint").alias("n_features"), weight.alias("weight"))
    return x.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, eligible: Column, draw) -> DataFrame:
    """Adds ``rank`` to rows (doc_id, score, ...), which must be written somewhere: from 1, by falling score, then doc_id; null if not drawn.

    draw gives the number to draw from the number of eligible rows.
    """
    spark = rows.sparkSession
    stats = rows.where(eligible).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    most = draw(stats["n"])
    if not most:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    low, width = stats["low"], (stats["high"] - stats["low"]) // BINS + 1
    binned = rows.where(eligible).groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", F.expr(f"(score - ({low}L)) div {width}L"))
    above, first = 0, []
    for r in sorted(binned.groupBy("bin").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["bin"]):  # at most BINS
        if above >= most:
            break
        first.append((r["bin"], above))
        above += r["n"]
    cut = first[-1][0]
    starts = F.broadcast(spark.createDataFrame(first, "bin bigint, above bigint"))
    down = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = binned.where(F.col("bin") >= cut).withColumn("upto", F.sum("n").over(down)).join(starts, "bin")
    offsets = offsets.select("score", (F.col("above") + F.col("upto") - F.col("n")).alias("offset")).where(F.col("offset") < most)
    high = eligible & (F.col("score") >= low + cut * width)
    same = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))
    rank = F.col("offset") + F.row_number().over(same)
    # scores of the last bin below the cutoff have no offset
    top = rows.where(high).join(offsets, "score", "left").withColumn("rank", F.when(rank <= most, rank)).select(*rows.columns, "rank")
    return top.unionByName(rows.where(~F.coalesce(high, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint")))


def drawn(docs: DataFrame, target: DataFrame, keep: list[str], percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """Every row with its weight, score and rank: ``percent`` of the texts with ``least`` words or more are drawn."""
    rows = materialize(scored(docs, gains(docs, target, buckets, longest), keep, longest, seed), "resample-scores")
    return ranked(rows, F.col("n_words") >= least, lambda n: percent * n // 100)


def benchmark_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    x = drawn(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return x.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of every distinct word by its bytes: ``tab`` is the table of the polynomial, from its rule.
CRC32 = """t0 AS (SELECT i::UBIGINT AS i, i::UBIGINT AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM t0 WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM t0 WHERE k = 8)"""
_NIBBLE = "(strpos('0123456789ABCDEF', substr(hex(encode({0})), 2 * j::INT + {1}, 1)) - 1)"
_BYTES = f"list_transform(range(length(hex(encode({{0}}))) // 2), lambda j: ({_NIBBLE.format('{0}', 1)} * 16 + {_NIBBLE.format('{0}', 2)})::UBIGINT)"
#: For a column, with ``tab`` in scope.
CRC32_OF = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {_BYTES}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"
_HEX = functools.reduce(operator.add, [f" + (strpos('0123456789abcdef', substr(x, {i + 1}, 1)) - 1) * {16 ** (7 - i)}::DOUBLE" for i in range(8)], "0.5")

ORACLE = rf"""WITH RECURSIVE {CRC32},
d AS (SELECT row_number() OVER () AS r, doc_id, {plainwords.SQL.format("text")} AS ws FROM documents),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({plainwords.SQL.format("text")}) AS w FROM benchmark) GROUP BY ALL),
v AS (SELECT w, {CRC32_OF.format("w")} % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
s AS (SELECT b, sum(n)::DOUBLE AS s FROM dw JOIN v USING (w) GROUP BY b), t AS (SELECT b, sum(n)::DOUBLE AS t FROM bw JOIN v USING (w) GROUP BY b),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS S1, (SELECT coalesce(sum(t), 0) FROM t) AS T1),
g AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * (S1 + {BUCKETS})) / ((coalesce(s, 0) + 1) * (T1 + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (b), z),
u AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY r),
h AS (SELECT r, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS x FROM d LEFT JOIN u USING (r)),
c AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(({_HEX}) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= {LEAST})
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM c LEFT JOIN k USING (r)"""
