"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors become integers, floor(1024 * x). Each is cut into equal segments; of each segment the
mean and the deviation (root of the squared distance from the mean) are kept. For a query q
and a candidate v, the score is (|q|^2 + |v|^2 - d^2) / 2, and by Cauchy-Schwarz on the
centred segments the squared distance is at least

    d^2 >= sum over segments of  w * (mean_q - mean_v)^2 + (dev_q - dev_v)^2

so segment statistics bound every score from above. The bounds are computed from coarse to
fine (``LEVELS`` segments); a candidate whose bound falls below the query's k-th best
exact score so far is dropped. Exact integer scores are computed for the survivors.

Queries are a stated set. A task is a pair of a block of ``BLOCK`` queries and a range of ``RANGE`` rows (about):
both are dealt evenly, whatever their ids; a row goes to as many tasks as there are blocks, and a query to as many
as there are ranges. Nothing passes through the driver but the two counts. Every task keeps its k best for
each query, and only those are shuffled.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no
part; a query meets the vectors of its own length; rows with equal ids are told apart except that a query never meets rows of its own id; ties go to the smaller
id; queries with no candidate have no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 10
SCALE = 1024
#: Queries and rows (about) of one task.
BLOCK, RANGE = 4096, 200_000
LEVELS = (2, 4, 8, 16)
#: Candidates compared at once in a task.
CHUNK = 2048


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and q array<bigint> of the vectors that take part."""
    x = F.col("embedding")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & ~odd).select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("q"))


class Resolutions:
    """Segment means and deviations of the rows of a matrix, coarse to fine."""

    def __init__(self, m: np.ndarray):
        self.exact = m
        self.square = (m * m).sum(axis=1)
        self.levels = []
        for s in LEVELS:
            cuts = [i * m.shape[1] // s for i in range(s + 1)]
            width = np.diff(cuts)
            cuts, width = [c for c, w in zip(cuts, width, strict=False) if w] + [m.shape[1]], width[width > 0]
            f = m.astype(np.float64)
            mean = np.add.reduceat(f, cuts[:-1], axis=1) / width
            dev = np.sqrt(np.maximum(np.add.reduceat(f * f, cuts[:-1], axis=1) - width * mean * mean, 0))
            self.levels.append(np.hstack([mean * np.sqrt(width), dev]))

    def rows(self, at: np.ndarray | slice) -> Resolutions:
        out = object.__new__(Resolutions)
        out.exact, out.square, out.levels = self.exact[at], self.square[at], [x[at] for x in self.levels]
        return out


class Best:
    """The k best rows so far for each query; queries and rows have one length."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = ids, Resolutions(matrix), k
        n = len(ids)
        self.scores = [np.zeros(0, dtype=np.int64)] * n
        self.ids = [np.zeros(0, dtype=np.int64)] * n
        self.floor = np.full(n, -np.inf)
        self.half_q = self.queries.square / 2.0

    def add(self, cand_ids: np.ndarray, matrix: np.ndarray) -> None:
        query_ids, queries, scores, ids, floor, k = self.query_ids, self.queries, self.scores, self.ids, self.floor, self.k
        c = Resolutions(matrix)
        # coarsest bound for all, then ever finer ones for what is left of each query
        gap = self.half_q[:, None] + c.square[None, :] / 2.0
        bound = gap - _half_distance(queries.levels[0], c.levels[0])
        for i in range(len(query_ids)):
            left = np.flatnonzero((bound[i] + 1e-3 * (1 + abs(gap[i])) * 1e-3 >= floor[i]) & (cand_ids != query_ids[i]))
            if len(scores[i]) == k:
                for q_level, c_level in zip(queries.levels[1:], c.levels[1:], strict=True):
                    if not len(left):
                        break
                    diff = c_level[left] - q_level[i]
                    upper = gap[i, left] - (diff * diff).sum(axis=1) / 2
                    left = left[upper + 1e-6 * (1 + np.abs(gap[i, left])) >= floor[i]]
            if not len(left):
                continue
            s = np.concatenate([scores[i], c.exact[left] @ queries.exact[i]])
            d = np.concatenate([ids[i], cand_ids[left]])
            top = np.lexsort((d, -s))[:k]
            scores[i], ids[i] = s[top], d[top]
            if len(top) == k:
                floor[i] = s[top[-1]]

    def found(self) -> Iterator[tuple[int, int, int]]:
        """(query, candidate, score)."""
        for q, ids, scores in zip(self.query_ids.tolist(), self.ids, self.scores, strict=True):
            for d, s in zip(ids.tolist(), scores.tolist(), strict=True):
                yield q, d, s


def by_length(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of the rows of each length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    sizes = np.unique(lengths).tolist()
    if len(sizes) == 1:
        yield sizes[0], ids, vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), sizes[0])
        return
    for size in sizes:
        at = np.flatnonzero(lengths == size)
        yield size, ids[at], vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def _half_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half of the squared distances between all rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0) / 2


def top_k(vectors: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    v = integers(vectors).where(F.col("vec_id").isNotNull())
    asked = v.where(F.col("vec_id") % every == 0).distinct()
    rows, queries = v.count(), asked.count()
    blocks = max(1, -(-queries // BLOCK))
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    ranges = max(1, -(-rows // RANGE), min(width, -(-rows // CHUNK)))
    number = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).cast("int")  # they are distinct, so they spread
    dealt = asked.select(block.alias("block"), F.lit(0).alias("kind"), "vec_id", "q").withColumn("range", each(ranges))
    dealt = dealt.unionByName(v.select(number(ranges).alias("range"), F.lit(1).alias("kind"), "vec_id", "q").withColumn("block", each(blocks)))
    dealt = dealt.select((F.col("range") * blocks + F.col("block")).alias("task"), "kind", "vec_id", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.Array, pa.Array]] = []  # queries, which come first; then rows
        best: dict[int, Best] | None = None

        def joined() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            ids, vectors = (pa.concat_arrays([w[i] for w in waiting]) for i in (0, 1))
            waiting.clear()
            return by_length(ids.to_numpy(zero_copy_only=False), vectors)

        def compare() -> None:
            for size, ids, matrix in joined():
                if size in best:
                    best[size].add(ids, matrix)

        for b in batches:
            first = int(np.searchsorted(b.column(1).to_numpy(zero_copy_only=False), 1))
            if first:
                waiting.append((b.column(2).slice(0, first), b.column(3).slice(0, first)))
            if first == b.num_rows:
                continue
            if best is None:
                best = {size: Best(ids, matrix, k) for size, ids, matrix in joined()} if waiting else {}
            for at in range(first, b.num_rows, CHUNK):
                waiting.append((b.column(2).slice(at, CHUNK), b.column(3).slice(at, CHUNK)))
                if sum(len(w[0]) for w in waiting) >= CHUNK:
                    compare()
        if best and waiting:
            compare()
        found = [x for b in (best or {}).values() for x in b.found()]
        columns = zip(*found, strict=True) if found else [[]] * 3
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    pairs = dealt.repartitionById(ranges * blocks, F.col("task")).sortWithinPartitions("kind")
    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_hundredth(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: SQL with the same rows, for tables whose vectors all have one length.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(a.q)), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
