"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines). Every paragraph is hashed
into a wide vector, and the document's fingerprint is the sum of these vectors:

* ``EXACT`` lanes modulo 2**64 from a keyed cryptographic hash of the paragraph:
  equal multisets have equal sums, different ones differ but for chance;
* ``LANES`` lanes modulo 2**32 into which the paragraph's words and neighbouring word pairs
  fall with hashed signs: their cosine estimates how alike two documents are.

Sums do not depend on order, so a paragraph is inserted by adding its vector and
deleted by subtracting it (``insert``, ``delete``), without reading the rest.

``edited_neighbours`` compares each document with an edited version of itself and with
the next document. Documents are ordered by id (null last), rows of one id by the hash of
their text. Id ranges are processed apart; each range gets a copy of the first document of
the next range, so no task needs more than two texts at a time and no global sort is made.

Defined cases: null text is an empty one; an empty text is one empty paragraph; a
table of one row has itself as the next document; likeness is 1 for equal fingerprints,
0 if either has no words, else the cosine, cut at 0.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.wordhash import mix, word_hashes, words

EXACT, LANES = 4, 128
#: Least rows of one id range (about). Ranges are as long as there are many, the root of all rows, so what the
#: driver holds (one id for each) stays small beside the table; a range streams through its task.
RANGE_ROWS = 5_000


class Fingerprint:
    """Two arrays of lanes; the sum over paragraphs."""

    def __init__(self, text: str = ""):
        self.exact = np.zeros(EXACT, dtype=np.uint64)
        self.lanes = np.zeros(LANES, dtype=np.int32)
        if text is not None:
            self._add(text, 1)

    def _add(self, text: str, sign: int) -> None:
        raw = text.encode()
        digests = b"".join([hashlib.blake2b(p, digest_size=8 * EXACT, key=b"paragraph").digest() for p in raw.split(b"\n")])
        total = np.frombuffer(digests, dtype="<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
        starts, ends = words(raw)
        h = word_hashes(raw, starts, ends)
        if len(h):
            breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
            line = np.searchsorted(breaks, starts)
            pairs = mix(h[:-1] * np.uint64(3) + h[1:])[line[:-1] == line[1:]]
            h = np.concatenate([h, pairs])
            signs = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
            lanes = np.bincount((h % np.uint64(LANES)).astype(np.int64), weights=signs, minlength=LANES).astype(np.int64).astype(np.int32)
        else:
            lanes = np.zeros(LANES, dtype=np.int32)
        if sign > 0:
            self.exact, self.lanes = self.exact + total, self.lanes + lanes
        else:
            self.exact, self.lanes = self.exact - total, self.lanes - lanes

    @classmethod
    def empty(cls) -> Fingerprint:
        """Of no paragraph at all."""
        return cls(None)

    def insert(self, paragraph: str) -> None:
        self._add(paragraph, 1)

    def delete(self, paragraph: str) -> None:
        self._add(paragraph, -1)

    def __str__(self) -> str:
        return base64.b64encode(self.exact.astype("<u8").tobytes() + self.lanes.astype("<i4").tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        if (self.exact == other.exact).all() and (self.lanes == other.lanes).all():
            return 1.0
        a, b = self.lanes.astype(np.float64), other.lanes.astype(np.float64)
        norm = float(np.sqrt(a @ a) * np.sqrt(b @ b))
        return max(0.0, min(1.0, float(a @ b) / norm)) if norm else 0.0


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([str(Fingerprint(t.as_py() or "")) for t in b.column(1)], pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col]).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edit(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as much of the beginning of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, doc_id, text), sorted; every range ends with a guest, which only serves as a next document."""
    held: tuple | None = None  # id, text, fingerprint
    for b in batches:
        rows = []
        for _, guest, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            mark = Fingerprint(text)
            if held is not None:
                changed = edit(held[1], text)
                other = Fingerprint(changed)
                rows.append((held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), str(held[2]), str(other), held[2].likeness(other), held[2].likeness(mark)))
            held = None if guest else (doc, text, mark)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """One row for each document: its fingerprint, its edited text's, and how alike it is to the edited text and the next document."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = d.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // max(RANGE_ROWS, math.isqrt(count))))
    cuts = sorted(set(d.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if count and n > 1 else []
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="_id", outputCol="_range", handleInvalid="keep")

    def ranged(x: DataFrame) -> DataFrame:
        return ranges.transform(x.withColumn("_id", F.col("doc_id").cast("double"))).withColumn("_range", F.col("_range").cast("int")).drop("_id")

    # the first id of each range: one row for each range
    firsts = [(r["_range"], r["first"]) for r in ranged(d.select("doc_id")).groupBy("_range").agg(F.min("doc_id").alias("first")).orderBy("_range").collect()]
    follows = [(firsts[i][0], firsts[(i + 1) % len(firsts)][1]) for i in range(len(firsts))]
    guide = F.broadcast(spark.createDataFrame(follows, "_range int, first bigint"))
    guests = (
        d.join(guide, d["doc_id"].eqNullSafe(guide["first"]))
        .groupBy("_range", "doc_id")
        .agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("least"))
        .select("_range", F.lit(1).alias("_guest"), "doc_id", F.col("least.text").alias("text"))
    )
    rows = ranged(d).select("_range", F.lit(0).alias("_guest"), "doc_id", "text").unionByName(guests)
    return (
        rows.repartitionById(len(splits), F.col("_range"))
        .sortWithinPartitions("_range", "_guest", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
        .mapInArrow(_compare, RESULT)
    )
