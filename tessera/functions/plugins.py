"""Extension points: embedder, entity extractor, language model, notifier; and the guard against mixed vector spaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Embedder = Callable[[list[str], str], np.ndarray]
Extractor = Callable[[str], list[tuple[str, str]]]
Notifier = Callable[[str, str], None]


def hash_embedder(size: int = 64) -> Embedder:
    """Deterministic embedding for tests: signed counts of hashed words, unit length."""
    import hashlib

    def embed(texts: list[str], kind: str) -> np.ndarray:
        out = np.zeros((len(texts), size), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed(df: DataFrame, embedder: Embedder, model: str, text: str = "text", kind: str = "document") -> DataFrame:
    """Adds embedding and model, one Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(x.fillna("").tolist(), kind)))

    return df.withColumn("embedding", run(F.col(text))).withColumn("model", F.lit(model))


def extract(df: DataFrame, extractor: Extractor, key: str, text: str = "text") -> DataFrame:
    """(key, entity, kind): what the extractor finds in each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, e, t) for k, x in zip(pdf[key], pdf[text], strict=True) for e, t in extractor(x or "")]
            yield pd.DataFrame(rows, columns=[key, "entity", "kind"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, entity string, kind string")


def one_space(vectors: DataFrame, model: str = "model") -> DataFrame:
    """vectors, after checking that they all come from one model; a ValueError names them otherwise."""
    found = [r[0] for r in vectors.select(model).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"vectors of several models: {sorted(map(str, found))}")
    return vectors


def register(spark: SparkSession, name: str, function, kind: str) -> None:
    """Make a Python function available in SQL; pandas functions where speed matters."""
    spark.udf.register(name, function if hasattr(function, "evalType") else F.pandas_udf(function, kind))


def to_blob(vectors: Column) -> Column:
    """Vectors as stored blobs: little-endian 32-bit floats one after another. A null component is stored as NaN. The values of a batch are taken as they lie."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        values = v.flatten().cast(pa.float32()).fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("<f4")
        return _binaries(values.tobytes(), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) * 4, v.is_valid())

    return pack(vectors)


def from_blob(blobs: Column) -> Column:
    """array<float> of stored blobs; bytes after the last whole float are left out."""

    @F.arrow_udf("array<float>")
    def unpack(b: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.frombuffer(b"".join(b.drop_null().to_pylist()) if b.null_count or (sizes % 4).any() else _contents(b), dtype=np.uint8)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = sizes // 4
        values = raw[place < np.repeat(whole * 4, sizes)].view("<f4")
        offsets = pa.array(np.concatenate([[0], np.cumsum(whole)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(values, pa.float32()), mask=pc.invert(b.is_valid()) if b.null_count else None)

    return unpack(blobs)


def _contents(b: pa.Array) -> bytes:
    """The bytes of all values of a binary array, one after another."""
    wide = b.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return wide.buffers()[2][offsets[0] : offsets[-1]].to_pybytes() if len(wide) and wide.buffers()[2] else b""


def _binaries(raw: bytes, sizes: np.ndarray, valid: pa.Array) -> pa.Array:
    """A binary array from its bytes and the length of each value."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    bits = np.packbits(valid.to_numpy(zero_copy_only=False), bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(sizes), [pa.py_buffer(bits), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
