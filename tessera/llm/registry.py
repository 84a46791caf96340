"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontam, fingerprints, jaccard, langid, manifest, packing, phrases, pii, resample, secretscan, topk, urlfilter
from tessera.llm.common import documents


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.round_trip_digests(documents(spark, sf_dir), word_vocabulary())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), word_vocabulary())


def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every url, by rule or by path template."""
    return urlfilter.pages(spark, sf_dir)


def op3_secretscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secretscan.scan_documents(documents(spark, sf_dir))


def op4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words or more, removed from every document."""
    return phrases.remove_repeats(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.scan_documents(documents(spark, sf_dir))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products for every hundredth vector."""
    return topk.every_hundredth(spark, sf_dir)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard.join(documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.languages(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_neighbours(documents(spark, sf_dir))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    return decontam.benchmark(spark, sf_dir)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark."""
    return resample.benchmark_like(spark, sf_dir)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, every row checked by its proof."""
    return manifest.checked(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_urlfilter": op2_urlfilter,
        "op3_secretscan": op3_secretscan,
        "op4_phrases": op4_phrases,
        "op5_pii": op5_pii,
        "op6_topk": op6_topk,
        "op7_packing": op7_packing,
        "op8_jaccard": op8_jaccard,
        "op9_langid": op9_langid,
        "op10_fingerprints": op10_fingerprints,
        "op11_decontamination": op11_decontamination,
        "op12_resampling": op12_resampling,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": topk.ORACLE, "op11_decontamination": decontam.ORACLE, "op12_resampling": resample.ORACLE, "op13_manifest": manifest.ORACLE}
