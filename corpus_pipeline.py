"""The corpus pipeline: five stages, each on all that the one before kept.

1. ``language_id`` drops documents whose language cannot be told (no letter at all);
2. ``near_duplicates`` keeps one document, the smallest doc_id, of each component of near copies;
3. ``repeated_passages`` cuts passages of 20 words or more that occur earlier;
4. ``secrets`` replaces secrets by a mark;
5. ``packing`` packs the texts into sequences of at most 4096 tokens.

All but the last return the columns of documents. Each stage is judged on its own input.
Defined cases: rows with null doc_id pass stages 1 to 4 as documents of their own; null
and empty texts go in stage 1; of several rows with one doc_id in a component of near
copies all stay if it is the smallest id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, langid, packing, phrases, secretscan
from tessera.llm.registry import word_vocabulary

#: Near duplicates of the pipeline: five words, a similarity of 0.8 or more.
SHINGLE_WORDS, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = langid.learn(docs)
    if not learned:  # no label to learn from: only texts without a letter are sure to have no language
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.identify(docs, learned).where(F.col("lang_pred") != "und").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.join(docs, SHINGLE_WORDS, PERCENT)
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(others, docs["doc_id"] == others["_copy"], "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrases.without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, word_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", pack),
]

#: SQL cannot express language identification, packing or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents. What lies between two stages is written to the shared folder, and deleted when it has been read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []  # what this run wrote and still reads
    for name, stage in STAGES:
        with common.gathered() as own:
            out = stage(spark, docs, sf_dir)
            if name == STAGES[-1][0]:
                return out
            docs = common.materialize(out, f"stage-{name}")
        common.delete([*before, *[x for x in own if x != docs._folder]])
        before = [docs._folder]
