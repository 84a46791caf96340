"""A small table of awkward documents and a reader of the driver's tables."""

import os

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")

AWKWARD = [
    (1, "plain text with a few words"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "plain text with a few words"),
    (5, "plain text with a few words"),
    (None, "a row without an id"),
    (6, "ΑΣ İé́ ẞ \x1c a\x85b　c 😀 <|endoftext|> x"),
    (7, "word " * 5000),
    (8, "0123456789 !!! ---"),
]


def table(spark, rows=AWKWARD, extra=True):
    """documents with the given (doc_id, text); extra columns clash with names used inside the operators."""
    full = [(i, t, "en", "src0", None if t is None else len(t), "x", 1) for i, t in rows]
    df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, n string, start int")
    return df if extra else df.drop("n", "start")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
