"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, as DataFrame operations.

A window is ``WINDOW`` consecutive words of a benchmark item (the whole item, if it has fewer); equal windows of
several items are one. A document contains a window when the same words stand in it in a row. The join is that of
prefix filtering, for a containment of one:

* a window's tokens are its shingles of ``SHINGLE`` words (all its words, if it has fewer), ordered by rarity: by how
  often they occur in all documents, counted in a first pass. A window must share all of them with a document that
  contains it, so one token is a sufficient prefix: the rarest. Windows whose rarest token occurs nowhere go;
* in a second pass every place of every document meets the windows whose prefix token stands there, by
  the token's hash;
* bounds of position and length follow from the token's place in the window: a window that would begin before
  the document or end behind it is dropped;
* what is left is verified on the words themselves, over a stretch as long as the window.

No list of a document's tokens is ever shuffled: windows are broadcast in blocks of at most ``BLOCK`` (about
50 MB), one reading of the documents for each block, and a document's words stay in its row. What goes on
is one small row for each document and each occurrence.

Defined cases: null and empty texts have no words and are not hit; items without words have no windows;
rows of one item_id are one item, as are all rows of null item_id (listed as the empty string); repeated document rows
are judged alike, each a row of the result; other columns play no part, whatever their names; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import plainwords
from tessera.llm.common import documents, materialize
from tessera.llm.plainwords import plain_words

WINDOW, SHINGLE = 10, 3
#: Windows, or tokens, that are broadcast at a time (some 200 bytes each); (window, item) pairs up to this number are broadcast, too.
BLOCK = 1 << 18


def _token(words: str, at: Column, size: int) -> Column:
    """The hash of the ``size`` words from a place on."""
    return F.xxhash64(F.lit(size), *[F.get(F.col(words), at + j) for j in range(size)])


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(id, words, size) of distinct windows and (id, item) of the items that have them; items: item_id, text."""
    ws = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item"), plain_words(items["text"]).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - size, F.lit(0))
    each = ws.select("item", "all", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item", F.slice("all", F.col("at") + 1, F.lit(size)).alias("words")).distinct()
    distinct = materialize(each.select("words").distinct().select(F.monotonically_increasing_id().alias("id"), "words", F.size("words").alias("size")), "decontam-windows")
    return distinct, each.join(distinct, "words").select("id", "item")


def tokens(found: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, at, length, token) of every shingle of every window; ``at`` is its place there."""
    by_length = [F.when(F.col("length") == n, _token("words", F.col("at"), n)) for n in range(1, shingle + 1)]
    places = found.withColumn("length", F.least("size", F.lit(shingle))).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("length"))))
    return places.select("id", "at", "length", F.coalesce(*by_length).alias("token"))


def _places(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """A row for each place of each document and length of token: adds pos and token. A document without words has one row."""
    each = docs.withColumn("pos", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)))))
    kinds = [_token("words", F.col("pos"), n) for n in lengths] or [F.lit(None).cast("bigint")]
    return each.withColumn("token", kinds[0] if len(kinds) == 1 else F.explode(F.array(*kinds)))


def _blocks(table: DataFrame, key: str, n: int) -> list[DataFrame]:
    blocks = -(-n // BLOCK) or 1
    return [table.where(F.pmod(F.col(key), F.lit(blocks)) == b) if blocks > 1 else table for b in range(blocks)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rarest(docs: DataFrame, found: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, list[int]]:
    """The windows that can occur, with the rarest of their tokens (token, at, length), and all lengths of such tokens.

    docs: words, n_words. Tokens are counted over all documents.
    """
    all_tokens = materialize(tokens(found, shingle), "decontam-tokens")
    lengths = [r["length"] for r in all_tokens.select("length").distinct().collect()]  # at most ``shingle`` numbers
    asked = all_tokens.select("token").distinct()
    counts = [_places(docs, lengths).select("token").join(F.broadcast(part), "token").groupBy("token").agg(F.count("*").alias("met")) for part in _blocks(asked, "token", asked.count())]
    best = all_tokens.join(_union(counts), "token").groupBy("id").agg(F.min(F.struct("met", "at", "token", "length")).alias("best"), F.count("*").alias("n"))
    # all tokens of a window must occur
    rare = best.join(found, "id").where(F.col("n") == F.col("size") - F.col("best.length") + 1)
    return materialize(rare.select("id", "words", "size", "best.at", "best.token", "best.length"), "decontam-prefixes"), lengths


def occurrences(docs: DataFrame, items: DataFrame, keep: list[str], size: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(number, row, n_words, start, end, id) and (id, item).

    The first has a row for each occurrence of a window in a document (words start to end, exclusive) and one or more with null id for
    each document; number tells the documents' rows apart, row is a struct of the columns ``keep``.
    """
    found, listed = windows(items, size)
    read = docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*[docs[c] for c in keep]).alias("row"), plain_words(docs["text"]).alias("words"))
    read = read.withColumn("n_words", F.size("words"))
    prefixes, lengths = rarest(read.select("words", "n_words"), found, shingle)
    places = _places(read, lengths)
    start = F.col("pos") - F.col("w_at")
    fits = (start >= 0) & (start + F.col("w_size") <= F.col("n_words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("w_size")) == F.col("w_words")
    out = []
    for part in _blocks(prefixes, "id", prefixes.count()):
        side = part.select("id", F.col("token").alias("w_token"), F.col("at").alias("w_at"), F.col("size").alias("w_size"), F.col("words").alias("w_words"))
        met = places.join(F.broadcast(side), (F.col("token") == F.col("w_token")) & fits & same, "left").where(F.col("id").isNotNull() | (F.col("pos") == 0))
        at = F.when(F.col("id").isNotNull(), start)
        out.append(met.select("number", "row", "n_words", at.alias("start"), (at + F.col("w_size")).alias("end"), "id"))
    return materialize(_union(out), "decontam-hits"), listed


def judged(docs: DataFrame, items: DataFrame, keep: list[str], size: int = WINDOW) -> DataFrame:
    """(row, n_words, n_hit, n_items, items: array of the sorted ids of the items met) of every row; row is a struct of the columns ``keep``."""
    hits, listed = occurrences(docs, items, keep, size)
    before = Window.partitionBy("number").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.least("end", F.coalesce(F.max("end").over(before), F.lit(0))))
    cover = hits.withColumn("fresh", fresh).groupBy("number").agg(F.first("row").alias("row"), F.first("n_words").alias("n_words"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_hit"))
    pairs = materialize(listed, "decontam-items")
    side = F.broadcast(pairs) if pairs.count() <= BLOCK else pairs
    met = hits.where("id is not null").select("number", "id").distinct().join(side, "id").select("number", "item").distinct()
    met = met.groupBy("number").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast("array<string>")
    return cover.join(met, "number", "left").select("row", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce("items", none).alias("items"))


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents that contain no window."""
    return judged(docs, items, docs.columns, size).where("n_hit = 0").select("row.*")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    x = judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return x.select(
        "row.doc_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("n_words", "n_hit", "n_items")],
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {plainwords.SQL.format("text")} AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {plainwords.SQL.format("text")} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS size, array_to_string(ws[s + 1 : s + {WINDOW}], ' ') AS x FROM (SELECT item, ws, unnest(range(greatest(len(ws) - {WINDOW}, 0) + 1)) AS s FROM i WHERE len(ws) > 0)),
p AS (SELECT r, s, size, array_to_string(ws[s + 1 : s + size], ' ') AS x FROM (SELECT r, ws, size, unnest(range(len(ws) - size + 1)) AS s FROM d, (SELECT DISTINCT size FROM w))),
h AS (SELECT r, s, p.size, item FROM p JOIN w ON p.x = w.x AND p.size = w.size),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS q FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)"""
