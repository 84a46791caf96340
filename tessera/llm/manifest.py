"""A Merkle manifest of a data set, level by level with windows.

A row's leaf is the SHA-256 of its columns, each as its length in bytes and its value. Rows of a group (a language) ascend by
doc_id; every run of ``FANOUT`` consecutive nodes (the last may be shorter) becomes the SHA-256 of their digests, until one node is left, the
group's subroot; the subroots, in the order of their groups (null first), become the root alike. With a root one can check a
row from its proof alone: the siblings on its way up.

A level is a window over the children of one parent, partitioned by the group and the parent's index, whose full frame collects their digests in
order: that list is the parent's preimage, and gives each child its siblings. ``STRIDE`` levels run in one pass: rows
are dealt once by group and block of FANOUT ** STRIDE consecutive ones, and all windows of these levels stay inside a block, so there is
no further shuffle. In each level only the first row of a child contributes its digest. Parents at the top of a block are then
deduplicated to one row each: the next pass has 1 / FANOUT ** STRIDE of the rows. Proofs come back down by
joins on the block, which holds at most FANOUT ** STRIDE rows: a group of a third of all rows is dealt like any other.

Rows are numbered inside their group by ranges of (group, doc_id, digest): a range's first number follows from the counts of
those before it, one for each range and group.

Defined cases: nulls have a form of their own (``-``), so null and empty text differ; null doc_ids come first; rows of one doc_id are
ordered by their digests, equal rows are equal leaves, so their order does not matter; an empty table gives no rows; columns other than the
five play no part, whatever their names. A null doc_id is not tampered with in the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import documents, materialize
from tessera.llm.resample import CRC32, CRC32_OF

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT, STRIDE = 2, 8
STEPS = "array<struct<before:string,after:string>>"


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def field(value: Column) -> Column:
    """A value as text that no other value has."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return digest(*[field(columns[c]) for c in FIELDS])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``i``, the place of a row in its group ``g`` from 0, and ``n``, the group's size. rows must be written somewhere."""
    ordered = materialize(rows.repartitionByRange("g", *order, "number").withColumn("part", F.spark_partition_id()), "manifest-ranges")
    counts = ordered.groupBy("g", "part").agg(F.count("*").alias("here"))
    w = Window.partitionBy("g")
    starts = counts.select("g", "part", F.sum("here").over(w).alias("n"), (F.sum("here").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("first"))
    inside = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order, "number"))
    return ordered.withColumn("inside", inside).join(starts, ["g", "part"]).withColumn("i", F.col("first") + F.col("inside") - 1).drop("part", "inside", "first")


def climb(nodes: DataFrame, fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """``stride`` levels up from nodes (g, i, n, d: digest, ...): adds block, top (the digest of the node's ancestor there) and steps.

    steps has the siblings of each level that has any node beside: their digests before and after the node's ancestor.
    """
    x = nodes.withColumn("block", F.floor(F.col("i") / fanout**stride)).repartition("g", "block")
    x = x.withColumn("top", F.col("d")).withColumn("steps", F.array().cast(STEPS))
    for level in range(stride):
        size = fanout**level
        child, parent = F.expr(f"i div {size}"), F.expr(f"i div {size * fanout}")
        x = x.withColumn("parent", parent)
        run = Window.partitionBy("g", "block", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        x = x.withColumn("run", F.collect_list(F.when(F.col("i") % size == 0, F.col("top"))).over(run))
        at = (child % fanout).cast("int")
        step = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(fanout)), "").alias("after"))
        more = F.col("n") > size  # more than one node is left
        x = x.withColumn("steps", F.when(more, F.concat("steps", F.array(step))).otherwise(F.col("steps"))).withColumn("top", F.when(more, digest(F.array_join("run", ""))).otherwise(F.col("top")))
    return x.drop("parent", "run")


def tree(leaves: DataFrame, fanout: int = FANOUT, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """(leaves with g, i, n, d and their steps up to the root of their group, (g, top)); leaves must be written somewhere."""
    size = fanout**stride
    most = leaves.agg(F.max("n")).first()[0] or 1
    passes, nodes = [], leaves
    while not passes or most > 1:
        most = -(-most // size)
        passes.append(climb(nodes, fanout, stride))
        nodes = materialize(passes[-1].where(F.col("i") % size == 0).select("g", F.col("block").alias("i"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("d")), "manifest-parents")
    ways = None
    for p in reversed(passes):
        if ways is not None:
            above = ways.select("g", F.col("i").alias("block"), F.col("steps").alias("further"))
            p = p.join(above, ["g", "block"]).withColumn("steps", F.concat("steps", "further")).drop("further")
        ways = p.drop("block", "top")
    return ways, nodes.select("g", F.col("d").alias("top"))


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its steps."""
    return F.aggregate(steps, start, lambda d, s: digest(s["before"], d, s["after"]))


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None, fanout: int = FANOUT, stride: int = STRIDE) -> DataFrame:
    """(doc_id, leaf, changed: the leaf of the columns as tampered gives them, subroot, root, steps: the proof) of every row."""
    columns = {c: docs[c] for c in FIELDS}
    key = F.coalesce(F.concat(F.lit("="), columns[group].cast("string")), F.lit(""))  # null first, then bytewise
    rows = docs.select(
        key.alias("g"), columns["doc_id"].alias("doc_id"), columns[order].alias("o"), leaf(columns).alias("d"),
        leaf(columns | (tampered or {})).alias("changed"), F.monotonically_increasing_id().alias("number"),
    )
    leaves = materialize(numbered(materialize(rows, "manifest-leaves"), ["o", "d"]).drop("number", "o"), "manifest-numbered")
    ways, tops = tree(leaves, fanout, stride)
    subroots = tops.select(F.lit("").alias("g"), F.col("g").alias("sub"), F.col("top").alias("d"), F.monotonically_increasing_id().alias("number"))
    subroots = materialize(numbered(materialize(subroots, "manifest-subroots"), ["sub"]), "manifest-groups")
    upper, roots = tree(subroots, fanout, stride)
    root = materialize(upper.join(F.broadcast(roots.select("g", F.col("top").alias("root"))), "g").select(F.col("sub").alias("g"), F.col("d").alias("subroot"), "root", F.col("steps").alias("further")), "manifest-roots")
    out = ways.join(_small(root), "g")
    return out.select("doc_id", F.col("d").alias("leaf"), "changed", "subroot", "root", F.concat("steps", "further").alias("steps"))


#: Groups up to this number (about 1 KB each) are broadcast.
BROADCAST_GROUPS = 1 << 15


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, with every row checked against the root, some after a change of n_chars."""
    docs = documents(spark, sf_dir)
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, F.lit(False))
    x = manifest(docs, tampered={"n_chars": F.when(hit, docs["n_chars"] + 1).otherwise(docs["n_chars"])})
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    x = x.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("changed"), F.col("steps")).alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))


def _text(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"



_LEAF = "sha256(" + " || ".join(_text(c) for c in FIELDS) + ")"
_CHANGED = "sha256(" + " || ".join(_text("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"
_UP = "list_transform(range((len(nodes) + 1) // 2), lambda j: sha256(nodes[2 * j::INT + 1] || coalesce(nodes[2 * j::INT + 2], '')))"

#: Each level of each group is a list; ``l`` are the trees of the groups and ``r`` that of the subroots.
ORACLE = f"""WITH RECURSIVE {CRC32},
d AS (SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {CRC32_OF.format("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_CHANGED} ELSE {_LEAF} END AS changed, row_number() OVER () AS n FROM documents, tab),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, n) - 1 AS i FROM d),
l AS (SELECT lang, 0 AS k, list(leaf ORDER BY i) AS nodes FROM o GROUP BY lang UNION ALL SELECT lang, k + 1, {_UP} FROM l WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM l WHERE len(nodes) = 1),
r AS (SELECT 0 AS k, list(subroot ORDER BY i) AS nodes FROM s UNION ALL SELECT k + 1, {_UP} FROM r WHERE len(nodes) > 1),
f AS (SELECT o.n, o.lang, 0 AS k, o.i, changed AS acc, '' AS proof FROM o UNION ALL
  SELECT f.n, f.lang, f.k + 1, f.i // 2, CASE WHEN f.i % 2 = 1 THEN sha256(nodes[f.i::INT] || acc) ELSE sha256(acc || coalesce(nodes[f.i::INT + 2], '')) END,
    proof || CASE WHEN f.i % 2 = 1 THEN nodes[f.i::INT] ELSE coalesce(nodes[f.i::INT + 2], '') END FROM f JOIN l ON l.lang IS NOT DISTINCT FROM f.lang AND l.k = f.k WHERE len(nodes) > 1),
m AS (SELECT n, arg_max(acc, k) AS acc, arg_max(proof, k) AS proof FROM f GROUP BY n),
h AS (SELECT m.n, 0 AS k, s.i, acc, proof, subroot FROM m JOIN o ON o.n = m.n JOIN s ON s.lang IS NOT DISTINCT FROM o.lang UNION ALL
  SELECT h.n, h.k + 1, h.i // 2, CASE WHEN h.i % 2 = 1 THEN sha256(nodes[h.i::INT] || acc) ELSE sha256(acc || coalesce(nodes[h.i::INT + 2], '')) END,
    proof || CASE WHEN h.i % 2 = 1 THEN nodes[h.i::INT] ELSE coalesce(nodes[h.i::INT + 2], '') END, subroot FROM h JOIN r ON r.k = h.k WHERE len(nodes) > 1),
e AS (SELECT n, arg_max(acc, k) AS folded_root, arg_max(proof, k) AS proof, any_value(subroot) AS subroot FROM h GROUP BY n)
SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM r WHERE len(nodes) = 1) AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = (SELECT nodes[1] FROM r WHERE len(nodes) = 1) AS verified FROM d JOIN e USING (n)"""
