import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import manifest, registry
from tests.llm.helpers import AWKWARD, SF, documents, table
from tests.oracle import connect, difference


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(r):
    return h(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in manifest.FIELDS])


def climbed(nodes, fanout):
    """The root of a list of digests, and for each the siblings before and after on its way up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            run, p = runs[i // fanout], i % fanout
            ways[k].append(("".join(run[:p]), "".join(run[p + 1 :])))
        at, nodes = [i // fanout for i in at], [h(*r) for r in runs]
    return nodes[0], ways


def brute(rows, fanout=2):
    """[(doc_id, leaf, subroot, root, steps)] of all rows, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    subs = []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subs.append((members, *climbed([leaf(r) for r in members], fanout)))
    root, upper = climbed([s[1] for s in subs], fanout) if subs else (None, [])
    return sorted(((r["doc_id"], leaf(r), sub, root, way + up) for (members, sub, ways), up in zip(subs, upper, strict=True) for r, way in zip(members, ways, strict=True)), key=repr)


def got(docs, **options):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]]) for r in manifest.manifest(docs, **options).collect()), key=repr)


def rows_of(df):
    return [r.asDict() for r in df.select(*manifest.FIELDS).collect()]


@pytest.mark.parametrize(("fanout", "stride"), [(2, 8), (2, 1), (3, 2), (5, 1)])
def test_against_brute_force(spark, fanout, stride):
    rng = random.Random(5)
    rows = [(i, rng.choice(["de", "en", "É", "z", "", None]), rng.choice([None, "src"]), rng.choice([None, 3]), rng.choice([None, "", "téxt", "😀"])) for i in range(70)]
    rows += [(None, "en", None, None, None)] * 3 + [(5, "en", "src", 1, "a"), (5, "en", "src", 1, "b"), (7, "alone", None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, n_chars bigint, text string").withColumns({c: F.lit(9) for c in ("g", "i", "n", "d", "top", "run", "part")})
    assert got(docs, fanout=fanout, stride=stride) == brute(rows_of(docs), fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 16, 17])
def test_sizes_around_blocks(spark, n):
    docs = table(spark, [(i, f"text {i}") for i in range(n)])
    assert got(docs, stride=2) == brute(rows_of(docs))


def test_awkward_rows(spark):
    docs = table(spark, AWKWARD)
    assert got(docs) == brute(rows_of(docs))


def test_whole_table_against_sql(spark):
    assert difference(spark, connect(SF), SF, registry.op13_manifest, manifest.ORACLE) is None


def test_checked_rows(spark):
    rows = {r["doc_id"]: r for r in rows_of(documents(spark))}
    for r in registry.op13_manifest(spark, SF).collect():
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and rows[r["doc_id"]]["n_chars"] is not None
        assert r["verified"] is not tampered
        assert (r["folded_root"] == r["root"]) is not tampered


def test_any_change_is_seen(spark):
    docs = documents(spark)
    for c, changed in [("text", F.concat("text", F.lit("."))), ("source", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1)]:
        x = manifest.manifest(docs, tampered={c: changed})
        assert x.where(manifest.folded(F.col("changed"), F.col("steps")) == F.col("root")).count() == 0
    x = manifest.manifest(docs)
    assert x.where(manifest.folded(F.col("changed"), F.col("steps")) == F.col("root")).count() == docs.count()


def test_null_is_not_empty(spark):
    a = table(spark, [(1, None)]).withColumn("n_chars", F.lit(0).cast("bigint"))
    assert got(a)[0][1] != got(a.withColumn("text", F.lit("")))[0][1]


def test_empty_and_single(spark):
    assert manifest.manifest(table(spark, [])).count() == 0
    one = manifest.manifest(table(spark, [(3, "x")])).first()
    assert one["leaf"] == one["subroot"] == one["root"] and list(one["steps"]) == []


def test_one_hot_language_and_very_long_text(spark):
    docs = table(spark, [(i, "same") for i in range(3000)] + [(9999, "long " * 400_000)])
    assert got(docs) == brute(rows_of(docs))
