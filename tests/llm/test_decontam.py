import hashlib
import re

import pytest

from tessera.llm import decontam, registry
from tests.llm.helpers import AWKWARD, SF, documents, table
from tests.oracle import connect, difference

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, size=10):
    """(doc_id, n_words, n_hit, items) of each document, from every stretch of every document."""
    windows = {}
    for i, t in items:
        ws = words(t)
        for s in range(max(len(ws) - size, 0) + 1 if ws else 0):
            windows.setdefault(tuple(ws[s : s + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        ws, hit, met = words(t), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(ws) - n + 1):
                found = windows.get(tuple(ws[s : s + n]))
                if found:
                    hit |= set(range(s, s + n))
                    met |= found
        out.append((d, len(ws), len(hit), sorted(met)))
    return sorted(out, key=repr)


def got(docs, items, **options):
    return sorted(((r["row"]["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.judged(docs, items, ["doc_id"], **options).collect()), key=repr)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id bigint, text string, words int")


ITEMS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "alpha BETA gamma, delta epsilon zeta eta theta iota kappa"),  # a window of item 1
    (3, "Paris"),
    (4, "É à"),
    (5, None),
    (6, " .,; "),
    (7, "the the the the the the the the the the the the"),
    (8, "the end of"),
    (8, "another text of item eight"),
    (None, "no id here"),
    (10, "ΑΣ İé́ ẞ a c 😀"),
]
RUN = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
DOCS = [
    *AWKWARD,
    (20, f"x {RUN} y"),
    (21, RUN.replace("mu", "nu")),
    (22, RUN.replace("gamma", "gamma-") + " " + RUN.upper()),
    (23, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (24, "paris"),
    (25, "é à É Ã É à"),
    (26, "the " * 25 + "end of the the"),
    (27, "another text of item eight, no id here and the end of"),
    (28, f"{RUN} {RUN[6:]} {RUN}"),
    (29, "Paris" + " paris" * 300),
    (20, f"x {RUN} y"),
]


def test_awkward_against_brute_force(spark):
    assert got(table(spark, DOCS), benchmark(spark, ITEMS)) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_sizes(spark, size):
    assert got(table(spark, DOCS), benchmark(spark, ITEMS), size=size) == brute(DOCS, ITEMS, size)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 3)
    assert got(table(spark, DOCS), benchmark(spark, ITEMS)) == brute(DOCS, ITEMS)


def test_whole_table_against_sql(spark):
    assert difference(spark, connect(SF), SF, registry.op11_decontamination, decontam.ORACLE) is None


def test_items_themselves_are_hit_whole(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for r in decontam.judged(items.withColumnRenamed("item_id", "doc_id"), items, ["doc_id"]).collect():
        assert r["n_hit"] == r["n_words"] > 0 and str(r["row"]["doc_id"]) in r["items"]


def test_empty_tables(spark):
    none, docs = benchmark(spark, []), table(spark)
    assert decontam.judged(table(spark, []), benchmark(spark, ITEMS), ["doc_id"]).count() == 0
    rows = decontam.judged(docs, none, ["doc_id"]).collect()
    assert len(rows) == len(AWKWARD) and all(r["n_hit"] == r["n_items"] == 0 for r in rows)
    assert decontam.judged(docs, benchmark(spark, [(1, None), (2, "")]), ["doc_id"]).count() == len(AWKWARD)


def test_very_long_text_and_a_hot_window(spark):
    filler = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, f"{filler} {RUN} {filler}")] + [(i, f"{i} {RUN}") for i in range(2, 500)]
    found = {r["row"]["doc_id"]: r for r in decontam.judged(table(spark, rows), benchmark(spark, [(i, RUN) for i in range(300)]), ["doc_id"]).collect()}
    assert all(r["n_hit"] == 12 and r["n_items"] == 300 for r in found.values())
    assert found[1]["n_words"] == 600_012


def test_clashing_names_stay(spark):
    names = ["words", "n_words", "token", "pos", "number", "row", "id", "start", "end", "n_hit", "items", "fresh"]
    docs = spark.createDataFrame([(1, RUN, *range(len(names))), (2, "clean", *range(len(names)))], "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = decontam.clean(docs, benchmark(spark, ITEMS))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]


def test_no_python_in_the_plan(spark):
    df = registry.op11_decontamination(spark, SF)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_digest_of_items(spark):
    one = {r["doc_id"]: r for r in registry.op11_decontamination(spark, SF).collect()}
    texts = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d, n, hit, met in brute(texts, items):
        r = one[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(met), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(met).encode()).hexdigest()
