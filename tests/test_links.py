"""Records of mentions, prices by session, ends of links: each against a plain version."""

import datetime as dt
import random

import pytest

from tessera.operators import entities
from tessera.operators import relational as R

SUFFIX = {"inc", "corp", "ltd", "group", "holdings"}


def bare(name):
    words = "".join(c if c.isalnum() else " " for c in (name or "").lower()).split()
    return " ".join(words[:-1] if len(words) > 1 and words[-1] in SUFFIX else words)


def inside(hay, needle):
    return len(needle) >= 3 and f" {needle} " in f" {hay} "


def plain(rows):
    """One mention after another, against a growing list of records."""
    records, out = [], {}
    for m, cik, ticker, name in sorted(rows):
        n, cik, ticker = bare(name), (cik or "").strip() or None, (ticker or "").strip() or None
        if len(n) < 2:
            out[m] = None
            continue
        hit = next((r for r in records if cik and r[1] == cik), None) or next((r for r in records if ticker and r[2] == ticker), None)
        hit = hit or next((r for r in records if r[3] == n or inside(r[3], n) or inside(n, r[3])), None)
        if hit is None:
            hit = (m, cik, ticker, n)
            records.append(hit)
        out[m] = hit[0]
    return out


def settled(spark, rows):
    df = spark.createDataFrame(rows, "mention_id bigint, cik string, ticker string, name string")
    return {r["mention_id"]: r["canonical"] for r in entities.canonicals(df).collect()}


def test_records_by_hand(spark):
    rows = [
        (1, None, "ARM", "Arm"), (2, None, None, "Arm Holdings"), (3, None, None, "Hydrofarm"), (4, "c9", None, "Nvidia Corp"), (5, "c9", "ARM", "Something else"), (6, None, "ARM", "Nvidia"),
        (7, None, None, "else"), (8, None, None, "x"), (9, None, None, None), (10, "", " ", "ab"), (11, None, None, "ab cd"), (12, None, None, "AB"), (13, None, None, "the arm of nvidia"),
    ]
    # 5 joins by cik before its ticker and is no record, so its name and ticker give nothing on; 11 does not contain a name of two letters
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 1, 7: 7, 8: None, 9: None, 10: 10, 11: 11, 12: 10, 13: 1}
    assert plain(rows) == want
    assert settled(spark, rows) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_records_against_one_after_another(spark, seed):
    rng = random.Random(seed)
    words = ["arm", "blue", "sky", "inc", "corp", "of", "nova", "q", "delta", "x1"]
    pick = lambda n, p: rng.choice([None, *(f"k{i}" for i in range(n))]) if rng.random() < p else None
    rows = [(i, pick(12, 0.3), pick(15, 0.4) if i % 3 else "HOT", " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in rng.sample(range(1000), 150)]
    assert settled(spark, rows) == plain(rows)


def test_a_chain_that_settles_one_by_one(spark):
    rows = [(i, None, None, f"w{i} w{i + 1}") for i in range(0, 12)]
    rows += [(20 + i, None, None, f"w{i}") for i in range(13)]
    assert settled(spark, rows) == plain(rows)


def test_no_mentions(spark):
    assert settled(spark, []) == {}
    assert settled(spark, [(1, None, None, "Alone")]) == {1: 1}


def test_prices_by_session(spark):
    day = lambda n: dt.date(2024, 1, n)
    sessions = spark.createDataFrame([("a", day(5), 1.0, 2.0), ("a", day(8), 3.0, 4.0), ("b", day(8), 9.0, 9.5)], "k string, day date, open double, close double")
    at = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    cases = [
        (at(1, 3), 1.0), (at(5, 0), 1.0), (at(5, 12, 44), 1.0), (at(5, 12, 45), 2.0), (at(5, 15, 59), 2.0), (at(5, 16, 0), 3.0), (at(6, 11), 3.0), (at(7, 23), 3.0),
        (at(8, 9), 3.0), (at(8, 13), 4.0), (at(8, 16), None), (at(9, 9), None),
    ]
    trades = spark.createDataFrame([(i, "a", t, "x") for i, (t, _) in enumerate(cases)] + [(99, "none", at(5, 9), "x"), (98, "a", None, "x")], "id int, k string, `when` timestamp_ntz, `at` string").drop("at")
    got = {r["id"]: r["price"] for r in R.at_session(trades, sessions, "k", "when").collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: p for i, (_, p) in enumerate(cases)}
    assert got[99] is None and len(got) == len(cases) + 2


def test_ends_of_links(spark):
    e = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (3, 3, "z"), (None, 4, "n")], "a int, b int, t string")
    got = sorted(((r["node"], r["other"], r["t"]) for r in R.other_end(e, "a", "b").collect()), key=str)
    assert got == sorted([(1, 2, "x"), (2, 1, "x"), (2, 1, "y"), (1, 2, "y"), (3, 3, "z"), (4, None, "n")], key=str)


def test_lowest_story(spark):
    pool = spark.createDataFrame([(1, "b", "h"), (2, "b", None), (3, "c", "h"), (4, "b", "h")], "id int, briefing string, hash string")
    stories = spark.createDataFrame([(9, "b", "h"), (7, "b", "h"), (5, "b", None)], "story int, briefing string, hash string")
    assert {r["id"]: r["story"] for r in R.linked(pool, stories, ["briefing", "hash"], "story").collect()} == {1: 7, 2: None, 3: None, 4: 7}


def test_a_first_word_that_all_entities_share_pairs_nothing(spark):
    """A thousand names meet a thousand entities of the same first word by their runs of words: a few rows a name, not a million pairs."""
    from pyspark.sql import functions as F

    from tessera.operators import entities

    n = spark.range(1000).select(F.concat(F.lit("supplier "), F.col("id").cast("string")).alias("bare"), F.lit(2).alias("longest"))
    assert entities.word_runs(n).count() == 3000
    names = spark.createDataFrame([("the Acme Corp of Bonn Ltd",), ("Acme",), ("acmes",), ("...",), ("Bonn of",), (None,)], "name string")
    known = spark.createDataFrame([(1, "of Bonn"), (2, "acme Inc"), (3, "!"), (4, "Acme Corp of"), (5, None)], "entity_id long, entity string")
    got = {r["name"]: (r["entity_id"], r["confidence"]) for r in entities.tiered_match(names, known).collect()}
    assert got == {"the Acme Corp of Bonn Ltd": (1, 0.6), "Acme": (2, 0.85), "...": (3, 0.85)}
