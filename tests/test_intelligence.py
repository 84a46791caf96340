"""Migrations, trends, the go-live gate, the journal, logs, citations, retries, predictions: by hand or against a plain version."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import intelligence, search
from tessera.operators import relational as R

DAY = dt.date(2024, 1, 30)


def ago(n):
    return DAY - dt.timedelta(n)


def test_migrations(spark):
    rows = [(1, "ai", ago(50))] * 20 + [(1, "tech", ago(5))] * 2 + [(1, "old", ago(40))] * 9 + [(1, "one", ago(1))]
    rows += [(2, "ai", ago(9))] * 4 + [(2, "tech", ago(3))] * 4 + [(3, "b", ago(8))] * 6 + [(3, "a", ago(9))] * 6 + [(4, "ai", ago(2))] * 8 + [(None, None, None)]
    got = {(r["entity_id"], r["target"]): r for r in intelligence.migrations(spark.createDataFrame(rows, "entity_id int, sector string, day date"), F.lit(ago(30))).collect()}
    assert set(got) == {(1, "tech"), (3, "b")}  # 2 has no sector with five; of 3's equal sectors the earlier one is the source
    a, b = got[1, "tech"], got[3, "b"]
    assert (a["source"], a["source_n"], a["target_n"], a["stage"]) == ("ai", 20, 2, "Stage 2 of 5") and a["confidence"] == pytest.approx(0.3 + 0.3 + 0.04 + 0.02)
    assert (b["source"], b["stage"], b["timeline"]) == ("a", "Stage 5 of 5", "Already converging") and b["confidence"] == pytest.approx(0.3 + 0.09 + 0.12 + 0.2)


def test_trends(spark):
    rows = [(i, "hot", "ai" if i % 2 else "tech", ago(i % 5), f"h{i % 10}", 0.5) for i in range(40)]
    rows += [(100 + i, "cold", "ai", ago(20 + i), "same", None) for i in range(5)] + [(200, "once", "ai", ago(1), "x", 0.0)] + [(300 + i, "stale", "ai", ago(31), "x", 0.0) for i in range(9)]
    m = spark.createDataFrame(rows, "mention_id int, topic string, sector string, day date, headline string, sentiment double")
    p = spark.createDataFrame([("hot", "low", 0.2, "active"), ("hot", "high", 0.9, "active"), ("hot", "over", 1.0, "expired")], "topic string, title string, confidence double, status string")
    got = {r["topic"]: r for r in intelligence.trends(m, p, F.lit(DAY)).collect()}
    assert set(got) == {"hot", "cold"}
    hot, cold = got["hot"], got["cold"]
    assert (hot["rank"], hot["n"], hot["days"]) == (1, 40, 5) and hot["acceleration"] == pytest.approx(30 / 7) and hot["prediction"]["title"] == "high"
    assert list(hot["sparkline"]) == [0] * 9 + [8] * 5 and list(cold["sparkline"]) == [0] * 14 and hot["sectors"] == ["ai", "tech"]
    assert len(hot["points"]) == 8 and len({p["headline"] for p in hot["points"]}) == 8
    # latest day first; of one headline its latest mention
    assert [(p["day"], p["mention_id"]) for p in hot["points"]] == sorted([(p["day"], p["mention_id"]) for p in hot["points"]], reverse=True)
    assert [p["mention_id"] for p in cold["points"]] == [100] and cold["prediction"] is None
    assert intelligence.trends(m, p, F.lit(DAY), 1).count() == 1


def closed(key, n, pnl, excess, days=100):
    return [(key, ago(days), ago(0), pnl(i), excess(i)) for i in range(n)]


def test_go_live(spark):
    rows = closed("good", 120, lambda i: 3.0 if i % 2 else -2.0, lambda i: 1.0 + i % 3)
    rows += closed("few", 40, lambda i: 3.0, lambda i: 1.0 + i % 3, 30) + closed("flat", 100, lambda i: 1.0, lambda i: 1.0) + closed("bad", 10, lambda i: -1.0, lambda i: float("nan"), 0)
    t = spark.createDataFrame(rows, "book string, entry_day date, exit_day date, pnl double, excess double")
    dd = spark.createDataFrame([("good", 15.0), ("few", 15.1), ("flat", 0.0)], "book string, max_drawdown double")
    bare = spark.createDataFrame([("flat", 2)], "book string, n long")
    got = intelligence.go_live(t, dd, bare, "book").collect()
    passed = {b: [r["criterion"] for r in got if r["book"] == b and r["passed"]] for b in ("good", "few", "flat", "bad")}
    status = {r["book"]: (r["n_passed"], r["status"]) for r in got}
    assert len(got) == 28
    assert passed["good"] == intelligence.CRITERIA and status["good"] == (7, "ready")
    assert passed["few"] == ["net_profit", "edge", "stops"] and status["few"] == (3, "not_yet")  # no loss, but too few trades for the factor
    assert passed["flat"] == ["trades", "track_record", "net_profit", "profit_factor", "drawdown"] and status["flat"] == (5, "close")  # no spread: no edge
    assert passed["bad"] == ["stops"] and status["bad"] == (1, "not_yet")
    assert {r["criterion"]: r["current"] for r in got if r["book"] == "flat"}["edge"] is None


def test_journal(spark):
    rows = [
        (1, [("news", 0.6), ("gov", 0.2), ("insider", 0.9), ("search", 0.2)], "2024-01-01", "2024-01-11", -3.25, -2.04, "stopped_out", "trailing_stop (-4.2%)"),
        (2, [], "2024-01-01", None, None, None, "open", None), (3, [("news", 0.51)], "2024-01-01", "2024-01-01", None, 1.26, "closed", None), (4, [("news", 0.1)], "2024-01-01", "2024-01-02", 5.0, 0.0, "expired", "odd"),
    ]
    df = spark.createDataFrame(rows, "id int, s array<struct<dimension string, value double>>, a string, b string, pnl double, pct double, status string, reason string")
    c = F.col
    note = intelligence.journal(F.lit("Arm"), c("s"), c("a").cast("date"), F.lit(10.126), F.lit(1234.4), c("b").cast("date"), F.lit(9.9), c("pnl"), c("pct"), c("status"), c("reason"))
    got = {r["id"]: r["note"] for r in df.select("id", note.alias("note")).collect()}
    start = "Entered Arm long on 2024-01-01 at $10.13 driven by "
    assert got[1] == start + "insider (90%), news (60%), gov (20%). Position size: $1234. Exited after 10 days at $9.90 — -2.0% ($-3) because the trailing stop was hit. Multiple strong signals aligned on this trade."
    assert got[2] == start + "convergence signals. Position size: $1234."
    assert got[3] == start + "news (51%). Position size: $1234. Exited after 0 days at $9.90 — +1.3% because it was closed manually (exit reason not recorded). The news signal was the primary driver."
    assert "+0.0% ($+5) because the retired calendar-expiry engine" in got[4]


def test_funnel(spark):
    pool = spark.createDataFrame([("b", "h", 7, 0), ("b", "h", 8, 1), ("b", "i", 9, 2), ("c", "h", 10, 0)], "briefing string, url_hash string, candidate int, position int")
    keys = lambda rows: spark.createDataFrame(rows, "briefing string, url_hash string")
    stories = spark.createDataFrame([("b", "h", 5), ("b", "h", 3), ("z", "h", 1)], "briefing string, url_hash string, story_id int")
    got = sorted(tuple(r) for r in intelligence.funnel(pool, keys([("b", "h"), ("b", "h")]), keys([("b", "i")]), stories).collect())
    assert got == [("b", "h", 7, 0, True, False, 3), ("b", "i", 9, 2, False, True, None), ("c", "h", 10, 0, False, False, None)]


def test_citations(spark):
    cases = [([11, 12, 13], [12, 0, 12, 99, -1, 2, None], ([12, 11, 13], 2, 3)), ([], [0, 5], ([], 0, 2)), ([2, 1, 0], [0, 1, 2], ([0, 1, 2], 0, 0)), ([7], [], ([], 0, 0))]
    df = spark.createDataFrame([(i, o, c) for i, (o, c, _) in enumerate(cases)], "i int, offered array<bigint>, cited array<bigint>").select("i", text.resolved_refs(F.col("cited"), F.col("offered")).alias("r"))
    assert {r["i"]: (list(r["r"]["ids"]), r["r"]["remapped"], r["r"]["dropped"]) for r in df.collect()} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_retry_merge(spark):
    table = lambda rows: spark.createDataFrame(rows, "b string, id int, score int, at int")
    wanted = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 0)], "b string, id int")
    got = R.with_retry(wanted, table([("x", 0, 1, 0), ("x", 0, 2, 0), ("x", 9, 3, 0)]), table([("x", 0, 7, 0), ("x", 1, 8, 1), ("x", 1, 9, 0), ("x", 8, 1, 0), ("y", 0, 4, 0), ("x", 3, 5, 0)]), ["b"], "id", "at")
    assert sorted((r["b"], r["id"], r["score"], r["recovered"]) for r in got.collect()) == [("x", 0, 1, False), ("x", 0, 2, False), ("x", 1, 9, True), ("x", 3, 5, True), ("y", 0, 4, True)]


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_best_share_against_all_pairs(spark, least):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)] + ["the", "a-b", "été", "w1w2"]
    docs = [(i, " ".join(["the"] + rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)] + [(98, ""), (99, "The W1x\tW2\n")]
    items = [(i, rng.choices(words, k=rng.randint(1, 7))) for i in range(40)] + [(77, []), (78, ["nowhere"]), (79, ["the", "the", "the", "w3"])]
    want = {}
    for i, ks in items:
        shares = [sum(k in t.lower() for k in ks) / len(ks) for _, t in docs] if ks else []
        best = max(shares, default=0)
        want[i] = pytest.approx(best) if ks and best >= least else None
    got = search.best_share(spark.createDataFrame(items, "item_id int, keywords array<string>"), spark.createDataFrame(docs, "doc_id int, text string"), least)
    assert {r["item_id"]: r["share"] for r in got.collect()} == want
    assert not re.search("CartesianProduct|NestedLoop", got._jdf.queryExecution().executedPlan().toString())


def test_best_share_shuffles_no_words(spark, monkeypatch):
    """What leaves the tasks is a row for each item, however many texts and words there are; also by blocks of items."""
    monkeypatch.setattr(search, "BROADCAST_KEYWORDS", 7)
    monkeypatch.setattr(search, "KEYWORD_CELLS", 20)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('the and of ', repeat('to ', 5), 'n', id % 10) AS text")
    items = spark.createDataFrame([(i, ["the", "of", f"n{i}"]) for i in range(20)] + [(None, ["the"])], "item_id int, keywords array<string>")
    got = search.best_share(items, docs, 0.5)
    assert {r["item_id"]: r["share"] for r in got.collect()} == {i: 1.0 if i < 10 else pytest.approx(2 / 3) for i in range(20)} | {None: None}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") > 1


def test_recency_by_class(spark):
    rows = [(1, k, 0.8, d) for k in [*search.RECENCY, "advisory", None] for d in (ago(0), ago(30), None)]
    out = search.blend(spark.createDataFrame(rows, "query_id int, kind string, score double, day date"), F.col("kind"), F.lit(DAY)).collect()
    for r in out:
        alpha, half = search.RECENCY.get(r["kind"], search.RECENCY["general"])
        age = None if r["day"] is None else (DAY - r["day"]).days
        assert r["score"] == pytest.approx(0.8 if age is None else alpha * 0.8 + (1 - alpha) * 0.5 ** (age / half))
