"""Decay and silence, questions for the web, diagnosis of misses."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import chat, search, signals


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_a_silent_source_is_no_decay(spark):
    # ten readings a day for twenty days, three on the day after, then nothing; key 0 is read on days 0 and 1 only
    rows = [(k, day(d), 0.9 - 0.01 * d, d * 100 + k) for d in range(20) for k in range(1, 11)] + [(0, day(0), 1.0, 0), (0, day(1), 0.2, 1), (5, day(20), 0.9, 9000), (6, day(20), 0.9, 9001), (7, day(20), 0.26, 9002)]
    readings = spark.createDataFrame(rows, "key int, day date, score double, id int")
    asked = [(0, 0), (0, 1), (0, 4), (0, 5), (0, 22), (5, 22), (7, 22), (7, 23), (7, 25), (8, 22), (8, 23), (5, 60), (99, 10)]
    positions = spark.createDataFrame([(k, day(d), 0.9) for k, d in asked], "key int, as_of date, original double")
    got = {(r["key"], (r["as_of"] - day(0)).days): (r["latest"], r["healthy"], r["decayed"]) for r in signals.decay(readings, positions).collect()}
    assert got[0, 0] == (1.0, True, False)
    assert got[0, 1] == (0.2, True, True)  # under 0.3 of what it was
    assert got[0, 4] == (0.2, True, True) and got[0, 5] == (None, True, True)  # stale after three days: nothing is left
    assert got[5, 22] == (0.9, True, False) and got[7, 22] == (0.26, True, True)
    assert got[8, 22] == (pytest.approx(0.71), True, False)
    assert got[7, 23] == (0.26, True, True) and got[8, 23] == (None, True, True)  # three rows in three days are more than a quarter of ten
    assert got[7, 25] == (None, False, False) and got[5, 60] == (None, False, False)
    assert got[99, 10] == (None, True, True)


def test_health(spark):
    counts = {0: 100, 1: 100, 2: 120, 10: 24, 11: 1}
    rows = [(day(d),) for d, n in counts.items() for _ in range(n)]
    days = spark.createDataFrame([(day(d),) for d in (0, 2, 6, 10, 13, 14, 40, 42)], "as_of date")
    got = {(r["as_of"] - day(0)).days: (r["recent"], r["median"], r["healthy"]) for r in signals.output_health(spark.createDataFrame(rows, "day date"), days).collect()}
    assert got == {0: (100, 100, True), 2: (320, 100, True), 6: (0, 100, False), 10: (24, 100, False), 13: (25, 100, True), 14: (1, 100, False), 40: (0, 24, False), 42: (0, None, False)}


MESSAGES = [
    (1, "Should I compare it?", "advisory"), (2, "Nvidia VS AMD: which is better", "general"), (3, "What happened today", "general"), (4, "tell me about quantum chips", "general"),
    (5, "nvidia earnings", "general"), (6, "zorblax frobnicate", "general"), (7, "the and for", "general"), (8, "nvidia frobnicate", "general"), (9, "", "general"), (10, "chips, (chips) nonsense blah", "general"),
]


def test_web_rules(spark):
    q = spark.createDataFrame(MESSAGES, "query_id int, text string, kind string")
    names = spark.createDataFrame([("NVIDIA Corp earnings",), ("Quantumania",), (None,), ("Microchips Inc",)], "name string")
    found = spark.createDataFrame([(i, "HIGH" if i != 5 else "LOW") for i in (1, 2, 3, 4, 5, 6, 7, 8, 10)], "query_id int, confidence string")
    out = chat.web_trigger(chat.asked_for(q, F.col("kind")), found, chat.unknown(q, names))
    assert {r["query_id"]: r["reason"] for r in out.collect()} == {
        1: "advisory", 2: "comparison", 3: "timely", 4: None, 5: "low_confidence", 6: "unknown_entities", 7: None, 8: None, 9: "low_confidence", 10: None,
    }


def test_known_words_are_parts_of_names(spark):
    names = spark.createDataFrame([("Hydrofarm é-shop",), ("a",), ("",), (None,)], "name string")
    words = [("farm",), ("farms",), ("a",), ("é-s",), ("hydrofarm",), ("m é",), ("rofa",), ("zz",)]
    got = {r["w"] for r in chat.known(spark.createDataFrame(words, "w string"), names).collect()}
    assert got == {"farm", "a", "é-s", "hydrofarm", "rofa"}


def test_confidence(spark):
    rows = [(1, 1.0, "both")] * 2 + [(1, 0.1, "keyword")] * 6 + [(2, 1.0, "keyword")] * 4 + [(3, 1.0, "keyword")] + [(3, 0.0, "keyword")] * 9 + [(4, 0.0, "keyword")] * 9 + [(5, 0.6, "keyword")] * 8
    got = {r["query_id"]: r["confidence"] for r in search.confidence(spark.createDataFrame(rows, "query_id int, score double, match_type string")).collect()}
    assert got == {1: "HIGH", 2: "MODERATE", 3: "LOW", 4: "LOW", 5: "HIGH"}


def test_diagnosis(spark):
    expected = spark.createDataFrame([(1, d) for d in (10, 11, 12, 13, 14, 14)] + [(2, 10)], "query_id int, doc_id int")
    queries = spark.createDataFrame([(1, "The rain-coat, OR of"), (2, "an of")], "query_id int, text string")
    bodies = spark.createDataFrame([(10, "x"), (11, "x"), (12, "My RAINCOATS"), (13, "rain"), (14, None)], "doc_id int, body string")
    lane = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id int, rank int")
    lanes = {"a": lane([(1, 10, 3), (1, 11, 4)]), "b": lane([(1, 10, 1), (2, 11, 1)]), "shown": lane([(1, 10, 1)])}
    got = {(r["query_id"], r["doc_id"]): (r["a"], r["b"], r["shown"], r["outcome"]) for r in search.diagnose(expected, queries, bodies, lanes, "shown").collect()}
    assert got == {
        (1, 10): (3, 1, 1, "HIT"), (1, 11): (4, None, None, "FOUND_IN_LANE"), (1, 12): (None, None, None, "POOL"), (1, 13): (None, None, None, "VOCAB"), (1, 14): (None, None, None, "VOCAB"),
        (2, 10): (None, None, None, "VOCAB"),
    }
