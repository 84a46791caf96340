"""Bounded weights, refused batches, filings, paged calendars, graph expansion, rows that follow, vector blobs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import plugins
from tessera.operators import calibration, entities
from tessera.operators import relational as R
from tessera.sources import buckets, feeds

ARRAYS = "i int, current array<double>, defaults array<double>, n array<bigint>, days array<bigint>, t array<double>"


def plain(current, defaults, n, days, t):
    lo, hi = [d * 0.5 for d in defaults], [d * 1.5 for d in defaults]
    nxt, any_move = list(current), False
    for i in range(len(current)):
        if defaults[i] <= 0 or n[i] is None or n[i] < 30 or days[i] < 10 or t[i] is None or abs(t[i]) < 2:
            continue
        to = min(max(current[i] * (1.1 if t[i] > 0 else 0.9), lo[i]), hi[i])
        if abs(to - current[i]) > 1e-6:
            nxt[i], any_move = to, True
    if not any_move:
        return current
    pinned = [False] * len(nxt)
    for _ in range(16):
        fixed = sum(w for w, p in zip(nxt, pinned, strict=True) if p)
        free = sum(w for w, p in zip(nxt, pinned, strict=True) if not p)
        if free <= 0:
            break
        k, was, changed = (1 - fixed) / free, list(pinned), False
        for i in range(len(nxt)):
            if not was[i]:
                nxt[i] *= k
                if defaults[i] > 0 and not lo[i] <= nxt[i] <= hi[i]:
                    nxt[i], pinned[i], changed = min(max(nxt[i], lo[i]), hi[i]), True, True
        if not changed:
            break
    if abs(sum(nxt) - 1) > 1e-6:
        return current
    nxt = [round(w, 4) for w in nxt]
    k = max(range(len(nxt)), key=lambda i: (nxt[i], i))
    nxt[k] += 1 - sum(nxt)
    return nxt


def test_weights_against_a_plain_version(spark):
    rng = random.Random(1)
    rows = [(0, [0.4, 0.6, 0.0], [0.4, 0.6, 0.0], [50, 50, 50], [20, 20, 20], [3.0, -3.0, 9.0]), (1, [0.5, 0.5], [0.5, 0.5], [29, 30], [10, 9], [5.0, 5.0]), (2, [0.9, 0.1], [0.6, 0.1], [99, 99], [99, 99], [3.0, 3.0])]
    for i in range(3, 90):
        d = [rng.choice([0.0, rng.random()]) for _ in range(6)] + [0.2]
        d = [x / sum(d) for x in d]
        c = [min(max(x * rng.uniform(0.4, 1.6), x * 0.5), x * 1.5) for x in d]
        c = [x / sum(c) for x in c]
        rows.append((i, c, d, [rng.choice([10, 40, 40, 40, None]) for _ in d], [rng.choice([5, 20, 20]) for _ in d], [rng.choice([None, rng.uniform(-9, 9), rng.uniform(2, 9)]) for _ in d]))
    df = spark.createDataFrame(rows, ARRAYS).select("i", calibration.moved(*[F.col(c) for c in ("current", "defaults", "n", "days", "t")]).alias("w"))
    for r in df.collect():
        want = plain(*rows[r["i"]][1:])
        assert list(r["w"]) == pytest.approx(want, abs=1e-9), rows[r["i"]]
    moved = [r for r in rows if plain(*r[1:]) != r[1]]
    assert len(moved) > 20 and all(abs(sum(plain(*r[1:])) - 1) < 1e-9 for r in moved)


def test_stale_batches_are_refused_whole(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [
        ("a", 1, day(1), "x", 0.5, 0.6, "pending"), ("a", 1, day(1), "y", 0.0, 0.0, "pending"), ("a", 2, day(2), "x", 0.5, 0.9, "rejected"),
        ("b", 1, day(1), "x", 0.5, 0.4, "pending"), ("b", 1, day(1), "y", 0.0, 0.1, "pending"), ("c", 1, day(3), "x", 0.4, 0.4, "pending"), ("c", 0, day(1), "x", 0.5, 0.5, "pending"),
        ("d", 1, day(1), "unknown", 3.0, 4.0, "pending"), ("e", 1, day(1), "x", 0.5, 0.5, "applied"),
    ]
    p = spark.createDataFrame(rows, "acc string, batch int, computed_at date, dimension string, old double, new double, status string")
    d = spark.createDataFrame([("x", 0.5), ("y", 0.0)], "dimension string, default double")
    got = {r["acc"]: (r["batch"], r["status"], r["n_stale"], r["weights"] and [tuple(w) for w in r["weights"]]) for r in calibration.applied(p, d, "acc").collect()}
    assert got == {"a": (1, "applied", 0, [("x", 0.6), ("y", 0.0)]), "b": (1, "refused", 1, None), "c": (1, "refused", 1, None), "d": (1, "applied", 0, [("unknown", 4.0)])}


def test_form4_edges(spark):
    rows = [
        (1, "<ownershipDocument/>"),
        (2, "<ownershipDocument><nonDerivativeTable><nonDerivativeTransaction><transactionAmounts><transactionShares><value>x</value></transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"),
        (3, "<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>A</rptOwnerName></reportingOwnerId></reportingOwner><reportingOwner><reportingOwnerRelationship><isOfficer>TRUE</isOfficer></reportingOwnerRelationship></reportingOwner></ownershipDocument>"),
        (4, None),
    ]
    got = {r["id"]: r for r in feeds.form4_data(spark.createDataFrame(rows, "id int, xml string")).collect()}
    assert (got[1]["code"], got[1]["shares"], got[1]["ownership"], got[1]["owner_name"]) == ("H", 0.0, "D", "")
    assert (got[2]["code"], got[2]["shares"]) == ("?", 0.0)
    assert (got[3]["owner_name"], got[3]["is_officer"], got[3]["is_director"]) == ("A", True, False)
    assert got[4]["code"] == "H" and got[4]["is_officer"] is False


def test_full_windows_are_halved(spark, monkeypatch):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    counts = {0: 2, 3: 9, 4: 1, 17: 3, 40: 5}
    table = spark.createDataFrame([(day(d), i) for d, n in counts.items() for i in range(n)], "day date, i int")
    asked = []

    def answer(windows):
        asked.append([(r["start"], r["end"]) for r in windows.collect()])
        days = windows.select("start", F.explode(F.sequence("start", "end")).alias("day"))
        w = R.Window.partitionBy("start").orderBy("day", "i")
        return table.join(days, "day").withColumn("k", F.row_number().over(w)).where("k <= 5").drop("k")

    rows, full = feeds.paged_calendar(spark, answer, day(0), day(40), 5, 15)
    got = {}
    for r in rows.collect():
        got[(r["day"] - day(0)).days] = got.get((r["day"] - day(0)).days, 0) + 1
    assert got == {0: 2, 3: 5, 4: 1, 17: 3, 40: 5}  # the full day gives what the service gives
    assert sorted((r["day"] - day(0)).days for r in full.collect()) == [3, 40]
    assert len(asked[0]) == 3 and all(a <= b for w in asked for a, b in w) and len(asked) <= 6
    monkeypatch.setattr(feeds, "MOST_REQUESTS", 4)
    with pytest.raises(ValueError, match="requests"):
        feeds.paged_calendar(spark, answer, day(0), day(40), 5, 15)


def test_rows_that_say_the_same_stay(spark, tmp_path):
    put = lambda epoch, rows: buckets.apply_changed(spark.createDataFrame(rows, "k int, v int, seen int"), str(tmp_path), epoch, ["k"], ["v"], ["seen"], 4)
    put(0, [(1, 10, 100), (2, 20, 100)])
    for _ in range(2):
        put(1, [(1, 10, 101), (2, 21, 101), (3, None, 101), (None, 1, 1)])
    schema = spark.createDataFrame([], "k int, v int, seen int").schema
    assert sorted(map(tuple, buckets.read(spark, str(tmp_path), 1, schema).collect())) == [(1, 10, 100), (2, 21, 101), (3, None, 101)]


def test_graph_expansion(spark):
    names = spark.createDataFrame([(1, "arm holdings"), (2, "hydrofarm"), (3, "nvidia"), (4, "tsmc"), (5, "asml"), (6, "lonely")], "node int, name string")
    edges = [(1, 3, 9), (1, 4, 9), (1, 5, 2), (2, 5, 4), (3, 4, 7)]
    both = spark.createDataFrame(edges + [(b, a, s) for a, b, s in edges], "node int, other int, strength int")
    q = spark.createDataFrame([(1, "What of (Arm)?"), (2, "nvidia and TSMC"), (3, "lonely of"), (4, "farm then arm"), (5, None), (6, "")], "query_id int, text string")
    got = {r["query_id"]: list(r["added"]) for r in entities.graph_expanded(q, names, both, 2).collect()}
    # "arm" stands first in "arm holdings"; "farm" in hydrofarm; of each two neighbours, ties by name
    assert got == {1: ["nvidia", "tsmc"], 2: ["arm holdings"], 3: [], 4: ["asml", "nvidia", "tsmc"], 5: [], 6: []}


def test_rows_that_follow(spark):
    rows = spark.createDataFrame([(k, i, float(i)) for k in "ab" for i in range(1, 40)], "k string, i bigint, v double")
    entries = rows.where("i % 10 = 1").select("k", "i", F.col("v").alias("p"))
    got = sorted((r["k"], r["i"], r["after"], r["v"]) for r in R.following(entries, rows, "k", "i", 7, ["v"]).collect())
    assert got == sorted((k, i, a, float(i + a)) for k in "ab" for i in (1, 11, 21, 31) for a in range(1, 8) if i + a < 40)


def test_vector_blobs(spark):
    vectors = [[1.0, -2.5, float("inf")], [], None, [None, 3.0], [0.1] * 70]
    df = spark.createDataFrame(list(enumerate(vectors)), "i int, v array<float>").coalesce(1)
    blobs = {r["i"]: r["b"] for r in df.select("i", plugins.to_blob(F.col("v")).alias("b")).collect()}
    for i, v in enumerate(vectors):
        assert blobs[i] is None if v is None else bytes(blobs[i]) == np.array(v, dtype="<f4").tobytes()
    cut = [bytes(blobs[0]) + b"xy", b"", None, b"abc", bytes(blobs[4])]
    back = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(cut)], "i int, b binary").coalesce(1)
    got = {r["i"]: r["v"] for r in back.select("i", plugins.from_blob(F.col("b")).alias("v")).collect()}
    assert got[0] == [1.0, -2.5, float("inf")] and got[1] == got[3] == [] and got[2] is None and got[4] == pytest.approx([0.1] * 70)
    whole = {r["i"]: r["v"] for r in df.where("v is not null").select("i", plugins.from_blob(plugins.to_blob(F.col("v"))).alias("v")).collect()}
    assert whole[0] == vectors[0] and whole[1] == [] and np.isnan(whole[3][0]) and whole[3][1] == 3.0
