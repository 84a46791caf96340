"""Edge cases of the relational, ordered, search and scalar operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, scoring, text
from tessera.operators import entities, ordered, search
from tessera.operators import relational as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cosine_hand_values(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
    assert one(spark, scoring.cosine(a(1, 2), a(1, 2))) == pytest.approx(1)
    assert one(spark, scoring.cosine(a(1, 0), a(0, 1))) == 0
    assert one(spark, scoring.cosine(a(1, 0), a(-1, 0))) == pytest.approx(-1)
    assert one(spark, scoring.cosine(a(1, 2, 3), a(4, 5, 6))) == pytest.approx(0.974632, abs=1e-6)
    assert one(spark, scoring.cosine(a(), a(1))) == 0
    assert one(spark, scoring.cosine(a(1, 2, 9), a(1, 2))) == pytest.approx(1)


def test_scores(spark):
    assert one(spark, scoring.acceleration(F.lit(0), F.lit(0))) == 0
    assert one(spark, scoring.acceleration(F.lit(3), F.lit(0))) == 10
    assert one(spark, scoring.saturate(F.lit(-1.0), 5.0)) == 0
    assert one(spark, scoring.recency(F.lit(-2), 3.0)) == 1
    assert one(spark, scoring.recency(F.lit(3), 3.0)) == 0.5
    assert one(spark, scoring.finite_or(F.lit(float("inf")), F.lit(0.0))) == 0


def test_text(spark):
    assert one(spark, text.normalize_title(F.lit("  Hello,  WORLD! 42 "))) == "hello world 42"
    same = [one(spark, text.hash_url(F.lit(u))) for u in ("http://A.com/x", " http://a.com/x/ ", "http://a.com/x?q=1")]
    assert len(set(same)) == 1
    assert one(spark, text.hash_url(F.lit("http://a.com/x/?q"))) != same[0]  # the slash goes before the query does
    assert one(spark, text.json_envelope(F.lit("no json"))) is None
    assert one(spark, text.clip(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.is_noise(F.lit("ALL CAPS NAME"))) is True
    assert one(spark, text.escape_like(F.lit(r"50%_a\b"))) == r"50\%\_a\\b"


def test_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.add_trading_days(day("2024-01-05"), 1)) == dt.date(2024, 1, 8)
    assert one(spark, dates.weekdays_between(day("2024-01-05"), day("2024-01-09"))) == 2
    assert one(spark, dates.weekdays_between(day("2024-01-09"), day("2024-01-05"))) == 0
    assert one(spark, dates.in_blackout(day("2024-01-05"), day("2024-01-10"))) is True
    assert one(spark, dates.parse_day(F.lit("2024-01-05T10:00:00"))) == dt.date(2024, 1, 5)
    assert one(spark, dates.parse_day(F.lit(""))) is None
    assert one(spark, dates.session_minutes(F.lit("2024-01-05 14:30:00").cast("timestamp"))) == 570


def test_as_of_both_ways(spark):
    facts = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 50.0), ("b", 3, None)], "k string, t int, v double")
    probes = spark.createDataFrame([("a", 0), ("a", 1), ("a", 4), ("a", 9), ("b", 9), ("c", 1)], "k string, at int")
    back = {(r["k"], r["at"]): r["asof_v"] for r in R.as_of(probes, facts, "k", "at", "t", ["v"]).collect()}
    assert back == {("a", 0): None, ("a", 1): 10.0, ("a", 4): 10.0, ("a", 9): 50.0, ("b", 9): None, ("c", 1): None}
    ahead = {(r["k"], r["at"]): r["asof_v"] for r in R.as_of(probes, facts, "k", "at", "t", ["v"], forward=True).collect()}
    assert ahead == {("a", 0): 10.0, ("a", 1): 10.0, ("a", 4): 50.0, ("a", 9): None, ("b", 9): None, ("c", 1): None}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "x", 2, None), (2, "y", 3, "f")], "k int, a string, n int, f string")
    new = spark.createDataFrame([(1, "z", 5, "g"), (3, "w", 1, None)], "k int, a string, n int, f string")
    got = sorted(map(tuple, R.upsert(old, new, ["k"], ["a"], ["n"], ["f"]).collect()))
    assert got == [(1, "z", 7, "g"), (2, "y", 3, "f"), (3, "w", 1, None)]
    got = sorted(map(tuple, R.upsert_changed(old, new.union(spark.createDataFrame([(2, "y", 9, "q")], new.schema)), ["k"], ["a"], ["n"]).collect()))
    assert got == [(1, "z", 5, True), (2, "y", 3, False), (3, "w", 1, True)]


def test_interval_join_has_no_duplicates(spark):
    l = spark.createDataFrame([(1, dt.date(2024, 1, d)) for d in range(1, 20)], "k int, a date")  # noqa: E741
    r = l.withColumnRenamed("a", "b")
    got = sorted((x["a"], x["b"]) for x in R.interval_join(l, r, ["k"], "a", "b", 1, 3).collect())
    days = [dt.date(2024, 1, d) for d in range(1, 20)]
    assert got == sorted((a, b) for a in days for b in days if 1 <= (b - a).days <= 3)


def test_ordered(spark):
    s = spark.createDataFrame([("a", i) for i in (0, 5, 9, 10, 14, 20)] + [("b", 3)], "k string, i bigint")
    assert sorted(map(tuple, ordered.cooldown(s, "k", "i", 10).collect())) == [("a", 0), ("a", 10), ("a", 20), ("b", 3)]
    b = spark.createDataFrame([("g", i, t) for i, t in enumerate([5, 5, 5, 12, 1])], "g string, i bigint, t bigint")
    assert [r["batch"] for r in ordered.token_batches(b, "g", "i", "t", 10, 128).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    bars = [("s", dt.date(2024, 1, d), 1, sc, p) for d, sc, p in [(1, 0.5, 100.0), (2, None, 101.0), (3, None, 89.0), (4, 0.5, 90.0), (5, None, 120.0), (6, 0.9, 100.0)]]
    sim = ordered.simulate(spark.createDataFrame(bars, "g string, day date, ticker bigint, score double, close double"), "g", 2, 1000.0, 0.1, 0.15, 6)
    assert sorted((r["entry_day"].day, r["exit_day"].day, r["reason"]) for r in sim.collect()) == [(1, 3, "stop"), (4, 5, "target"), (6, 6, "data_end")]


def test_simulation_on_admissible_rows_is_the_whole_simulation(spark):
    import random

    rng = random.Random(8)
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(d), t, rng.choice([None, round(rng.random(), 1)]), 100 * rng.uniform(0.8, 1.25)) for d in range(40) for t in range(30) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "g string, day date, ticker bigint, score double, close double")
    few = ordered.admissible(df, "g", 2, 4)
    assert few.count() < 0.6 * len(rows)
    got = sorted(map(tuple, ordered.simulate(df, "g", 2, 1000.0, 0.1, 0.15, 4).collect()))
    pdf = df.toPandas()
    want = ordered.walk(pdf.assign(end=pdf["day"].max()), "g", 2, 1000.0, 0.1, 0.15, 4, 0.0)
    assert got == sorted(map(tuple, want.itertuples(index=False))) and len(got) > 20


def test_containment_inside_words(spark):
    issuers = spark.createDataFrame([(1, "Steelworks Inc"), (2, "steel"), (3, "Stee"), (4, "al"), (5, "copper")], "filing bigint, issuer string")
    topics = spark.createDataFrame([("steel",), ("metal",)], "topic string")
    assert {r["topic"]: r["filings"] for r in entities.contained(issuers, topics).collect()} == {"steel": 3, "metal": 1}


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue bird")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in search.minmax(search.bm25(docs, spark.createDataFrame([(1, "Red fox")], "query_id bigint, text string"), {"text": 1.0}), "query_id").collect()}
    assert got == {1: 1.0, 2: 0.0}
    lane = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id int, score double, rank int")
    fused = {r["doc_id"]: (r["match_type"], r["score"]) for r in search.fuse(lane([(1, 1, 1.0, 0), (1, 2, 0.0, 1)]), lane([(1, 1, 0.9, 0)])).collect()}
    assert fused[1] == ("both", 1.0) and fused[2][0] == "keyword"


def test_distinct_results(spark):
    rows = [(1, 1, "a", "big news today here", [1.0, 0.0]), (1, 2, "b", "big news today there", [0.0, 1.0]), (1, 3, "b", "other words", [1.0, 0.1]), (1, 4, "a", "same source near", [1.0, 0.05]), (1, 5, "a", "third of a source", None), (1, 6, "c", None, None)]
    df = spark.createDataFrame(rows, "query_id int, rank int, source string, headline string, embedding array<double>")
    assert sorted(r["rank"] for r in ordered.distinct_results(df, "query_id", "rank").collect()) == [1, 2, 4, 6]


def test_title_candidates(spark):
    assert one(spark, text.title_candidates(F.lit("ACME WIDGETS, INC."))) == ["ACME WIDGETS, INC.", "ACME WIDGETS", "Acme Widgets, Inc.", "Acme Widgets"]


def test_entities(spark):
    from tessera.operators import entities

    e = spark.createDataFrame([(1, "Acme Inc"), (2, "Blue Sky")], "entity_id bigint, entity string")
    n = spark.createDataFrame([("acme inc",), ("ACME Corp",), ("the blue sky fund",), ("nobody",)], "name string")
    got = {r["name"]: (r["entity_id"], float(r["confidence"])) for r in entities.tiered_match(n, e).collect()}
    assert got == {"acme inc": (1, 0.95), "ACME Corp": (1, 0.85), "the blue sky fund": (2, 0.6)}
    m = spark.createDataFrame([(1, "c1", None, "Acme Inc", "x"), (2, None, "ACM", "Acme", "x"), (3, "c1", None, "Other", "x"), (4, None, "ACM", "Something", "x"), (5, None, None, "Acme Labs", "x"), (6, None, None, "Zed", "x")], "mention_id bigint, cik string, ticker string, name string, block string")
    assert {r["mention_id"]: r["canonical"] for r in entities.canonicalise(m).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}


def test_sizing_and_plugins(spark):
    import numpy as np

    from tessera.functions import plugins, sizing

    s = sizing.Strategy()
    assert s.with_changes(stop=-0.05).stop == -0.05
    with pytest.raises(ValueError):
        s.with_changes(weights=(0.3, 0.1, 0.3, 0.3, 0.0, 0.0, 0.0, 0.0))
    with pytest.raises(ValueError):
        s.with_changes(nothing=1)
    w = sizing.bounded_weights([0.5, 0.3, 0.2], [3.0, -0.5, 0.1], [40, 40, 40], [20, 20, 20])
    assert abs(sum(w) - 1) < 1e-9 and w[1] == 0.3
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    v = plugins.embed(docs, plugins.hash_embedder(8), "hash-8")
    rows = {r["doc_id"]: r["embedding"] for r in v.collect()}
    assert np.allclose(rows[1], plugins.hash_embedder(8)(["a b"], "document")[0]) and set(rows[2]) == {0.0}
    assert plugins.one_space(v) is v
    with pytest.raises(ValueError):
        plugins.one_space(v.union(v.withColumn("model", F.lit("other"))))
    assert plugins.extract(docs, lambda t: [(w, "word") for w in t.split()], "doc_id").count() == 2


def test_every_nearest_neighbour_query_is_answered(spark, tmp_path, monkeypatch):
    # 70 queries, more than the 64 that were once answered, in several blocks
    import random

    import duckdb

    from tessera.plans import catalog
    from tests.oracle import difference

    monkeypatch.setattr(search, "TASK_QUERIES", 30)
    monkeypatch.setattr(search, "TASK_ROWS", 900)
    rng = random.Random(5)
    rows = [(i, i % 5, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(4200)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("sl5_knn", "sl6_older_knn", "ag48_metrics"):
        assert difference(spark, con, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name]) is None, name


def test_backtests_against_the_whole_walk(spark):
    from tessera.plans import catalog, domain
    from tests.test_oracles import SF

    whole = lambda df, *args: ordered.walk((p := df.toPandas()).assign(end=p["day"].max()), "group_", *args)
    show = lambda rows: sorted((r[1], r[2], r[3], r[4], round(r[5], 6)) for r in rows)
    base = domain._scenarios(spark, SF).where("scenario = 'base'").withColumnRenamed("scenario", "group_")
    assert show(catalog.queries()["cp16_backtest"](spark, SF).collect()) == show(whole(base, 5, 100_000.0, 0.10, 0.15, 6, 0.0).itertuples(index=False))
    replay = domain._replayed(spark, SF)
    assert show(catalog.queries()["cp19_replay"](spark, SF).collect()) == show(whole(replay, 5, 100_000.0, 0.10, 0.15, 6, 0.001).itertuples(index=False))


def test_answer_markers_and_headlines(spark):
    rows = ['see [story:7][story: 8 ] [story:x] [story:9', '[followup: "a?" | type: "deeper"] [followup: b] [followup: ""]', '[prediction: "up" | confidence: .9 | timeframe: "1y"] [prediction: "x"]', "## more\n1. [followup: z]\n- [story:1]\nend", None]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    got = df.select(text.story_references(F.col("a")), text.followups(F.col("a")), text.predictions(F.col("a")), text.without_markers(F.col("a"))).collect()
    assert got[0][0] == [7, 8] and got[1][1] == ["deeper::a?", "b"] and [tuple(p) for p in got[2][2]] == [("up", 0.9, "1y")]
    assert got[3][3] == "## more\nend" and got[4][0] is None
    heads = spark.createDataFrame([("Bank Upgrades X to Buy",), ("X Prices 3M Share Offering",), ("X Prices Offering Of Notes",), (None,)], "h string")
    assert [r[0] and tuple(r[0]) for r in heads.select(text.headline_rule(F.col("h"))).collect()] == [("upgrade", 1), ("equity_offering", -1), None, None]


def test_vector_blobs(spark):
    from tessera.functions import plugins

    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    rows = df.select(plugins.to_blob(F.col("v")).alias("b")).select("b", plugins.from_blob(F.col("b")).alias("v")).collect()
    assert bytes(rows[0]["b"]).hex() == "0000c03f000000c0" and rows[0]["v"] == [1.5, -2.0] and rows[1]["v"] == [] and rows[2]["v"] is None


def test_dense_index_and_shuffles(spark):
    import math

    df = spark.range(0, 5000, 7).withColumn("v", F.col("id") * 2)
    rows = R.dense_index(df, "id").orderBy("id").collect()
    assert [r["i"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0].asDict().keys() == {"id", "v", "i"}
    assert R.dense_index(df.where("id < 0"), "id").count() == 0
    for n in (1, 2, 10, 2654435761, 2 * 2654435761):
        assert all(math.gcd(a, n) == 1 or n == 1 for a in R.coprime_powers(n, 5))


def test_permuted_sums_by_blocks(spark, monkeypatch):
    """Against the plain sums, with one and with several blocks; rows are shuffled for each block, not for each replicate."""
    monkeypatch.setattr(R, "SEGMENT", 4)
    n, count = 45, 7
    data = [(i, (i * 7 % 5) / 4, None if i == 9 else i * 0.5) for i in range(1, n + 1)]
    rows = spark.createDataFrame(data, "i long, x double, y double")
    ys = {i: y or 0.0 for i, _, y in data}
    want = {k: sum(x * ys[((i - 1) * p + k) % n + 1] for i, x, _ in data) for k, p in enumerate(R.coprime_powers(n, count), 1)}
    for block in (1 << 22, 8):
        monkeypatch.setattr(R, "BLOCK", block)
        got = R.permuted_sums(rows, "i", "x", "y", count)
        assert {r["k"]: r["total"] for r in got.collect()} == pytest.approx(want)
    assert R.permuted_sums(rows.limit(0), "i", "x", "y", count).count() == 0


def test_queries_of_the_nearest_are_not_copied_more_often_than_rows(spark, monkeypatch):
    """Floats are dealt as floats, and at most as many copies of queries as of rows; the nearest stay the same."""
    e = spark.range(600).selectExpr("id AS vec_id", "transform(sequence(1, 8), k -> cast(sin(id * 7 + k * k) AS float)) AS embedding")
    q = e.where("vec_id % 2 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    want = search.knn(e, q, 3).orderBy("query_id", "rank").collect()
    dealt, plain = [], type(e).repartitionById
    monkeypatch.setattr(type(e), "repartitionById", lambda self, *a: (dealt.append(self), plain(self, *a))[1])
    monkeypatch.setattr(search, "CHUNK", 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        assert search.knn(e, q, 3).orderBy("query_id", "rank").collect() == want and len(want) == 900
        assert dealt[0].count() <= 2 * 600 and dict(dealt[0].dtypes)["v"] == "array<float>"
        wide = q.selectExpr("query_id", "cast(q AS array<double>) AS q")
        assert search.knn(e, wide, 3).orderBy("query_id", "rank").collect() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
