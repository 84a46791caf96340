import json

from pyspark.sql import functions as F

from tessera.sources import feeds, tables
from tessera.streaming import streams


def test_rss_and_failures(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://a/1</link><pubDate>Fri, 05 Jan 2024 10:00:00 +0000</pubDate></item><item><title>B</title><link>http://a/2</link><pubDate>bad</pubDate></item></channel></rss>")
    good, bad = feeds.collect({"ok": lambda: feeds.rss(spark, str(tmp_path / "f.xml"), "ok"), "broken": lambda: feeds.rss(spark, str(tmp_path / "missing.xml"), "x")}, spark)
    rows = {r["title"]: r for r in good.collect()}
    assert rows["A"]["published_at"].hour == 10 and rows["B"]["published_at"] is None and rows["A"]["source_type"] == "news"
    assert [r["feed"] for r in bad.collect()] == ["broken"]
    assert good.columns == [f.name for f in feeds.ARTICLE]


def test_json_hits_and_markets(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"hits": [{"objectID": "1", "title": "Focus habits", "url": "u"}, {"objectID": "2", "title": "Compilers", "url": "v"}]}))
    assert {r["title"]: r["sector"] for r in feeds.json_hits(spark, str(tmp_path / "h.json"), "hn", ["habit"]).collect()} == {"Focus habits": "productivity", "Compilers": "tech"}
    (tmp_path / "m.json").write_text(json.dumps([{"id": 1, "outcomes": '["Yes","No"]', "outcomePrices": ["0.4", "0.6"], "volume": "12.5"}, {"id": 2, "outcomes": ["A", "B"], "volume": 3}]))
    m = feeds.markets(spark, str(tmp_path / "m.json")).collect()
    assert [(r["id"], r["prices"], r["volume"]) for r in m] == [("1", [0.4, 0.6], 12.5)]


def test_filings(spark):
    xml = "<ownershipDocument><issuer><issuerTradingSymbol>abc</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>N</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    r = feeds.form4(spark.createDataFrame([(1, xml)], "id int, xml string")).first()
    assert (r["ticker"], r["is_director"], r["is_officer"], r["code"], r["shares"], r["price"]) == ("ABC", True, False, "P", 10.0, 2.5)
    h = "<informationTable><infoTable><nameOfIssuer>X</nameOfIssuer><cusip>1</cusip><value>5</value><shrsOrPrnAmt><sshPrnamt>7</sshPrnamt></shrsOrPrnAmt></infoTable></informationTable>"
    assert [(x["issuer"], x["shares"]) for x in feeds.holdings(spark.createDataFrame([(1, h)], "id int, xml string")).collect()] == [("X", 7)]
    html = spark.range(1).select(feeds.filing_items(F.lit("Item 2.02 ... ITEM&nbsp;5.02 item 2.02")).alias("x")).first()["x"]
    assert html == ["2.02", "5.02"]


def test_small_sources(spark):
    posts = spark.createDataFrame([(1, "a", "u1", 5), (2, "b", "u1", 9), (3, "a", "u2", 9), (4, "a", "u3", 1)], "pos int, sub string, url string, score int")
    assert sorted(r["pos"] for r in feeds.pick(posts, F.col("score") > 2, "sub", "pos", 1).collect()) == [1]
    views = spark.createDataFrame([("p", f"2024-01-{d:02d}", 50.0 if d > 23 else 20.0) for d in range(1, 31)], "page string, day string, views double").withColumn("day", F.col("day").cast("date"))
    assert feeds.attention(views, F.lit("2024-01-30").cast("date")).first()["delta"] == 150.0
    obs = spark.createDataFrame([("s", 1, "100"), ("s", 2, "."), ("s", 3, "110")], "series string, day int, value string")
    assert [r["change_pct"] for r in feeds.series_change(obs).orderBy("day").collect()] == [None, 10.0]
    calls = []

    def fetch(a, b):
        calls.append((a, b))
        return [1] * (10 if a != b else 1)

    assert feeds.page_windows(fetch, "2024-01-01", "2024-01-04", 10) == [1, 1, 1, 1] and len(calls) == 7


def test_sinks_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "event_id bigint, k bigint, v double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).groupBy("k").agg(F.sum("v").alias("v"))
    streams.run_batches(stream, "update", tables.upsert_sink(str(tmp_path / "out"), ["k"], overwrite=["v"]), str(tmp_path / "cp"))
    last = sorted((p for p in (tmp_path / "out").iterdir()), key=lambda p: int(p.name[1:]))[-1]
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(last)).collect()} == {k: float(sum(range(k, 30, 3))) for k in range(3)}
    e = rows.select("event_id", (F.col("event_id") % 3).alias("user_id"), (F.col("event_id") > 20).alias("active"))
    e.repartition(2).write.parquet(str(tmp_path / "in2"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in2"))
    assert sorted(r["user_id"] for r in streams.run_to_end(streams.newly_entered(s), str(tmp_path / "new")).collect()) == [0, 1, 2]
    panel = spark.createDataFrame([("A", f"2024-01-{d:02d}", 1.0, 1.0, 1.0, 10.0, 2e6 if d == 9 else 1.0) for d in range(1, 10)] + [("B", "2024-01-01", 1.0, 1.0, 1.0, 1.0, 1.0)], "sym string, date string, o double, h double, l double, c double, v double")
    assert {r["sym"] for r in tables.liquid_panel(panel, 1e6).collect()} == {"A"}
    days = rows.withColumn("day", F.col("k"))
    tables.replace_days(days, str(tmp_path / "days"))
    tables.replace_days(days.where("k = 1").limit(1), str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).count() == 21
    assert tables.by_ids(rows, spark.createDataFrame([(3,), (3,), (99,)], "event_id bigint"), "event_id").count() == 1
