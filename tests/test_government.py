"""Records of the four services, the entities they name, whole trades, fresh events, markets."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ledger, search
from tessera.sources import government


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def page(tmp_path, results):
    (tmp_path / "p.json").write_text(json.dumps({"results": results}))
    return str(tmp_path)


def test_numbers_as_printf_writes_them(spark):
    import random

    rng = random.Random(2)
    xs = [0.0, 0.5, 1.5, 2.5, 0.125, 0.375, -0.03, -0.5, -1.25, 128.645, 1.005, 1.15, 1.45, 0.05, 9.995, 99.5, 1e-9, 123456789.125, 0.1 + 0.2, 130.5, 999999.9999]
    xs += [rng.uniform(-1e6, 1e6) for _ in range(300)] + [round(rng.uniform(-1e4, 1e4), 3) for _ in range(300)] + [rng.randrange(-10**6, 10**6) / 8 for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[text.fixed(F.col("x"), n).alias(f"n{n}") for n in range(4)])
    for r in df.collect():
        for n in range(4):
            assert r[f"n{n}"] == f"{r['x']:.{n}f}", r["x"]
    assert one(spark, text.fixed(F.lit(None).cast("double"), 1)) is None


def test_money_and_clips(spark):
    m = lambda x, **k: one(spark, government.money(F.lit(float(x)), **k))
    assert [m(x) for x in (2.5e9, 1.25e6, 1499.0, 130500.0, 999.0, 0.0)] == ["$2500.0M", "$1.2M", "$1K", "$130K", "$999", "$0"]
    assert m(2.5e9, billions=True) == "$2.5B" and m(0, none="undisclosed amount") == "undisclosed amount" and m(12, none="x") == "$12"
    c = lambda x, n: one(spark, government.clipped(F.lit(x), n))
    assert (c("abcdef", 6), c("abcdefg", 6), c("ééé", 6), c("éééé", 6)) == ("abcdef", "abc...", "ééé", "ééé...")


def test_awards(spark, tmp_path):
    rows = [{"Award ID": "1", "Recipient Name": "X", "Award Amount": 1e6, "Description": "d" * 81, "Start Date": "2024-02-03"}, {"Award Amount": 999_999.0}, {"Award Amount": 5e9, "Start Date": "no day"}, {}]
    got = sorted(government.awards(spark, page(tmp_path, rows)).collect(), key=lambda r: r["title"])
    assert [r["title"] for r in got] == ["Unknown wins $5.0B Unknown Agency contract: No description", f"X wins $1.0M Unknown Agency contract: {'d' * 77}..."]
    assert got[0]["published_at"] is None and got[1]["published_at"] == dt.datetime(2024, 2, 3)
    assert json.loads(got[0]["financial_metadata"])["naics"] == "N/A" and got[1]["url"] == "https://www.usaspending.gov/award/1"


def test_contributions_and_lobbying(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    got = government.contributions(spark, page(a, [{"contribution_receipt_amount": 10_000.0, "sub_id": "7"}, {"contribution_receipt_amount": 9999.0}])).collect()
    assert [(r["title"], r["feed_id"]) for r in got] == [("Unknown contributes $10K to Unknown Committee (N/A)", "fec_7")]
    act = {"general_issue_code_display": "Taxes", "government_entities": [{"name": "B"}, {"name": None}, {"name": "A"}, {"name": "B"}]}
    rows = [
        {"filing_uuid": "1", "client": {"name": "C"}, "income": "0", "expenses": "2500", "lobbying_activities": [act, {"general_issue_code_display": None}]}, {"filing_uuid": "2", "client": {"name": "D"}, "income": "x"},
        {"filing_uuid": "3", "client": {"name": None}, "income": "5"}, {"client": {"name": "E"}, "income": "5"}, {"filing_uuid": "4", "client": {"name": "F"}, "lobbying_activities": [{"description": "d"}], "dt_posted": "2024-01-02T03:04"},
    ]
    got = {r["feed_id"]: r for r in government.lobbying(spark, page(b, rows)).collect()}
    assert {k: r["title"] for k, r in got.items()} == {"lda_1": "C spent $2K lobbying on Taxes", "lda_4": "F lobbied on unspecified issues"}
    assert json.loads(got["lda_1"]["financial_metadata"])["government_entities"] == ["A", "B"] and got["lda_4"]["published_at"] == dt.datetime(2024, 1, 2)


def test_rules(spark, tmp_path):
    rows = [{"title": "T" * 121, "document_number": "1", "html_url": "u", "type": "PRORULE", "agencies": [{"name": "A"}, {}, {"name": "B"}], "cfr_references": [{"title": "21", "part": "9"}, {"title": "1"}]}, {"title": "T", "document_number": "2"}, {"title": "S", "document_number": "3", "html_url": "v"}]
    got = {r["url"]: r for r in government.rules(spark, page(tmp_path, rows)).collect()}
    assert got["u"]["title"] == "A, B: " + "T" * 117 + "..." and got["v"]["title"] == "Unknown Agency: S"
    assert json.loads(got["u"]["financial_metadata"]) == {"document_number": "1", "agencies": ["A", "B"], "cfr_references": "21 CFR Part 9", "rule_type": "Proposed Rule", "abstract": "No abstract available"}


def test_named_entities(spark):
    meta = [
        ("SEC EDGAR", {"entity_name": "Acme", "filing_type": "8-K", "display_names": ["Acme", "Beta", None, "Late"]}), ("SEC EDGAR", {"entity_name": "", "filing_type": "4"}), ("USASpending", {"recipient": "R", "agency": "Dept"}),
        ("FEC", {"recipient": "PAC", "contributor": "Jo", "employer": "RETIRED"}), ("FEC", {"employer": "Works"}), ("Senate LDA", {"client": " Big Co ", "registrant": "Firm"}), ("USPTO", {"assignee": "Inv"}), ("Wikipedia Pageviews", {"entity_name": "Wiki"}),
        ("EIA", {"product": "oil"}), ("Federal Register", {"agencies": "EPA, FDA ,,"}), ("Federal Register", {"agencies": ["EPA"]}), ("Blog", {"entity_name": "No"}), ("FEC", "no json"),
    ]
    df = spark.createDataFrame([(i, s, m if isinstance(m, str) else json.dumps(m)) for i, (s, m) in enumerate(meta)] + [(99, "FEC", None)], "id int, source_name string, financial_metadata string")
    got = sorted((r["id"], r["name"], r["normalized"], r["entity_type"], r["sentiment"]) for r in government.named_entities(df, ["id"]).collect())
    assert got == sorted([
        (0, "Acme", "acme", "material_event", 0.0), (0, "Beta", "beta", "company", 0.0), (2, "Dept", "dept", "regulatory_action", 0.0), (3, "PAC", "pac", "person", 0.0), (3, "Jo", "jo", "person", 0.0), (4, "Works", "works", "company", 0.0),
        (5, " Big Co ", "big co", "company", 0.0), (5, "Firm", "firm", "lobbying_disclosure", 0.0), (6, "Inv", "inv", "patent_cluster", 0.3), (7, "Wiki", "wiki", "company", 0.0), (8, "oil", "oil", "topic", 0.0), (9, "EPA", "epa", "regulatory_action", 0.0), (9, "FDA", "fda", "regulatory_action", 0.0),
    ])


def test_whole_trades(spark):
    trades = spark.createDataFrame([(1, 10.0, 125.0, 10.0, 50.0), (2, 10.0, 0.0, 5.0, 5.0), (3, 10.0, 20.0, 0.0, 10.0), (4, 10.0, 20.0, 0.0, 10.0), (5, 0.0, 1.0, 1.0, 1.0)], "trade_id int, entry double, realized double, pnl double, qty double")
    events = [(1, 1, "half_close", 50.0, None), (2, 1, "note", 9.0, None), (3, 1, "half_close", 99.0, None), (3, 2, "resync", None, '{"sells":[[4,1.0],[],[6,2]]}'), (3, 3, "stop_sale", 10.0, None), (4, 2, "resync", None, "{bad"), (4, 3, "partial_sale", 10.0, None), (5, 1, "half_close", 1.0, None)]
    got = {r["trade_id"]: r["pct"] for r in ledger.whole_trade_pct(trades, spark.createDataFrame(events, "trade_id int, id int, kind string, qty double, detail string")).collect()}
    assert got == {1: pytest.approx(13.5), 2: None, 3: pytest.approx(20 / 300 * 100), 4: pytest.approx(10.0), 5: None}


def test_fresh_events(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [
        (1, "tone", "A", day(30), day(30), "up", 1.0), (2, "tone", "B", day(20), day(29), "up", 5.0), (3, "tone", "C", day(28), day(28), "up", 9.0), (4, "director", "D", day(1), day(26), "up", 2.0), (5, "tone", "HELD", day(30), day(30), "up", 9.0),
        (6, "tone", "E", day(29), day(29), "down", 9.0), (7, "other", "F", day(30), day(30), "up", 9.0), (8, "tone", "G", day(29), day(29), "up", 8.0), (9, "director", "G", day(29), day(29), "up", 1.0), (10, "tone", "H", day(30), day(30), "up", 3.0),
    ]
    e = spark.createDataFrame(rows, "id int, kind string, ticker string, day date, detected date, direction string, strength double")
    held = spark.createDataFrame([("HELD",), ("HELD",)], "ticker string")
    acted = spark.createDataFrame([("G", "tone", day(29)), ("G", "tone", day(1)), ("H", "tone", day(29)), ("A", "director", day(30))], "ticker string, kind string, entry date")
    out = ledger.event_candidates(e, held, acted, F.lit(day(30)), "director", ["up"], ["tone", "director"])
    assert [r["id"] for r in out.collect()] == [2, 10, 4, 1, 9]
    assert ledger.event_candidates(e, held, acted, F.lit(day(30)), "director", ["up"], ["tone", "director"], 2).count() == 2


def test_markets(spark):
    rows = [(1, 1e4, 1e4, "Rain?", None, None, 0.5), (2, 9999.0, 1e5, "Rain?", None, 0.9, 0.5), (3, 1e5, 9999.0, "Rain?", None, 0.9, 0.5), (4, 1e5, 1e5, "Rain?", None, 0.04, 0.98), (5, 1e5, 1e5, "Rain?", None, -0.05, 0.99), (6, 1e5, 1e5, "How many Tweets", None, 0.5, 0.5),
            (7, 1e5, 1e5, 'Will X say "no"', None, 0.5, 0.5), (8, 1e5, 1e5, "Q", "What will he say", 0.5, 0.5), (9, 1e5, 1e5, "Q", "He will say", 0.5, 0.03), (10, 1e5, 1e5, "Tweets", None, None, 0.02)]
    m = spark.createDataFrame(rows, "id int, volume_24h double, liquidity double, question string, event_title string, change_1d double, probability double")
    assert [r["id"] for r in m.where(ledger.worth_showing()).orderBy("id").collect()] == [1, 5, 9]


def test_older_related(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10.0]) for i in range(8)], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, q array<double>")
    s = spark.createDataFrame([(i, f"h{i}", dt.date(2024, 1, 1 + i)) for i in range(8)], "vec_id bigint, headline string, day date")
    got = search.older_related(v, q, s, F.lit(dt.date(2024, 1, 6)), 3, 0.95).orderBy("rank").collect()
    assert [(r["vec_id"], r["headline"]) for r in got] == [(1, "h1"), (2, "h2"), (3, "h3")]
