"""Queries of the sources and sinks: files are left in the shared folder as a service would, then read by the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.session import load
from tessera.sources import buckets, feeds, scratch, tables


#: Rows of one page as a service would give it.
PAGE = 1000


def _items(spark, d, tag: str, link: str, when: str, form: str):
    x = load(spark, d, "events").select(
        F.floor(F.col("event_id") / PAGE).alias("page"),
        F.concat(F.lit(f"<{tag}><title> Story "), "event_id", F.lit(" &amp; more</title>"), F.expr(link), F.lit(f"<{when}>"), F.date_format("ts", form), F.lit(f"</{when}><id>urn:"), "event_id", F.lit(f"</id><summary>s"), "user_id", F.lit(f"</summary></{tag}>")).alias("value"),
    )
    body = x.groupBy("page").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("value"), ""), F.lit("</channel></rss>")).alias("value"))
    return scratch.dropped(body, "feed", "page")


_STORY = "SELECT 'Story ' || event_id || ' & more' AS title, {url} AS url, 'urn:' || event_id AS source_id, date_trunc('second', ts) AS published_at, 's' || user_id AS content_snippet, '{sector}' AS sector, 'news' AS source_type FROM events"


def _shown(df):
    return df.select("title", "url", "source_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "content_snippet", "sector", "source_type")


@query(_STORY.format(url="'http://a/' || event_id", sector="world"))
def sc3_rss(spark, d):
    path = _items(spark, d, "item", "concat('<link>http://a/', event_id, '</link>')", "pubDate", "EEE, d MMM yyyy HH:mm:ss +0000")
    return _shown(feeds.rss(spark, f"{path}/*/*", "wire"))


@query(_STORY.format(url="'urn:' || event_id", sector="science"))
def sc7_atom(spark, d):
    path = _items(spark, d, "entry", "''", "published", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _shown(feeds.rss(spark, f"{path}/*/*", "papers", "science", "entry"))


@query("""WITH f AS (SELECT 'q' || (event_id % 3) AS feed_id, event_id FROM events WHERE event_id % 3 < 2) SELECT feed_id, count(*) AS n, 'f2' AS failed FROM f GROUP BY 1""")
def sc1_collect(spark, d):
    """Several query feeds at once; one of them is broken and only reported."""
    e = load(spark, d, "events")
    read = lambda i: lambda: feeds.article(e.where(F.col("event_id") % 3 == i), title=F.col("event_id"), feed_id=F.concat(F.lit("q"), F.col("event_id") % 3))
    good, bad = feeds.collect({"f0": read(0), "f1": read(1), "f2": lambda: spark.read.parquet(f"{d}/no-such-feed.parquet")}, spark)
    return good.groupBy("feed_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(bad.agg(F.max("feed").alias("failed"))))  # one row


@query("""SELECT CAST(doc_id AS VARCHAR) AS source_id, 'Title ' || doc_id || CASE WHEN doc_id % 7 = 0 THEN ' on Focus habits' ELSE '' END AS title, 'http://h/' || doc_id AS url, CASE WHEN doc_id % 7 = 0 THEN 'productivity' ELSE 'tech' END AS sector, source AS page FROM documents""")
def sc5_json_hits(spark, d):
    x = load(spark, d, "documents").select("source", F.floor(F.col("doc_id") / PAGE).alias("page"), F.struct(F.col("doc_id").cast("string").alias("objectID"), F.concat(F.lit("Title "), "doc_id", F.when(F.col("doc_id") % 7 == 0, " on Focus habits").otherwise("")).alias("title"), F.concat(F.lit("http://h/"), "doc_id").alias("url")).alias("hit"))
    pages = x.groupBy("page").agg(F.to_json(F.struct(F.collect_list("hit").alias("hits"))).alias("value"))
    read = feeds.json_hits(spark, scratch.dropped(pages, "hits", "page"), "hn", ["habit"])
    return read.join(x.select(F.col("hit.objectID").alias("source_id"), F.col("source").alias("page")), "source_id").select("source_id", "title", "url", "sector", "page")


@query("""WITH p AS (SELECT event_id AS position, event_type AS sub, 'u' || (event_id % 700) AS url, value FROM events WHERE value > 5), o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY position) = 1)
SELECT sub, url, position FROM o QUALIFY row_number() OVER (PARTITION BY sub ORDER BY position) <= 10""")
def sc6_pick(spark, d):
    p = load(spark, d, "events").select(F.col("event_id").alias("position"), F.col("event_type").alias("sub"), F.concat(F.lit("u"), F.col("event_id") % 700).alias("url"), "value")
    return feeds.pick(p, F.col("value") > 5, "sub", "position", 10).select("sub", "url", "position")


@query("""WITH v AS (SELECT l_partkey AS paper_id, l_linenumber::BIGINT AS version, CAST(l_shipdate AS DATE) AS updated, 'v' || l_orderkey AS title FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01'),
w AS (SELECT DISTINCT paper_id, version FROM v) SELECT paper_id, max(version) AS version, true AS known FROM w GROUP BY 1""")
def sc8_research(spark, d):
    """Papers updated since a day, the last version of each; of several rows of that version any one."""
    v = load(spark, d, "lineitem").select(F.col("l_partkey").alias("paper_id"), F.col("l_linenumber").cast("bigint").alias("version"), F.to_date("l_shipdate").alias("updated"), F.concat(F.lit("v"), "l_orderkey").alias("title"))
    got = feeds.research(v, F.lit("1996-01-01").cast("date"))
    return got.join(v.select("paper_id", "version", "updated", "title", F.lit(True).alias("known")).distinct(), ["paper_id", "version", "updated", "title"], "left").select("paper_id", "version", F.coalesce("known", F.lit(False)).alias("known"))


@query("""SELECT l_orderkey AS accession, l_linenumber AS line, 'P' || l_partkey AS ticker, 'Owner ' || l_suppkey AS owner_name, l_suppkey % 2 = 0 AS is_director, false AS is_officer, l_returnflag AS code, l_quantity AS shares, CASE WHEN l_linenumber % 5 <> 0 THEN round(l_extendedprice, 2) END AS price FROM lineitem""")
def sc10_form4(spark, d):
    amount = lambda tag, v: f"'<{tag}><value>', {v}, '</value></{tag}>'"
    xml = F.expr(f"""concat('<ownershipDocument><issuer><issuerTradingSymbol>p', l_partkey, '</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>Owner ', l_suppkey, '</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>', CASE WHEN l_suppkey % 2 = 0 THEN 'true' ELSE '0' END, '</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode>', l_returnflag, '</transactionCode></transactionCoding><transactionAmounts>', {amount('transactionShares', 'l_quantity')}, {amount('transactionPricePerShare', "CASE WHEN l_linenumber % 5 <> 0 THEN cast(cast(round(l_extendedprice, 2) as decimal(18,2)) as string) ELSE 'none' END")}, '</transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>')""")
    return feeds.form4(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("line"), xml.alias("xml")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['2.02', '9.01'] WHEN o_orderkey % 3 = 1 THEN ['5.02'] ELSE [] END AS items FROM orders""")
def sc11_filing_items(spark, d):
    html = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '<p>Item&nbsp;2.02 Results</p> see item 2.02; ITEM 9.01' WHEN 1 THEN 'item  5.02' ELSE '<b>no such thing 5.02</b>' END")
    return load(spark, d, "orders").select("o_orderkey", feeds.filing_items(html).alias("items"))


@query("SELECT l_orderkey AS accession, 'Issuer ' || l_partkey AS issuer, 'C' || l_suppkey AS cusip, CAST(floor(l_extendedprice) AS BIGINT) AS value, CAST(l_quantity AS BIGINT) AS shares FROM lineitem")
def sc12_holdings(spark, d):
    row = F.expr("concat('<infoTable><nameOfIssuer>Issuer ', l_partkey, '</nameOfIssuer><cusip>C', l_suppkey, '</cusip><value>', cast(floor(l_extendedprice) as bigint), '</value><shrsOrPrnAmt><sshPrnamt>', cast(l_quantity as bigint), '</sshPrnamt></shrsOrPrnAmt></infoTable>')")
    filings = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("accession")).agg(F.concat(F.lit("<informationTable>"), F.array_join(F.collect_list(row), ""), F.lit("</informationTable>")).alias("xml"))
    return feeds.holdings(filings)


@query("""WITH v AS (SELECT o_custkey AS series, o_orderkey AS day, o_totalprice AS value FROM orders WHERE o_orderkey % 5 <> 0)
SELECT series, day, value, (value - lag(value) OVER w) * 100 / lag(value) OVER w AS change_pct FROM v WINDOW w AS (PARTITION BY series ORDER BY day)""")
def sc13_series(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("day"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("string")).otherwise(".").alias("value"))
    return feeds.series_change(o)


@query("""SELECT 'Award ' || o_orderkey AS title, 'awards' AS source_name, '{"kind":"awards","agency":"' || o_orderpriority || '","amount":' || CAST(floor(o_totalprice) AS BIGINT) || '}' AS financial_metadata, 'financial' AS source_type, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS published_at FROM orders""")
def sc14_records(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("agency"), F.floor("o_totalprice").cast("bigint").alias("amount"), F.to_date("o_orderdate").cast("string").alias("day"))
    raw = spark.read.schema("o_orderkey bigint, agency string, amount bigint, day string").json(scratch.dropped(o.select(F.to_json(F.struct("*")).alias("value")), "awards"))
    got = feeds.records(raw, "awards", F.concat(F.lit("Award "), "o_orderkey"), F.to_timestamp("day"), ["agency", "amount"])
    return got.select("title", "source_name", "financial_metadata", "source_type", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("""SELECT CAST(ps.l_partkey AS VARCHAR) AS patent_id, 'Supplier ' || ps.l_suppkey AS assignee, CAST('1997-01-01' AS DATE) AS day, ((SELECT count(*) FROM (SELECT DISTINCT 'Supplier ' || l_suppkey AS s FROM lineitem) x WHERE x.s < 'Supplier ' || ps.l_suppkey) // 20)::BIGINT AS request FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= DATE '1998-06-01') ps""")
def sc15_patents(spark, d):
    """Patents of a watch list that is asked for in batches of twenty names."""
    l = load(spark, d, "lineitem")  # noqa: E741
    new = l.where("l_shipdate >= date'1998-06-01'").select("l_partkey", F.concat(F.lit("Supplier "), "l_suppkey").alias("assignee")).distinct()
    page = new.groupBy("l_partkey").agg(F.collect_list(F.struct(F.col("assignee").alias("assignee_organization"))).alias("assignees"))
    hit = F.struct(F.col("l_partkey").cast("string").alias("patent_id"), F.lit("t").alias("patent_title"), F.lit("1997-01-01").alias("patent_date"), "assignees")
    path = scratch.dropped(page.select(F.to_json(F.struct(F.array(hit).alias("patents"))).alias("value")), "patents")
    names = feeds.batched(l.select(F.concat(F.lit("Supplier "), "l_suppkey").alias("assignee")), "assignee", 20)
    return feeds.patents(spark, path).join(names, "assignee").select("patent_id", "assignee", "day", F.col("request").cast("bigint").alias("request"))


@query("""WITH v AS (SELECT user_id AS page, CAST(ts AS DATE) AS day, sum(value) AS views FROM events GROUP BY ALL), m AS (SELECT max(day) AS t FROM v), a AS (SELECT page, avg(views) FILTER (day > t - 7) AS recent, avg(views) FILTER (day <= t - 7 AND day > t - 37) AS base FROM v, m GROUP BY page)
SELECT page, round(recent, 6) AS recent, round(base, 6) AS base, round((recent - base) * 100 / base, 6) AS delta FROM a WHERE base > 10 AND abs((recent - base) * 100 / base) >= 20""")
def sc16_attention(spark, d):
    v = load(spark, d, "events").groupBy(F.col("user_id").alias("page"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("views"))
    last = v.agg(F.max("day")).first()[0]
    return feeds.attention(v, F.lit(last)).select("page", *[F.round(c, 6).alias(c) for c in ("recent", "base", "delta")])


@query("""SELECT CAST(event_id AS VARCHAR) AS id, 'q' || event_id AS question, round(value / 100, 4) AS yes, CASE WHEN event_id % 4 <> 1 THEN round(value * 10, 1) END AS volume FROM events WHERE event_id % 3 <> 2""")
def sc17_markets(spark, d):
    """Numbers and arrays as values or as strings; markets with other outcomes than yes and no go."""
    names = "CASE event_id % 3 WHEN 0 THEN '\"[\\\\\"Yes\\\\\",\\\\\"No\\\\\"]\"' WHEN 1 THEN '[\"yes\",\"no\"]' ELSE '[\"Up\",\"Down\"]' END"
    one = F.expr(f"""concat('{{"id":', event_id, ',"question":"q', event_id, '","outcomes":', {names}, ',"outcomePrices":["', round(value / 100, 4), '","0.5"],"volume":', CASE event_id % 4 WHEN 0 THEN concat('"', round(value * 10, 1), '"') WHEN 1 THEN '"n/a"' ELSE cast(round(value * 10, 1) as string) END, '}}')""")
    pages = load(spark, d, "events").select(F.floor(F.col("event_id") / PAGE).alias("page"), one.alias("m")).groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("m"), ","), F.lit("]")).alias("value"))
    got = feeds.markets(spark, f"{scratch.dropped(pages, 'markets', 'page')}/*/*")
    return got.select("id", "question", F.round(F.get("prices", F.lit(0)), 4).alias("yes"), F.round("volume", 1).alias("volume"))


PANEL = """SELECT 'S' || l_suppkey AS sym, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS c, min(l_extendedprice) AS l, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"""


def _panel(spark, d):
    x = load(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("sym"), F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("c"), F.min("l_extendedprice").alias("l"), F.sum("l_quantity").alias("v"))
    return x.select("sym", "date", F.col("c").alias("o"), F.when(F.month("date") != 2, F.col("c")).alias("h"), "l", "c", "v")


@query(f"WITH p AS ({PANEL}) SELECT * FROM p WHERE sym IN ('S1', 'S2', 'S7')")
def sc20_bars(spark, d):
    """Bars saved by symbol (a second download changes nothing) and read with pruning by symbol."""
    path = scratch.folder(spark, "bars")
    panel = _panel(spark, d)
    tables.save_bars(panel, path)
    tables.save_bars(panel.withColumn("c", F.lit(0.0)), path)
    return tables.bars(spark, path).where(F.col("sym").isin("S1", "S2", "S7")).select("sym", "date", "c", "l", "v")


@query(f"WITH p AS ({PANEL}), m AS (SELECT *, avg(c * v) OVER (PARTITION BY sym ORDER BY date ROWS 19 PRECEDING) AS dollar FROM p), k AS (SELECT * FROM p WHERE sym IN (SELECT sym FROM m GROUP BY sym HAVING max(dollar) >= 1.6e6)) SELECT date, max(c) FILTER (sym = 'S1') AS \"S1\", max(c) FILTER (sym = 'S2') AS \"S2\", max(c) FILTER (sym = 'S3') AS \"S3\" FROM k WHERE sym IN ('S1', 'S2', 'S3') GROUP BY date")
def sc23_panel(spark, d):
    return tables.wide(tables.liquid_panel(_panel(spark, d), 1.6e6), ["S1", "S2", "S3"])


@query("""WITH t AS (SELECT o_orderkey AS a, 'C' || o_custkey AS sym, o_clerk_ AS owner, CASE WHEN o_orderkey % 4 = 0 THEN 'S' ELSE 'P' END AS code, l_quantity AS sh, round(l_extendedprice / l_quantity, 4) AS px, l_quantity * 3 AS after, CAST(o_orderdate AS DATE) + 3 AS filed, CAST(o_orderdate AS DATE) AS traded, l_linenumber FROM (SELECT *, 'K' || (o_custkey % 50) AS o_clerk_ FROM orders) JOIN lineitem ON l_orderkey = o_orderkey)
SELECT sym, filed, round(sum(CASE WHEN code = 'P' THEN sh * px ELSE -sh * px END), 2) AS net_usd, count(DISTINCT owner) FILTER (code = 'P') AS buyers, count(DISTINCT owner) FILTER (code = 'P' AND a % 3 = 0) AS officers, round(max(sh / (after - sh)) FILTER (code = 'P'), 6) AS own_chg, round(avg(date_diff('day', traded, filed)), 4) AS lag FROM t GROUP BY ALL""")
def sc25_insider_features(spark, d):
    """Three tab-separated tables read, joined and made into features by symbol and filing day."""
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")  # noqa: E741
    day = lambda n: F.date_format(F.date_add(F.to_date("o_orderdate"), n), "dd-MMM-yyyy")
    path = scratch.folder(spark, "form345")
    parts = {
        "SUBMISSION.tsv": o.select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), day(3).alias("FILING_DATE"), F.concat(F.lit("C"), "o_custkey").alias("ISSUERTRADINGSYMBOL")),
        "REPORTINGOWNER.tsv": o.select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), F.concat(F.lit("K"), F.col("o_custkey") % 50).alias("RPTOWNERCIK"), F.when(F.col("o_orderkey") % 3 == 0, "Officer,Director").otherwise("TenPercentOwner").alias("RPTOWNER_RELATIONSHIP")),
        "NONDERIV_TRANS.tsv": l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_orderkey").alias("ACCESSION_NUMBER"), day(0).alias("TRANS_DATE"), F.when(F.col("o_orderkey") % 4 == 0, "S").otherwise("P").alias("TRANS_CODE"), F.col("l_quantity").alias("TRANS_SHARES"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("TRANS_PRICEPERSHARE"), (F.col("l_quantity") * 3).alias("SHRS_OWND_FOLWNG_TRANS")),
    }
    for name, df in parts.items():
        df.write.option("sep", "\t").option("header", True).csv(f"{path}/{name}")
    f = tables.insider_features(tables.insider_trades(spark, path))
    return f.select("sym", "filed", F.round("net_usd", 2).alias("net_usd"), "buyers", "officers", F.round("own_chg", 6).alias("own_chg"), F.round("lag", 4).alias("lag"))


@query("SELECT event_id, 'T' || user_id AS sym FROM events WHERE event_id % 3 <> 0")
def sc26_headlines(spark, d):
    h = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("T1, T2")).otherwise(F.concat(F.lit(" T"), "user_id")).alias("stocks"))
    return tables.single_ticker_headlines(h).select("event_id", "sym")


@query(f"WITH p AS ({PANEL}) SELECT sym, date, c AS h FROM p WHERE sym IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey < 5)")
def sc28_preload(spark, d):
    wanted = load(spark, d, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("S"), "s_suppkey").alias("sym"))
    return tables.preload(_panel(spark, d), wanted).select("sym", "date", "h")


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, value FROM events), m AS (SELECT max(day) AS t FROM e) SELECT event_id, day, CASE WHEN day = t THEN -value ELSE value END AS value FROM e, m WHERE day >= t - 180""")
def sc31_replace_day(spark, d):
    """A table by day whose last day is replaced, and rows older than 180 days left out."""
    path = scratch.folder(spark, "days")
    e = load(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), "value")
    last = F.lit(e.agg(F.max("day")).first()[0])
    tables.replace_days(e, path)
    tables.replace_days(e.where(F.col("day") == last).withColumn("value", -F.col("value")), path)
    return tables.retain(spark.read.parquet(path), F.col("day"), last)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sc32_snapshot(spark, d):
    path = scratch.folder(spark, "snapshot")
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    tables.snapshot(n.withColumn("n_name", F.lit("old")), path)
    tables.snapshot(n, path)
    return spark.read.schema(n.schema).json(path)


# three batches in turn: a key's price is that of the last row of the last batch that has it, its first return date the first that any batch told
@query("""WITH r AS (SELECT *, (l_orderkey % 3) * 1000000000000 + l_orderkey AS told FROM lineitem)
SELECT l_suppkey, l_linenumber, count(*) AS fills, sum(l_quantity) AS qty, arg_max(l_extendedprice, struct_pack(a := told, b := l_partkey, c := l_extendedprice)) AS price, arg_min(l_shipdate, struct_pack(a := told, b := l_partkey, c := l_extendedprice)) FILTER (l_returnflag = 'R') AS returned FROM r GROUP BY ALL""")
def sc29_upsert(spark, d):
    """Three batches of orders merged into a bucketed table, the second one run twice: prices overwrite, counts and quantities add up, dates only fill nulls."""
    path = scratch.folder(spark, "upserts")
    merge = buckets.Merge(["l_suppkey", "l_linenumber"], overwrite=["price"], add=["fills", "qty"], fill=["returned"])
    order = F.struct("l_orderkey", "l_partkey", "price")
    l = load(spark, d, "lineitem")  # noqa: E741
    rows = l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.lit(1).cast("bigint").alias("fills"), F.col("l_quantity").alias("qty"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("returned"))
    for epoch in (0, 1, 1, 2):
        buckets.apply(rows.where(F.col("l_orderkey") % 3 == epoch), path, epoch, merge, order)
    columns = ["l_suppkey", "l_linenumber", "price", "fills", "qty", "returned"]
    return buckets.read(spark, path, 2, rows.select(*columns).schema)
