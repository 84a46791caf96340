"""Further queries: matching and expansion, gates and reports, labels and reordering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import sizing, text
from tessera.operators import entities
from tessera.operators import relational as R
from tessera.plans.catalog import query
from tessera.plans.views import BARS, TRADES, bars, by_day, trades
from tessera.session import load


@query("SELECT event_id, concat_ws(' | ', 'Event ' || event_type, 'user ' || user_id, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 'k=' || json_extract_string(props, '$.k') END) AS body FROM events")
def pf21_metadata_text(spark, d):
    k = F.get_json_object("props", "$.k")
    return load(spark, d, "events").select("event_id", F.concat_ws(" | ", F.concat(F.lit("Event "), "event_type"), F.concat(F.lit("user "), F.col("user_id").cast("string")), F.concat(F.lit("k="), k)).alias("body"))


LINKS = "links AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


@query(f"WITH {LINKS} SELECT p.p_partkey AS part, s.p_partkey AS other, s.p_name AS other_name, s.p_type AS other_type FROM part p JOIN links l ON l.a = p.p_partkey OR l.b = p.p_partkey JOIN part s ON s.p_partkey = CASE WHEN l.a = p.p_partkey THEN l.b ELSE l.a END")
def jn13_other_end(spark, d):
    """Parts are linked that follow each other in an order: the other end of every link of every part, whichever end the part is."""
    l, p = load(spark, d, "lineitem"), load(spark, d, "part")  # noqa: E741
    first = l.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"))
    then = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    links = first.join(then, ["l_orderkey", "l_linenumber"]).select("a", "b").distinct()
    ends = R.other_end(links, "a", "b").withColumnsRenamed({"node": "part"})
    named = p.select(F.col("p_partkey").alias("other"), F.col("p_name").alias("other_name"), F.col("p_type").alias("other_type"))
    return ends.join(p.select(F.col("p_partkey").alias("part")), "part", "left_semi").join(named, "other").select("part", "other", "other_name", "other_type")


# the rule as it reads: the first session on or after the day; another day: its open; else by the minute
@query("""WITH b AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, arg_min(value, event_id) AS open, arg_max(value, event_id) AS close FROM events WHERE isodow(ts) < 6 GROUP BY ALL),
s AS (SELECT *, lead(open) OVER (PARTITION BY ticker ORDER BY day) AS next_open FROM b),
t AS (SELECT event_id, user_id AS ticker, CAST(ts AS DATE) AS day, CASE WHEN event_id % 10 <> 3 THEN hour(ts) * 60 + minute(ts) END AS minutes FROM events WHERE event_type <> 'view')
SELECT event_id, round(CASE WHEN s.day > t.day OR minutes IS NULL OR minutes < 765 THEN s.open WHEN minutes < 960 THEN s.close ELSE s.next_open END, 6) AS price FROM t ASOF LEFT JOIN s ON s.ticker = t.ticker AND s.day >= t.day""")
def jn17_intraday_rule(spark, d):
    """Each trade at its ticker's price of that time: the open until 12:45, the close until 16:00, then the next session's open, also over weekends. Trades of a day without a time are of its open."""
    e = load(spark, d, "events")
    day = F.to_date("ts")
    sessions = e.where(F.weekday("ts") < 5).groupBy(F.col("user_id").alias("ticker"), day.alias("day")).agg(F.min_by("value", "event_id").alias("open"), F.max_by("value", "event_id").alias("close"))
    when = F.when(F.col("event_id") % 10 != 3, F.col("ts")).otherwise(day.cast("timestamp_ntz"))
    t = e.where("event_type <> 'view'").select("event_id", F.col("user_id").alias("ticker"), when.alias("when"))
    return R.at_session(t, sessions, "ticker", "when").select("event_id", F.round("price", 6).alias("price"))


@query(f"""WITH {BARS}, c AS (SELECT ticker, day, CASE WHEN month(day) % 4 = 0 THEN NULL ELSE close END AS close FROM bars) SELECT ticker, day, round(coalesce(close, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY day), 100.0), 6) AS mark FROM c""")
def jn18_last_mark(spark, d):
    c = F.when(F.month("day") % 4 != 0, F.col("close"))
    return bars(spark, d).withColumn("c", c).select("ticker", "day", F.round(F.coalesce("c", F.last("c", True).over(by_day().rowsBetween(Window.unboundedPreceding, 0)), F.lit(100.0)), 6).alias("mark"))


@query(f"""WITH {BARS}, i AS (SELECT day, avg(close) AS m FROM bars GROUP BY day), j AS (SELECT b.ticker, b.day, b.close, i.m FROM bars b JOIN i USING (day) WHERE month(b.day) <> 6)
SELECT ticker, day, round(close / lag(close) OVER w - m / lag(m) OVER w, 6) AS rel FROM j WINDOW w AS (PARTITION BY ticker ORDER BY day)""")
def jn20_aligned(spark, d):
    b = bars(spark, d)
    j = b.where("month(day) <> 6").join(b.groupBy("day").agg(F.avg("close").alias("m")), "day")
    return j.select("ticker", "day", F.round(F.col("close") / F.lag("close").over(by_day()) - F.col("m") / F.lag("m").over(by_day()), 6).alias("rel"))


@query("""WITH i AS (SELECT DISTINCT p_partkey AS filing, lower(p_type) AS i FROM part), t AS (SELECT DISTINCT lower(p_type) AS topic FROM part WHERE p_size = 3)
SELECT topic, count(DISTINCT filing) AS filings FROM i JOIN t ON contains(i, topic) OR contains(topic, i) GROUP BY topic""")
def jn26_containment(spark, d):
    p = load(spark, d, "part")
    return entities.contained(p.select(F.col("p_partkey").alias("filing"), F.col("p_type").alias("issuer")), p.where("p_size = 3").select(F.lower("p_type").alias("topic")).distinct())


@query("""WITH n AS (SELECT DISTINCT lower(trim(s_name)) || CASE WHEN s_suppkey % 3 = 0 THEN ' Inc' ELSE '' END AS name, s_suppkey FROM supplier)
SELECT name, s_suppkey AS entity_id, CASE WHEN s_suppkey % 3 = 0 THEN 0.85 ELSE 0.95 END AS confidence FROM n""")
def jn27_tiered(spark, d):
    s = load(spark, d, "supplier")
    names = s.select(F.concat(F.lower(F.trim("s_name")), F.when(F.col("s_suppkey") % 3 == 0, " Inc").otherwise("")).alias("name"))
    return entities.tiered_match(names, s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("entity")))


# one mention after another; the records so far are a list
@query(r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
n AS (SELECT doc_id AS m, CASE WHEN doc_id % 7 = 0 THEN 'C' || len(ws) % 40 END AS cik, CASE WHEN doc_id % 5 = 0 THEN 'T' || doc_id % 35 END AS ticker,
  trim(regexp_replace(array_to_string(ws[1:(1 + doc_id % 3)], ' '), '\s+(inc|corp|corporation|co|company|ltd|llc|plc|sa|ag|group|holdings)\.?$', '')) AS name FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY m) AS i FROM n WHERE length(name) >= 2),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS m, NULL::BIGINT AS canonical, []::STRUCT(id BIGINT, cik VARCHAR, ticker VARCHAR, name VARCHAR)[] AS records
UNION ALL SELECT i, m, coalesce(hit, m), CASE WHEN hit IS NULL THEN list_append(records, {'id': m, 'cik': cik, 'ticker': ticker, 'name': name}) ELSE records END
  FROM (SELECT o.i, o.m, o.cik, o.ticker, o.name, records, coalesce(list_filter(records, lambda c: c.cik = o.cik)[1].id, list_filter(records, lambda c: c.ticker = o.ticker)[1].id,
    list_filter(records, lambda c: c.name = o.name OR (length(o.name) >= 3 AND contains(' ' || c.name || ' ', ' ' || o.name || ' ')) OR (length(c.name) >= 3 AND contains(' ' || o.name || ' ', ' ' || c.name || ' ')))[1].id) AS hit FROM r JOIN o ON o.i = r.i + 1))
SELECT n.m AS mention_id, canonical FROM n LEFT JOIN r USING (m)""".replace("company|", ""))
def jn28_canonical(spark, d):
    """The first words of every document as a name, some with a ticker or a company number, settled in the order of their ids."""
    ws = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    i = F.col("doc_id")
    m = load(spark, d, "documents").withColumn("ws", F.coalesce(ws, F.array().cast("array<string>"))).select(
        i.alias("mention_id"), F.when(i % 7 == 0, F.concat(F.lit("C"), (F.size("ws") % 40).cast("string"))).alias("cik"), F.when(i % 5 == 0, F.concat(F.lit("T"), (i % 35).cast("string"))).alias("ticker"),
        F.array_join(F.slice("ws", F.lit(1), (1 + i % 3).cast("int")), " ").alias("name"))
    return entities.canonicals(m)


@query("""WITH a AS (SELECT lower(n_name) AS name, lower(r_name) AS alias FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT name AS w, alias AS f FROM a UNION SELECT alias, name FROM a)
SELECT CAST(1 AS BIGINT) AS query_id, w AS word, f AS found FROM p QUALIFY row_number() OVER (PARTITION BY w ORDER BY f) <= 3""")
def jn30_aliases(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")  # 25 and 5 rows at any scale
    a = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("name"), F.col("r_name").alias("alias"))
    words = a.select(F.lit(1).cast("bigint").alias("query_id"), F.upper("name").alias("word")).union(a.select(F.lit(1).cast("bigint"), "alias")).distinct()
    return entities.expand(words, a)


@query("""WITH f AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS filed FROM orders), s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem WHERE isodow(l_shipdate) < 6)
SELECT filed, min(session) AS session FROM f JOIN s ON session >= filed AND session <= filed + 10 GROUP BY filed""")
def jn34_session_day(spark, d):
    """The first session on or after each filing day, over the calendar of sessions (one row for each day)."""
    f = load(spark, d, "orders").select(F.lit(0).alias("k"), F.to_date("o_orderdate").alias("filed")).distinct()
    s = load(spark, d, "lineitem").where("weekday(l_shipdate) < 5").select(F.lit(0).alias("k"), F.to_date("l_shipdate").alias("session")).distinct()
    return R.as_of(f, s, "k", "filed", "session", ["k"], forward=True).select("filed", F.col("asof_at").alias("session")).where("session is not null and datediff(session, filed) <= 10")


@query("SELECT c_custkey, n FROM (SELECT c_custkey, count(DISTINCT o_orderpriority) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1) ORDER BY n DESC, c_custkey LIMIT 40")
def jn35_semi_ordered(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 100000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("o_orderpriority").alias("n"))
    return o.join(load(spark, d, "customer"), "c_custkey", "left_semi").orderBy(F.desc("n"), "c_custkey").limit(40)


@query("SELECT o_custkey, o_orderpriority, max(o_orderkey) AS newest FROM orders GROUP BY ALL")
def jn36_latest_composite(spark, d):
    return R.latest(load(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderkey")]).select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("newest"))


# the pool is all pages; stories are those with an extension, a slash or nothing behind their number, news those in English
@query(r"""WITH p AS (SELECT page_id, page_id % 20 AS briefing, sha256(string_split(lower(regexp_replace(trim(regexp_replace(regexp_replace(url, '^https?://(www\.|m\.|blog\.)?', ''), '/[0-9]+.*$', '')), '/+$', '')), '?')[1]) AS url_hash, url FROM pages),
s AS (SELECT page_id AS story_id, briefing, url_hash, CASE WHEN contains(url, '/en/') THEN 'news' ELSE 'other' END AS source_type FROM p WHERE NOT contains(url, '?'))
SELECT page_id, (SELECT min(story_id) FROM s WHERE s.briefing = p.briefing AND s.url_hash = p.url_hash AND s.source_type = 'news') AS story_id FROM p""")
def jn38_link_back(spark, d):
    """Every page of the pool with the story that it became: the lowest id of its briefing with its (host's and section's) url."""
    place = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.|m\.|blog\.)?", ""), "/[0-9]+.*$", "")
    p = load(spark, d, "pages").select("page_id", (F.col("page_id") % 20).alias("briefing"), text.hash_url(place).alias("url_hash"), "url")
    s = p.where(~F.contains("url", F.lit("?"))).select(F.col("page_id").alias("story_id"), "briefing", "url_hash", F.when(F.contains("url", F.lit("/en/")), "news").otherwise("other").alias("source_type"))
    return R.linked(p, s.where("source_type = 'news'"), ["briefing", "url_hash"], "story_id").select("page_id", "story_id")


@query(f"""WITH {TRADES}, m AS (SELECT status, avg(pnl / invested) AS measured FROM trades GROUP BY 1), x AS (SELECT status, avg(pnl / invested) AS traded, count(*) AS n FROM trades WHERE fills >= 4 AND status <> 'P' GROUP BY 1)
SELECT status, round(measured, 6) AS measured, round(traded, 6) AS traded, coalesce(n, 0) AS n FROM m LEFT JOIN x USING (status)""")
def ag41_events(spark, d):
    r, chosen = F.expr("pnl / invested"), (F.col("fills") >= 4) & (F.col("status") != "P")
    return trades(spark, d).groupBy("status").agg(F.round(F.avg(r), 6).alias("measured"), F.round(F.avg(F.when(chosen, r)), 6).alias("traded"), F.count_if(chosen).alias("n"))


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS i FROM part QUALIFY i < 8), o AS (SELECT * FROM (VALUES (0, 3), (1, 0), (2, 5)) v(pos, i))
SELECT p_partkey, CAST(row_number() OVER (ORDER BY coalesce(o.pos, 100), r.i) AS INTEGER) AS rank FROM r LEFT JOIN o USING (i)""")
def cp5_rerank(spark, d):
    """Reorder by an index list: bad and repeated indexes are ignored, the rest follows in its order."""
    top = load(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(8)
    r = top.select("p_partkey", (F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")) - 1).alias("i"))
    given = spark.createDataFrame([(p, i) for p, i in enumerate([3, 0, 99, 3, 5])], "pos int, i int")  # a model's answer
    first = given.groupBy("i").agg(F.min("pos").alias("pos"))
    return r.join(F.broadcast(first), "i", "left").select("p_partkey", F.row_number().over(Window.orderBy(F.coalesce("pos", F.lit(100)), "i")).alias("rank"))


@query(f"WITH {TRADES} SELECT account % 10 AS book, count(*) AS n, round(sum(pnl), 4) AS pnl FROM trades WHERE status <> 'P' GROUP BY 1")
def cp17_realised(spark, d):
    return trades(spark, d).where("status <> 'P'").groupBy((F.col("account") % 10).alias("book")).agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"))


@query(f"""WITH {BARS}, n AS (SELECT *, lead(open) OVER w AS o1, lead(close) OVER w AS c1 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day))
SELECT CASE WHEN c1 >= o1 AND o1 > close THEN 'held' WHEN o1 > close THEN 'faded' ELSE 'no_gap' END AS kind, count(*) AS n, round(avg(c1 / o1 - 1), 6) AS mean FROM n WHERE o1 IS NOT NULL GROUP BY 1""")
def cp23_gap_test(spark, d):
    n = bars(spark, d).withColumn("o1", F.lead("open").over(by_day())).withColumn("c1", F.lead("close").over(by_day())).where("o1 is not null")
    kind = F.when((F.col("c1") >= F.col("o1")) & (F.col("o1") > F.col("close")), "held").when(F.col("o1") > F.col("close"), "faded").otherwise("no_gap")
    return n.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("c1") / F.col("o1") - 1), 6).alias("mean"))


@query("SELECT o_orderkey, (CAST(o_orderdate AS DATE) + 3) AS report, date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 30 AS near FROM orders WHERE isodow(o_orderdate) = 1")
def fn24_windows(spark, d):
    day = F.to_date("o_orderdate")
    return load(spark, d, "orders").where("weekday(o_orderdate) = 0").select("o_orderkey", F.date_add(day, 3).alias("report"), F.date_diff(day, F.lit("1996-01-01").cast("date")).between(0, 30).alias("near"))


@query(f"""WITH {TRADES}, x AS (SELECT trade_id, 100000.0 AS eq, (trade_id % 10) / 100.0 AS atr, (trade_id % 25) / 100.0 AS dd, (trade_id % 8) / 2.0 AS edge FROM trades)
SELECT trade_id, round(least(eq * 0.005 * greatest(0.25, least(1.0, 1 - (dd - 0.05) / 0.15 * 0.75)) * greatest(0, least(3.0, edge / 2)) / greatest(0.03, least(0.15, 3 * atr)), eq * 0.08), 4) AS size FROM x""")
def fn36_risk_size(spark, d):
    i = F.col("trade_id")
    return trades(spark, d).select("trade_id", F.round(sizing.risk_size(F.lit(100000.0), i % 10 / 100.0, i % 25 / 100.0, i % 8 / 2.0), 4).alias("size"))


@query(f"WITH {BARS} SELECT ticker, day, CASE WHEN close > 1500 THEN 8.0 WHEN close > 1200 THEN 5.0 ELSE 2.0 END AS tier, round(greatest(open * 0.9, high - 3 * (high - low)), 6) AS stop FROM bars")
def fn37_tiers_and_stops(spark, d):
    score = F.when(F.col("close") > 1500, 0.7).when(F.col("close") > 1200, 0.5).otherwise(0.3)
    return bars(spark, d).select("ticker", "day", sizing.tier_pct(score).alias("tier"), F.round(sizing.stops(F.col("open"), F.col("high"), F.col("high") - F.col("low"), F.lit(False)), 6).alias("stop"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 ORDER BY c_mktsegment, (c_nationkey = 3) DESC, c_acctbal DESC, c_custkey LIMIT 60")
def sl13_calendar_order(spark, d):
    return load(spark, d, "customer").where("c_acctbal > 5000").orderBy("c_mktsegment", F.desc(F.col("c_nationkey") == 3), F.desc("c_acctbal"), "c_custkey").limit(60).select("c_custkey", "c_acctbal")


@query(f"""WITH {BARS} SELECT ticker, day, round(sum(close - open) OVER w, 4) AS equity, round(max(close) OVER w, 6) AS peak, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1, 6) AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day)""")
def wn4_running(spark, d):
    w = by_day().rowsBetween(Window.unboundedPreceding, 0)
    return bars(spark, d).select("ticker", "day", F.round(F.sum(F.expr("close - open")).over(w), 4).alias("equity"), F.round(F.max("close").over(w), 6).alias("peak"), F.round(F.col("close") / F.lag("close").over(by_day()) - 1, 6).alias("ret"))


@query(f"""WITH {BARS}, i AS (SELECT day, avg(close) AS m FROM bars GROUP BY day), j AS (SELECT b.*, i.m FROM bars b JOIN i USING (day))
SELECT ticker, day, round(close / lag(close, 6) OVER w - m / lag(m, 6) OVER w, 6) AS rel, round(avg(close * volume) OVER (PARTITION BY ticker ORDER BY day ROWS 9 PRECEDING), 4) AS dollar FROM j WINDOW w AS (PARTITION BY ticker ORDER BY day)""")
def wn16_prior_relative(spark, d):
    b = bars(spark, d)
    j = b.join(b.groupBy("day").agg(F.avg("close").alias("m")), "day")
    back = lambda c: F.col(c) / F.lag(c, 6).over(by_day())
    return j.select("ticker", "day", F.round(back("close") - back("m"), 6).alias("rel"), F.round(F.avg(F.expr("close * volume")).over(by_day().rowsBetween(-9, 0)), 4).alias("dollar"))


@query("SELECT s_suppkey, [s_name || ', Inc.', s_name] AS titles FROM supplier")
def fn11_title_candidates(spark, d):
    """Names here are in title case already, so two of the four forms are the same."""
    return load(spark, d, "supplier").select("s_suppkey", text.title_candidates(F.concat("s_name", F.lit(", Inc."))).alias("titles"))
