"""Queries of the four government services, of who they name, and of look-ups over nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ledger, search
from tessera.plans.catalog import query
from tessera.plans.views import AS_OF, STORIES, stories, today
from tessera.session import load
from tessera.sources import government, scratch

#: Records of a page.
PAGE = 100


def _pages(df, name: str, key: str, record) -> str:
    page = df.select(F.floor(F.col(key) / PAGE).alias("page"), record.alias("r")).groupBy("page").agg(F.collect_list("r").alias("results"))  # PAGE keys each
    return scratch.dropped(page.select(F.to_json(F.struct("results")).alias("value")), name)


def _services(spark, d):
    """Orders as awards, contributions and lobbying by their status, parts as rules: pages as the services would give them, read by their readers."""
    o, p = load(spark, d, "orders"), load(spark, d, "part")
    k = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    unless = lambda n, x: F.when(k % n != 0, x)
    day = F.to_date("o_orderdate").cast("string")
    award = F.struct(F.concat(F.lit("A"), text(k)).alias("Award ID"), unless(17, F.concat(F.lit("Firm "), text(F.col("o_custkey")))).alias("Recipient Name"), (F.col("o_totalprice") * 10).alias("Award Amount"), F.concat(F.lit("Agency "), "o_orderpriority").alias("Awarding Agency"),
                     F.concat(F.lit("Supply of "), F.repeat(F.lit("parts "), (k % 20).cast("int"))).alias("Description"), day.alias("Start Date"))
    committee = unless(13, F.struct(F.concat(F.lit("Committee "), text(F.col("o_custkey") % 9)).alias("name"), F.lit("IND").alias("party")))
    gift = F.struct(unless(17, F.concat(F.lit("Donor "), text(F.col("o_custkey")))).alias("contributor_name"), (F.col("o_totalprice") / 5).alias("contribution_receipt_amount"), committee.alias("committee"), day.alias("contribution_receipt_date"),
                    F.when(k % 5 == 0, "RETIRED").otherwise(F.concat(F.lit("Works "), text(k % 50))).alias("contributor_employer"), text(k).alias("sub_id"))
    act = lambda issue: F.struct(F.lit(issue).alias("general_issue_code_display"), F.array(F.struct(F.lit("SENATE").alias("name")), F.struct(F.lit("HOUSE").alias("name"))).alias("government_entities"), F.lit("about it").alias("description"))
    acts = F.when(k % 7 == 0, F.array().cast(f"array<{spark.range(1).select(act('x').alias('a')).schema['a'].dataType.simpleString()}>")).otherwise(F.array(act("Taxes"), act("Trade")))
    filing = F.struct(F.concat(F.lit("u"), text(k)).alias("filing_uuid"), F.struct(unless(19, F.concat(F.lit("Client "), text(F.col("o_custkey")))).alias("name")).alias("client"), F.struct(F.lit("Shop & Co").alias("name")).alias("registrant"),
                      F.when(k % 3 == 0, "x").when(k % 3 == 1, "0").otherwise(text(F.floor("o_totalprice"))).alias("income"), F.when(k % 2 == 0, text(F.floor(F.col("o_totalprice") / 2))).alias("expenses"), acts.alias("lobbying_activities"), F.concat(day, F.lit("T01:02:03")).alias("dt_posted"))
    i = F.col("p_partkey")
    rule = F.struct(F.concat(F.lit("On "), "p_name", F.repeat(F.lit(" and so on"), (i % 15).cast("int"))).alias("title"), F.concat(F.lit("R"), text(i)).alias("document_number"), F.when(i % 23 != 0, F.concat(F.lit("http://r/"), text(i))).alias("html_url"),
                    F.when(i % 3 == 0, "PRORULE").when(i % 3 == 1, "RULE").otherwise("NOTICE").alias("type"), F.when(i % 4 != 0, F.array(F.struct(F.concat(F.lit("Agency "), "p_type").alias("name")), F.struct(F.lit("Bureau").alias("name")))).alias("agencies"),
                    F.array(F.struct(F.lit("21").alias("title"), text(i % 9).alias("part"))).alias("cfr_references"), F.lit("1999-05-04").alias("publication_date"))
    of = lambda s: o.where(F.col("o_orderstatus") == s)
    got = government.awards(spark, _pages(of("O"), "awards", "o_orderkey", award)).unionByName(government.contributions(spark, _pages(of("F"), "contributions", "o_orderkey", gift)))
    return got.unionByName(government.lobbying(spark, _pages(of("P"), "lobbying", "o_orderkey", filing))).unionByName(government.rules(spark, _pages(p, "rules", "p_partkey", rule)))


def _money(x: str) -> str:
    return f"CASE WHEN {x} >= 1e6 THEN printf('$%.1fM', {x} / 1e6) WHEN {x} >= 1e3 THEN printf('$%.0fK', {x} / 1e3) ELSE printf('$%.0f', {x}) END"


# the four services' records as their readers should give them: title, url, source, day and who is named
RECORDS = f"""aw AS (SELECT 'A' || o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 17 <> 0 THEN 'Firm ' || o_custkey END, 'Unknown') AS recipient, o_totalprice * 10 AS amount, 'Agency ' || o_orderpriority AS agency, 'Supply of ' || repeat('parts ', (o_orderkey % 20)::INT) AS about, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'O'),
cn AS (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 17 <> 0 THEN 'Donor ' || o_custkey END, 'Unknown') AS donor, CASE WHEN o_orderkey % 13 <> 0 THEN 'Committee ' || o_custkey % 9 ELSE 'Unknown Committee' END AS recipient, CASE WHEN o_orderkey % 13 <> 0 THEN 'IND' ELSE 'N/A' END AS party,
  o_totalprice / 5 AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 'RETIRED' ELSE 'Works ' || o_orderkey % 50 END AS employer, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'),
lb AS (SELECT o_orderkey, 'Client ' || o_custkey AS client, CASE WHEN o_orderkey % 3 = 2 AND floor(o_totalprice) > 0 THEN floor(o_totalprice) WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice / 2) ELSE 0 END AS amount, o_orderkey % 7 = 0 AS idle, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 19 <> 0),
rl AS (SELECT p_partkey, 'On ' || p_name || repeat(' and so on', (p_partkey % 15)::INT) AS headline, CASE WHEN p_partkey % 4 <> 0 THEN 'Agency ' || p_type || ', Bureau' ELSE 'Unknown Agency' END AS agencies FROM part WHERE p_partkey % 23 <> 0),
rec AS (SELECT recipient || ' wins ' || {_money("amount")} || ' ' || agency || ' contract: ' || CASE WHEN strlen(about) <= 80 THEN about ELSE about[:77] || '...' END AS title, 'https://www.usaspending.gov/award/' || id AS url, 'USASpending' AS source_name, day AS published, [recipient, agency] AS names, ['contract_award', 'regulatory_action'] AS kinds FROM aw WHERE amount >= 1e6
UNION ALL SELECT donor || ' contributes ' || {_money("amount")} || ' to ' || recipient || ' (' || party || ')', 'https://www.fec.gov/data/receipts/?sub_id=' || o_orderkey, 'FEC', day, [recipient, donor, CASE WHEN employer <> 'RETIRED' THEN employer END], ['person', 'person', 'company'] FROM cn WHERE amount >= 1e4
UNION ALL SELECT client || CASE WHEN amount > 0 THEN ' spent ' || {_money("amount")} || ' lobbying on ' ELSE ' lobbied on ' END || CASE WHEN idle THEN 'unspecified issues' ELSE 'Taxes, Trade' END, 'https://lda.gov/filings/public/filing/u' || o_orderkey || '/print/', 'Senate LDA', day, [client, 'Shop & Co'], ['company', 'lobbying_disclosure'] FROM lb WHERE amount <> 0 OR NOT idle
UNION ALL SELECT agencies || ': ' || CASE WHEN strlen(headline) <= 120 THEN headline ELSE headline[:117] || '...' END, 'http://r/' || p_partkey, 'Federal Register', DATE '1999-05-04', [], [] FROM rl)"""


@query(f"WITH {RECORDS} SELECT title, url, source_name, published, 'financial' AS source_type FROM rec")
def sc14_services(spark, d):
    """Articles of awards, contributions, lobbying and rules."""
    return _services(spark, d).select("title", "url", "source_name", F.to_date("published_at").alias("published"), "source_type")


@query(f"WITH {RECORDS}, e AS (SELECT url, unnest(names) AS name, unnest(kinds) AS entity_type FROM rec) SELECT url, name, lower(name) AS normalized, entity_type, CASE WHEN entity_type = 'contract_award' THEN 0.5 ELSE 0.0 END AS sentiment FROM e WHERE name IS NOT NULL")
def pf20_entity_projection(spark, d):
    """Who the records of the four services name, and as what."""
    return government.named_entities(_services(spark, d), ["url"])


# a trade's events are its lines; every third trade has a resync after its second one, whose detail lists the sells found, some of it no JSON
EVENTS = """ev AS (SELECT l_orderkey AS trade_id, l_linenumber * 10 AS id, CASE l_returnflag WHEN 'R' THEN 'half_close' WHEN 'A' THEN 'partial_sale' ELSE 'note' END AS kind, l_quantity AS qty, NULL AS detail FROM lineitem
UNION ALL SELECT l_orderkey, 25, 'resync', NULL, CASE WHEN l_orderkey % 30 = 0 THEN '{bad' ELSE '{"sells":[[' || sum(l_quantity) || ',1.5],[2,3.5],[]]}' END FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey)"""


@query(f"""WITH {EVENTS}, tr AS (SELECT l_orderkey AS trade_id, arg_min(l_extendedprice / l_quantity, struct_pack(a := l_linenumber, b := l_partkey, c := l_quantity)) AS entry, sum(l_extendedprice * l_discount) AS realized, max(l_tax) * 100 AS pnl, max(l_quantity) AS qty FROM lineitem GROUP BY 1),
rs AS (SELECT trade_id, max(id) AS id, arg_max(detail, id) AS detail FROM ev WHERE kind = 'resync' GROUP BY 1), sd AS (SELECT trade_id, CASE WHEN json_valid(detail) THEN coalesce(list_sum(CAST(json_extract(detail, '$.sells[*][0]') AS DOUBLE[])), 0) ELSE 0 END AS told, id FROM rs),
s AS (SELECT tr.*, coalesce(told, 0) + coalesce((SELECT sum(qty) FROM ev WHERE ev.trade_id = tr.trade_id AND kind IN ('half_close', 'partial_sale', 'stop_sale') AND ev.id > coalesce(sd.id, 0)), 0) AS sold FROM tr LEFT JOIN sd USING (trade_id))
SELECT trade_id, CASE WHEN sold > 0 AND entry > 0 THEN round((realized + pnl) / (entry * (qty + sold)) * 100, 6) END AS pct FROM s""")
def jn22_nested_json(spark, d):
    """The return of whole trades: dollars of all legs over everything held at cost, with the legs that a resync's nested list tells."""
    l = load(spark, d, "lineitem")  # noqa: E741
    own = l.select(F.col("l_orderkey").alias("trade_id"), (F.col("l_linenumber") * 10).alias("id"), F.when(F.col("l_returnflag") == "R", "half_close").when(F.col("l_returnflag") == "A", "partial_sale").otherwise("note").alias("kind"), F.col("l_quantity").alias("qty"), F.lit(None).cast("string").alias("detail"))
    told = F.when(F.col("trade_id") % 30 == 0, "{bad").otherwise(F.concat(F.lit('{"sells":[['), F.sum("l_quantity").cast("string"), F.lit(",1.5],[2,3.5],[]]}")))
    found = l.withColumnRenamed("l_orderkey", "trade_id").where("trade_id % 3 = 0").groupBy("trade_id").agg(told.alias("detail")).select("trade_id", F.lit(25).alias("id"), F.lit("resync").alias("kind"), F.lit(None).cast("double").alias("qty"), "detail")
    t = l.groupBy(F.col("l_orderkey").alias("trade_id")).agg(F.min_by(F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("entry"), F.sum(F.expr("l_extendedprice * l_discount")).alias("realized"), (F.max("l_tax") * 100).alias("pnl"), F.max("l_quantity").alias("qty"))
    return ledger.whole_trade_pct(t, own.unionByName(found)).select("trade_id", F.round("pct", 6).alias("pct"))


@query("""WITH e AS (SELECT event_id AS id, event_type AS kind, user_id AS ticker, CAST(ts AS DATE) AS day, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 2 ELSE CAST(ts AS DATE) END AS detected, CASE WHEN value >= 20 THEN 'up' ELSE 'down' END AS direction, value AS strength FROM events),
t AS (SELECT DISTINCT o_custkey AS ticker, o_orderstatus = 'O' AS open FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 <> 1), p AS (SELECT user_id AS ticker, event_type AS trigger, CAST(ts AS DATE) AS entry FROM events WHERE event_id % 4 = 0)
SELECT id, kind, ticker, direction, strength FROM e WHERE (day >= DATE '2024-01-29' OR detected >= DATE '2024-01-29' OR (kind = 'signup' AND detected >= DATE '2024-01-26')) AND ticker NOT IN (SELECT ticker FROM t WHERE open)
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.ticker = e.ticker AND p.trigger = e.kind AND p.entry >= e.day) AND direction = 'up' AND kind <> 'view' ORDER BY strength DESC, id LIMIT 10""")
def cp15_candidates(spark, d):
    """The ten strongest fresh events that nothing is held of and no trade has acted on since."""
    day = F.to_date("ts")
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("ticker"), day.alias("day"), F.when(F.col("event_id") % 3 == 0, F.date_add(day, 2)).otherwise(day).alias("detected"), F.when(F.col("value") >= 20, "up").otherwise("down").alias("direction"), F.col("value").alias("strength"))
    held = load(spark, d, "orders").where("o_orderstatus = 'O' and o_orderkey % 2 = 0 and o_custkey % 3 <> 1").select(F.col("o_custkey").alias("ticker"))
    acted = load(spark, d, "events").where("event_id % 4 = 0").select(F.col("user_id").alias("ticker"), F.col("event_type").alias("kind"), day.alias("entry"))
    return ledger.event_candidates(e, held, acted, today(), slow="signup", directions=["up"], traded=["signup", "error", "click", "purchase"]).select("id", "kind", "ticker", "direction", "strength")


#: The least cosine: 0.5 for vectors of texts; those of the tables are nearly random, none of them so close.
ALIKE = 0.2


@query(f"""WITH {STORIES}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), old AS (SELECT vec_id, e, headline, day FROM v JOIN (SELECT story_id, day, string_split(summary, '.')[1] AS headline FROM stories) s ON story_id = vec_id WHERE day < DATE '{AS_OF}' - 7),
c AS (SELECT q.vec_id AS query_id, old.vec_id AS story_id, headline, day, round(list_cosine_similarity(q.e, old.e), 9) AS score FROM v q JOIN old ON q.vec_id % 50 = 0 AND old.vec_id <> q.vec_id)
SELECT query_id, story_id, headline, day, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, story_id) AS INTEGER) AS rank FROM c WHERE score >= {ALIKE} QUALIFY rank <= 3""")
def sl19_older_related(spark, d):
    """For every query up to three stories that are older than a week and alike, with their headline and day."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = stories(spark, d).select(F.col("story_id").alias("vec_id"), search.headline(F.col("summary")).alias("headline"), "day")
    return search.older_related(e, q, s, F.date_sub(today(), 7), least=ALIKE).select("query_id", F.col("vec_id").alias("story_id"), "headline", "day", F.round("score", 5).alias("score"), "rank")


_M = """SELECT o_orderkey, o_totalprice AS volume, c_acctbal * 10 AS liquidity, CASE o_orderkey % 11 WHEN 0 THEN 'How many Tweets this week?' WHEN 1 THEN 'Will they say "peace"?' ELSE 'Will it rain?' END AS question,
  CASE o_orderkey % 13 WHEN 0 THEN 'What will he say on Friday' WHEN 1 THEN 'Tweets and tweets' END AS event_title, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 21 - 10) / 100.0 END AS change, o_orderkey % 101 / 100.0 AS probability FROM orders JOIN customer ON c_custkey = o_custkey"""


@query(f"""WITH m AS ({_M}), x AS (SELECT *, lower(question) AS q, lower(coalesce(event_title, '')) AS e FROM m)
SELECT o_orderkey FROM x WHERE volume >= 10000 AND liquidity >= 10000 AND NOT (contains(q, ' tweets') OR contains(e, ' tweets') OR contains(q, ' say "') OR contains(q, ' say “') OR contains(q, ' say ''') OR (starts_with(e, 'what will') AND contains(e, ' say')))
  AND (coalesce(abs(change) >= 0.05, false) OR probability BETWEEN 0.03 AND 0.97)""")
def pf9_market_quality(spark, d):
    """Markets with enough money behind their price that are no novelty bets, and moved or are still open."""
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    k = F.col("o_orderkey")
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        k, F.col("o_totalprice").alias("volume_24h"), (F.col("c_acctbal") * 10).alias("liquidity"), F.when(k % 11 == 0, "How many Tweets this week?").when(k % 11 == 1, 'Will they say "peace"?').otherwise("Will it rain?").alias("question"),
        F.when(k % 13 == 0, "What will he say on Friday").when(k % 13 == 1, "Tweets and tweets").alias("event_title"), F.when(k % 5 != 0, (k % 21 - 10) / 100.0).alias("change_1d"), (k % 101 / 100.0).alias("probability"))
    return m.where(ledger.worth_showing()).select("o_orderkey")
