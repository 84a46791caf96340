"""Queries of reports: migration between sectors, trends, predictions, the go-live gate, the journal, budgets and logs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import intelligence, search
from tessera.operators import relational as R
from tessera.plans.catalog import query
from tessera.plans.views import AS_OF, BARS, MENTIONS, TRADES, bars, mentions, today, trades
from tessera.session import load

_STAGE = "CASE " + " ".join(f"WHEN g.n / s.n::DOUBLE < {b} THEN '{{}}'" if b else "ELSE '{}' END" for b, _, _ in intelligence.STAGES)


@query(f"""WITH {MENTIONS}, g AS (SELECT entity_id, sector, count(*) AS n, min(day) AS first FROM mentions GROUP BY ALL), s AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, first, sector) = 1)
SELECT s.entity_id, s.sector AS source, g.sector AS target, s.n AS source_n, g.n AS target_n, {_STAGE.format(*[x[1] for x in intelligence.STAGES])} AS stage, {_STAGE.format(*[x[2] for x in intelligence.STAGES])} AS timeline,
  round(least(0.3 + 0.3 * least(s.n / 20, 1) + 0.2 * least(g.n / 10, 1) + 0.2 * least(g.n / s.n, 1), 1), 6) AS confidence FROM s JOIN g ON g.entity_id = s.entity_id AND g.sector <> s.sector AND s.n >= 5 AND g.n >= 2 AND g.first >= DATE '{AS_OF}' - 28""")
def cp9_migration(spark, d):
    """Users that move from their main kind of event to one that they first had in the last four weeks."""
    return intelligence.migrations(mentions(spark, d), F.date_sub(today(), 28)).withColumn("confidence", F.round("confidence", 6))


_TOPICS = f"""{MENTIONS}, m AS (SELECT mention_id, entity_id AS topic, sector, day, 'Story ' || k AS headline, sentiment FROM mentions WHERE day BETWEEN DATE '{AS_OF}' - {intelligence.EVIDENCE} AND DATE '{AS_OF}'),
pr AS (SELECT o_custkey AS topic, 'Order ' || o_orderkey AS title, floor(o_totalprice) AS confidence FROM orders WHERE o_orderstatus = 'O')"""


@query(f"""WITH {_TOPICS}, r AS (SELECT topic, count(*) AS n, count(DISTINCT day) AS days, avg(sentiment) AS sentiment, round((count_if(day >= DATE '{AS_OF}' - 7) / 7.0) / (count(*) / 30.0), 9) AS acceleration FROM m GROUP BY topic HAVING count(*) >= 3 OR count(DISTINCT day) >= 2),
t AS (SELECT *, row_number() OVER (ORDER BY round(days * n * acceleration, 6) DESC, topic) AS rank FROM r QUALIFY rank <= {intelligence.TRENDS}),
sp AS (SELECT topic, string_agg(k, ',' ORDER BY i DESC) AS sparkline FROM (SELECT topic, i, (SELECT count(*) FROM m WHERE m.topic = t.topic AND m.day = DATE '{AS_OF}' - i::INTEGER) AS k FROM t, range({intelligence.SPARK}) r(i)) GROUP BY topic),
h AS (SELECT topic, mention_id, day, headline FROM m QUALIFY row_number() OVER (PARTITION BY topic, headline ORDER BY day DESC, mention_id DESC) = 1),
p AS (SELECT topic, string_agg(mention_id || ' ' || day || ' ' || headline, '|' ORDER BY day DESC, mention_id DESC) AS points FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY topic ORDER BY day DESC, mention_id DESC) <= {intelligence.POINTS}) GROUP BY topic),
s AS (SELECT topic, string_agg(DISTINCT sector, ',' ORDER BY sector) AS sectors FROM m GROUP BY topic), a AS (SELECT topic, arg_max(title, struct_pack(a := confidence, b := title)) AS prediction FROM pr GROUP BY topic)
SELECT CAST(rank AS INTEGER) AS rank, topic, n, days, round(acceleration, 6) AS acceleration, round(sentiment, 6) AS sentiment, sparkline, points, sectors, prediction FROM t JOIN sp USING (topic) JOIN p USING (topic) JOIN s USING (topic) LEFT JOIN a USING (topic)""")
def cp12_trends(spark, d):
    """The strongest topics with their evidence."""
    m = mentions(spark, d).select("mention_id", F.col("entity_id").alias("topic"), "sector", "day", F.concat(F.lit("Story "), F.col("k").cast("string")).alias("headline"), "sentiment")
    o = load(spark, d, "orders")
    p = o.select(F.col("o_custkey").alias("topic"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.floor("o_totalprice").alias("confidence"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("over").alias("status"))
    x = intelligence.trends(m, p, today())
    point = lambda p: F.concat_ws(" ", p["mention_id"].cast("string"), p["day"].cast("string"), p["headline"])
    return x.select("rank", "topic", "n", "days", F.round("acceleration", 6).alias("acceleration"), F.round("sentiment", 6).alias("sentiment"), F.array_join(F.transform("sparkline", lambda k: k.cast("string")), ",").alias("sparkline"),
                    F.array_join(F.transform("points", point), "|").alias("points"), F.array_join("sectors", ",").alias("sectors"), F.col("prediction.title").alias("prediction"))


INDEX = "ix AS (SELECT day, avg(close) AS c FROM bars GROUP BY day)"
EXCESS = f"{TRADES}, {BARS}, {INDEX}, ex AS (SELECT t.*, pnl / invested - (b.c / a.c - 1) AS excess FROM trades t ASOF JOIN ix a ON t.entry_day >= a.day ASOF JOIN ix b ON t.exit_day >= b.day)"


def _excess(spark, d):
    """Trades with their return over the index. The index has a row for each month at any scale: with the months between filled in, both look-ups are equal joins by month."""
    i = bars(spark, d).groupBy("day").agg(F.avg("close").alias("c"))
    w = Window.partitionBy(F.year("day") * 0).orderBy("day")
    until = F.greatest(F.col("day"), F.add_months(F.coalesce(F.lead("day").over(w), F.add_months("day", 1200)), -1))
    months = i.withColumn("until", until).select("c", F.explode(F.sequence("day", "until", F.expr("interval 1 month"))).alias("month"))
    t = trades(spark, d)
    for day, c in (("entry_day", "c1"), ("exit_day", "c2")):
        t = t.join(F.broadcast(months.withColumnRenamed("c", c)), F.trunc(day, "month") == F.col("month")).drop("month")
    return t.withColumn("excess", F.col("pnl") / F.col("invested") - (F.col("c2") / F.col("c1") - 1))


@query(f"WITH {EXCESS} SELECT trade_id, round(excess, 6) AS excess FROM ex")
def cp24_benchmark(spark, d):
    """Each trade against the index over the same days."""
    return _excess(spark, d).select("trade_id", F.round("excess", 6).alias("excess"))


I = intelligence  # noqa: E741


@query(f"""WITH {EXCESS}, tr AS (SELECT ex.*, c_nationkey AS book, excess * 100 AS x FROM ex JOIN customer ON c_custkey = account), cl AS (SELECT * FROM tr WHERE status = 'F'),
dy AS (SELECT book, exit_day, sum(pnl) AS pnl FROM cl GROUP BY ALL), cv AS (SELECT book, exit_day, 50000 + sum(pnl) OVER (PARTITION BY book ORDER BY exit_day) AS v FROM dy), pk AS (SELECT *, greatest(50000, max(v) OVER (PARTITION BY book ORDER BY exit_day)) AS peak FROM cv),
dd AS (SELECT book, max((peak - v) / peak * 100) AS max_drawdown FROM pk GROUP BY book), un AS (SELECT book, count(*) AS bare FROM tr WHERE status = 'O' AND fills = 1 AND book % 3 = 0 GROUP BY book),
a AS (SELECT book, count(*) AS n, greatest(date_diff('day', min(entry_day), max(exit_day)), 0) AS track, sum(pnl) AS net, count(x) AS compared, avg(x) / (stddev_samp(x) / sqrt(count(x))) AS t, avg(x) AS mean, sum(greatest(pnl, 0)) AS won, sum(greatest(-pnl, 0)) AS lost FROM cl GROUP BY book),
b AS (SELECT a.*, max_drawdown, coalesce(bare, 0) AS bare FROM a LEFT JOIN dd USING (book) LEFT JOIN un USING (book)),
c AS (SELECT book, unnest([{{'criterion': 'trades', 'passed': n >= {I.MIN_TRADES}, 'current': n::DOUBLE}}, {{'criterion': 'track_record', 'passed': track >= {I.MIN_DAYS}, 'current': track::DOUBLE}}, {{'criterion': 'net_profit', 'passed': net > 0, 'current': net}},
  {{'criterion': 'edge', 'passed': coalesce(compared >= {I.MIN_COMPARED} AND mean > 0 AND t >= {I.MIN_T}, false), 'current': CASE WHEN compared >= {I.MIN_COMPARED} THEN t END}}, {{'criterion': 'profit_factor', 'passed': CASE WHEN lost > 0 THEN won / lost >= {I.MIN_FACTOR} ELSE n >= {I.MIN_TRADES} AND won > 0 END, 'current': CASE WHEN lost > 0 THEN won / lost END}},
  {{'criterion': 'drawdown', 'passed': coalesce(max_drawdown <= {I.MAX_DRAWDOWN}, false), 'current': max_drawdown}}, {{'criterion': 'stops', 'passed': bare = 0, 'current': bare::DOUBLE}}], recursive := true) FROM b),
p AS (SELECT *, count_if(passed) OVER (PARTITION BY book) AS n_passed FROM c)
SELECT book, criterion, passed, round("current", 4) AS "current", CAST(n_passed AS INTEGER) AS n_passed, CASE WHEN n_passed = 7 THEN 'ready' WHEN n_passed >= 5 THEN 'close' ELSE 'not_yet' END AS status FROM p""")
def cp25_go_live(spark, d):
    """Whether the book of each nation's customers may go live: seven criteria and a status."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_nationkey").alias("book"))
    t = _excess(spark, d).join(c, "account")
    closed = t.where("status = 'F'").withColumn("excess", F.col("excess") * 100)
    w = Window.partitionBy("book").orderBy("exit_day").rowsBetween(Window.unboundedPreceding, 0)
    daily = closed.groupBy("book", "exit_day").agg(F.sum("pnl").alias("pnl")).withColumn("v", 50000 + F.sum("pnl").over(w))  # a row for each book and day
    peaks = daily.withColumn("peak", F.greatest(F.lit(50000.0), F.max("v").over(w)))
    drawdowns = peaks.groupBy("book").agg(F.max((F.col("peak") - F.col("v")) / F.col("peak") * 100).alias("max_drawdown"))
    unprotected = t.where("status = 'O' and fills = 1 and book % 3 = 0").groupBy("book").agg(F.count("*").alias("n"))
    return intelligence.go_live(closed, drawdowns, unprotected, "book").withColumn("current", F.round("current", 4))


_KEYWORD = r"list_filter(list_transform(list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: strlen(w) >= 3), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')"


@query(f"""WITH k AS (SELECT item_id, {_KEYWORD} AS ws FROM benchmark), u AS (SELECT item_id, unnest(ws) AS w FROM k), m AS (SELECT item_id, doc_id, count(*) AS n FROM u JOIN documents ON contains(lower(text), w) GROUP BY ALL), b AS (SELECT item_id, max(n) AS n FROM m GROUP BY item_id)
SELECT item_id, CASE WHEN b.n / len(ws) >= 0.3 THEN round(b.n / len(ws), 6) END AS share, CASE WHEN b.n / len(ws) >= 0.6 THEN 'validated' WHEN b.n / len(ws) >= 0.3 THEN 'partially_validated' ELSE 'open' END AS verdict FROM k LEFT JOIN b USING (item_id)""")
def cp28_validation(spark, d):
    """The best share of a prediction's keywords in one story."""
    long = F.filter(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"), lambda w: F.octet_length(w) >= 3)
    bare = F.array_remove(F.transform(long, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), "")
    items = load(spark, d, "benchmark").select("item_id", bare.alias("keywords"))
    s = search.best_share(items, load(spark, d, "documents").where("text is not null"), 0.3)
    return s.select("item_id", F.round("share", 6).alias("share"), F.when(F.col("share") >= 0.6, "validated").when(F.col("share") >= 0.3, "partially_validated").otherwise("open").alias("verdict"))


_POOL = r"""p AS (SELECT page_id, page_id % 20 AS briefing, sha256(string_split(lower(regexp_replace(trim(regexp_replace(regexp_replace(url, '^https?://(www\.|m\.|blog\.)?', ''), '/[0-9]+.*$', '')), '/+$', '')), '?')[1]) AS url_hash, url, length(html) AS size FROM pages)"""


@query(f"""WITH {_POOL}, q AS (SELECT *, row_number() OVER (PARTITION BY briefing ORDER BY page_id) - 1 AS position FROM p), f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY briefing, url_hash ORDER BY position) = 1)
SELECT briefing, url_hash, page_id AS candidate, CAST(position AS INTEGER) AS pool_position, (briefing, url_hash) IN (SELECT (briefing, url_hash) FROM p WHERE size > 1500) AS kept, (briefing, url_hash) IN (SELECT (briefing, url_hash) FROM p WHERE NOT contains(url, '?')) AS summarised,
  (SELECT min(page_id) FROM p s WHERE s.briefing = f.briefing AND s.url_hash = f.url_hash AND contains(s.url, '/en/') AND NOT contains(s.url, '?')) AS story_id FROM f""")
def cp35_funnel(spark, d):
    """The pool of each briefing: where a url stood, whether it was kept and summarised, and which story it became."""
    place = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.|m\.|blog\.)?", ""), "/[0-9]+.*$", "")
    p = load(spark, d, "pages").select("page_id", (F.col("page_id") % 20).alias("briefing"), text.hash_url(place).alias("url_hash"), "url", F.length("html").alias("size"))
    w = Window.partitionBy("briefing").orderBy("page_id")
    pool = p.select("briefing", "url_hash", F.col("page_id").alias("candidate"), (F.row_number().over(w) - 1).alias("position"))
    plain = p.where(~F.contains("url", F.lit("?")))
    stories = plain.where(F.contains("url", F.lit("/en/"))).select("briefing", "url_hash", F.col("page_id").alias("story_id"))
    return intelligence.funnel(pool, p.where("size > 1500"), plain, stories)


# amounts are in cents, so that both engines write the same digits
@query(f"""WITH {TRADES}, c AS (SELECT *, CAST(round(invested * 100) AS BIGINT) AS cents FROM trades), o AS (SELECT account, count(*) AS n, sum(cents)::BIGINT AS cents, max(cents)::BIGINT AS most, list({{'trade': trade_id, 'ticker': ticker, 'cents': cents}} ORDER BY trade_id) AS positions FROM c WHERE status = 'O' GROUP BY account),
f AS (SELECT account, list({{'trade': trade_id, 'closed': CAST(exit_day AS VARCHAR), 'fills': fills}} ORDER BY exit_day DESC, trade_id DESC) AS trades FROM (SELECT * FROM c WHERE status = 'F' QUALIFY row_number() OVER (PARTITION BY account ORDER BY exit_day DESC, trade_id DESC) <= 5) GROUP BY account),
e AS (SELECT account, list({{'day': CAST(exit_day AS VARCHAR), 'ticker': ticker, 'held': ticker IN (SELECT ticker FROM c x WHERE x.account = c.account AND status = 'O')}} ORDER BY exit_day, trade_id) AS due FROM c WHERE status = 'P' GROUP BY account)
SELECT c_custkey AS account, CAST(to_json({{'version': 1, 'account': {{'id': c_custkey, 'cash_cents': CAST(round(c_acctbal * 100) AS BIGINT), 'segment': c_mktsegment}}, 'risk': {{'positions': coalesce(o.n, 0), 'cents': coalesce(o.cents, 0), 'largest': coalesce(o.most, 0)}},
  'positions': coalesce(positions, []), 'recent_trades': coalesce(f.trades, []), 'calendar': coalesce(due, [])}}) AS VARCHAR) AS doc FROM customer LEFT JOIN o ON o.account = c_custkey LEFT JOIN f ON f.account = c_custkey LEFT JOIN e ON e.account = c_custkey""")
def cp36_snapshot(spark, d):
    """A nested document for each account: cash, risk, open positions, the last five trades, and what is due with whether it is held."""
    t = trades(spark, d).withColumn("cents", F.round(F.col("invested") * 100).cast("bigint"))
    opened = t.where("status = 'O'")
    position = F.struct(F.col("trade_id").alias("trade"), "ticker", "cents")
    o = opened.groupBy("account").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.max("cents").alias("most"), F.sort_array(F.collect_list(position)).alias("positions"))
    w = Window.partitionBy("account").orderBy(F.desc("exit_day"), F.desc("trade_id"))
    last = t.where("status = 'F'").withColumn("k", F.row_number().over(w)).where("k <= 5")
    f = last.groupBy("account").agg(F.sort_array(F.collect_list(F.struct("k", F.struct(F.col("trade_id").alias("trade"), F.col("exit_day").cast("string").alias("closed"), "fills").alias("x")))).alias("trades"))
    held = opened.select("account", "ticker").distinct().withColumn("held", F.lit(True))
    due = t.where("status = 'P'").join(held, ["account", "ticker"], "left").select("account", "exit_day", "trade_id", F.struct(F.col("exit_day").cast("string").alias("day"), "ticker", F.coalesce("held", F.lit(False)).alias("held")).alias("x"))
    e = due.groupBy("account").agg(F.sort_array(F.collect_list(F.struct("exit_day", "trade_id", "x"))).alias("due"))
    c = load(spark, d, "customer").withColumnRenamed("c_custkey", "account").join(o, "account", "left").join(f, "account", "left").join(e, "account", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("bigint")
    some = lambda x: F.coalesce(x, F.array())
    account = F.struct(F.col("account").alias("id"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cash_cents"), F.col("c_mktsegment").alias("segment"))
    risk = F.struct(zero("n").alias("positions"), zero("cents").alias("cents"), zero("most").alias("largest"))
    inner = lambda c: F.transform(c, lambda y: y["x"])
    doc = F.struct(F.lit(1).alias("version"), account.alias("account"), risk.alias("risk"), some(F.col("positions")).alias("positions"), some(inner("trades")).alias("recent_trades"), some(inner("due")).alias("calendar"))
    return c.select("account", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


_SIGNALS = "[{'d': 'insider', 'v': trade_id % 97 / 97.0}, {'d': 'news', 'v': trade_id % 89 / 89.0}, {'d': 'government', 'v': trade_id % 83 / 83.0}, {'d': 'search', 'v': trade_id % 79 / 79.0}]"
_REASON = "CASE trade_id % 5 WHEN 0 THEN 'trailing_stop (-4.2%, high 9)' WHEN 1 THEN 'signal_decay' WHEN 2 THEN 'manual' WHEN 3 THEN 'odd rule' END"
_BECAUSE = "coalesce(CASE regexp_extract(reason, '^[^\\s(]*') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in I.BECAUSE.items()) + f" END, CASE status WHEN 'P' THEN '{I.BECAUSE_STATUS['stopped_out']}' END, '{I.UNRECORDED}')"


@query(f"""WITH {TRADES}, s AS (SELECT t.*, p_name AS name, invested / 97 AS price, pnl / invested * 100 AS pct, {_REASON} AS reason, list_sort(list_transform(list_filter({_SIGNALS}, lambda x: x.v > 0.05), lambda x: {{'n': -x.v, 'd': x.d}}))[1:3] AS top FROM trades t JOIN part ON p_partkey = ticker)
SELECT trade_id, 'Entered ' || name || ' long on ' || entry_day || ' at $' || printf('%.2f', price) || ' driven by ' || CASE WHEN len(top) > 0 THEN array_to_string(list_transform(top, lambda x: x.d || ' (' || printf('%.0f', -x.n * 100) || '%)'), ', ') ELSE 'convergence signals' END || '. Position size: $' || printf('%.0f', invested) || '.'
  || CASE WHEN status <> 'O' THEN ' Exited after ' || date_diff('day', entry_day, exit_day) || ' days at $' || printf('%.2f', price * (1 + pct / 100)) || ' — ' || CASE WHEN pct >= 0 THEN '+' ELSE '' END || printf('%.1f', pct) || '% ($' || CASE WHEN pnl >= 0 THEN '+' ELSE '' END || printf('%.0f', pnl) || ') because ' || {_BECAUSE} || '.' ELSE '' END
  || CASE WHEN len(list_filter(top, lambda x: x.n < -0.5)) >= 2 THEN ' Multiple strong signals aligned on this trade.' WHEN len(list_filter(top, lambda x: x.n < -0.5)) = 1 THEN ' The ' || list_filter(top, lambda x: x.n < -0.5)[1].d || ' signal was the primary driver.' ELSE '' END AS note FROM s""")
def cp37_explanation(spark, d):
    """The journal of every trade: what drove its entry, how and why it was left."""
    i = F.col("trade_id")
    signals = F.filter(F.array(*[F.struct(F.lit(n).alias("dimension"), (i % k / float(k)).alias("value")) for n, k in (("insider", 97), ("news", 89), ("government", 83), ("search", 79))]), lambda s: s["value"] > 0.05)
    reason = F.when(i % 5 == 0, "trailing_stop (-4.2%, high 9)").when(i % 5 == 1, "signal_decay").when(i % 5 == 2, "manual").when(i % 5 == 3, "odd rule")
    price, pct = F.col("invested") / 97, F.col("pnl") / F.col("invested") * 100
    gone = lambda c: F.when(F.col("status") != "O", c)
    t = trades(spark, d).join(load(spark, d, "part").select(F.col("p_partkey").alias("ticker"), "p_name"), "ticker")
    note = intelligence.journal(F.col("p_name"), signals, F.col("entry_day"), price, F.col("invested"), gone(F.col("exit_day")), gone(price * (1 + pct / 100)), F.col("pnl"), pct, F.when(F.col("status") == "P", "stopped_out").otherwise("closed"), reason)
    return t.select("trade_id", note.alias("note"))


@query("""WITH f AS (SELECT l_orderkey, sum(l_quantity) AS expected, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS held, sum(CASE WHEN l_linestatus <> 'O' AND l_returnflag <> 'A' THEN l_quantity END) AS sold FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(sold IS NOT NULL AND abs(expected - held - sold) < greatest(0.01, expected * 0.0001), false) AS explained FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def cp43_gap(spark, d):
    """Whether the fills that are known add up to the shares that are missing, give or take a share's rounding; without fills nothing is explained."""
    gone = F.col("l_linestatus") != "O"
    f = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("expected"), F.sum(F.when(gone, 0.0).otherwise(F.col("l_quantity"))).alias("held"), F.sum(F.when(gone & (F.col("l_returnflag") != "A"), F.col("l_quantity"))).alias("sold"))
    fits = F.col("sold").isNotNull() & (F.abs(F.col("expected") - F.col("held") - F.col("sold")) < F.greatest(F.lit(0.01), F.col("expected") * 0.0001))
    return load(spark, d, "orders").join(f, "o_orderkey", "left").select("o_orderkey", F.coalesce(fits, F.lit(False)).alias("explained"))


@query(f"""WITH {TRADES}, d AS (SELECT account, exit_day, sum(pnl) AS pnl FROM trades GROUP BY ALL), c AS (SELECT account, exit_day, 2000 + sum(pnl) OVER (PARTITION BY account ORDER BY exit_day) AS v FROM d), m AS (SELECT account, max(v) AS mark, arg_max(v, exit_day) AS value FROM c GROUP BY account)
SELECT account, round(CASE WHEN mark > 0 AND value > 0 THEN greatest((mark - value) / mark, 0) ELSE 0 END, 6) AS drawdown FROM m""")
def ag62_current_drawdown(spark, d):
    """How far each account is below its high-water mark: the highest snapshot or today's value; none without value."""
    w = Window.partitionBy("account").orderBy("exit_day").rowsBetween(Window.unboundedPreceding, 0)
    c = trades(spark, d).groupBy("account", "exit_day").agg(F.sum("pnl").alias("pnl")).withColumn("v", 2000 + F.sum("pnl").over(w))
    m = c.groupBy("account").agg(F.max("v").alias("mark"), F.max_by("v", "exit_day").alias("value"))
    below = F.when((F.col("mark") > 0) & (F.col("value") > 0), F.greatest((F.col("mark") - F.col("value")) / F.col("mark"), F.lit(0.0))).otherwise(0.0)
    return m.select("account", F.round(below, 6).alias("drawdown"))


CAP = 60.0


@query(f"""WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50 THEN value ELSE 0 END AS cost FROM events),
s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM e)
SELECT event_id, user_id, round(spent, 4) AS spent, round(spent, 6) + value <= {CAP} AS allowed FROM s WHERE event_type = 'signup'""")
def ag65_budget(spark, d):
    """For each call whether its estimate fits under the day's cap: what was logged before it that day, and the estimates of what is still being read."""
    e = load(spark, d, "events")
    reading = (F.col("event_type") == "click") & (F.expr("try_cast(get_json_object(props, '$.k') AS int)") >= 50)
    cost = F.when((F.col("event_type") == "purchase") | reading, F.col("value")).otherwise(0.0)
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    s = e.withColumn("spent", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).where("event_type = 'signup'")
    return s.select("event_id", "user_id", F.round("spent", 4).alias("spent"), (F.round("spent", 6) + F.col("value") <= CAP).alias("allowed"))


@query("""WITH x AS (SELECT event_id, [event_id, event_id + 3, user_id, 5] AS offered, [event_id % 6, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT), user_id, -1, event_id + 3] AS cited FROM events),
y AS (SELECT event_id, list_transform(cited, lambda r: CASE WHEN list_contains(offered, r) THEN r WHEN r >= 0 AND r < 4 THEN offered[r + 1] END) AS ids, len(list_filter(cited, lambda r: NOT list_contains(offered, r) AND r >= 0 AND r < 4)) AS remapped FROM x),
z AS (SELECT event_id, remapped, len(list_filter(ids, lambda i: i IS NULL)) AS dropped, list_filter(ids, lambda i: i IS NOT NULL) AS ids FROM y)
SELECT event_id, array_to_string(list_transform(list_filter(ids, lambda i, k: list_position(ids, i) = k), lambda i: CAST(i AS VARCHAR)), ',') AS ids, CAST(remapped AS INTEGER) AS remapped, CAST(dropped AS INTEGER) AS dropped FROM z""")
def so10_citations(spark, d):
    """What an answer cites: an offered id stands for itself, a place in the list for the id there, anything else is dropped; each once, in order."""
    k = F.expr("try_cast(get_json_object(props, '$.k') AS bigint)")
    i, u = F.col("event_id"), F.col("user_id")
    x = load(spark, d, "events").select("event_id", text.resolved_refs(F.array(i % 6, i, k, u, F.lit(-1).cast("bigint"), i + 3), F.array(i, i + 3, u, F.lit(5).cast("bigint"))).alias("r"))
    return x.select("event_id", F.array_join(F.transform("r.ids", lambda i: i.cast("string")), ",").alias("ids"), "r.remapped", "r.dropped")


@query("""WITH w AS (SELECT DISTINCT doc_id AS id FROM documents), s AS (SELECT doc_id AS id, quality AS score FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id + 1000000000, quality FROM labels WHERE toxic = 1), f AS (SELECT s.* FROM s WHERE id IN (SELECT id FROM w)),
r AS (SELECT vec_id AS id, label AS score, 1 AS at_ FROM embeddings WHERE label > 2 UNION ALL SELECT vec_id, label + 100, 2 FROM embeddings WHERE label > 1)
SELECT id, score, false AS recovered FROM f UNION ALL SELECT id, arg_min(score, at_), true FROM r WHERE id IN (SELECT id FROM w) AND id NOT IN (SELECT id FROM f) GROUP BY id""")
def so12_retry_merge(spark, d):
    """Scores of a first answer, some for ids that nobody asked for, and of a retry that gives some twice."""
    wanted = load(spark, d, "documents").select(F.col("doc_id").alias("id"))
    l, e = load(spark, d, "labels"), load(spark, d, "embeddings")  # noqa: E741
    scores = l.select(F.when(F.col("toxic") == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1000000000).alias("id"), F.col("quality").alias("score"))
    retry = e.where("label > 2").select(F.col("vec_id").alias("id"), F.col("label").alias("score"), F.lit(1).alias("at")).unionByName(e.where("label > 1").select(F.col("vec_id").alias("id"), (F.col("label") + 100).alias("score"), F.lit(2).alias("at")))
    return R.with_retry(wanted, scores.withColumn("at", F.lit(0)), retry, [], "id", "at").select("id", "score", "recovered")
