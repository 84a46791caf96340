"""Queries of what the system learns from, and of readers and look-ups with rules of their own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import dates, sizing
from tessera.operators import calibration, entities, ordered
from tessera.operators import relational as R
from tessera.plans import catalog, domain, intelligence
from tessera.plans.catalog import query
from tessera.plans.views import TRADES, trades
from tessera.session import load
from tessera.sources import buckets, feeds, scratch

DIMENSIONS = "insider institutional news government search patent supply_chain political".split()
DEFAULTS = sizing.Strategy().weights
_PRIMES = (2, 3, 5, 7, 11, 13, 17, 19)
_WEIGHTS = "[" + ", ".join(f"{w}::DOUBLE" for w in DEFAULTS) + "]"


def _marks(day: str) -> list[str]:
    """SQL of the trades that each dimension spoke for."""
    return [f"SELECT book, {i} AS i, ret, {day} AS day FROM tr WHERE trade_id % {p} = 0" for i, p in enumerate(_PRIMES)]


# the rounds are a recursion; one row for each book
EVIDENCE = f"""{TRADES}, tr AS (SELECT t.trade_id, c_nationkey AS book, exit_day, pnl / invested + CASE WHEN c_nationkey % 4 = t.trade_id % 2 THEN 0.004 ELSE 0 END AS ret FROM trades t JOIN customer ON c_custkey = account),
al AS (SELECT book, avg(ret) AS m FROM tr GROUP BY book), mk AS ({" UNION ALL ".join(_marks("exit_day"))}),
ev AS (SELECT book, i, count(*) AS n, count(DISTINCT day) AS days, (avg(ret) - any_value(m)) / nullif(stddev_samp(ret) / sqrt(count(*)), 0) AS t FROM mk JOIN al USING (book) GROUP BY book, i),
df AS (SELECT {_WEIGHTS} AS d), cr AS (SELECT book, list(x ORDER BY i) AS w FROM (SELECT al.book, r.i, CASE WHEN d[r.i::INT + 1] > 0 AND n >= {calibration.MIN_SIGNALS} AND days >= {calibration.MIN_DAYS} AND abs(t) >= {calibration.MIN_T}
  THEN least(greatest(d[r.i::INT + 1] * CASE WHEN t > 0 THEN {1 + calibration.STEP} ELSE {1 - calibration.STEP} END, d[r.i::INT + 1] * {1 - calibration.BOUND}), d[r.i::INT + 1] * {1 + calibration.BOUND}) ELSE d[r.i::INT + 1] END AS x FROM al CROSS JOIN range(8) r(i) LEFT JOIN ev ON ev.book = al.book AND ev.i = r.i CROSS JOIN df) GROUP BY book)"""
_FREE = "list_sum(list_transform(w, lambda x, i: CASE WHEN pinned[i] THEN 0 ELSE x END))"
_FIXED = "list_sum(list_transform(w, lambda x, i: CASE WHEN pinned[i] THEN x ELSE 0 END))"


@query(f"""WITH RECURSIVE {EVIDENCE}, rn AS (SELECT book, 0 AS r, w, list_transform(w, lambda x: false) AS pinned, false AS done FROM cr
UNION ALL SELECT book, r + 1, list_transform(v, lambda x, i: CASE WHEN gone[i] THEN least(greatest(x, d[i] * {1 - calibration.BOUND}), d[i] * {1 + calibration.BOUND}) ELSE x END), list_transform(pinned, lambda p, i: p OR gone[i]), NOT list_contains(gone, true)
  FROM (SELECT *, list_transform(v, lambda x, i: NOT pinned[i] AND d[i] > 0 AND (x < d[i] * {1 - calibration.BOUND} OR x > d[i] * {1 + calibration.BOUND})) AS gone
    FROM (SELECT book, r, pinned, d, list_transform(w, lambda x, i: CASE WHEN pinned[i] THEN x ELSE x * ((1 - {_FIXED}) / {_FREE}) END) AS v FROM rn, df WHERE NOT done AND r < {calibration.ROUNDS}))),
fn AS (SELECT book, arg_max(w, r) AS w FROM rn GROUP BY book), ch AS (SELECT book, cr.w <> d AS changed, fn.w, list_transform(fn.w, lambda x: round(x, 4)) AS v, d FROM fn JOIN cr USING (book), df),
nd AS (SELECT book, CASE WHEN changed AND abs(list_sum(w) - 1) <= 1e-6 THEN list_transform(v, lambda x, i: CASE WHEN i = 9 - list_position(list_reverse(v), list_max(v)) THEN x + 1 - list_sum(v) ELSE x END) ELSE d END AS w FROM ch)
SELECT book, array_to_string(list_transform(w, lambda x: printf('%.4f', x)), ' ') AS weights FROM nd""")
def cp27_weight_moves(spark, d):
    """The weights that the results of each source justify, for the book of every nation: some books reward some dimensions."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_nationkey").alias("book"))
    gift = F.when(F.col("book") % 4 == F.col("trade_id") % 2, 0.004).otherwise(0.0)
    t = trades(spark, d).join(c, "account").select("trade_id", "book", "exit_day", (F.col("pnl") / F.col("invested") + gift).alias("ret"))
    spoke = F.array(*[F.when(F.col("trade_id") % p == 0, F.lit(i)) for i, p in enumerate(_PRIMES)])
    mean = t.groupBy("book").agg(F.avg("ret").alias("m"))
    ev = t.withColumn("i", F.explode(F.array_compact(spoke))).groupBy("book", "i").agg(F.count("*").alias("n"), F.count_distinct("exit_day").alias("days"), F.avg("ret").alias("a"), F.stddev_samp("ret").alias("sd"))
    ev = ev.join(mean, "book").withColumn("t", F.try_divide(F.col("a") - F.col("m"), F.col("sd") / F.sqrt("n")))
    ev = ev.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("n", "days", "t")))).alias("by"))  # eight entries
    dims = F.array(*[F.lit(i) for i in range(len(DIMENSIONS))])
    of = lambda c: F.transform(dims, lambda i: F.try_element_at(F.col("by"), i)[c])
    weights = F.array(*[F.lit(w) for w in DEFAULTS])
    w = calibration.moved(weights, weights, of("n"), of("days"), of("t"))
    return ev.select("book", F.array_join(F.transform(w, lambda x: F.format_string("%.4f", x)), " ").alias("weights"))


# a customer's orders are batches; the first order's old weights are those of the code, others are off by the line
@query(f"""WITH df AS (SELECT unnest({DIMENSIONS}) AS dimension, unnest({_WEIGHTS}) AS "default"), pr AS (SELECT DISTINCT o_custkey AS account, o_orderkey AS batch, o_orderdate AS computed_at, dm AS dimension, ({_WEIGHTS})[i + 1] + CASE WHEN l_quantity > 45 THEN 0.01 ELSE 0 END AS old,
  ({_WEIGHTS})[i + 1] + CASE WHEN l_quantity < 3 THEN 0.02 ELSE 0 END AS new, CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'pending' END AS status FROM (SELECT *, CAST((l_partkey + l_linenumber) % 8 AS INTEGER) AS i, ({DIMENSIONS})[CAST((l_partkey + l_linenumber) % 8 AS INTEGER) + 1] AS dm FROM orders JOIN lineitem ON l_orderkey = o_orderkey)),
nw AS (SELECT account, batch FROM pr WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY account ORDER BY computed_at DESC, batch DESC) = 1)
SELECT account, batch, CASE WHEN count(s) = 0 THEN 'applied' ELSE 'refused' END AS status, count(s) AS n_stale FROM (SELECT pr.*, CASE WHEN (abs("default") < 1e-6 AND abs(new) >= 1e-6) OR abs(old - "default") >= 1e-6 THEN 1 END AS s FROM pr JOIN nw USING (account, batch) JOIN df USING (dimension)) WHERE status = 'pending' GROUP BY account, batch""")
def cp44_calibration(spark, d):
    """Whether each customer's latest pending batch of weights is applied or refused."""
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")  # noqa: E741
    i = ((F.col("l_partkey") + F.col("l_linenumber")) % 8).cast("int")
    weights, names = F.array(*[F.lit(w) for w in DEFAULTS]), F.array(*[F.lit(x) for x in DIMENSIONS])
    w = F.get(weights, i)
    p = o.join(l, o["o_orderkey"] == l["l_orderkey"]).select(
        F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("batch"), F.col("o_orderdate").alias("computed_at"), F.get(names, i).alias("dimension"), (w + F.when(F.col("l_quantity") > 45, 0.01).otherwise(0.0)).alias("old"),
        (w + F.when(F.col("l_quantity") < 3, 0.02).otherwise(0.0)).alias("new"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("pending").alias("status"))
    known = spark.createDataFrame(list(zip(DIMENSIONS, map(float, DEFAULTS), strict=True)), "dimension string, default double")
    return calibration.applied(p, known, "account").select("account", "batch", "status", "n_stale")


HORIZON = 10


@query(f"""WITH RECURSIVE {intelligence.EXCESS}, g AS (SELECT trade_id, reason, CASE WHEN reason = 'ok' THEN 'bought' ELSE 'skipped' END AS outcome FROM ({catalog._oracles["cp33_gates"]}) z),
x AS (SELECT ticker, outcome, reason, entry_day, arg_min(excess, trade_id) AS excess FROM ex JOIN g USING (trade_id) GROUP BY ALL),
k AS (SELECT ticker, outcome, reason, min(entry_day) AS entry_day FROM x GROUP BY ALL UNION ALL SELECT x.ticker, x.outcome, x.reason, min(x.entry_day) FROM k JOIN x ON x.ticker = k.ticker AND x.reason = k.reason AND x.entry_day >= k.entry_day + {HORIZON} GROUP BY ALL)
SELECT outcome, reason, count(*) AS n, round(avg(excess), 6) AS mean, round(avg(excess) / nullif(stddev_samp(excess) / sqrt(count(*)), 0), 4) AS t FROM k JOIN x USING (ticker, outcome, reason, entry_day) GROUP BY ALL""")
def ag40_gates(spark, d):
    """What became of the candidates that each gate let through or held back: one decision for a ticker, outcome and reason in HORIZON days, then mean excess and t by reason."""
    g = domain.cp33_gates(spark, d).select("trade_id", "reason", F.when(F.col("reason") == "ok", "bought").otherwise("skipped").alias("outcome"))
    x = intelligence._excess(spark, d).select("trade_id", "ticker", "entry_day", "excess").join(g, "trade_id")
    x = x.withColumn("key", F.concat_ws("|", "ticker", "outcome", "reason")).withColumn("at", F.unix_date("entry_day")).withColumn("at", F.col("at").cast("bigint"))
    once = ordered.cooldown(R.latest(x, ["key", "at"], [F.col("trade_id")]), "key", "at", HORIZON)
    n = F.count("*")
    return once.groupBy("outcome", "reason").agg(n.alias("n"), F.round(F.avg("excess"), 6).alias("mean"), F.round(F.try_divide(F.avg("excess"), F.stddev_samp("excess") / F.sqrt(n)), 4).alias("t"))


@query("""SELECT o_orderkey AS accession, CASE WHEN o_orderkey % 4 = 0 THEN 'H' WHEN o_orderkey % 4 = 1 THEN '?' ELSE o_orderstatus END AS code, CASE WHEN o_orderkey % 4 IN (1, 2, 3) THEN (o_orderkey % 90)::DOUBLE ELSE 0 END AS shares, CASE WHEN o_orderkey % 4 IN (2, 3) THEN 12.5 ELSE 0 END AS price,
  CASE WHEN o_orderkey % 4 IN (2, 3) THEN (o_orderkey % 90) * 12.5 ELSE 0 END AS total_value, 'Owner ' || o_custkey AS owner_name, o_custkey % 2 = 0 OR o_custkey % 3 = 0 AS is_director, o_custkey % 3 = 0 AS is_officer, o_custkey % 5 = 0 AS is_ten_percent_owner,
  CASE WHEN o_custkey % 3 = 0 THEN 'CFO' ELSE '' END AS officer_title, (1000 + o_orderkey % 7)::DOUBLE AS post_shares, CASE WHEN o_orderkey % 4 = 3 THEN 'I' ELSE 'D' END AS ownership FROM orders""")
def sc10_form4_data(spark, d):
    """One record for each ownership filing: its first transaction, all owners' flags, what is held afterwards."""
    k, c = "o_orderkey", "o_custkey"
    owner = lambda name, tags: f"'<reportingOwner><reportingOwnerId><rptOwnerName>', {name}, '</rptOwnerName></reportingOwnerId><reportingOwnerRelationship>', {tags}, '</reportingOwnerRelationship></reportingOwner>'"
    first = owner(f"'Owner ', {c}", f"CASE WHEN {c} % 2 = 0 THEN '<isDirector>1</isDirector>' ELSE '<isDirector>0</isDirector>' END, CASE WHEN {c} % 5 = 0 THEN '<isTenPercentOwner>true</isTenPercentOwner>' ELSE '' END")
    second = owner("'Second'", "'<isDirector>true</isDirector><isOfficer>1</isOfficer><officerTitle>CFO</officerTitle>'")
    post = f"'<postTransactionAmounts><sharesOwnedFollowingTransaction><value>', 1000 + {k} % 7, '</value></sharesOwnedFollowingTransaction></postTransactionAmounts>'"
    code = f"CASE WHEN {k} % 4 = 1 THEN '' ELSE concat('<transactionCoding><transactionCode>', o_orderstatus, '</transactionCode></transactionCoding>') END"
    price = f"CASE WHEN {k} % 4 = 1 THEN '' ELSE '<transactionPricePerShare><value>12.5</value></transactionPricePerShare>' END"
    nature = f"CASE WHEN {k} % 4 = 3 THEN '<ownershipNature><directOrIndirectOwnership><value>I</value></directOrIndirectOwnership></ownershipNature>' ELSE '' END"
    deal = f"'<nonDerivativeTransaction>', {code}, '<transactionAmounts><transactionShares><value>', {k} % 90, '</value></transactionShares>', {price}, '</transactionAmounts>', {post}, {nature}, '</nonDerivativeTransaction>'"
    later = "'<nonDerivativeTransaction><transactionCoding><transactionCode>Z</transactionCode></transactionCoding></nonDerivativeTransaction>'"
    table = f"CASE WHEN {k} % 4 = 0 THEN concat('<nonDerivativeTable><nonDerivativeHolding>', {post}, '</nonDerivativeHolding></nonDerivativeTable>') ELSE concat('<nonDerivativeTable>', {deal}, {later}, '</nonDerivativeTable>') END"
    xml = F.expr(f"concat('<ownershipDocument>', {first}, CASE WHEN {c} % 3 = 0 THEN concat({second}) ELSE '' END, {table}, '</ownershipDocument>')")
    return feeds.form4_data(load(spark, d, "orders").select(F.col(k).alias("accession"), xml.alias("xml")))


ROW_CAP, FIRST_WINDOW = 40, 15


@query(f"SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) <= {ROW_CAP}")
def sc18_calendar(spark, d):
    """A calendar from a service that gives at most ROW_CAP rows for a window of days: windows that are full are halved and asked for again, all windows of a round at once."""
    o = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")

    def answer(windows):
        """What the service would give: the first rows of each window."""
        days = windows.select("start", F.explode(F.sequence("start", "end")).alias("day"))
        w = Window.partitionBy("start").orderBy("day", "o_orderkey")
        return o.join(F.broadcast(days), "day").withColumn("k", F.row_number().over(w)).where(F.col("k") <= ROW_CAP).drop("k")

    span = o.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    rows, _ = feeds.paged_calendar(spark, answer, span["a"], span["b"], ROW_CAP, FIRST_WINDOW)
    return rows.select("day", "o_orderkey")


@query("""WITH b AS (SELECT l_suppkey, l_linenumber, l_orderkey % 3 AS batch, max(l_quantity) AS qty, max(l_orderkey) AS seen FROM lineitem GROUP BY ALL), o AS (SELECT *, lag(qty) OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY batch) AS before FROM b)
SELECT l_suppkey, l_linenumber, arg_max(qty, batch) AS qty, arg_max(seen, batch) FILTER (qty IS DISTINCT FROM before) AS seen FROM o GROUP BY ALL""")
def sc30_changed(spark, d):
    """Three batches into a table whose rows change only if their quantity does: a batch that says the same leaves the row, and its mark, as they are."""
    path = scratch.folder(spark, "changed")
    l = load(spark, d, "lineitem")  # noqa: E741
    b = l.groupBy("l_suppkey", "l_linenumber", (F.col("l_orderkey") % 3).alias("batch")).agg(F.max("l_quantity").alias("qty"), F.max("l_orderkey").alias("seen"))
    keys = ["l_suppkey", "l_linenumber"]
    for epoch in (0, 1, 1, 2):
        buckets.apply_changed(b.where(F.col("batch") == epoch).drop("batch"), path, epoch, keys, ["qty"], ["seen"])
    return buckets.read(spark, path, 2, b.drop("batch").schema)


# parts that follow each other in many orders are related
@query("""WITH e AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey GROUP BY ALL),
nm AS (SELECT p_partkey, lower(p_name || ' p' || p_partkey) AS name FROM part), eb AS (SELECT a AS p, b AS q, n FROM e UNION ALL SELECT b, a, n FROM e), es AS (SELECT p, q, sum(n) AS n FROM eb GROUP BY ALL HAVING sum(n) >= 1),
rl AS (SELECT x.name AS name, y.name AS other, n, row_number() OVER (PARTITION BY p ORDER BY n DESC, y.name) AS k FROM es JOIN nm x ON x.p_partkey = p JOIN nm y ON y.p_partkey = q QUALIFY k <= 5),
q AS (SELECT item_id AS query_id, 'about p' || (item_id * 7 + 3) || ', and (p' || (item_id * 3 + 1) || ') ok p' || (item_id * 7 + 3) AS text FROM benchmark),
w AS (SELECT query_id, pos, regexp_replace(lower(x), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') AS w, lower(text) AS low FROM (SELECT query_id, text, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS pos FROM q) WHERE strlen(x) >= 3),
h AS (SELECT query_id, pos, low, (SELECT min(name) FROM nm WHERE contains(name, w)) AS name FROM w WHERE w <> ''),
f AS (SELECT query_id, other, min(pos * 10 + k) AS at_ FROM h JOIN rl USING (name) WHERE NOT contains(low, other) GROUP BY query_id, other)
SELECT query_id, coalesce(string_agg(other, '; ' ORDER BY at_), '') AS added FROM q LEFT JOIN f USING (query_id) GROUP BY query_id""")
def jn31_graph_expansion(spark, d):
    """Queries expanded by what their words' entities are related to: the strongest five of each, in the order of the words, without what the query says itself."""
    l = load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    r = l.select("l_suppkey", "l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("b"))
    e = l.join(r, ["l_suppkey", "l_orderkey"]).where("l_linenumber < line and l_partkey <> b").groupBy(F.col("l_partkey").alias("a"), "b").agg(F.count("*").alias("n"))
    names = load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.lower(F.concat("p_name", F.lit(" p"), F.col("p_partkey").cast("string"))).alias("name"))
    both = R.both_ways(e, "a", "b").groupBy("node", "other").agg(F.sum("n").alias("strength"))
    i = F.col("item_id")
    q = load(spark, d, "benchmark").select(i.alias("query_id"), F.concat(F.lit("about p"), (i * 7 + 3).cast("string"), F.lit(", and (p"), (i * 3 + 1).cast("string"), F.lit(") ok p"), (i * 7 + 3).cast("string")).alias("text"))
    out = entities.graph_expanded(q, names, both.where("strength >= 1"), 5)
    return out.select("query_id", F.array_join("added", "; ").alias("added"))


@query("""WITH e AS (SELECT event_id, ts + to_days(CAST(event_id % 12 * 30 AS INTEGER)) AS ts FROM events), n AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM e)
SELECT event_id, CAST(hour(t) * 60 + minute(t) AS INTEGER) AS minutes, hour(t) * 60 + minute(t) < 570 AS pre_open, CAST(t AS DATE) AS local_day FROM n""")
def fn27_session_minutes(spark, d):
    """Minutes after midnight in New York, over the changes of the clock, and whether that is before the open."""
    ts = F.col("ts") + F.make_dt_interval((F.col("event_id") % 12 * 30).cast("int"))
    e = load(spark, d, "events").select("event_id", ts.cast("timestamp").alias("ts"))
    m = dates.session_minutes(F.col("ts"))
    return e.select("event_id", m.alias("minutes"), (m < 570).alias("pre_open"), F.to_date(F.from_utc_timestamp("ts", "America/New_York")).alias("local_day"))


BUDGET, TEXTS = 6000, 128


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, greatest(ceil(strlen(coalesce(text, '')) / 4)::BIGINT, 1) AS cost, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS i, conv_id % 8 AS feed FROM conversations),
r AS (SELECT feed, 0::BIGINT AS i, 0::BIGINT AS batch, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, NULL::BIGINT AS cost FROM t GROUP BY feed
UNION ALL SELECT r.feed, t.i, CASE WHEN fresh THEN batch + 1 ELSE batch END, CASE WHEN fresh THEN t.cost ELSE used + t.cost END, CASE WHEN fresh THEN 1 ELSE n + 1 END, t.conv_id, t.turn, t.cost
  FROM (SELECT r.*, r.n > 0 AND (r.used + t.cost > {BUDGET} OR r.n >= {TEXTS}) AS fresh FROM r JOIN t ON t.feed = r.feed AND t.i = r.i + 1) r JOIN t ON t.feed = r.feed AND t.i = r.i + 1)
SELECT conv_id, turn, cost AS tokens, batch FROM r WHERE i > 0""")
def fn40_token_batches(spark, d):
    """Texts of eight feeds in batches for one request each: under a budget of estimated tokens and at most so many texts; a larger text is a batch of its own."""
    c = load(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 8).alias("feed"), F.greatest(F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4), F.lit(1)).cast("bigint").alias("tokens"))
    c = c.withColumn("at", F.col("conv_id") * 1000000 + F.col("turn"))
    return ordered.token_batches(c, "feed", "at", "tokens", BUDGET, TEXTS).select("conv_id", "turn", "tokens", "batch")
