"""Queries of the composite domain operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import entries, ordered, signals
from tessera.operators import relational as R
from tessera.plans.catalog import query
from tessera.plans.views import AS_OF, BARS, EVERY, MENTIONS, STORIES, TRADES, bars, by_day, mentions, stories, today, trades
from tessera.session import load



@query(f"""WITH {MENTIONS}, t AS (SELECT DISTINCT entity_id, day FROM mentions WHERE sector = 'signup'), c AS (SELECT DISTINCT entity_id, day FROM mentions WHERE sector = 'error'),
p AS (SELECT t.entity_id, count(*) AS occurrences, avg(date_diff('day', t.day, c.day)) AS delay FROM t JOIN c ON c.entity_id = t.entity_id AND date_diff('day', t.day, c.day) BETWEEN 1 AND 7 GROUP BY 1), n AS (SELECT entity_id, count(*) AS triggers FROM t GROUP BY 1)
SELECT entity_id, occurrences, round(delay, 6) AS delay, round(least(1, occurrences / triggers * (1 / (1 + delay / 90))), 6) AS confidence FROM p JOIN n USING (entity_id)""")
def cp7_causal(spark, d):
    """Trigger-consequence pairs within a week of each entity, mean delay and confidence."""
    m = mentions(spark, d)
    t = m.where("sector = 'signup'").select("entity_id", "day").distinct()
    c = m.where("sector = 'error'").select("entity_id", F.col("day").alias("then")).distinct()
    p = R.interval_join(t, c, ["entity_id"], "day", "then", 1, 7).groupBy("entity_id").agg(F.count("*").alias("occurrences"), F.avg(F.date_diff("then", "day")).alias("delay"))
    n = t.groupBy("entity_id").agg(F.count("*").alias("triggers"))
    return p.join(n, "entity_id").select("entity_id", "occurrences", F.round("delay", 6).alias("delay"), F.round(F.least(F.lit(1.0), F.col("occurrences") / F.col("triggers") * (1 / (1 + F.col("delay") / 90))), 6).alias("confidence"))


@query(f"""WITH {MENTIONS}, s AS (SELECT entity_id, avg(sentiment) AS mean, stddev_pop(sentiment) AS sd FROM mentions GROUP BY 1 HAVING abs(avg(sentiment)) > 0.1)
SELECT s.entity_id, round(any_value(mean), 6) AS mean, round(any_value(sd), 6) AS sd, count(*) AS dissent FROM s JOIN mentions m ON m.entity_id = s.entity_id AND sign(m.sentiment) = -sign(s.mean) AND abs(m.sentiment) > 0.3 GROUP BY 1""")
def cp8_contrarian(spark, d):
    """Entities of clear mean tone with the mentions of opposite sign: both from one aggregate over two signs."""
    x = F.col("sentiment")
    a = mentions(spark, d).groupBy("entity_id").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count_if(x > 0.3).alias("up"), F.count_if(x < -0.3).alias("down"))
    return a.where("abs(mean) > 0.1").select("entity_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.when(F.col("mean") > 0, F.col("down")).otherwise(F.col("up")).alias("dissent")).where("dissent > 0")


@query(f"""WITH {MENTIONS}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-20', DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE) AS as_of)
SELECT entity_id, as_of, count(*) FILTER (WHERE day >= as_of - 7) AS w7, count(*) AS w30 FROM days JOIN mentions ON day <= as_of AND day >= as_of - 30 GROUP BY ALL""")
def cp11_backfill(spark, d):
    """Recompute for every day of a range: daily counts first, each then spread over the days that look back on it."""
    daily = mentions(spark, d).groupBy("entity_id", "day").agg(F.count("*").alias("n"))
    start = F.greatest(F.col("day"), F.lit("2024-01-20").cast("date"))
    end = F.least(F.date_add("day", 30), today())
    spread = daily.where(start <= end).withColumn("as_of", F.explode(F.sequence(start, end)))
    return spread.groupBy("entity_id", "as_of").agg(F.coalesce(F.sum(F.when(F.col("day") >= F.date_sub(F.col("as_of"), 7), F.col("n"))), F.lit(0)).alias("w7"), F.sum("n").alias("w30"))


@query(f"""WITH {MENTIONS}, a AS (SELECT entity_id, avg(CASE WHEN ts >= TIMESTAMP '2024-01-30 00:00:00' THEN sentiment END) AS r, coalesce(avg(CASE WHEN ts < TIMESTAMP '2024-01-30 00:00:00' THEN sentiment END), 0.24) AS b FROM mentions GROUP BY 1)
SELECT entity_id, round(r - b, 6) AS surprise FROM a WHERE abs(r - b) >= 0.5""")
def cp13_tone_surprise(spark, d):
    late = F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    a = mentions(spark, d).groupBy("entity_id").agg(F.avg(F.when(late, F.col("sentiment"))).alias("r"), F.coalesce(F.avg(F.when(~late, F.col("sentiment"))), F.lit(0.24)).alias("b"))
    return a.where("abs(r - b) >= 0.5").select("entity_id", F.round(F.col("r") - F.col("b"), 6).alias("surprise"))


@query(f"WITH {MENTIONS} SELECT entity_id, day, sum(k) AS total, count(*) AS buys FROM mentions WHERE sector = 'purchase' AND k > 20 GROUP BY ALL HAVING sum(k) >= 200")
def cp14_buys(spark, d):
    return mentions(spark, d).where("sector = 'purchase' and k > 20").groupBy("entity_id", "day").agg(F.sum("k").alias("total"), F.count("*").alias("buys")).where("total >= 200")


def _scenarios(spark, d):
    b = bars(spark, d).withColumn("score", F.when(F.col("close") > F.lag("close", 2).over(by_day()), F.round(F.col("close") / F.lag("close", 2).over(by_day()) - 1, 9)))
    sets = spark.createDataFrame([("base",), ("tight",)], "scenario string")
    return b.select("day", "ticker", "close", "score").crossJoin(F.broadcast(sets))


@query()
def cp16_backtest(spark, d):
    """Calendar walk with shared capital; one group for each scenario."""
    s = _scenarios(spark, d).where("scenario = 'base'").withColumnRenamed("scenario", "group_")
    return ordered.simulate(s, "group_", 5, 100_000.0, 0.10, 0.15, 6).withColumn("ret", F.round("ret", 6))


@query()
def cp18_what_if(spark, d):
    """The same walk for a baseline and a variant; closed trades only, without those closed by the end of the data."""
    s = _scenarios(spark, d)
    runs = [ordered.simulate(s.where(f"scenario = '{n}'").withColumnRenamed("scenario", "group_"), "group_", 5, 100_000.0, stop, 0.15, 6) for n, stop in (("base", 0.10), ("tight", 0.05))]
    done = runs[0].unionByName(runs[1]).where("reason <> 'data_end'")
    return done.groupBy("group").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"))


def _replayed(spark, d):
    """Signals of the replay: momentum, minus a tenth for net selling, plus a bonus where three or more tickers of a brand signal on one day; none while the market lies under its ten-bar mean."""
    b = bars(spark, d)
    market = b.groupBy("day").agg(F.avg("close").alias("m"))
    calm = market.withColumn("mean", F.avg("m").over(Window.orderBy("day").rowsBetween(-9, 0))).select("day", (F.col("m") >= F.col("mean")).alias("calm"))  # one row a day
    flow = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ticker"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("day")).agg(F.sum(F.expr("CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END")).alias("net"))
    brand = load(spark, d, "part").select(F.col("p_partkey").alias("ticker"), "p_brand")
    x = b.withColumn("rise", F.col("close") / F.lag("close", 2).over(by_day()) - 1).join(flow, ["ticker", "day"]).join(calm, "day").join(brand, "ticker", "left")
    signal = F.when((F.col("rise") > 0) & F.col("calm"), F.col("rise") - F.when(F.col("net") < 0, 0.1).otherwise(0.0))
    x = x.withColumn("raw", F.when(signal > 0, signal))
    together = F.count("raw").over(Window.partitionBy("p_brand", "day"))
    return x.select(F.lit("replay").alias("group_"), "day", "ticker", "close", F.when(F.col("raw").isNotNull(), F.round(F.col("raw") + F.when(together >= 3, 0.05).otherwise(0.0), 9)).alias("score"))


@query()
def cp19_replay(spark, d):
    """Historical replay with net selling, cluster bonus, regime stop and costs."""
    return ordered.simulate(_replayed(spark, d), "group_", 5, 100_000.0, 0.10, 0.15, 6, 0.001).withColumn("ret", F.round("ret", 6))


@query()
def cp45_proposal(spark, d):
    """What a proposed strategy would have changed over the full range of signals: trades, mean return and win rate against the present one."""
    s = _scenarios(spark, d)
    run = lambda n, slots, target: ordered.simulate(s.where(f"scenario = '{n}'").withColumnRenamed("scenario", "group_"), "group_", slots, 100_000.0, 0.10, target, 6).where("reason <> 'data_end'")
    both = run("base", 5, 0.15).unionByName(run("tight", 4, 0.25))
    pick = lambda n, x: F.when(F.col("group") == n, x)
    won = F.when(F.col("ret") > 0, 1.0).otherwise(0.0)
    delta = lambda x: F.round(F.avg(pick("tight", x)) - F.avg(pick("base", x)), 6)
    return both.agg((F.count(pick("tight", F.lit(1))) - F.count(pick("base", F.lit(1)))).alias("trades"), delta(F.col("ret")).alias("mean"), delta(won).alias("win_rate"))


EVENT = f"""{BARS}, i AS (SELECT day, avg(open) AS o, avg(close) AS c FROM bars GROUP BY day), f AS (SELECT ticker, day, close / lag(close) OVER w - 1 AS ret, lead(open) OVER w AS eo, lead(close, 3) OVER w AS xc, lead(day) OVER w AS ed, lead(day, 3) OVER w AS xd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day)),
e AS (SELECT f.ticker, f.day, (f.xc / f.eo - 1) - (x.c / a.o - 1) - 0.002 AS excess FROM f JOIN i a ON a.day = f.ed JOIN i x ON x.day = f.xd WHERE f.ret >= 0.1)"""


def _event_study(spark, d):
    """Enter at the open after the event, leave three bars later at the close, against the index, minus costs."""
    b = bars(spark, d)
    index = b.groupBy("day").agg(F.avg("open").alias("o"), F.avg("close").alias("c"))
    f = b.select("ticker", "day", (F.col("close") / F.lag("close").over(by_day()) - 1).alias("ret"), F.lead("open").over(by_day()).alias("eo"), F.lead("close", 3).over(by_day()).alias("xc"), F.lead("day").over(by_day()).alias("ed"), F.lead("day", 3).over(by_day()).alias("xd")).where("ret >= 0.1")
    f = f.join(index.select(F.col("day").alias("ed"), "o"), "ed").join(index.select(F.col("day").alias("xd"), "c"), "xd")
    return f.select("ticker", "day", ((F.col("xc") / F.col("eo") - 1) - (F.col("c") / F.col("o") - 1) - 0.002).alias("excess"))


@query(f"WITH {EVENT}, m AS (SELECT day, avg(excess) AS x, count(*) AS n FROM e GROUP BY day) SELECT count(*) AS days, sum(n)::BIGINT AS events, round(avg(x), 6) AS mean, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS t FROM m")
def cp20_event_study(spark, d):
    m = _event_study(spark, d).groupBy("day").agg(F.avg("excess").alias("x"), F.count("*").alias("n"))
    return m.agg(F.count("*").alias("days"), F.sum("n").alias("events"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.try_divide(F.avg("x"), F.stddev_samp("x") / F.sqrt(F.count("*"))), 4).alias("t"))


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM bars), e AS (SELECT ticker, i, close AS p FROM n WHERE i % 12 = 1),
j AS (SELECT e.ticker, e.i, p, n.i - e.i AS k, n.low, n.close, greatest(p, coalesce(max(n.high) OVER (PARTITION BY e.ticker, e.i ORDER BY n.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p)) AS top FROM e JOIN n ON n.ticker = e.ticker AND n.i > e.i AND n.i <= e.i + 12),
h AS (SELECT ticker, i, p, k, close, CASE WHEN low <= top * 0.8 THEN k END AS hit, top * 0.8 AS stop FROM j)
SELECT ticker, i, min(hit) AS bar, round(coalesce(arg_min(stop, hit), arg_max(close, k)) / any_value(p) - 1, 6) AS ret FROM h GROUP BY ALL""")
def cp21_exits(spark, d):
    """Trailing stop at 80 % of the highest earlier price, else the last close, of an entry at every EVERY-th bar: running maxima without the current bar."""
    b = bars(spark, d).withColumn("i", F.row_number().over(by_day()).cast("bigint"))
    e = b.where(F.col("i") % EVERY == 1).select("ticker", "i", F.col("close").alias("p"))
    x = R.following(e, b, "ticker", "i", 12, ["high", "low", "close"]).withColumnRenamed("after", "k")
    w = Window.partitionBy("ticker", "i").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("stop", F.greatest(F.col("p"), F.coalesce(F.max("high").over(w), F.col("p"))) * 0.8)
    hit = F.when(F.col("low") <= F.col("stop"), F.col("k"))
    g = x.groupBy("ticker", "i").agg(F.min(hit).alias("bar"), F.min_by("stop", hit).alias("s"), F.max_by("close", "k").alias("c"), F.first("p").alias("p"))
    return g.select("ticker", "i", "bar", F.round(F.coalesce("s", "c") / F.col("p") - 1, 6).alias("ret"))


@query(f"""WITH {BARS}, g AS (SELECT * FROM (VALUES (2), (4), (6)) v(h)), r AS (SELECT ticker, day, lead(close, 2) OVER w / close - 1 AS r2, lead(close, 4) OVER w / close - 1 AS r4, lead(close, 6) OVER w / close - 1 AS r6 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day))
SELECT h, CASE WHEN day < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS period, round(avg(CASE h WHEN 2 THEN r2 WHEN 4 THEN r4 ELSE r6 END), 6) AS mean FROM r, g GROUP BY ALL""")
def cp22_grid(spark, d):
    """Holding periods by train and test: all leads in one window, then unpivoted."""
    hs = (2, 4, 6)
    r = bars(spark, d).select("day", *[(F.lead("close", h).over(by_day()) / F.col("close") - 1).alias(str(h)) for h in hs])
    u = r.unpivot(["day"], [str(h) for h in hs], "h", "ret").withColumn("period", F.when(F.col("day") < F.lit("1999-01-01").cast("date"), "train").otherwise("test"))
    return u.groupBy(F.col("h").cast("int").alias("h"), "period").agg(F.round(F.avg("ret"), 6).alias("mean"))


GATE = f"""{TRADES}, a AS (SELECT count(*) AS n, date_diff('day', min(entry_day), max(exit_day)) AS days, avg(pnl / invested) / (stddev_samp(pnl / invested) / sqrt(count(*))) AS t, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / -sum(CASE WHEN pnl < 0 THEN pnl END) AS pf FROM trades)"""


@query(f"""WITH {BARS}, p AS (SELECT ticker, day AS made, close AS base, day + 95 AS due FROM bars WHERE month(day) = 3) SELECT p.ticker, p.made, CASE WHEN b.close >= base * 1.05 THEN 'validated' WHEN b.close >= base THEN 'partial' ELSE 'failed' END AS outcome FROM p ASOF JOIN bars b ON b.ticker = p.ticker AND p.due >= b.day""")
def cp29_resolution(spark, d):
    b = bars(spark, d)
    p = b.where("month(day) = 3").select("ticker", F.col("day").alias("made"), F.col("close").alias("base"), F.date_add("day", 95).alias("due"))
    x = R.as_of(p, b, "ticker", "due", "day", ["close"])
    return x.select("ticker", "made", F.when(F.col("asof_close") >= F.col("base") * 1.05, "validated").when(F.col("asof_close") >= F.col("base"), "partial").otherwise("failed").alias("outcome"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '2000-01-01' THEN 'expired' ELSE o_orderstatus END AS status FROM orders")
def cp30_expiry(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.when((F.col("o_orderstatus") != "F") & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")), "expired").otherwise(F.col("o_orderstatus")).alias("status"))


@query(f"""WITH {MENTIONS}, n AS (SELECT day, count(*) AS n FROM mentions GROUP BY day), p AS (SELECT entity_id, min(day) AS opened, arg_min(sentiment, mention_id) AS original FROM mentions GROUP BY entity_id),
g AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM mentions), (SELECT max(day) FROM mentions) + 7, INTERVAL 1 DAY)) AS DATE) AS as_of),
h AS (SELECT as_of, coalesce(sum(n) FILTER (day >= as_of - {signals.STALE}), 0) AS recent, list_sort(list(n)) AS ns FROM g JOIN n ON day BETWEEN as_of - {signals.NORMAL} AND as_of GROUP BY as_of),
d AS (SELECT entity_id, day, arg_max(sentiment, mention_id) AS score FROM mentions GROUP BY ALL),
x AS (SELECT p.entity_id, as_of, original, recent >= ns[len(ns) // 2 + 1] * {signals.HEALTHY} AS healthy FROM p JOIN h ON as_of >= opened),
y AS (SELECT x.*, CASE WHEN as_of - d.day <= {signals.STALE} THEN score END AS latest FROM x ASOF LEFT JOIN d ON d.entity_id = x.entity_id AND as_of >= d.day)
SELECT entity_id, as_of, round(latest, 6) AS latest, healthy, healthy AND coalesce(latest, 0) < greatest({signals.LEFT} * original, {signals.FLOOR}) AS decayed FROM y""")
def cp31_decay(spark, d):
    """Every entity on every day since it was opened, and a week beyond the last reading: there the source is silent, and nothing is concluded."""
    m = mentions(spark, d).select(F.col("entity_id").alias("key"), "day", F.col("sentiment").alias("score"), F.col("mention_id").alias("id"))
    opened = m.groupBy("key").agg(F.min("day").alias("opened"), F.min_by("score", "id").alias("original"))
    end = m.agg(F.max("day").alias("end"))  # one row
    positions = opened.crossJoin(F.broadcast(end)).select("key", "original", F.explode(F.sequence("opened", F.date_add("end", 7))).alias("as_of"))
    out = signals.decay(m, positions)
    return out.select(F.col("key").alias("entity_id"), "as_of", F.round("latest", 6).alias("latest"), "healthy", "decayed")


DECIDE = "CASE WHEN ret <= -0.05 THEN 'hard_stop' WHEN ret <= -0.02 THEN 'trail' WHEN ret >= 0.05 AND fills >= 3 THEN 'half' WHEN held > 100 THEN 'max_hold' ELSE 'hold' END"


@query(f"WITH {TRADES}, t AS (SELECT trade_id, pnl / invested AS ret, fills, date_diff('day', entry_day, exit_day) AS held FROM trades) SELECT trade_id, {DECIDE} AS decision FROM t")
def cp32_decision(spark, d):
    """Exit precedence: hard stop, trail, partial target, longest hold, else hold."""
    t = trades(spark, d).select("trade_id", F.expr("pnl / invested").alias("ret"), "fills", F.date_diff("exit_day", "entry_day").alias("held"))
    return t.select("trade_id", F.expr(DECIDE).alias("decision"))


#: Orders stand for candidates and accounts for runs; bars are monthly, so the spans in bars are short.
ENTRY = entries.Rules(volume=20_000.0, volume_bars=4, atr=0.25, atr_bars=5)

CANDIDATES = f"""{TRADES}, {BARS}, br AS (SELECT ticker, day, close, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr, close * volume AS dollars, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day)),
bf AS (SELECT ticker, day, close AS last, CASE WHEN k >= {ENTRY.volume_bars} THEN avg(dollars) OVER (PARTITION BY ticker ORDER BY day ROWS {ENTRY.volume_bars - 1} PRECEDING) END AS adv,
  CASE WHEN k > {ENTRY.atr_bars} THEN avg(tr) OVER (PARTITION BY ticker ORDER BY day ROWS {ENTRY.atr_bars - 1} PRECEDING) / nullif(close, 0) END AS atr_pct FROM br),
ix AS (SELECT day, avg(close) AS c FROM bars GROUP BY day), rg AS (SELECT day, CASE WHEN c < avg(c) OVER (ORDER BY day ROWS 2 PRECEDING) THEN 0.5 ELSE 1.0 END AS regime FROM ix),
hd AS (SELECT o_custkey AS account, l_partkey AS ticker, CAST(o_orderdate AS DATE) AS day, sum(l_extendedprice) AS held FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
hs AS (SELECT account, ticker, day, sum(held) OVER (PARTITION BY account, ticker ORDER BY day) AS held FROM hd),
cd AS (SELECT t.trade_id, t.account, t.entry_day AS day, t.ticker, o_totalprice / 300000.0 AS score, o_orderpriority = '1-URGENT' AS short, (p_size - 4) * 400000.0 AS insider_usd, p_brand <> 'Brand#7' AS eligible,
  CAST(date_trunc('quarter', t.entry_day) AS DATE) + CAST(t.ticker % 91 AS INTEGER) AS report, bf.last, bf.adv, bf.atr_pct, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE coalesce(regime, 1.0) END AS unit,
  coalesce(hs.held, 0) AS holding, status = 'P' AND o_orderpriority = '4-NOT SPECIFIED' AS open_order, c_mktsegment <> 'BUILDING' AS can_short, p_size % 3 <> 0 AS easy, p_type AS industry,
  20000 + 10 * greatest(c_acctbal, 0) AS equity, 3 * c_acctbal AS cash, CAST(33 + t.account % 8 AS INTEGER) AS n_open, (20000 + 10 * greatest(c_acctbal, 0)) * 0.01 * (t.account % 11) AS open_risk, (20000 + 10 * greatest(c_acctbal, 0)) * 0.07 * (t.account % 5) AS held
  FROM trades t JOIN orders ON o_orderkey = t.trade_id JOIN customer ON c_custkey = t.account JOIN part ON p_partkey = t.ticker LEFT JOIN rg ON rg.day = date_trunc('month', t.entry_day)
  ASOF LEFT JOIN bf ON bf.ticker = t.ticker AND date_trunc('month', t.entry_day) > bf.day ASOF LEFT JOIN hs ON hs.account = t.account AND hs.ticker = t.ticker AND t.entry_day > hs.day)"""


def _candidates(spark, d):
    """Every order as a candidate on its day, with the last full month's bars, the account's book and what it held of the ticker before."""
    b = bars(spark, d, True)
    features = entries.bar_features(b, ENTRY)
    months = Window.partitionBy(F.year("day") * 0).orderBy("day").rowsBetween(-2, 0)  # the index has one row for each month at any scale
    index = b.groupBy("day").agg(F.avg("close").alias("c"))
    regime = index.select(F.col("day").alias("month"), F.when(F.col("c") < F.avg("c").over(months), 0.5).otherwise(1.0).alias("regime"))
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")  # noqa: E741
    lines = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("account"), F.col("l_partkey").alias("ticker"), F.unix_date(F.to_date("o_orderdate")).alias("at"), F.col("l_extendedprice").alias("held"))
    t = trades(spark, d).select("trade_id", "account", F.col("entry_day").alias("day"), "ticker", "status", F.trunc("entry_day", "month").alias("month"))
    # what an account held of a ticker before the day: one shuffle of narrow rows; most have held nothing and have no row
    asked = t.select("account", "ticker", F.unix_date("day").alias("at"), F.lit(None).cast("double").alias("held"), "trade_id")
    before = Window.partitionBy("account", "ticker").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    holdings = lines.withColumn("trade_id", F.lit(None).cast("bigint")).unionByName(asked).withColumn("holding", F.sum("held").over(before)).where("trade_id is not null and holding is not null").select("trade_id", "holding")
    t = t.join(holdings, "trade_id", "left")
    t = t.join(o.select(F.col("o_orderkey").alias("trade_id"), "o_totalprice", "o_orderpriority"), "trade_id")
    t = t.join(load(spark, d, "customer").select(F.col("c_custkey").alias("account"), "c_acctbal", "c_mktsegment"), "account")
    t = t.join(load(spark, d, "part").select(F.col("p_partkey").alias("ticker"), "p_size", "p_brand", F.col("p_type").alias("industry")), "ticker").join(F.broadcast(regime), "month", "left")
    # the last bars before the month, of the ticker's list: it has one entry a month and lies where the lines were shuffled to, so bars are not shuffled again
    known = F.array_max(F.filter("bars", lambda x: x["day"] < F.col("month")))
    listed = features.groupBy("ticker").agg(F.collect_list(F.struct("day", "last", "adv", "atr_pct")).alias("bars"))
    t = t.join(listed, "ticker", "left").withColumn("known", known).select("*", "known.last", "known.adv", "known.atr_pct").drop("bars", "known")
    equity = 20000 + 10 * F.greatest("c_acctbal", F.lit(0.0))
    short = F.col("o_orderpriority") == "1-URGENT"
    return t.select(
        "trade_id", "account", "day", "ticker", (F.col("o_totalprice") / 300000.0).alias("score"), short.alias("short"), ((F.col("p_size") - 4) * 400000.0).alias("insider_usd"), (F.col("p_brand") != "Brand#7").alias("eligible"),
        F.date_add(F.to_date(F.date_trunc("quarter", "day")), (F.col("ticker") % 91).cast("int")).alias("report"), "last", "adv", "atr_pct", F.when(short, 1.0).otherwise(F.coalesce("regime", F.lit(1.0))).alias("unit"),
        F.coalesce("holding", F.lit(0.0)).alias("holding"), ((F.col("status") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")).alias("open_order"), (F.col("c_mktsegment") != "BUILDING").alias("can_short"),
        (F.col("p_size") % 3 != 0).alias("easy"), "industry", equity.alias("equity"), (3 * F.col("c_acctbal")).alias("cash"), (33 + F.col("account") % 8).cast("int").alias("n_open"),
        (equity * 0.01 * (F.col("account") % 11)).alias("open_risk"), (equity * 0.07 * (F.col("account") % 5)).alias("held"),
    )


_TIER = "CASE WHEN score > 0.6 THEN 8.0 WHEN score > 0.45 THEN 5.0 ELSE 2.0 END"
_BLACKOUT = f"report >= day AND len(list_filter(range(1, greatest(date_diff('day', day, report), 0) + 1), lambda k: isodow(day + k::INTEGER) < 6)) <= {ENTRY.blackout_days}"


# the run is a recursion over the ranks of all accounts at once; its state is the book, with the list of what was bought by industry
@query(f"""WITH RECURSIVE {CANDIDATES}, sz AS (SELECT *, least(greatest(equity * {_TIER} / 100, {ENTRY.floor}), {ENTRY.order_cap}, cash) AS sized, least(greatest({ENTRY.stop_atr} * atr_pct, {ENTRY.least_stop}), {ENTRY.most_stop}) AS stop, row_number() OVER (PARTITION BY account ORDER BY score DESC, trade_id) AS rank FROM cd),
nt AS (SELECT *, CASE WHEN cash >= {ENTRY.floor} AND sized >= {ENTRY.floor} THEN sized * unit END AS notional FROM sz),
gt AS (SELECT *, CASE WHEN NOT short AND insider_usd < {ENTRY.insider_veto} THEN 'insider_selling' WHEN NOT eligible THEN 'universe' END AS early,
  CASE WHEN {_BLACKOUT} THEN 'earnings' WHEN last IS NULL THEN 'no_bars' WHEN adv IS NULL OR adv < {ENTRY.volume} OR last < {ENTRY.price} THEN 'too_thin' WHEN atr_pct IS NULL THEN 'new_listing' WHEN atr_pct < {ENTRY.atr} THEN 'too_calm'
    WHEN notional IS NULL THEN 'no_cash' WHEN holding > 0 THEN 'untracked_holding' WHEN least(notional, greatest(equity * {ENTRY.ticker_cap} - holding, 0)) < {ENTRY.floor} THEN 'ticker_cap' END AS late FROM nt),
rn AS (SELECT account, 0 AS rank, any_value(n_open) AS n_open, any_value(cash)::DOUBLE AS cash, any_value(open_risk)::DOUBLE AS risk, false AS stopped, []::STRUCT(i VARCHAR, v DOUBLE)[] AS bought, NULL::BIGINT AS trade_id, NULL::VARCHAR AS reason, 0::BIGINT AS shares, 0::DOUBLE AS dollars FROM cd GROUP BY account
UNION ALL SELECT account, rank, CASE WHEN reason = 'ok' THEN n_open + 1 ELSE n_open END, CASE WHEN reason = 'ok' THEN cash - want ELSE cash END, CASE WHEN reason = 'ok' THEN risk + want * stop ELSE risk END, stopped OR reason = 'max_positions',
  CASE WHEN reason = 'ok' THEN list_append(bought, {{'i': industry, 'v': cost}}) ELSE bought END, trade_id, reason, CASE WHEN reason = 'ok' THEN qty ELSE 0 END, CASE WHEN reason = 'ok' THEN cost ELSE 0 END
  FROM (SELECT *, CASE WHEN stopped THEN 'max_positions' WHEN early IS NOT NULL THEN early WHEN n_open >= {ENTRY.positions} THEN 'max_positions' WHEN late IS NOT NULL THEN late WHEN want < {ENTRY.floor} THEN 'no_risk_room' WHEN open_order THEN 'open_order'
      WHEN last < {ENTRY.price} OR qty = 0 THEN 'price' WHEN short AND NOT (can_short AND easy) THEN 'not_shortable' WHEN held + coalesce(list_sum(list_transform(list_filter(bought, lambda x: x.i = industry), lambda x: x.v)), 0) + cost > equity * {ENTRY.sector} THEN 'sector_full' ELSE 'ok' END AS reason
    FROM (SELECT *, floor(want / last)::BIGINT AS qty, floor(want / last) * last AS cost FROM (SELECT rn.account, gt.rank, rn.n_open, rn.cash, rn.risk, rn.stopped, rn.bought, gt.trade_id, early, late, stop, last, open_order, short, can_short, easy, industry, gt.held, equity,
      least(least(equity * {ENTRY.risk} * unit, greatest(equity * {ENTRY.heat} - greatest(rn.risk, 0), 0)) / stop, equity * {ENTRY.ticker_cap}, greatest(rn.cash, 0)) AS want FROM rn JOIN gt ON gt.account = rn.account AND gt.rank = rn.rank + 1))))
SELECT trade_id, account, reason, shares, round(dollars, 4) AS dollars FROM rn WHERE rank > 0""")
def cp33_gates(spark, d):
    """The first failing gate names the reason; positions, risk, cash and exposure by industry run on within an account."""
    c = _candidates(spark, d).withColumn("down", -F.col("score"))
    return entries.admit(c, "account", ["down", "trade_id"], ENTRY).select("trade_id", "account", "reason", "shares", F.round("dollars", 4).alias("dollars"))


@query("SELECT l_orderkey AS trade, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) END), 4) AS realised, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS open_qty FROM lineitem GROUP BY 1")
def cp34_ledger(spark, d):
    sold = F.col("l_returnflag") == "R"
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trade")).agg(F.round(F.sum(F.when(sold, F.expr("l_extendedprice * (1 - l_discount)"))), 4).alias("realised"), F.sum(F.when(~sold, F.col("l_quantity")).otherwise(0.0)).alias("open_qty"))


@query(f"WITH {STORIES} SELECT source_name, max(day) AS last, date_diff('day', max(day), DATE '2024-03-05') > 5 AS stale FROM stories GROUP BY source_name")
def cp40_stale_sources(spark, d):
    return stories(spark, d).groupBy("source_name").agg(F.max("day").alias("last"), (F.date_diff(F.lit("2024-03-05").cast("date"), F.max("day")) > 5).alias("stale"))


@query(f"WITH {MENTIONS} SELECT entity_id, round(arg_min(sentiment, mention_id), 6) AS anchored FROM mentions WHERE day >= DATE '2024-01-15' GROUP BY 1")
def cp42_reanchor(spark, d):
    return mentions(spark, d).where("day >= date'2024-01-15'").groupBy("entity_id").agg(F.round(F.min_by("sentiment", "mention_id"), 6).alias("anchored"))


@query(f"""WITH RECURSIVE {TRADES}, n AS (SELECT pnl / invested AS ret, (trade_id % 13) / 12.0 AS score, row_number() OVER (ORDER BY trade_id) AS i FROM trades), z AS (SELECT count(*) AS n FROM n),
pw AS (SELECT 1 AS k, 2654435761::HUGEINT % n AS a, n FROM z UNION ALL SELECT k + 1, a * 2654435761 % n, n FROM pw WHERE k < 100),
p AS (SELECT k, i, score, ((i - 1) * a + k) % n + 1 AS j FROM n, pw), s AS (SELECT k, sum(p.score * b.ret) AS v FROM p JOIN n b ON b.i = p.j GROUP BY k), r AS (SELECT sum(score * ret) AS v FROM n)
SELECT round((SELECT v FROM r), 6) AS real, count_if(s.v >= (SELECT v FROM r)) AS above, round(avg(CASE WHEN s.v >= (SELECT v FROM r) THEN 1.0 ELSE 0 END), 6) AS p FROM s""")
def ag50_permutation(spark, d):
    """Permutation test with an arithmetic shuffle: replicate k pairs the score of row i with the return of row (i * P^k + k) mod n."""
    t = trades(spark, d).select("trade_id", F.expr("pnl / invested").alias("ret"), (F.col("trade_id") % 13 / 12.0).alias("score"))
    n = R.dense_index(t, "trade_id").select("i", "ret", "score")
    s = R.permuted_sums(n, "i", "score", "ret", 100).select(F.col("total").alias("v"))
    real = n.agg(F.sum(F.col("score") * F.col("ret")).alias("r"))
    return s.crossJoin(F.broadcast(real)).agg(F.round(F.first("r"), 6).alias("real"), F.count_if(F.col("v") >= F.col("r")).alias("above"), F.round(F.avg(F.when(F.col("v") >= F.col("r"), 1.0).otherwise(0.0)), 6).alias("p"))


@query(f"""WITH {TRADES}, w AS (SELECT *, date_diff('day', DATE '1995-01-01', entry_day) // 60 AS win FROM trades) SELECT win, CASE WHEN win % 2 = 0 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(pnl / invested), 6) AS mean FROM w GROUP BY ALL""")
def ag51_walk_forward(spark, d):
    w = trades(spark, d).withColumn("win", F.floor(F.date_diff("entry_day", F.lit("1995-01-01").cast("date")) / 60))
    return w.groupBy("win", F.when(F.col("win") % 2 == 0, "train").otherwise("test").alias("part")).agg(F.count("*").alias("n"), F.round(F.avg(F.expr("pnl / invested")), 6).alias("mean"))


@query(f"""WITH {STORIES} SELECT source_name, count(*) AS offered, count_if(importance >= 7) AS kept, count(*) >= 20 AND count_if(importance >= 7) < 0.25 * count(*) AS buried FROM stories GROUP BY 1""")
def ag53_news_board(spark, d):
    kept = F.count_if(F.col("importance") >= 7)
    return stories(spark, d).groupBy("source_name").agg(F.count("*").alias("offered"), kept.alias("kept"), ((F.count("*") >= 20) & (kept < 0.25 * F.count("*"))).alias("buried"))


@query(f"""WITH {TRADES} SELECT CAST(date_trunc('week', exit_day) AS DATE) AS week, count_if(status = 'F') AS sold, count_if(status = 'O') AS bought, count_if(status = 'P') AS held, count(DISTINCT ticker) AS tickers FROM trades GROUP BY 1""")
def ag52_scoreboard(spark, d):
    n = lambda s: F.count_if(F.col("status") == s)
    return trades(spark, d).groupBy(F.to_date(F.date_trunc("week", "exit_day")).alias("week")).agg(n("F").alias("sold"), n("O").alias("bought"), n("P").alias("held"), F.count_distinct("ticker").alias("tickers"))
