"""Queries of aggregation operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scoring
from tessera.operators import relational as R
from tessera.plans.catalog import query
from tessera.plans.views import AS_OF, BARS, MENTIONS, STORIES, TRADES, bars, mentions, stories, today, trades
from tessera.session import load

TRAJECTORY = "CASE WHEN w30 = 0 THEN 'dormant' WHEN w7 >= 20 AND acc >= 1.5 THEN 'hot' WHEN acc >= 1.2 THEN 'rising' WHEN acc < 0.5 THEN 'fading' ELSE 'steady' END"


@query(f"""WITH {MENTIONS}, c AS (SELECT entity_id, sector, count(*) FILTER (WHERE day >= DATE '{AS_OF}' - 7) AS w7, count(*) FILTER (WHERE day >= DATE '{AS_OF}' - 30) AS w30,
 count(*) AS w90, count(DISTINCT day) AS days FROM mentions WHERE day BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}' GROUP BY ALL),
a AS (SELECT *, CASE WHEN w30 > 0 THEN (w7 / 7.0) / (w30 / 30.0) WHEN w7 > 0 THEN 10.0 ELSE 0.0 END AS acc FROM c)
SELECT entity_id, sector, w7, w30, w90, days, round(acc, 6) AS acceleration, {TRAJECTORY} AS trajectory FROM a""")
def ag1_window_counts(spark, d):
    """Flagship: 7/30/90-day counts, acceleration and trajectory for each (topic, sector), in one pass."""
    within = lambda k: F.count_if(F.col("day") >= F.date_sub(today(), k))
    c = mentions(spark, d).where(F.col("day").between(F.date_sub(today(), 90), today())).groupBy("entity_id", "sector").agg(
        within(7).alias("w7"), within(30).alias("w30"), F.count("*").alias("w90"), F.count_distinct("day").alias("days"))
    c = c.withColumn("acc", scoring.acceleration(F.col("w7"), F.col("w30")))
    return c.select("entity_id", "sector", "w7", "w30", "w90", "days", F.round("acc", 6).alias("acceleration"), F.expr(TRAJECTORY).alias("trajectory"))


@query(f"WITH {MENTIONS} SELECT sector, count(DISTINCT entity_id) AS entities, count(DISTINCT day) AS days FROM mentions GROUP BY sector")
def ag2_count_distinct(spark, d):
    return mentions(spark, d).groupBy("sector").agg(F.count_distinct("entity_id").alias("entities"), F.count_distinct("day").alias("days"))


@query(f"WITH {MENTIONS} SELECT entity_id, sum(CASE WHEN sector = 'purchase' THEN k ELSE 0 END) AS bought, max(CASE WHEN day >= DATE '{AS_OF}' - 14 THEN k END) AS severity FROM mentions GROUP BY entity_id")
def ag3_json_sum_max(spark, d):
    return mentions(spark, d).groupBy("entity_id").agg(F.sum(F.when(F.col("sector") == "purchase", F.col("k")).otherwise(0)).alias("bought"), F.max(F.when(F.col("day") >= F.date_sub(today(), 14), F.col("k"))).alias("severity"))


@query(f"WITH {MENTIONS}, a AS (SELECT avg(abs(sentiment)) AS m FROM mentions) SELECT entity_id, round(avg(sentiment) - (SELECT m FROM a), 6) AS rel FROM mentions GROUP BY entity_id")
def ag5_scalar_broadcast(spark, d):
    m = mentions(spark, d)
    one = m.agg(F.avg(F.abs("sentiment")).alias("m"))
    return m.groupBy("entity_id").agg(F.avg("sentiment").alias("s")).crossJoin(F.broadcast(one)).select("entity_id", F.round(F.col("s") - F.col("m"), 6).alias("rel"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def ag6_group_concat(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("SELECT l_partkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey HAVING count(*) >= 5 AND sum(l_quantity) >= 500")
def ag7_having(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")).where("n >= 5 and qty >= 500")


@query("SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus = 'O') AS open FROM orders GROUP BY o_orderpriority")
def ag8_boolean_sums(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))


@query(f"WITH {MENTIONS} SELECT entity_id, round(avg(sentiment), 6) AS mean, count(*) AS n FROM mentions GROUP BY entity_id")
def ag9_incremental_mean(spark, d):
    """The mean of two halves merged as running means are: (a * n + b * m) / (n + m)."""
    m = mentions(spark, d)
    part = lambda x: x.groupBy("entity_id").agg(F.avg("sentiment").alias("mean"), F.count("*").alias("n"))
    a, b = part(m.where("mention_id % 2 = 0")), part(m.where("mention_id % 2 = 1"))
    both = a.unionByName(b).groupBy("entity_id").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return both.select("entity_id", F.round("mean", 6).alias("mean"), "n")


@query("SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey")
def ag10_latest_by_max(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("last_price"))


@query("""WITH r AS (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
SELECT l_partkey, l_quantity AS median FROM r WHERE i = n // 2 + 1""")
def ag11_upper_median(spark, d):
    return R.upper_median(load(spark, d, "lineitem").select("l_partkey", "l_quantity"), ["l_partkey"], "l_quantity", [F.col("l_quantity")])


@query("SELECT l_partkey, round(quantile_cont(l_extendedprice, 0.5), 4) AS median FROM lineitem GROUP BY l_partkey")
def ag12_median(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.percentile("l_extendedprice", 0.5), 4).alias("median"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def ag13_usage(spark, d):
    return load(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


@query("SELECT event_type AS surface, count(*) AS n, count_if(event_type = 'view') AS views, count(DISTINCT CAST(ts AS DATE)) AS active_days, max(ts) AS last_seen FROM events GROUP BY event_type")
def ag14_engagement(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("surface")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_distinct(F.to_date("ts")).alias("active_days"), F.max("ts").alias("last_seen"))


@query("""SELECT n_F, n_P, n_O, round((n_F + 0.5 * n_P) / (n_F + n_P + n_O), 6) AS accuracy FROM (SELECT count_if(o_orderstatus = 'F') AS n_F, count_if(o_orderstatus = 'P') AS n_P, count_if(o_orderstatus = 'O') AS n_O FROM orders)""")
def ag15_status_histogram(spark, d):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s}")
    return load(spark, d, "orders").agg(n("F"), n("P"), n("O")).withColumn("accuracy", F.round((F.col("n_F") + 0.5 * F.col("n_P")) / (F.col("n_F") + F.col("n_P") + F.col("n_O")), 6))


CONF = "p AS (SELECT doc_id, (doc_id * 37 % 101) / 100.0 AS conf, CAST(quality AS DOUBLE) AS outcome, toxic FROM labels)"


def _predictions(spark, d):
    return load(spark, d, "labels").select("doc_id", (F.expr("doc_id * 37 % 101") / 100.0).alias("conf"), F.col("quality").cast("double").alias("outcome"), "toxic")


@query(f"WITH {CONF} SELECT round(avg((conf - outcome) * (conf - outcome)), 6) AS brier, count(*) AS n FROM p")
def ag16_brier(spark, d):
    return _predictions(spark, d).agg(F.round(F.avg(F.pow(F.col("conf") - F.col("outcome"), 2)), 6).alias("brier"), F.count("*").alias("n"))


@query(f"WITH {CONF} SELECT CAST(floor(conf * 5) AS INTEGER) AS bucket, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(outcome), 6) AS hit_rate FROM p WHERE conf < 1 GROUP BY 1")
def ag17_calibration(spark, d):
    """Fifths of confidence, upper bound excluded: exactly 1 is in no bucket."""
    return _predictions(spark, d).where("conf < 1").groupBy(F.floor(F.col("conf") * 5).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("confidence"), F.round(F.avg("outcome"), 6).alias("hit_rate"))


@query(f"""WITH {CONF}, q AS (SELECT CAST(floor(conf * 5) AS INTEGER) AS band, toxic, outcome FROM p)
SELECT band, toxic, CAST(grouping(band) * 2 + grouping(toxic) AS BIGINT) AS level, count(*) AS n, round(avg(outcome), 6) AS accuracy FROM q GROUP BY GROUPING SETS ((band), (toxic), ()) HAVING count(*) >= 5""")
def ag18_breakdowns(spark, d):
    q = _predictions(spark, d).select(F.floor(F.col("conf") * 5).cast("int").alias("band"), "toxic", "outcome")
    g = q.groupingSets([[F.col("band")], [F.col("toxic")], []], F.col("band"), F.col("toxic"))
    return g.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("outcome"), 6).alias("accuracy")).where("n >= 5")


@query(f"""WITH {TRADES} SELECT account % 10 AS book, count(*) AS n, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(CASE WHEN pnl > 0 THEN pnl END), 4) AS mean_win, round(avg(CASE WHEN pnl < 0 THEN pnl END), 4) AS mean_loss,
round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / -sum(CASE WHEN pnl < 0 THEN pnl END), 6) AS profit_factor, round(100 * sum(pnl) / sum(invested), 6) AS invested_return FROM trades GROUP BY 1""")
def ag19_win_loss(spark, d):
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    gain, lost = F.coalesce(F.sum(win), F.lit(0.0)), F.coalesce(-F.sum(loss), F.lit(0.0))
    return trades(spark, d).groupBy((F.col("account") % 10).alias("book")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"), F.round(F.avg(win), 4).alias("mean_win"), F.round(F.avg(loss), 4).alias("mean_loss"),
        F.round(F.when(lost == 0, F.lit(math.inf)).otherwise(gain / F.nullif(lost, F.lit(0.0))), 6).alias("profit_factor"), F.round(100 * F.sum("pnl") / F.sum("invested"), 6).alias("invested_return"))


RETURNS = f"{TRADES}, r AS (SELECT *, pnl / invested AS ret, account % 10 AS book FROM trades)"


def _returns(spark, d):
    return trades(spark, d).withColumn("ret", F.col("pnl") / F.col("invested")).withColumn("book", F.col("account") % 10)


@query(f"WITH {RETURNS} SELECT book, round(CASE WHEN count(*) < 2 OR stddev_samp(ret) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(least(50, count(*))) END, 6) AS sharpe FROM r GROUP BY book")
def ag20_sharpe_trades(spark, d):
    sd = F.stddev_samp("ret")
    return _returns(spark, d).groupBy("book").agg(F.round(F.when((F.count("*") < 2) | (sd == 0), F.lit(0.0)).otherwise(F.try_divide(F.avg("ret"), sd) * F.sqrt(F.least(F.lit(50), F.count("*")))), 6).alias("sharpe"))


@query(f"""WITH {BARS}, x AS (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1 AS r FROM bars)
SELECT ticker, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0), 6) AS sharpe FROM x GROUP BY ticker""")
def ag21_sharpe_daily(spark, d):
    w = Window.partitionBy("ticker").orderBy("day")
    x = bars(spark, d).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    return x.groupBy("ticker").agg(F.round(F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")) * math.sqrt(252), F.lit(0.0)), 6).alias("sharpe"))


@query(f"WITH {RETURNS} SELECT book, round(avg(ret) / coalesce(nullif(stddev_samp(ret), 0), 1) * sqrt(252 / avg(greatest(1, date_diff('day', entry_day, exit_day)))), 6) AS sharpe FROM r GROUP BY book")
def ag22_sharpe_hold(spark, d):
    hold = F.avg(F.greatest(F.lit(1), F.date_diff("exit_day", "entry_day")))
    return _returns(spark, d).groupBy("book").agg(F.round(F.avg("ret") / F.coalesce(F.nullif(F.stddev_samp("ret"), F.lit(0.0)), F.lit(1.0)) * F.sqrt(252 / hold), 6).alias("sharpe"))


@query(f"WITH {RETURNS} SELECT book, round(avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)), 6) AS sortino FROM r GROUP BY book")
def ag23_sortino(spark, d):
    down = F.sqrt(F.avg(F.when(F.col("ret") < 0, F.col("ret") * F.col("ret"))))
    return _returns(spark, d).groupBy("book").agg(F.round(F.coalesce(F.try_divide(F.avg("ret"), down), F.lit(math.inf)), 6).alias("sortino"))


CURVE = f"{TRADES}, c AS (SELECT account % 10 AS book, exit_day AS day, sum(pnl) AS pnl FROM trades GROUP BY ALL), e AS (SELECT *, sum(pnl) OVER (PARTITION BY book ORDER BY day) AS cum FROM c)"


def _curve(spark, d):
    c = trades(spark, d).groupBy((F.col("account") % 10).alias("book"), F.col("exit_day").alias("day")).agg(F.sum("pnl").alias("pnl"))
    return c.withColumn("cum", F.sum("pnl").over(Window.partitionBy("book").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"""WITH {CURVE}, p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY book ORDER BY day)) AS peak FROM e)
SELECT book, round(max(CASE WHEN peak > 0 THEN (peak - cum) / peak * 100 ELSE 0 END), 4) AS max_drawdown FROM p GROUP BY book""")
def ag24_drawdown_pnl(spark, d):
    w = Window.partitionBy("book").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    p = _curve(spark, d).withColumn("peak", F.greatest(F.lit(0.0), F.max("cum").over(w)))
    return p.groupBy("book").agg(F.round(F.max(F.when(F.col("peak") > 0, F.try_divide(F.col("peak") - F.col("cum"), F.col("peak")) * 100).otherwise(0.0)), 4).alias("max_drawdown"))


@query(f"""WITH {BARS}, p AS (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY day) AS peak FROM bars)
SELECT ticker, round(max((peak - close) / peak), 6) AS max_drawdown, arg_min(day, close / peak) AS worst_day FROM p GROUP BY ticker""")
def ag25_drawdown_equity(spark, d):
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    p = bars(spark, d).withColumn("peak", F.max("close").over(w))
    return p.groupBy("ticker").agg(F.round(F.max((F.col("peak") - F.col("close")) / F.col("peak")), 6).alias("max_drawdown"), F.min_by("day", F.col("close") / F.col("peak")).alias("worst_day"))


@query(f"""WITH {BARS}, p AS (SELECT ticker, day, close, max(close) OVER (PARTITION BY ticker ORDER BY day) AS peak FROM bars)
SELECT p.ticker, p.day, round((close - peak) / peak * 100, 6) AS drawdown, (SELECT min(b.day) FROM bars b WHERE b.ticker = p.ticker AND b.close = p.peak) AS peak_day FROM p""")
def ag26_drawdown_series(spark, d):
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    p = bars(spark, d).withColumn("peak", F.max("close").over(w)).withColumn("peak_day", F.max_by("day", F.struct("close", -F.unix_date("day"))).over(w))
    return p.select("ticker", "day", F.round((F.col("close") - F.col("peak")) / F.col("peak") * 100, 6).alias("drawdown"), "peak_day")


@query(f"WITH {TRADES} SELECT strftime(exit_day, '%Y-%m') AS month, round(sum(pnl), 4) AS pnl, round(sum(invested), 4) AS invested FROM trades GROUP BY 1")
def ag27_monthly_trades(spark, d):
    return trades(spark, d).groupBy(F.date_format("exit_day", "yyyy-MM").alias("month")).agg(F.round(F.sum("pnl"), 4).alias("pnl"), F.round(F.sum("invested"), 4).alias("invested"))


@query(f"""WITH {CURVE}, m AS (SELECT book, strftime(day, '%Y-%m') AS month, arg_max(cum, day) AS last FROM e GROUP BY ALL)
SELECT book, month, round(last - lag(last) OVER (PARTITION BY book ORDER BY month), 4) AS change FROM m""")
def ag28_monthly_equity(spark, d):
    m = _curve(spark, d).groupBy("book", F.date_format("day", "yyyy-MM").alias("month")).agg(F.max_by("cum", "day").alias("last"))
    return m.select("book", "month", F.round(F.col("last") - F.lag("last").over(Window.partitionBy("book").orderBy("month")), 4).alias("change"))


@query(f"""WITH {TRADES} SELECT coalesce(c_mktsegment, 'unknown') AS sector, count(*) AS n, round(sum(pnl), 4) AS pnl, round(avg(CASE WHEN pnl / invested > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate FROM trades LEFT JOIN customer ON account = c_custkey GROUP BY 1""")
def ag29_exposure(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("account"), "c_mktsegment")
    return trades(spark, d).join(c, "account", "left").groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("sector")).agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"), F.round(F.avg(F.when(F.col("pnl") / F.col("invested") > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"))


DIMS = f"{TRADES}, t AS (SELECT trade_id, pnl / invested AS ret, (trade_id % 11) / 10.0 AS d1, (trade_id % 7) / 6.0 AS d2, (trade_id % 5) / 4.0 AS d3 FROM trades), u AS (SELECT trade_id, ret, 'd1' AS dim, d1 AS v FROM t UNION ALL SELECT trade_id, ret, 'd2', d2 FROM t UNION ALL SELECT trade_id, ret, 'd3', d3 FROM t)"


def _dims(spark, d):
    t = trades(spark, d).select("trade_id", (F.col("pnl") / F.col("invested")).alias("ret"), (F.col("trade_id") % 11 / 10.0).alias("d1"), (F.col("trade_id") % 7 / 6.0).alias("d2"), (F.col("trade_id") % 5 / 4.0).alias("d3"))
    return t.unpivot(["trade_id", "ret"], ["d1", "d2", "d3"], "dim", "v")


@query(f"WITH {DIMS} SELECT dim, round(avg(CASE WHEN ret > 0 THEN v END) - avg(CASE WHEN ret <= 0 THEN v END), 6) AS edge, count(*) AS n FROM u WHERE v > 0.01 GROUP BY dim")
def ag30_attribution(spark, d):
    return _dims(spark, d).where("v > 0.01").groupBy("dim").agg(F.round(F.avg(F.when(F.col("ret") > 0, F.col("v"))) - F.avg(F.when(F.col("ret") <= 0, F.col("v"))), 6).alias("edge"), F.count("*").alias("n"))


HITS = f"{DIMS}, h AS (SELECT dim, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS hit FROM u WHERE v > 0.2 GROUP BY dim)"


@query(f"WITH {HITS} SELECT dim, n, round(hit, 6) AS hit, (hit < 0.5 AND n >= 5) AS dead FROM h")
def ag31_dimension_hits(spark, d):
    h = _dims(spark, d).where("v > 0.2").groupBy("dim").agg(F.count("*").alias("n"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit"))
    return h.select("dim", "n", F.round("hit", 6).alias("hit"), ((F.col("hit") < 0.5) & (F.col("n") >= 5)).alias("dead"))


@query(f"WITH {HITS} SELECT dim, round((1 / 3.0 * hit / 0.5) / sum(1 / 3.0 * hit / 0.5) OVER (), 6) AS weight FROM h")
def ag32_weight_proposal(spark, d):
    h = _dims(spark, d).where("v > 0.2").groupBy("dim").agg(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit"))
    raw = 1 / 3.0 * F.col("hit") / 0.5
    total = h.agg(F.sum(raw).alias("total"))  # one row
    return h.crossJoin(F.broadcast(total)).select("dim", F.round(raw / F.col("total"), 6).alias("weight"))


@query("SELECT user_id, round((up + 1) / (up + down + 2), 6) AS reputation, round(0.8 + 0.4 * (up + 1) / (up + down + 2), 6) AS boost FROM (SELECT user_id, count_if(event_type = 'click') AS up, count_if(event_type = 'error') AS down FROM events GROUP BY user_id)")
def ag33_reputation(spark, d):
    e = load(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("up"), F.count_if(F.col("event_type") == "error").alias("down"))
    rep = (F.col("up") + 1) / (F.col("up") + F.col("down") + 2)
    return e.select("user_id", F.round(rep, 6).alias("reputation"), F.round(0.8 + 0.4 * rep, 6).alias("boost"))


@query(f"WITH {RETURNS} SELECT book, count(*) AS n, round(avg(ret) * count(*) / (count(*) + 20), 6) AS shrunk, round(avg(ret) / (stddev_samp(ret) / sqrt(count(*))), 4) AS t FROM r GROUP BY book")
def ag34_shrunk_t(spark, d):
    n = F.count("*")
    return _returns(spark, d).groupBy("book").agg(n.alias("n"), F.round(F.avg("ret") * n / (n + 20), 6).alias("shrunk"), F.round(F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(n)), 4).alias("t"))


def _clustered(df, keys, cluster, value):
    """Mean and t over cluster means."""
    per = df.groupBy(*keys, cluster.alias("_c")).agg(F.avg(value).alias("_m"))
    n = F.count("*")
    return per.groupBy(*keys).agg(n.alias("clusters"), F.round(F.avg("_m"), 6).alias("mean"), F.round(F.try_divide(F.avg("_m"), F.stddev_samp("_m") / F.sqrt(n)), 4).alias("t"))


@query(f"WITH {RETURNS}, m AS (SELECT book, exit_day, avg(ret) AS x FROM r GROUP BY ALL) SELECT book, count(*) AS clusters, round(avg(x), 6) AS mean, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS t FROM m GROUP BY book")
def ag35_day_clustered(spark, d):
    return _clustered(_returns(spark, d), ["book"], F.col("exit_day"), "ret")


@query(f"""WITH {RETURNS}, m AS (SELECT CASE WHEN exit_day < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS period, strftime(exit_day, '%Y-%m') AS c, avg(ret) AS x FROM r GROUP BY ALL)
SELECT period, count(*) AS clusters, round(avg(x), 6) AS mean, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 4) AS t FROM m GROUP BY period""")
def ag36_month_clustered(spark, d):
    r = _returns(spark, d).withColumn("period", F.when(F.col("exit_day") < F.lit("1999-01-01").cast("date"), "train").otherwise("test"))
    return _clustered(r, ["period"], F.date_format("exit_day", "yyyy-MM"), "ret")


@query(f"WITH {RETURNS} SELECT book, coalesce(avg(ret) / nullif(stddev_samp(ret) / sqrt(count(*)), 0) >= 2, false) AND count(*) >= 2 AS significant FROM r GROUP BY book")
def ag37_t_gate(spark, d):
    return _returns(spark, d).groupBy("book").agg((F.coalesce(F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("*"))) >= 2, F.lit(False)) & (F.count("*") >= 2)).alias("significant"))


@query(f"""WITH {DIMS}, g AS (SELECT avg(ret) AS m FROM t) SELECT dim, count(*) AS n, round(avg(ret) - (SELECT m FROM g), 6) AS relative, round((count_if(ret > 0) + 10) / (count(*) + 20), 6) AS smoothed FROM u WHERE v > 0.25 GROUP BY dim""")
def ag38_source_results(spark, d):
    u = _dims(spark, d)
    grand = _returns(spark, d).agg(F.avg("ret").alias("m"))
    return u.where("v > 0.25").groupBy("dim").agg(F.count("*").alias("n"), F.avg("ret").alias("a"), F.count_if(F.col("ret") > 0).alias("w")).crossJoin(F.broadcast(grand)).select(
        "dim", "n", F.round(F.col("a") - F.col("m"), 6).alias("relative"), F.round((F.col("w") + 10) / (F.col("n") + 20), 6).alias("smoothed"))


@query(f"WITH {RETURNS} SELECT status AS kind, fills, count(*) AS n, round(avg(ret), 6) AS mean FROM r GROUP BY ALL")
def ag39_exit_results(spark, d):
    return _returns(spark, d).groupBy(F.col("status").alias("kind"), "fills").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean"))


@query(f"""WITH {RETURNS}, g AS (SELECT 'score' AS kind, CAST(fills AS VARCHAR) AS grp, ret, pnl FROM r UNION ALL SELECT 'status', status, ret, pnl FROM r)
SELECT kind, grp, count(*) AS n, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(quantile_cont(ret, 0.5), 6) AS median, round(sum(pnl), 4) AS pnl FROM g GROUP BY ALL""")
def ag42_scorecard(spark, d):
    g = _returns(spark, d).select("ret", "pnl", F.explode(F.array(F.struct(F.lit("score").alias("kind"), F.col("fills").cast("string").alias("grp")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("grp")))).alias("g"))
    return g.groupBy("g.kind", "g.grp").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"), F.round(F.percentile("ret", 0.5), 6).alias("median"), F.round(F.sum("pnl"), 4).alias("pnl"))


@query(f"WITH {RETURNS} SELECT book, count(*) AS n, round(avg(ret) * 100, 6) AS expectancy_pct, round(avg(pnl), 4) AS expectancy, count(*) >= 20 AS sufficient FROM r GROUP BY book")
def ag43_edge(spark, d):
    return _returns(spark, d).groupBy("book").agg(F.count("*").alias("n"), F.round(F.avg("ret") * 100, 6).alias("expectancy_pct"), F.round(F.avg("pnl"), 4).alias("expectancy"), (F.count("*") >= 20).alias("sufficient"))


@query(f"WITH {TRADES} SELECT trade_id FROM trades WHERE pnl IS NULL OR sign(pnl) <> sign(invested - 150000)")
def ag44_audit(spark, d):
    return trades(spark, d).where(F.col("pnl").isNull() | (F.signum("pnl") != F.signum(F.col("invested") - 150000))).select("trade_id")


@query(f"""WITH {BARS}, i AS (SELECT day, avg(close) AS c FROM bars GROUP BY day), j AS (SELECT ticker, day, b.close, i.c FROM bars b JOIN i USING (day)),
x AS (SELECT ticker, close / lag(close) OVER w - 1 AS s, c / lag(c) OVER w - 1 AS m FROM j WINDOW w AS (PARTITION BY ticker ORDER BY day))
SELECT ticker, count(s) AS n, CASE WHEN count(s) >= 30 THEN round(regr_slope(s, m), 6) END AS beta FROM x GROUP BY ticker""")
def ag45_beta(spark, d):
    b = bars(spark, d)
    j = b.join(b.groupBy("day").agg(F.avg("close").alias("c")), "day")
    w = Window.partitionBy("ticker").orderBy("day")
    x = j.select("ticker", (F.col("close") / F.lag("close").over(w) - 1).alias("s"), (F.col("c") / F.lag("c").over(w) - 1).alias("m"))
    return x.groupBy("ticker").agg(F.count("s").alias("n"), F.when(F.count("s") >= 30, F.round(F.regr_slope("s", "m"), 6)).alias("beta"))


@query("""WITH p AS (SELECT c_mktsegment AS industry, CASE WHEN c_acctbal < 0 THEN c_acctbal END AS s, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS l, c_acctbal AS v FROM customer)
SELECT industry, round(coalesce(sum(l), 0), 4) AS long, round(coalesce(sum(s), 0), 4) AS short, round(sum(v), 4) AS net, round(100 * sum(abs(v)) / (SELECT sum(abs(v)) FROM p), 6) AS gross_pct FROM p GROUP BY industry""")
def ag46_exposure_industry(spark, d):
    v = F.col("c_acctbal")
    p = load(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("industry")).agg(F.coalesce(F.sum(F.when(v >= 0, v)), F.lit(0.0)).alias("long"), F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("short"))
    gross = F.col("long") - F.col("short")
    total = p.agg(F.sum(gross).alias("total"))
    return p.crossJoin(F.broadcast(total)).select("industry", F.round("long", 4).alias("long"), F.round("short", 4).alias("short"), F.round(F.col("long") + F.col("short"), 4).alias("net"), F.round(100 * gross / F.col("total"), 6).alias("gross_pct"))


@query("SELECT move, round(sum(c_acctbal * (1 + (c_custkey % 5) / 10.0) * move), 2) AS loss FROM customer, (VALUES (-0.05), (-0.1), (-0.2), (0.05)) m(move) GROUP BY move".replace("(-0.05), (-0.1), (-0.2), (0.05)", "(CAST(-0.05 AS DOUBLE)), (CAST(-0.1 AS DOUBLE)), (CAST(-0.2 AS DOUBLE)), (CAST(0.05 AS DOUBLE))"))
def ag47_stress(spark, d):
    moves = spark.createDataFrame([(x,) for x in (-0.05, -0.1, -0.2, 0.05)], "move double")  # four scenarios
    exposed = load(spark, d, "customer").agg(F.sum(F.col("c_acctbal") * (1 + F.col("c_custkey") % 5 / 10.0)).alias("x"))
    return moves.crossJoin(exposed).select("move", F.round(F.col("x") * F.col("move"), 2).alias("loss"))


@query("""WITH e AS (SELECT event_type AS feed, user_id, value, event_id FROM events)
SELECT feed, user_id, max(value) AS slowest, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 1 END) AS BIGINT) AS entries, min(CASE WHEN value > 50 THEN event_id END) AS first_error FROM e GROUP BY ALL""")
def ag54_feed_fold(spark, d):
    e = load(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("feed"), "user_id").agg(F.max("value").alias("slowest"), F.sum(F.when(F.col("event_id") % 3 == 0, 1)).alias("entries"), F.min(F.when(F.col("value") > 50, F.col("event_id"))).alias("first_error"))


@query(f"WITH {MENTIONS} SELECT day, round(sum(k), 4) AS spent, CASE WHEN sum(k) > 18000 THEN 'over' WHEN sum(k) > 16000 THEN 'warn' ELSE 'ok' END AS state FROM mentions GROUP BY day")
def ag55_cost_cap(spark, d):
    s = F.sum("k")
    return mentions(spark, d).groupBy("day").agg(F.round(s.cast("double"), 4).alias("spent"), F.when(s > 18000, "over").when(s > 16000, "warn").otherwise("ok").alias("state"))


@query("SELECT n_regionkey AS r, c_mktsegment AS s, count(*) AS n, CAST(grouping(n_regionkey) * 2 + grouping(c_mktsegment) AS BIGINT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def ag56_cube(spark, d):
    c = load(spark, d, "customer").join(F.broadcast(load(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows at any scale
    return c.cube(F.col("n_regionkey").alias("r"), F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, true AS users_close, true AS median_close FROM events GROUP BY 1")
def ag57_approximate(spark, d):
    """Approximate counterparts (sketches) and whether they keep their error bounds: three deviations of a count, and two in a thousand ranks of a median."""
    e = load(spark, d, "events")
    a = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("near"), F.percentile_approx("value", 0.5, 1000).alias("median"), F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))  # one row a type
    ranks = e.join(F.broadcast(a.select("event_type", "median")), "event_type").groupBy("event_type").agg(F.count_if(F.col("value") < F.col("median")).alias("below"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
    slack = F.col("n") / 500 + 1
    close = (F.col("below") <= F.col("n") / 2 + slack) & (F.col("upto") >= F.col("n") / 2 - slack)
    return a.join(ranks, "event_type").select("event_type", "users", (F.abs(F.col("near") - F.col("users")) <= F.greatest(0.06 * F.col("users"), F.lit(1.0))).alias("users_close"), close.alias("median_close"))


@query("SELECT source, count(*) AS n, count_if(n_chars > 2000) AS long, count(*) >= 51 AS healthy FROM documents GROUP BY source")
def ag58_source_health(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"), (F.count("*") >= 51).alias("healthy"))


@query("SELECT round(avg(CASE WHEN vec_id IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage, count(*) AS n FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def ag59_coverage(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    return load(spark, d, "documents").select("doc_id").join(e, "doc_id", "left").agg(F.round(F.avg(F.when(F.col("has").isNotNull(), 1.0).otherwise(0.0)), 6).alias("coverage"), F.count("*").alias("n"))


@query("SELECT event_type AS cause, n, sample FROM (SELECT event_type, count(*) AS n, min(event_id) AS sample FROM events GROUP BY event_type) ORDER BY n DESC, cause LIMIT 1")
def ag60_dominant(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("cause")).agg(F.count("*").alias("n"), F.min("event_id").alias("sample")).orderBy(F.desc("n"), "cause").limit(1)


@query(f"WITH {TRADES}, l AS (SELECT * FROM trades ORDER BY exit_day DESC, trade_id DESC LIMIT 50) SELECT count_if(pnl > 0) AS wins, round(avg(CASE WHEN pnl > 0 THEN pnl END), 4) AS mean_win, round(avg(CASE WHEN pnl <= 0 THEN pnl END), 4) AS mean_loss FROM l")
def ag61_recent_edge(spark, d):
    return trades(spark, d).orderBy(F.desc("exit_day"), F.desc("trade_id")).limit(50).agg(F.count_if(F.col("pnl") > 0).alias("wins"), F.round(F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), 4).alias("mean_win"), F.round(F.avg(F.when(F.col("pnl") <= 0, F.col("pnl"))), 4).alias("mean_loss"))


@query(f"""WITH {CURVE}, v AS (SELECT book, day, 100000 + cum AS value FROM e)
SELECT book, day, round(value, 4) AS value, round(greatest(100000, max(value) OVER w), 4) AS high_water, round((greatest(100000, max(value) OVER w) - value) / greatest(100000, max(value) OVER w), 6) AS drawdown FROM v WINDOW w AS (PARTITION BY book ORDER BY day)""")
def ag63_snapshots(spark, d):
    w = Window.partitionBy("book").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    v = _curve(spark, d).withColumn("value", 100000 + F.col("cum")).withColumn("hw", F.greatest(F.lit(100000.0), F.max("value").over(w)))
    return v.select("book", "day", F.round("value", 4).alias("value"), F.round("hw", 4).alias("high_water"), F.round((F.col("hw") - F.col("value")) / F.col("hw"), 6).alias("drawdown"))


@query(f"WITH {STORIES} SELECT sector, count(DISTINCT source_name) AS sources FROM stories WHERE day >= DATE '2024-02-01' GROUP BY sector HAVING count(DISTINCT source_name) >= 2")
def ag64_diversity(spark, d):
    return stories(spark, d).where("day >= date'2024-02-01'").groupBy("sector").agg(F.count_distinct("source_name").alias("sources")).where("sources >= 2")


@query(f"WITH {MENTIONS} SELECT entity_id, count(DISTINCT day) AS days, round(min(sentiment), 6) AS lo, round(max(sentiment), 6) AS hi, count_if(sentiment > 0.4) AS converged FROM mentions GROUP BY entity_id")
def ag66_history(spark, d):
    return mentions(spark, d).groupBy("entity_id").agg(F.count_distinct("day").alias("days"), F.round(F.min("sentiment"), 6).alias("lo"), F.round(F.max("sentiment"), 6).alias("hi"), F.count_if(F.col("sentiment") > 0.4).alias("converged"))


@query(f"WITH {MENTIONS} SELECT mention_id, entity_id FROM mentions WHERE day = (SELECT max(day) FROM mentions)")
def ag67_newest_day(spark, d):
    m = mentions(spark, d)
    return m.join(F.broadcast(m.agg(F.max("day").alias("day"))), "day").select("mention_id", "entity_id")


@query("SELECT o_custkey AS batch, bool_or(o_orderstatus = 'O') AS superseded, count(*) AS n FROM orders GROUP BY o_custkey")
def ag68_batches(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("superseded"), F.count("*").alias("n"))
