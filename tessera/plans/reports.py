"""Queries of reviews, reports, answer parsing and stored formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import plugins, scoring, text
from tessera.operators import relational as R
from tessera.plans.catalog import query
from tessera.plans.views import BARS, TRADES, bars, by_day, trades
from tessera.session import load

ANSWER = """concat('Because of it [story:', conv_id, '] and [story: x', turn, '] [story:', turn, ' ]', chr(10), '1. [followup: "Why ', role, '?" | type: "deeper"]', chr(10), '2. [followup: "And then?"] so', chr(10), '[prediction: "up ', turn, '" | confidence: ', CASE WHEN turn % 2 = 0 THEN '0.7' ELSE 'high' END, ' | timeframe: "30d"] [prediction: "two parts" | confidence: 0.9]', chr(10), text)"""


@query(f"""WITH a AS (SELECT conv_id, turn, role, {ANSWER} AS answer, text FROM conversations)
SELECT conv_id, turn, [conv_id, turn] AS stories, concat('deeper::Why ', role, '?') AS first_followup, 2::BIGINT AS followups, concat('up ', turn) AS prediction, CASE WHEN turn % 2 = 0 THEN 0.7 ELSE 0.5 END AS confidence, '30d' AS timeframe, 1::BIGINT AS predictions,
concat('Because of it  and  ', chr(10), '2.  so', chr(10), ' ', chr(10), text) AS clean FROM a""")
def fn16_references(spark, d):
    """Story ids, follow-up questions and predictions of an answer, and the answer without its markers."""
    a = load(spark, d, "conversations").select("conv_id", "turn", F.expr(ANSWER).alias("answer"))
    p = a.select("conv_id", "turn", text.story_references(F.col("answer")).alias("stories"), text.followups(F.col("answer")).alias("f"), text.predictions(F.col("answer")).alias("p"), text.without_markers(F.col("answer")).alias("clean"))
    first = F.col("p")[0]
    return p.select(
        "conv_id", "turn", "stories", F.col("f")[0].alias("first_followup"), F.size("f").cast("bigint").alias("followups"), first["text"].alias("prediction"),
        first["confidence"].alias("confidence"), first["timeframe"].alias("timeframe"), F.size("p").cast("bigint").alias("predictions"), "clean",
    )


_FORMS = [
    "Bank Upgrades {} to Buy", "Bank Downgrades {} to Sell", "{} Q2 EPS $1 Beats Est, Sales $2 Beat Est", "{} Q2 EPS $1 Misses Est, Sales $2 Miss Est", "{} Raises FY25 Guidance", "{} Cuts Q3 Sales Outlook",
    "{} Prices 2M Share Public Offering", "{} Prices Offering Of 5% Notes", "Bank Initiates Coverage On {} With Outperform", "Bank Initiates Coverage On {} With Underweight", "{} Board Approves $1B Buyback", "Bank Maintains Hold on {}, Raises Price Target to 5",
    "Bank Maintains Hold on {}, Lowers Price Target to 5", "{} opens a plant",
]
_RULES = ["upgrade", "downgrade", "beat_both", "miss_both", "guide_up", "guide_down", "equity_offering", None, "initiate_buy", "initiate_sell", "buyback", "pt_raise", "pt_lower", None]
_SIDES = {None: None, **{k: v[0] for k, v in text.HEADLINES.items()}}


def _case(values: list, key: str = "p_size % 14") -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + " END"


@query(f"SELECT p_partkey, {_case(_RULES)} AS rule, {_case([_SIDES[r] for r in _RULES])}::INTEGER AS side FROM part")
def fn8_headline_rules(spark, d):
    """The first of twelve rules that a headline meets, and its side."""
    h = F.replace(F.expr(_case(_FORMS)), F.lit("{}"), F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", text.headline_rule(h).alias("r")).select("p_partkey", "r.rule", "r.side")


@query("SELECT vec_id, 4 * len(embedding)::BIGINT AS bytes, round(list_sum(embedding::DOUBLE[]), 4) AS total, true AS same FROM embeddings")
def fn32_vector_blob(spark, d):
    """Vectors to blobs and back."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding", plugins.to_blob(F.col("embedding")).alias("blob"))
    back = e.select("vec_id", "embedding", F.octet_length("blob").cast("bigint").alias("bytes"), plugins.from_blob(F.col("blob")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", "bytes", F.round(total, 4).alias("total"), (F.col("v") == F.col("embedding")).alias("same"))


@query("""WITH n AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT o_custkey, string_agg(s || '=' || n, ',' ORDER BY s) AS by_status FROM n GROUP BY 1),
i AS (SELECT o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days FROM orders GROUP BY 1)
SELECT o_custkey, by_status, days::INTEGER AS days, days > 700 AS long FROM m JOIN i USING (o_custkey)""")
def fn45_map_interval(spark, d):
    """A map column of counts by status and a day-time interval between first and last order."""
    o = load(spark, d, "orders")
    counts = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("by"))
    span = o.groupBy("o_custkey").agg((F.to_date(F.max("o_orderdate")).cast("timestamp") - F.to_date(F.min("o_orderdate")).cast("timestamp")).alias("span"))
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("by")), lambda k: F.concat(k, F.lit("="), F.element_at("by", k))), ",")
    return counts.join(span, "o_custkey").select("o_custkey", shown.alias("by_status"), F.extract(F.lit("DAY"), F.col("span")).cast("int").alias("days"), (F.col("span") > F.expr("INTERVAL '700' DAY")).alias("long"))


@query("SELECT l_partkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(38, 10))) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def sl15_exact_sums(spark, d):
    """Sums of doubles that do not depend on the order of the rows."""
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(scoring.exact_sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("total"))


# ---- trade review

#: Bars after the exit that a review looks at.
AFTER = (5, 10, 20)
_KIND = "CASE WHEN status = 'O' THEN 'trailing_stop' WHEN status = 'F' THEN 'signal_decay' ELSE 'max_hold' END"

REVIEW = f"""{TRADES}, {BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM bars), m AS (SELECT day, avg(open) AS o, avg(close) AS c FROM bars GROUP BY day),
e AS (SELECT trade_id, t.ticker, entry_day, exit_day, trade_id % 5 = 0 AS short, {_KIND} AS kind, min(i) FILTER (day >= entry_day) AS ei, max(i) FILTER (day <= exit_day) AS xi FROM trades t JOIN b ON b.ticker = t.ticker GROUP BY ALL HAVING xi >= ei),
w AS (SELECT trade_id, entry_day, exit_day, short, kind, ei, xi, max(open) FILTER (i = ei) AS ep, max(close) FILTER (i = ei) AS ec, max(close) FILTER (i = xi) AS xp, max(high) FILTER (i > ei AND i < xi) AS hi, min(low) FILTER (i > ei AND i < xi) AS lo,
  max(close) FILTER (i = xi + 5) AS c5, max(close) FILTER (i = xi + 10) AS c10, max(close) FILTER (i = xi + 20) AS c20 FROM e JOIN b ON b.ticker = e.ticker AND i BETWEEN ei AND xi + 20 GROUP BY ALL),
k AS (SELECT w.*, a.o AS so, z.c AS sc FROM w ASOF LEFT JOIN m a ON a.day >= w.entry_day ASOF LEFT JOIN m z ON z.day <= w.exit_day),
p AS (SELECT trade_id, kind, xi - ei AS hold, CASE WHEN short THEN -1 ELSE 1 END AS sgn, ep, xp, 100 * (sc / so - 1) AS spy, greatest(hi, ec, xp) AS high, least(lo, ec, xp) AS low, c5, c10, c20, short FROM k),
r AS (SELECT trade_id, kind, hold, sgn * 100 * (xp / ep - 1) AS ret, spy, sgn * 100 * (CASE WHEN short THEN low ELSE high END / ep - 1) AS mfe, sgn * 100 * (CASE WHEN short THEN high ELSE low END / ep - 1) AS mae, sgn * 100 * (c5 / xp - 1) AS a5, sgn * 100 * (c10 / xp - 1) AS a10, sgn * 100 * (c20 / xp - 1) AS a20, sgn FROM p),
f AS (SELECT *, ret - sgn * spy AS excess FROM r)"""


@query(f"""WITH {REVIEW} SELECT trade_id, kind, hold, round(ret, 4) + 0 AS ret, round(excess, 4) + 0 AS excess, round(mfe, 4) + 0 AS mfe, round(mae, 4) + 0 AS mae, round(a5, 4) + 0 AS after5, round(a20, 4) + 0 AS after20, a20 IS NOT NULL AS final,
list_filter([CASE WHEN excess >= 0 THEN 'beat_market' WHEN excess < 0 THEN 'lagged_market' END, CASE WHEN mfe >= 5 AND ret < mfe / 3 THEN 'gave_back_gains' END, CASE WHEN kind = 'trailing_stop' AND a5 >= 3 THEN 'stopped_then_recovered' END, CASE WHEN kind = 'signal_decay' AND a10 >= 3 THEN 'sold_early' END,
 CASE WHEN a10 <= -3 THEN 'good_exit' END, CASE WHEN mae <= -10 THEN 'deep_drawdown' END, CASE WHEN hold <= 3 AND ret < 0 THEN 'quick_loss' END], lambda x: x IS NOT NULL) AS lessons FROM f""")
def cp26_lessons(spark, d):
    """Review of every trade from its own bars and the market's: best and worst excursion, excess, what came after, lessons."""
    b = bars(spark, d)
    n = b.withColumn("i", F.row_number().over(by_day()))
    t = trades(spark, d).select("trade_id", "ticker", "entry_day", "exit_day", (F.col("trade_id") % 5 == 0).alias("short"), F.expr(_KIND).alias("kind"))
    at = n.select("ticker", "day", "i")
    e = t.join(at, "ticker").groupBy(*t.columns).agg(F.min(F.when(F.col("day") >= F.col("entry_day"), F.col("i"))).alias("ei"), F.max(F.when(F.col("day") <= F.col("exit_day"), F.col("i"))).alias("xi")).where("xi >= ei")
    i, ei, xi = F.col("i"), F.col("ei"), F.col("xi")
    near = e.join(n.select("ticker", "i", "open", "high", "low", "close"), "ticker").where(i.between(ei, xi + AFTER[-1]))
    only = lambda cond, c: F.max(F.when(cond, F.col(c)))
    w = near.groupBy(*e.columns).agg(
        only(i == ei, "open").alias("ep"), only(i == ei, "close").alias("ec"), only(i == xi, "close").alias("xp"), only((i > ei) & (i < xi), "high").alias("hi"),
        F.min(F.when((i > ei) & (i < xi), F.col("low"))).alias("lo"), *[only(i == xi + a, "close").alias(f"c{a}") for a in AFTER],
    )
    # the market's days are few and carry one key: a broadcast of the first and last day of each day in question
    m = b.groupBy("day").agg(F.avg("open").alias("o"), F.avg("close").alias("c"))
    days = w.select(F.col("entry_day").alias("at")).union(w.select("exit_day")).distinct().withColumn("k", F.lit(1))
    market = m.withColumn("k", F.lit(1))
    opens = R.as_of(days, market, "k", "at", "day", ["o"], forward=True).select(F.col("at").alias("entry_day"), F.col("asof_o").alias("so"))
    closes = R.as_of(days, market, "k", "at", "day", ["c"]).select(F.col("at").alias("exit_day"), F.col("asof_c").alias("sc"))
    k = w.join(opens, "entry_day", "left").join(closes, "exit_day", "left")
    sign = F.when(F.col("short"), -1).otherwise(1)
    high, low = F.greatest("hi", "ec", "xp"), F.least("lo", "ec", "xp")
    move = lambda a, base: sign * 100 * (a / F.col(base) - 1)
    r = k.select(
        "trade_id", "kind", (xi - ei).alias("hold"), move(F.col("xp"), "ep").alias("ret"), (sign * 100 * (F.col("sc") / F.col("so") - 1)).alias("spy"),
        move(F.when(F.col("short"), low).otherwise(high), "ep").alias("mfe"), move(F.when(F.col("short"), high).otherwise(low), "ep").alias("mae"), *[move(F.col(f"c{a}"), "xp").alias(f"a{a}") for a in AFTER],
    ).withColumn("excess", F.col("ret") - F.col("spy"))
    c = F.col
    lessons = F.array_compact(F.array(
        F.when(c("excess") >= 0, "beat_market").when(c("excess") < 0, "lagged_market"), F.when((c("mfe") >= 5) & (c("ret") < c("mfe") / 3), "gave_back_gains"),
        F.when((c("kind") == "trailing_stop") & (c("a5") >= 3), "stopped_then_recovered"), F.when((c("kind") == "signal_decay") & (c("a10") >= 3), "sold_early"),
        F.when(c("a10") <= -3, "good_exit"), F.when(c("mae") <= -10, "deep_drawdown"), F.when((c("hold") <= 3) & (c("ret") < 0), "quick_loss"),
    ))
    shown = [(F.round(x, 4) + 0.0).alias(y) for x, y in zip(("ret", "excess", "mfe", "mae", "a5", "a20"), ("ret", "excess", "mfe", "mae", "after5", "after20"), strict=True)]
    return r.select("trade_id", "kind", c("hold").cast("bigint").alias("hold"), *shown, c("a20").isNotNull().alias("final"), lessons.alias("lessons"))


# ---- exits

_ACT = "CASE WHEN ret <= -0.05 THEN 'hard_stop' WHEN ret <= -0.02 AND fills >= 3 THEN 'trailing_stop' WHEN ret >= 0.03 THEN 'half' ELSE 'hold' END"


@query(f"""WITH {TRADES}, t AS (SELECT *, pnl / invested AS ret, trade_id % 5 = 0 AS short FROM trades), a AS (SELECT *, {_ACT} AS act FROM t),
x AS (SELECT *, CASE WHEN trade_id % 17 = 0 THEN 'broker_stop' WHEN trade_id % 13 = 0 THEN 'manual' WHEN act IN ('hard_stop', 'trailing_stop') THEN act WHEN act = 'half' AND trade_id % 7 = 0 THEN '' WHEN act = 'half' AND short AND fills < 2 THEN '' WHEN act = 'half' THEN 'profit_target' WHEN trade_id % 11 = 0 THEN 'signal_decay' ELSE '' END AS why FROM a),
q AS (SELECT *, CASE WHEN why = '' THEN 0 WHEN why = 'profit_target' AND short THEN floor(fills / 2) WHEN why = 'profit_target' THEN fills / 2 ELSE fills END AS qty FROM x)
SELECT trade_id, CASE WHEN trade_id % 17 <> 0 AND date_diff('day', entry_day, exit_day) >= 100 AND qty < fills THEN 'max_hold' ELSE why END AS reason, CAST(CASE WHEN trade_id % 17 <> 0 AND date_diff('day', entry_day, exit_day) >= 100 AND qty < fills THEN fills ELSE qty END AS DOUBLE) AS qty FROM q""")
def cp41_exit_precedence(spark, d):
    """Broker stop, manual, price rules (full, half once, whole shares of a short), decay only on hold; the longest hold upgrades to a full close."""
    c = F.col
    t = trades(spark, d).withColumn("ret", F.expr("pnl / invested")).withColumn("short", c("trade_id") % 5 == 0).withColumn("act", F.expr(_ACT))
    half = c("act") == "half"
    why = (
        F.when(c("trade_id") % 17 == 0, "broker_stop").when(c("trade_id") % 13 == 0, "manual").when(c("act").isin("hard_stop", "trailing_stop"), c("act"))
        .when(half & ((c("trade_id") % 7 == 0) | (c("short") & (c("fills") < 2))), "").when(half, "profit_target").when(c("trade_id") % 11 == 0, "signal_decay").otherwise("")
    )
    part = F.when(c("short"), F.floor(c("fills") / 2)).otherwise(c("fills") / 2)
    q = t.withColumn("why", why).withColumn("qty", F.when(c("why") == "", 0.0).when(c("why") == "profit_target", part).otherwise(c("fills")).cast("double"))
    expired = (c("trade_id") % 17 != 0) & (F.date_diff("exit_day", "entry_day") >= 100) & (c("qty") < c("fills"))
    return q.select("trade_id", F.when(expired, "max_hold").otherwise(c("why")).alias("reason"), F.when(expired, c("fills").cast("double")).otherwise(c("qty")).alias("qty"))


# ---- portfolio and risk reports, as rows (section, name, value)


@query(f"""WITH {TRADES}, t AS (SELECT *, pnl / invested AS ret, pnl > 0 AS won, date_diff('day', entry_day, exit_day) AS held FROM trades),
c AS (SELECT exit_day, sum(pnl) AS pnl FROM t GROUP BY 1), e AS (SELECT exit_day, sum(pnl) OVER (ORDER BY exit_day) AS cum FROM c), h AS (SELECT cum, greatest(0, max(cum) OVER (ORDER BY exit_day)) AS top FROM e),
a AS (SELECT count(*)::DOUBLE AS total_trades, 100.0 * count_if(won) / count(*) AS win_rate, 100.0 * count_if(NOT won) / count(*) AS loss_rate, 100 * coalesce(avg(ret) FILTER (won), 0) AS avg_win_pct, 100 * coalesce(avg(ret) FILTER (NOT won), 0) AS avg_loss_pct,
  sum(pnl) FILTER (won) / abs(sum(pnl) FILTER (NOT won)) AS profit_factor, 100 * sum(pnl) / sum(invested) AS total_return_pct, sum(pnl) AS total_return_dollars, avg(held) AS avg_holding_days, avg(ret) / stddev_samp(ret) * sqrt(least(50, count(*))) AS sharpe_ratio,
  avg(ret) / sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(least(50, count(*))) AS sortino_ratio, max(ret) * 100 AS best_pct, min(ret) * 100 AS worst_pct, (SELECT max(top - cum) FROM h) AS max_drawdown FROM t),
u AS (UNPIVOT a ON COLUMNS(*) INTO NAME name VALUE value)
SELECT 'core' AS section, name, round(value, 4) AS value FROM u UNION ALL SELECT 'status', status, round(sum(invested), 4) FROM t GROUP BY status UNION ALL SELECT 'month', strftime(exit_day, '%Y-%m'), round(100 * sum(pnl) / sum(invested), 4) FROM t GROUP BY 2 UNION ALL SELECT 'curve', strftime(exit_day, '%Y-%m-%d'), round(cum, 4) FROM e""")
def cp38_portfolio(spark, d):
    """The portfolio's figures, exposure by status, monthly returns and equity curve as one table."""
    won, ret = F.col("pnl") > 0, F.col("pnl") / F.col("invested")
    t = trades(spark, d).withColumn("ret", ret)
    days = t.groupBy("exit_day").agg(F.sum("pnl").alias("pnl"))  # one row a day: the curve is a window over days
    curve = days.withColumn("cum", F.sum("pnl").over(Window.orderBy("exit_day")))
    top = F.greatest(F.lit(0.0), F.max("cum").over(Window.orderBy("exit_day")))
    fall = curve.select((top - F.col("cum")).alias("x")).agg(F.max("x").alias("max_drawdown"))
    n = F.count("*")
    year = F.sqrt(F.least(F.lit(50), n))
    when = lambda c, x: F.when(c, x)
    core = t.agg(
        n.cast("double").alias("total_trades"), (100.0 * F.count_if(won) / n).alias("win_rate"), (100.0 * F.count_if(~won) / n).alias("loss_rate"), (100 * F.coalesce(F.avg(when(won, ret)), F.lit(0.0))).alias("avg_win_pct"),
        (100 * F.coalesce(F.avg(when(~won, ret)), F.lit(0.0))).alias("avg_loss_pct"), F.try_divide(F.sum(when(won, F.col("pnl"))), F.abs(F.sum(when(~won, F.col("pnl"))))).alias("profit_factor"), (100 * F.sum("pnl") / F.sum("invested")).alias("total_return_pct"),
        F.sum("pnl").alias("total_return_dollars"), F.avg(F.date_diff("exit_day", "entry_day")).alias("avg_holding_days"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * year).alias("sharpe_ratio"),
        (F.try_divide(F.avg("ret"), F.sqrt(F.avg(when(ret < 0, ret * ret)))) * year).alias("sortino_ratio"), (100 * F.max("ret")).alias("best_pct"), (100 * F.min("ret")).alias("worst_pct"),
    ).crossJoin(F.broadcast(fall))  # one row each
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in core.columns]))
    value = lambda c: F.round(c, 4).alias("value")
    sections = [
        core.select(named.alias("x")).select(F.lit("core").alias("section"), "x.name", value(F.col("x.value"))),
        t.groupBy(F.col("status").alias("name")).agg(value(F.sum("invested"))).select(F.lit("status").alias("section"), "name", "value"),
        t.groupBy(F.date_format("exit_day", "yyyy-MM").alias("name")).agg(value(100 * F.sum("pnl") / F.sum("invested"))).select(F.lit("month").alias("section"), "name", "value"),
        curve.select(F.lit("curve").alias("section"), F.date_format("exit_day", "yyyy-MM-dd").alias("name"), value(F.col("cum"))),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out


#: Market moves of the stress test, and shares of the account that are warned about, in per cent.
STRESS, BIG_POSITION, BIG_INDUSTRY = (-10.0, -5.0, 5.0, 10.0), 10.0, 30.0

RISK = f"""{BARS}, m AS (SELECT day, avg(close) AS c FROM bars GROUP BY day), j AS (SELECT ticker, day, b.close, m.c FROM bars b JOIN m USING (day)), x AS (SELECT ticker, close / lag(close) OVER w - 1 AS s, c / lag(c) OVER w - 1 AS m FROM j WINDOW w AS (PARTITION BY ticker ORDER BY day)),
be AS (SELECT ticker, CASE WHEN count(s) >= 30 THEN regr_slope(s, m) END AS beta FROM x GROUP BY ticker), px AS (SELECT ticker, arg_max(close, day) AS price FROM bars GROUP BY ticker),
h AS (SELECT l_partkey AS ticker, sum(CASE WHEN l_returnflag = 'R' THEN -2 * l_quantity ELSE l_quantity END) AS qty FROM lineitem GROUP BY 1), eq AS (SELECT sum(c_acctbal) AS equity FROM customer),
p AS (SELECT h.ticker, qty, price, qty * price AS mv, p_brand AS industry, beta, CASE WHEN h.ticker % 3 <> 0 THEN price * CASE WHEN qty < 0 THEN 1.1 ELSE 0.9 END END AS stop, equity FROM h JOIN px USING (ticker) LEFT JOIN part ON p_partkey = h.ticker LEFT JOIN be USING (ticker), eq),
ind AS (SELECT industry, sum(CASE WHEN mv >= 0 THEN mv ELSE 0 END) AS l, sum(CASE WHEN mv < 0 THEN -mv ELSE 0 END) AS s, any_value(equity) AS equity FROM p GROUP BY industry),
tt AS (SELECT sum(CASE WHEN mv >= 0 THEN mv ELSE 0 END) AS l, sum(CASE WHEN mv < 0 THEN -mv ELSE 0 END) AS s, sum(abs(mv)) FILTER (beta IS NOT NULL) AS seen, sum(beta * mv) AS bw, sum(greatest(0, CASE WHEN qty < 0 THEN stop - price ELSE price - stop END * abs(qty))) AS sl, count_if(stop IS NULL) AS bare, max(abs(mv)) AS big, count(*) AS n, any_value(equity) AS equity FROM p)"""


@query(f"""WITH {RISK} SELECT 'position' AS section, CAST(ticker AS VARCHAR) AS name, round(100 * abs(mv) / equity, 4) AS value FROM p UNION ALL SELECT 'industry', industry, round(100 * (l + s) / equity, 4) FROM ind UNION ALL
SELECT 'total', k, round(v, 4) FROM (SELECT unnest(['gross_pct', 'net_pct', 'position_count', 'largest_position_pct', 'stop_loss_pct', 'positions_without_stop', 'beta_exposure_pct', 'beta_coverage_pct']) AS k, unnest([100 * (l + s) / equity, 100 * (l - s) / equity, n, 100 * big / equity, 100 * sl / equity, bare, 100 * bw / equity, 100 * seen / (l + s)]) AS v FROM tt) UNION ALL
SELECT 'stress', CAST(mv_ AS VARCHAR), round(sum(coalesce(beta, 1) * mv * mv_ / 100), 2) FROM p, (VALUES (-10), (-5), (5), (10)) s(mv_) GROUP BY mv_ UNION ALL
SELECT 'warning', 'largest position', round(100 * big / equity, 4) FROM tt WHERE 100 * big / equity > 10 UNION ALL SELECT 'warning', industry, round(100 * (l + s) / equity, 4) FROM ind WHERE 100 * (l + s) / equity > 30 UNION ALL SELECT 'warning', 'no stop', bare FROM tt WHERE bare > 0 UNION ALL SELECT 'warning', 'beta coverage', round(100 * seen / (l + s), 4) FROM tt WHERE 100 * seen / (l + s) < 100""")
def cp39_risk(spark, d):
    """Positions, industries, totals, stress by beta and warnings as one table."""
    b = bars(spark, d)
    returns = b.join(b.groupBy("day").agg(F.avg("close").alias("c")), "day").select("ticker", (F.col("close") / F.lag("close").over(by_day()) - 1).alias("s"), (F.col("c") / F.lag("c").over(by_day()) - 1).alias("m"))
    beta = returns.groupBy("ticker").agg(F.when(F.count("s") >= 30, F.regr_slope("s", "m")).alias("beta"))
    price = b.groupBy("ticker").agg(F.max_by("close", "day").alias("price"))
    held = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("ticker")).agg(F.sum(F.expr("CASE WHEN l_returnflag = 'R' THEN -2 * l_quantity ELSE l_quantity END")).alias("qty"))
    industry = load(spark, d, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_brand").alias("industry"))
    equity = load(spark, d, "customer").agg(F.sum("c_acctbal").alias("equity"))
    c = F.col
    p = held.join(price, "ticker").join(industry, "ticker", "left").join(beta, "ticker", "left").crossJoin(F.broadcast(equity))  # one row
    short = c("qty") < 0
    p = p.withColumn("mv", c("qty") * c("price")).withColumn("stop", F.when(c("ticker") % 3 != 0, c("price") * F.when(short, 1.1).otherwise(0.9)))
    side = [F.sum(F.when(c("mv") >= 0, c("mv")).otherwise(0.0)).alias("l"), F.sum(F.when(c("mv") < 0, -c("mv")).otherwise(0.0)).alias("s"), F.any_value("equity").alias("equity")]
    at_stop = F.greatest(F.lit(0.0), F.when(short, c("stop") - c("price")).otherwise(c("price") - c("stop")) * F.abs("qty"))
    total = p.agg(
        *side, F.sum(F.when(c("beta").isNotNull(), F.abs("mv"))).alias("seen"), F.sum(c("beta") * c("mv")).alias("bw"), F.sum(at_stop).alias("sl"), F.count_if(c("stop").isNull()).alias("bare"), F.max(F.abs("mv")).alias("big"),
        F.count("*").alias("n"), *[F.sum(F.coalesce("beta", F.lit(1.0)) * c("mv") * x / 100).alias(f"stress{i}") for i, x in enumerate(STRESS)],
    )
    gross = c("l") + c("s")
    ind = p.groupBy("industry").agg(*side).withColumn("share", 100 * gross / c("equity"))
    figures = {
        "gross_pct": 100 * gross / c("equity"), "net_pct": 100 * (c("l") - c("s")) / c("equity"), "position_count": c("n"), "largest_position_pct": 100 * c("big") / c("equity"), "stop_loss_pct": 100 * c("sl") / c("equity"),
        "positions_without_stop": c("bare"), "beta_exposure_pct": 100 * c("bw") / c("equity"), "beta_coverage_pct": 100 * c("seen") / gross,
    }

    def row(section: str, name, value, good=None):
        x = F.struct(F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("double").alias("value"))
        return x if good is None else F.when(good, x)

    rows = [row("total", k, F.round(v, 4)) for k, v in figures.items()] + [row("stress", str(int(x)), F.round(c(f"stress{i}"), 2)) for i, x in enumerate(STRESS)]
    rows += [
        row("warning", "largest position", F.round(figures["largest_position_pct"], 4), figures["largest_position_pct"] > BIG_POSITION), row("warning", "no stop", c("bare"), c("bare") > 0),
        row("warning", "beta coverage", F.round(figures["beta_coverage_pct"], 4), figures["beta_coverage_pct"] < 100),
    ]
    return (
        total.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*")
        .unionByName(p.select(row("position", c("ticker").cast("string"), F.round(100 * F.abs("mv") / c("equity"), 4)).alias("x")).select("x.*"))
        .unionByName(ind.select(F.explode(F.array_compact(F.array(row("industry", c("industry"), F.round("share", 4)), row("warning", c("industry"), F.round("share", 4), c("share") > BIG_INDUSTRY)))).alias("x")).select("x.*"))
    )
