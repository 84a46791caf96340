"""Queries of the relational layer: filters, joins, aggregates, windows, sorts, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import relational as R
from tessera.plans.catalog import query
from tessera.plans.views import AS_OF, BARS, MENTIONS, STORIES, TRADES, bars, mentions, stories, today, trades
from tessera.session import load



# ---- filters and projections -------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def pf1_filters(spark, d):
    return load(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1997-01-01'").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, event_type FROM events WHERE coalesce(event_type, '') NOT LIKE 'err%' AND json_extract_string(props, '$.flag') IS NULL AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def pf2_null_tolerant(spark, d):
    return load(spark, d, "events").where(~F.coalesce("event_type", F.lit("")).like("err%") & F.get_json_object("props", "$.flag").isNull() & (F.expr("try_cast(get_json_object(props, '$.k') as int)") > 50)).select("event_id", "event_type")


@query("""WITH m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE contains(lower(text), 'thation'))
SELECT doc_id, round(greatest(1.0 - 0.1 * i, 0.1), 6) AS score FROM m WHERE i < 20""")
def pf3_keyword_fallback(spark, d):
    hits = load(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("thation"))).select("doc_id").orderBy("doc_id").limit(20)
    return hits.withColumn("i", F.row_number().over(Window.orderBy("doc_id")) - 1).select("doc_id", F.round(F.greatest(F.lit(1.0) - 0.1 * F.col("i"), F.lit(0.1)), 6).alias("score"))


@query(r"SELECT page_id FROM pages WHERE url LIKE '%utm\_source=%' ESCAPE '\'")
def pf4_escaped_like(spark, d):
    return load(spark, d, "pages").where(r"url like '%utm#_source=%' escape '#'").select("page_id")


@query("SELECT doc_id, regexp_matches(substr(text, 1, 10), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS iso FROM documents")
def pf5_date_shape(spark, d):
    return load(spark, d, "documents").select("doc_id", F.substring("text", 1, 10).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$").alias("iso"))


@query(f"WITH {MENTIONS} SELECT sector, count(*) AS n FROM mentions WHERE day >= DATE '{AS_OF}' - 7 AND day <= DATE '{AS_OF}' GROUP BY sector")
def pf6_relative_window(spark, d):
    return mentions(spark, d).where(F.col("day").between(F.date_sub(today(), 7), today())).groupBy("sector").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, (regexp_matches(lower(s_name), 'unknown|n/a|various') OR (len(string_split(trim(s_name), ' ')) >= 3 AND upper(s_name) = s_name)) AS noise FROM supplier")
def pf7_noise_entity(spark, d):
    from tessera.functions.text import is_noise

    return load(spark, d, "supplier").select("s_suppkey", is_noise(F.col("s_name")).alias("noise"))


@query(f"""WITH {BARS}, w AS (SELECT *, avg(close * volume) OVER p AS dollar, count(*) OVER p AS n FROM bars WINDOW p AS (PARTITION BY ticker ORDER BY day ROWS 19 PRECEDING))
SELECT ticker, day, round(dollar, 4) AS dollar FROM w WHERE close >= 5 AND n >= 15 AND dollar >= 20000""")
def pf8_liquidity(spark, d):
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(-19, 0)
    b = bars(spark, d).withColumn("dollar", F.avg(F.col("close") * F.col("volume")).over(w)).withColumn("n", F.count("*").over(w))
    return b.where("close >= 5 and n >= 15 and dollar >= 20000").select("ticker", "day", F.round("dollar", 4).alias("dollar"))


@query("""SELECT c_custkey, coalesce(c_acctbal >= 300 AND c_mktsegment IS NOT NULL, false) AS eligible FROM customer""")
def pf10_eligibility(spark, d):
    return load(spark, d, "customer").select("c_custkey", F.coalesce((F.col("c_acctbal") >= 300) & F.col("c_mktsegment").isNotNull(), F.lit(False)).alias("eligible"))


@query(f"WITH {STORIES}, u AS (SELECT story_id, CASE WHEN story_id % 7 = 0 THEN NULL ELSE day END AS day FROM stories) SELECT story_id FROM u WHERE day >= DATE '2024-02-10' OR day IS NULL")
def pf11_keep_undated(spark, d):
    s = stories(spark, d).select("story_id", F.when(F.col("story_id") % 7 != 0, F.col("day")).alias("day"))
    return s.where((F.col("day") >= F.lit("2024-02-10").cast("date")) | F.col("day").isNull()).select("story_id")


@query("SELECT doc_id, CAST(quality AS BOOLEAN) AS good, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END AS state FROM labels")
def pf12_flags(spark, d):
    return load(spark, d, "labels").select("doc_id", F.col("quality").cast("boolean").alias("good"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("plain").alias("state"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS INTEGER) AS pos FROM orders
QUALIFY pos <= 50""")
def pf13_case_order(spark, d):
    order = [F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2), F.desc("o_totalprice"), F.col("o_orderkey")]
    top = load(spark, d, "orders").orderBy(*order).limit(50)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).alias("pos"))


@query("SELECT doc_id, coalesce(nullif(trim(substr(text, 1, 30)), ''), nullif(source, ''), 'untitled') AS headline FROM documents")
def pf14_fallbacks(spark, d):
    return load(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.trim(F.substring("text", 1, 30)), F.lit("")), F.nullif("source", F.lit("")), F.lit("untitled")).alias("headline"))


@query("""WITH opened AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), dwell AS (SELECT user_id, sum(value) AS s FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT u.user_id, o.user_id IS NOT NULL AS opened, round(coalesce(s, 0), 4) AS dwell FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN opened o USING (user_id) LEFT JOIN dwell USING (user_id)""")
def pf15_signals_view(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "click").alias("opened"),
        F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "view", F.col("value"))), F.lit(0.0)), 4).alias("dwell"),
    )


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE round(s_acctbal, 4) END AS required, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE round(s_acctbal, 4) END AS optional FROM supplier""")
def pf16_non_finite(spark, d):
    from tessera.functions.scoring import finite_or

    x = F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.round("s_acctbal", 4))
    return load(spark, d, "supplier").select("s_suppkey", finite_or(x, F.lit(0.0)).alias("required"), finite_or(x, F.lit(None).cast("double")).alias("optional"))


@query(f"WITH {STORIES} SELECT story_id, CAST(CASE WHEN sector = 'fr' THEN 0 ELSE 1 END AS INTEGER) AS pri FROM stories WHERE sector = 'fr' OR (importance >= 7 AND day BETWEEN DATE '2024-02-26' AND DATE '2024-02-29')")
def pf17_or_feed(spark, d):
    return stories(spark, d).where("sector = 'fr' or (importance >= 7 and day between date'2024-02-26' and date'2024-02-29')").select("story_id", F.when(F.col("sector") == "fr", 0).otherwise(1).alias("pri"))


@query("""SELECT split_part(p_type, ' ', 1) AS head, arg_max(brand, (n, brand)) AS main FROM (SELECT p_type, p_brand AS brand, count(*) AS n FROM part WHERE p_type LIKE 'ST%' GROUP BY ALL) GROUP BY 1
""".replace("arg_max(brand, (n, brand))", "max_by(brand, n * 1000 + CAST(regexp_extract(brand, '[0-9]+') AS INTEGER))"))
def pf18_prefix(spark, d):
    n = load(spark, d, "part").where(F.col("p_type").startswith("ST")).groupBy("p_type", F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return n.groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head")).agg(F.max_by("brand", F.col("n") * 1000 + F.regexp_extract("brand", "[0-9]+", 0).cast("int")).alias("main"))


@query(f"WITH {MENTIONS} SELECT sector, max(day) AS last, date_diff('day', max(day), DATE '{AS_OF}') >= 1 AS due FROM mentions GROUP BY sector")
def pf19_due(spark, d):
    return mentions(spark, d).groupBy("sector").agg(F.max("day").alias("last"), (F.date_diff(today(), F.max("day")) >= 1).alias("due"))


# ---- joins ------------------------------------------------------------------------------


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def jn1_inner_chain(spark, d):
    o, c, n = (load(spark, d, t) for t in ("orders", "customer", "nation"))
    # orders are summed by customer before the joins: the only shuffle carries one row for each customer
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return per.join(c, per["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000")
def jn2_left(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 250000")
    c = load(spark, d, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_shipdate >= TIMESTAMP '2001-10-01' GROUP BY s_suppkey")
def jn3_left_on(spark, d):
    recent = load(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'2001-10-01'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = load(spark, d, "supplier")
    return s.join(recent, s["s_suppkey"] == recent["l_suppkey"], "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def jn4_not_in(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders").select("o_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT a.event_id FROM events a WHERE a.event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts > a.ts)")
def jn5_not_exists(spark, d):
    e = load(spark, d, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.where("event_type = 'signup'").join(last, "user_id", "left").where("last is null or last <= ts").select("event_id")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def jn6_left_is_null(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query(f"WITH {MENTIONS} SELECT entity_id, count(*) AS n FROM mentions m WHERE day < DATE '2024-01-24' AND NOT EXISTS (SELECT 1 FROM mentions x WHERE x.entity_id = m.entity_id AND x.day >= DATE '2024-01-24' AND x.sector = 'error') GROUP BY entity_id HAVING count(*) >= 80")
def jn7_quiet(spark, d):
    m = mentions(spark, d)
    now = m.where("day >= date'2024-01-24' and sector = 'error'").select("entity_id")
    return m.where("day < date'2024-01-24'").groupBy("entity_id").agg(F.count("*").alias("n")).where("n >= 80").join(now, "entity_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def jn8_exists(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1) AS hot FROM part")
def jn9_in_key(spark, d):
    hot = load(spark, d, "lineitem").where("l_quantity = 50 and l_discount = 0.1").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("h", F.lit(True))
    return load(spark, d, "part").join(hot, "p_partkey", "left").select("p_partkey", F.col("h").isNotNull().alias("hot"))


@query(f"""WITH {MENTIONS}, t AS (SELECT DISTINCT entity_id, sector, day FROM mentions WHERE sector IN ('signup', 'purchase'))
SELECT a.entity_id, a.day AS day, count(*) AS n FROM t a JOIN t b ON a.entity_id = b.entity_id AND a.sector = 'signup' AND b.sector = 'purchase' AND date_diff('day', a.day, b.day) BETWEEN 1 AND 5 GROUP BY ALL""")
def jn10_interval(spark, d):
    t = mentions(spark, d).where("sector in ('signup', 'purchase')").select("entity_id", "sector", "day").distinct()
    a = t.where("sector = 'signup'").select("entity_id", "day")
    b = t.where("sector = 'purchase'").select("entity_id", F.col("day").alias("then"))
    return R.interval_join(a, b, ["entity_id"], "day", "then", 1, 5).groupBy("entity_id", "day").agg(F.count("*").alias("n"))


@query("SELECT least(a.l_partkey, b.l_partkey) AS lo, greatest(a.l_partkey, b.l_partkey) AS hi, count(*) AS strength FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) >= 2")
def jn11_cooccurrence(spark, d):
    l = load(spark, d, "lineitem").select("l_orderkey", "l_partkey")  # noqa: E741
    return l.join(l.withColumnRenamed("l_partkey", "hi"), "l_orderkey").where("l_partkey < hi").groupBy(F.col("l_partkey").alias("lo"), "hi").agg(F.count("*").alias("strength")).where("strength >= 2")


EDGES = "e AS (SELECT l_partkey AS a, l_suppkey + 100000 AS b, count(*) AS strength FROM lineitem GROUP BY ALL)"


def _edges(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100000).alias("b")).agg(F.count("*").alias("strength"))


@query(f"""WITH {EDGES}, u AS (SELECT a AS node, b AS other, strength FROM e UNION ALL SELECT b, a, strength FROM e)
SELECT node, other, strength FROM u WHERE strength >= 3 QUALIFY row_number() OVER (PARTITION BY node ORDER BY strength DESC, other) <= 5""")
def jn12_neighbours(spark, d):
    return R.latest(R.both_ways(_edges(spark, d), "a", "b").where("strength >= 3"), ["node"], [F.desc("strength"), F.col("other")], 5)


@query(f"""WITH {BARS}, p AS (SELECT ticker, CAST(day + 10 AS DATE) AS at FROM bars)
SELECT p.ticker, p.at, b.day AS asof_at, round(b.close, 6) AS asof_close FROM p ASOF JOIN bars b ON p.ticker = b.ticker AND p.at >= b.day""")
def jn14_asof_backward(spark, d):
    b = bars(spark, d)
    return R.as_of(b.select("ticker", F.date_add("day", 10).alias("at")), b, "ticker", "at", "day", ["close"]).withColumn("asof_close", F.round("asof_close", 6))


@query(f"""WITH {BARS}, p AS (SELECT ticker, CAST(day + 10 AS DATE) AS at FROM bars)
SELECT p.ticker, p.at, b.day AS asof_at, round(b.close, 6) AS asof_close FROM p ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.at <= b.day""")
def jn16_asof_forward(spark, d):
    b = bars(spark, d)
    return R.as_of(b.select("ticker", F.date_add("day", 10).alias("at")), b, "ticker", "at", "day", ["close"], forward=True).withColumn("asof_close", F.round("asof_close", 6))


@query(f"""WITH {BARS}, w AS (SELECT ticker, day, lead(open) OVER x AS entry, lead(close, 3) OVER x AS exit FROM bars WINDOW x AS (PARTITION BY ticker ORDER BY day))
SELECT ticker, day, round(exit / entry - 1, 6) AS ret FROM w WHERE entry IS NOT NULL AND exit IS NOT NULL""")
def jn19_bars_ahead(spark, d):
    w = Window.partitionBy("ticker").orderBy("day")
    b = bars(spark, d).withColumn("entry", F.lead("open").over(w)).withColumn("exit", F.lead("close", 3).over(w))
    return b.where("entry is not null and exit is not null").select("ticker", "day", F.round(F.col("exit") / F.col("entry") - 1, 6).alias("ret"))


@query("""SELECT e.event_id, d.doc_id FROM (SELECT event_id, unnest([event_id % 1000, event_id % 777]) AS doc_id FROM events) e JOIN labels d ON e.doc_id = d.doc_id""")
def jn21_unnest(spark, d):
    e = load(spark, d, "events").select("event_id", F.explode(F.from_json(F.concat_ws("", F.lit("["), F.expr("event_id % 1000").cast("string"), F.lit(","), F.expr("event_id % 777").cast("string"), F.lit("]")), "array<bigint>")).alias("doc_id"))
    return e.join(load(spark, d, "labels"), "doc_id").select("event_id", "doc_id")


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS newest, count(*) AS n FROM orders GROUP BY o_custkey")
def jn23_latest_each(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest"), F.count("*").alias("n"))


@query(f"""WITH {MENTIONS} SELECT entity_id, round(avg(CASE WHEN day >= DATE '{AS_OF}' - 2 THEN sentiment END), 6) AS recent, round(avg(CASE WHEN day < DATE '{AS_OF}' - 2 THEN sentiment END), 6) AS base FROM mentions GROUP BY entity_id""")
def jn24_two_windows(spark, d):
    recent = F.col("day") >= F.date_sub(today(), 2)
    return mentions(spark, d).groupBy("entity_id").agg(F.round(F.avg(F.when(recent, F.col("sentiment"))), 6).alias("recent"), F.round(F.avg(F.when(~recent, F.col("sentiment"))), 6).alias("base"))


@query("SELECT n_nationkey, s_suppkey, s_acctbal FROM nation LEFT JOIN (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1) ON s_nationkey = n_nationkey")
def jn25_best_of(spark, d):
    best = R.latest(load(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")])
    n = load(spark, d, "nation")
    return n.join(best, n["n_nationkey"] == best["s_nationkey"], "left").select("n_nationkey", "s_suppkey", "s_acctbal")


@query("""WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part)
SELECT word, count(*) AS parts FROM w WHERE word <> '' GROUP BY word""")
def jn29_keyword_counts(spark, d):
    w = load(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where("word <> ''").distinct()
    return w.groupBy("word").agg(F.count("*").alias("parts"))


@query(f"""WITH {BARS}, r AS (SELECT *, lead(close) OVER (PARTITION BY ticker ORDER BY day) / close - 1 AS fwd, close * volume AS dollar FROM bars),
q AS (SELECT *, CAST(least(floor((rank() OVER (PARTITION BY day ORDER BY dollar) + (count(*) OVER (PARTITION BY day, dollar) - 1) / 2.0) / count(*) OVER (PARTITION BY day) * 5), 4) AS INTEGER) AS quintile FROM r WHERE fwd IS NOT NULL),
m AS (SELECT day, quintile, avg(least(greatest(fwd, -0.5), 0.5)) AS peer FROM q GROUP BY ALL)
SELECT q.ticker, q.day, q.quintile, round(q.fwd - m.peer, 6) AS excess FROM q JOIN m ON q.day = m.day AND q.quintile = m.quintile""")
def jn32_quintile_benchmark(spark, d):
    w = Window.partitionBy("ticker").orderBy("day")
    r = bars(spark, d).withColumn("fwd", F.lead("close").over(w) / F.col("close") - 1).withColumn("dollar", F.expr("close * volume")).where("fwd is not null")
    day = Window.partitionBy("day")
    pct = (F.rank().over(day.orderBy("dollar")) + (F.count("*").over(Window.partitionBy("day", "dollar")) - 1) / 2.0) / F.count("*").over(day)
    q = r.withColumn("quintile", F.least(F.floor(pct * 5), F.lit(4)).cast("int"))
    m = q.groupBy("day", "quintile").agg(F.avg(F.least(F.greatest("fwd", F.lit(-0.5)), F.lit(0.5))).alias("peer"))
    return q.join(m, ["day", "quintile"]).select("ticker", "day", "quintile", F.round(F.col("fwd") - F.col("peer"), 6).alias("excess"))


@query("""WITH b AS (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
SELECT a.c, CAST(a.y AS INTEGER) AS y, CAST(a.m AS INTEGER) AS m FROM b a JOIN b p ON p.c = a.c AND p.m = a.m AND p.y = a.y - 1 JOIN b q ON q.c = a.c AND q.m = a.m AND q.y = a.y - 2""")
def jn33_routine(spark, d):
    b = base = load(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    for back in (1, 2):
        b = b.join(base.select("c", (F.col("y") + back).alias("y"), "m"), ["c", "y", "m"], "left_semi")
    return b


@query("SELECT doc_id, max_state, n FROM (SELECT d.doc_id, max(l.quality) AS max_state, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id)")
def jn37_scalar_list(spark, d):
    l = load(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("max_state"), F.count("*").alias("n"))  # noqa: E741
    return load(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", "max_state", F.coalesce("n", F.lit(0)).alias("n"))
