"""Queries of window functions, sorts and limits, set operations and dedup."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import ordered, search
from tessera.operators import relational as R
from tessera.plans.catalog import query
from tessera.plans.views import AS_OF, BARS, EVERY, MENTIONS, STORIES, bars, by_day, mentions, stories, today
from tessera.session import load



@query(f"WITH {MENTIONS} SELECT entity_id, mention_id, sector FROM mentions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, mention_id) = 1")
def wn1_latest(spark, d):
    return R.latest(mentions(spark, d), ["entity_id"], [F.desc("ts"), F.col("mention_id")]).select("entity_id", "mention_id", "sector")


@query(f"WITH {BARS} SELECT ticker, arg_max(day, day) AS day, round(arg_max(close, day), 6) AS close FROM bars GROUP BY ticker")
def wn2_latest_price(spark, d):
    return bars(spark, d).groupBy("ticker").agg(F.max("day").alias("day"), F.round(F.max_by("close", "day"), 6).alias("close"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey) = 1")
def wn3_two_keys(spark, d):
    return R.latest(load(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"""WITH {BARS}, t AS (SELECT *, lag(close) OVER w AS pc, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day)),
r AS (SELECT *, CASE WHEN pc IS NULL THEN NULL ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM t)
SELECT ticker, day, round(CASE WHEN i >= 15 THEN avg(tr) OVER (PARTITION BY ticker ORDER BY day ROWS 13 PRECEDING) ELSE 0 END, 6) AS atr,
round(CASE WHEN i >= 15 THEN avg(tr) OVER (PARTITION BY ticker ORDER BY day ROWS 13 PRECEDING) / close ELSE 0 END, 6) AS atr_pct FROM r""")
def wn7_atr(spark, d):
    """ATR(14): the mean of the last 14 true ranges, 0 with fewer than 15 bars; and as a share of the close."""
    b = bars(spark, d).withColumn("pc", F.lag("close").over(by_day())).withColumn("i", F.row_number().over(by_day()))
    b = b.withColumn("tr", F.when(F.col("pc").isNotNull(), F.greatest(F.expr("high - low"), F.abs(F.expr("high - pc")), F.abs(F.expr("low - pc")))))
    b = b.withColumn("atr", F.when(F.col("i") >= 15, F.avg("tr").over(by_day().rowsBetween(-13, 0))).otherwise(0.0))
    return b.select("ticker", "day", F.round("atr", 6).alias("atr"), F.round(F.col("atr") / F.col("close"), 6).alias("atr_pct"))


@query(f"""WITH {BARS}, t AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS pc FROM bars), r AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM t WHERE pc IS NOT NULL AND day >= DATE '2000-09-01')
SELECT ticker, CASE WHEN count(*) >= 8 THEN round(avg(tr), 6) END AS atr FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY day DESC) <= 14) GROUP BY ticker""")
def wn8_atr_tolerant(spark, d):
    b = bars(spark, d).withColumn("pc", F.lag("close").over(by_day())).where("pc is not null and day >= date'2000-09-01'")
    b = b.withColumn("tr", F.greatest(F.expr("high - low"), F.abs(F.expr("high - pc")), F.abs(F.expr("low - pc"))))
    return R.latest(b, ["ticker"], [F.desc("day")], 14).groupBy("ticker").agg(F.when(F.count("*") >= 8, F.round(F.avg("tr"), 6)).alias("atr"))


@query(f"WITH {BARS} SELECT ticker, day, round(avg(close) OVER (PARTITION BY ticker ORDER BY day ROWS 9 PRECEDING), 6) AS sma, CASE WHEN close < avg(close) OVER (PARTITION BY ticker ORDER BY day ROWS 9 PRECEDING) THEN 0.5 ELSE 1.0 END AS size FROM bars")
def wn10_sma_regime(spark, d):
    sma = F.avg("close").over(by_day().rowsBetween(-9, 0))
    return bars(spark, d).select("ticker", "day", F.round(sma, 6).alias("sma"), F.when(F.col("close") < sma, 0.5).otherwise(1.0).alias("size"))


@query(f"""WITH {BARS} SELECT ticker, day, round(stddev_samp(close) OVER (PARTITION BY ticker ORDER BY day ROWS 19 PRECEDING), 6) AS vol, round(avg(volume) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS prior_volume FROM bars""")
def wn12_rolling(spark, d):
    return bars(spark, d).select("ticker", "day", F.round(F.stddev_samp("close").over(by_day().rowsBetween(-19, 0)), 6).alias("vol"), F.round(F.avg("volume").over(by_day().rowsBetween(-20, -1)), 6).alias("prior_volume"))


@query(f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day)),
v AS (SELECT *, stddev_samp(ret) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sd, avg(volume) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS av FROM r)
SELECT ticker, day, round(ret / sd, 6) AS z FROM v WHERE sd > 0 AND volume >= 1.5 * av""")
def wn13_shock(spark, d):
    prior = by_day().rowsBetween(-20, -1)
    r = bars(spark, d).withColumn("ret", F.col("close") / F.lag("close").over(by_day()) - 1)
    v = r.withColumn("sd", F.stddev_samp("ret").over(prior)).withColumn("av", F.avg("volume").over(prior))
    return v.where("sd > 0 and volume >= 1.5 * av").select("ticker", "day", F.round(F.col("ret") / F.col("sd"), 6).alias("z"))


@query(f"WITH {BARS} SELECT ticker, day, round((rank() OVER (PARTITION BY day ORDER BY volume) + (count(*) OVER (PARTITION BY day, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY day), 6) AS pct FROM bars")
def wn14_percentile(spark, d):
    day = Window.partitionBy("day")
    return bars(spark, d).select("ticker", "day", F.round((F.rank().over(day.orderBy("volume")) + (F.count("*").over(Window.partitionBy("day", "volume")) - 1) / 2.0) / F.count("*").over(day), 6).alias("pct"))


@query(f"""WITH {MENTIONS}, m AS (SELECT DISTINCT sector, day, entity_id FROM mentions)
SELECT a.sector, a.day, count(DISTINCT b.entity_id) AS entities FROM (SELECT DISTINCT sector, day FROM m) a JOIN m b ON a.sector = b.sector AND b.day BETWEEN a.day - 5 AND a.day GROUP BY ALL""")
def wn17_trailing_distinct(spark, d):
    """Distinct entities of the last days: daily sets first, then a set union over the range window."""
    daily = mentions(spark, d).groupBy("sector", "day").agg(F.collect_set("entity_id").alias("s")).withColumn("n", F.unix_date("day"))
    w = Window.partitionBy("sector").orderBy("n").rangeBetween(-5, 0)
    return daily.select("sector", "day", F.size(F.array_distinct(F.flatten(F.collect_list("s").over(w)))).cast("bigint").alias("entities"))


@query(f"""WITH {MENTIONS}, m AS (SELECT sector, day, sum(k) AS v, count(*) AS n FROM mentions GROUP BY ALL)
SELECT sector, day FROM (SELECT *, sum(v) OVER w AS tv, sum(n) OVER w AS tn FROM m WINDOW w AS (PARTITION BY sector ORDER BY day RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW)) WHERE tn >= 2 AND tv >= 15000""")
def wn18_clusters(spark, d):
    m = mentions(spark, d).groupBy("sector", "day").agg(F.sum("k").alias("v"), F.count("*").alias("n")).withColumn("i", F.unix_date("day"))
    w = Window.partitionBy("sector").orderBy("i").rangeBetween(-3, 0)
    return m.withColumn("tv", F.sum("v").over(w)).withColumn("tn", F.sum("n").over(w)).where("tn >= 2 and tv >= 15000").select("sector", "day")


@query(f"""WITH RECURSIVE {BARS}, s AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i, close > open AS up FROM bars), u AS (SELECT ticker, i FROM s WHERE up),
k AS (SELECT ticker, min(i) AS i FROM u GROUP BY ticker UNION ALL SELECT k.ticker, (SELECT min(u.i) FROM u WHERE u.ticker = k.ticker AND u.i >= k.i + 10) FROM k WHERE EXISTS (SELECT 1 FROM u WHERE u.ticker = k.ticker AND u.i >= k.i + 10))
SELECT ticker, i FROM k""")
def wn19_cooldown(spark, d):
    s = bars(spark, d).withColumn("i", F.row_number().over(by_day()).cast("bigint")).where("close > open").select("ticker", "i")
    return ordered.cooldown(s, "ticker", "i", 10)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS q FROM a WHERE r <= 2)
SELECT o_orderkey FROM b WHERE q <= 5""")
def wn20_caps(spark, d):
    return R.cap(load(spark, d, "orders"), [(["o_custkey"], 2), (["o_orderpriority"], 5)], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey")


@query(f"""WITH {BARS}, t AS (SELECT ticker, day AS entry, close AS price, lead(day, 6) OVER w AS until, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day))
SELECT t.ticker, t.entry, round(max(b.high) / any_value(t.price) - 1, 6) AS mfe, round(min(b.low) / any_value(t.price) - 1, 6) AS mae FROM t JOIN bars b ON b.ticker = t.ticker AND b.day > t.entry AND b.day <= t.until WHERE t.i % 12 = 1 GROUP BY ALL""")
def wn21_mfe_mae(spark, d):
    """Best and worst price of the next six bars: a frame of following rows, no join."""
    ahead = by_day().rowsBetween(1, 6)
    b = bars(spark, d).withColumn("hi", F.max("high").over(ahead)).withColumn("lo", F.min("low").over(ahead)).withColumn("until", F.lead("day", 6).over(by_day())).withColumn("i", F.row_number().over(by_day()))
    return b.where(f"i % {EVERY} = 1 and until is not null").select("ticker", F.col("day").alias("entry"), F.round(F.col("hi") / F.col("close") - 1, 6).alias("mfe"), F.round(F.col("lo") / F.col("close") - 1, 6).alias("mae"))


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM bars), e AS (SELECT ticker, i, close AS p FROM n WHERE i % 12 = 1),
h AS (SELECT e.ticker, e.i, n.i - e.i AS after, CASE WHEN n.low <= p * 0.85 THEN 'stop' WHEN n.high >= p * 1.15 THEN 'target' END AS hit FROM e JOIN n ON n.ticker = e.ticker AND n.i > e.i AND n.i <= e.i + 20)
SELECT ticker, i, coalesce(arg_min(hit, after), 'none') AS first_hit, min(after) AS bars_to FROM (SELECT ticker, i, hit, after FROM h WHERE hit IS NOT NULL UNION ALL SELECT ticker, i, NULL, NULL FROM e) GROUP BY ALL""")
def wn22_first_hit(spark, d):
    """Which of stop and target comes first within 20 bars of an entry (every EVERY-th bar); the stop wins a tie."""
    b = bars(spark, d).withColumn("i", F.row_number().over(by_day()).cast("bigint"))
    e = b.where(F.col("i") % EVERY == 1).select("ticker", "i", F.col("close").alias("p"))
    x = R.following(e, b, "ticker", "i", 20, ["low", "high"])
    hit = F.when(F.col("low") <= F.col("p") * 0.85, "stop").when(F.col("high") >= F.col("p") * 1.15, "target")
    x = x.select("ticker", "i", "after", hit.alias("hit")).unionByName(e.select("ticker", "i", F.lit(None).cast("bigint").alias("after"), F.lit(None).cast("string").alias("hit")))
    return x.groupBy("ticker", "i").agg(F.coalesce(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("after"))), F.lit("none")).alias("first_hit"), F.min(F.when(F.col("hit").isNotNull(), F.col("after"))).alias("bars_to"))


@query(f"""WITH {MENTIONS}, days AS (SELECT CAST(unnest(generate_series(DATE '{AS_OF}' - 13, DATE '{AS_OF}', INTERVAL 1 DAY)) AS DATE) AS day), k AS (SELECT DISTINCT entity_id FROM mentions)
SELECT k.entity_id, days.day, count(m.mention_id) AS n FROM k CROSS JOIN days LEFT JOIN mentions m ON m.entity_id = k.entity_id AND m.day = days.day GROUP BY ALL""")
def wn23_sparkline(spark, d):
    m = mentions(spark, d)
    dense = m.select("entity_id").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(today(), 13), today())))
    n = m.groupBy("entity_id", "day").agg(F.count("*").alias("n"))
    return dense.join(n, ["entity_id", "day"], "left").select("entity_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {STORIES}, u AS (SELECT sector, substr(summary, 1, 40) AS headline, max(day) AS day, min(story_id) AS story_id FROM stories GROUP BY ALL)
SELECT sector, headline, day FROM u QUALIFY row_number() OVER (PARTITION BY sector ORDER BY day DESC, story_id) <= 8""")
def wn24_top_distinct(spark, d):
    u = stories(spark, d).groupBy("sector", F.substring("summary", 1, 40).alias("headline")).agg(F.max("day").alias("day"), F.min("story_id").alias("story_id"))
    return R.latest(u, ["sector"], [F.desc("day"), F.col("story_id")], 8).select("sector", "headline", "day")


# ---- sorts, limits, top-k ---------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sl1_top(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id DESC LIMIT 450")
def sl2_nulls_last(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality").orderBy(F.desc_nulls_last("quality"), F.desc("doc_id")).limit(450)


@query("SELECT c_custkey FROM customer ORDER BY (c_mktsegment = 'BUILDING') DESC, c_acctbal DESC, c_custkey LIMIT 30")
def sl3_boolean_first(spark, d):
    return load(spark, d, "customer").orderBy(F.desc(F.col("c_mktsegment") == "BUILDING"), F.desc("c_acctbal"), "c_custkey").limit(30).select("c_custkey")


@query("SELECT l_partkey, count(*) * count(DISTINCT l_suppkey) AS product FROM lineitem GROUP BY l_partkey ORDER BY product DESC, l_partkey LIMIT 20")
def sl4_product_sort(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey").agg((F.count("*") * F.count_distinct("l_suppkey")).alias("product")).orderBy(F.desc("product"), "l_partkey").limit(20)


@query("""WITH r AS (SELECT p_partkey, p_retailprice AS s, max(p_retailprice) OVER () AS top, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part WHERE p_size = 7) SELECT p_partkey FROM r WHERE s >= 0.9 * top OR i <= 3""")
def sl9_relative_cutoff(spark, d):
    p = load(spark, d, "part").where("p_size = 7")
    least = p.agg((F.max("p_retailprice") * 0.9).alias("least"))
    top3 = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(3).select("p_partkey")
    return p.crossJoin(F.broadcast(least)).where("p_retailprice >= least").select("p_partkey").union(top3).distinct()


@query(f"""WITH {STORIES}, r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY importance DESC, story_id) AS i FROM stories),
s AS (SELECT story_id, row_number() OVER (ORDER BY (i <= 10) DESC, importance DESC, story_id) AS j FROM r) SELECT story_id FROM s WHERE j <= 50""")
def sl10_balanced(spark, d):
    """An equal share for each sector by score, then the best of the rest."""
    r = stories(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("importance"), "story_id")))
    return r.orderBy(F.desc(F.col("i") <= 10), F.desc("importance"), "story_id").limit(50).select("story_id")


@query(f"""WITH {BARS}, c AS (SELECT day, ticker, abs(close / open - 1) AS move, close > open AS rising, row_number() OVER (PARTITION BY day ORDER BY abs(close / open - 1) DESC, ticker) AS r, max(abs(close / open - 1)) OVER (PARTITION BY day) AS top FROM bars)
SELECT day, ticker FROM c QUALIFY row_number() OVER (PARTITION BY day ORDER BY (rising AND move >= top / 2) DESC, r) = 1""")
def sl11_lead_pick(spark, d):
    move = F.abs(F.col("close") / F.col("open") - 1)
    c = bars(spark, d).select("day", "ticker", move.alias("move"), (F.col("close") > F.col("open")).alias("rising")).withColumn("top", F.max("move").over(Window.partitionBy("day")))
    return R.latest(c, ["day"], [F.desc(F.col("rising") & (F.col("move") >= F.col("top") / 2)), F.desc("move"), F.col("ticker")]).select("day", "ticker")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part QUALIFY i <= 9) SELECT p_partkey, CAST(row_number() OVER (ORDER BY i % 2 = 0, CASE WHEN i % 2 = 1 THEN i ELSE -i END) AS INTEGER) AS pos FROM r""")
def sl12_edge_first(spark, d):
    """Odd ranks first, even ranks reversed at the end."""
    top = load(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(9)
    r = top.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("i"))
    return r.select("p_partkey", F.row_number().over(Window.orderBy(F.col("i") % 2 == 0, F.when(F.col("i") % 2 == 1, F.col("i")).otherwise(-F.col("i")))).alias("pos"))


@query("SELECT s_suppkey, s_nationkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) % 4 = 1")
def sl14_round_robin(spark, d):
    s = load(spark, d, "supplier").withColumn("i", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    return s.where("i % 4 = 1").select("s_suppkey", "s_nationkey")


@query(f"WITH {STORIES} SELECT story_id, sector FROM stories QUALIFY row_number() OVER (PARTITION BY sector ORDER BY importance DESC, story_id) <= 40")
def sl16_stratified(spark, d):
    return R.latest(stories(spark, d), ["sector"], [F.desc("importance"), F.col("story_id")], 40).select("story_id", "sector")


@query(f"""WITH {STORIES}, t AS (SELECT sector, importance, story_id, string_split(summary, '.')[1] AS title FROM stories QUALIFY row_number() OVER (PARTITION BY sector, title ORDER BY importance, story_id) = 1)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY sector ORDER BY importance, story_id) <= 25""")
def sl17_claims(spark, d):
    s = stories(spark, d).select("sector", "importance", "story_id", search.headline(F.col("summary")).alias("title"))
    return ordered.claim(s, "sector", ["importance", "story_id"], "story_id", "title", 25)


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def sl18_last_turns(spark, d):
    return R.latest(load(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn", "role")


# ---- set operations and dedup -------------------------------------------------------------


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def so1_union(spark, d):
    return load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).union(load(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")).distinct()


@query("SELECT doc_id AS id FROM documents UNION ALL SELECT -item_id - 1 FROM benchmark")
def so2_union_all(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("id")).unionByName(load(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("id")))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'")
def so3_difference(spark, d):
    o = load(spark, d, "orders")
    old = o.where("o_orderdate < timestamp_ntz'2000-01-01'").select("o_custkey")
    return o.where("o_orderdate >= timestamp_ntz'2000-01-01'").select("o_custkey").distinct().join(old, "o_custkey", "left_anti")


@query("""WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS s FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def so4_jaccard(spark, d):
    w = load(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    b = w.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("s").alias("t"))
    return w.join(b, "item_id").select(F.col("item_id").alias("a"), "b", F.round(F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t")), 6).alias("jaccard"))


@query("SELECT DISTINCT source, lang FROM documents")
def so5_distinct(spark, d):
    return load(spark, d, "documents").select("source", "lang").distinct()


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def so6_exact_dedup(spark, d):
    """First document of every text; grouped by a hash of the text so that the shuffle carries no texts."""
    return load(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("""WITH u AS (SELECT page_id, split_part(rtrim(trim(lower(url)), '/'), '?', 1) AS k FROM pages), f AS (SELECT min(page_id) AS page_id, k FROM u GROUP BY k) SELECT page_id FROM f WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.k = f.k AND x.page_id < 20)""")
def so7_ledger(spark, d):
    """Within the batch by url, then against the ledger of urls seen before (here the first pages)."""
    u = load(spark, d, "pages").select("page_id", text.hash_url(F.col("url")).alias("k"))
    ledger = u.where("page_id < 20").select("k").distinct()
    return u.groupBy("k").agg(F.min("page_id").alias("page_id")).join(ledger, "k", "left_anti").select("page_id")


@query(f"WITH {STORIES} SELECT substr(summary, 1, 30) AS topic, min(story_id) AS story_id, string_agg(DISTINCT sector, ',' ORDER BY sector) AS sectors FROM stories GROUP BY 1")
def so9_topic_collapse(spark, d):
    return stories(spark, d).groupBy(F.substring("summary", 1, 30).alias("topic")).agg(F.min("story_id").alias("story_id"), F.array_join(F.array_sort(F.collect_set("sector")), ",").alias("sectors"))


@query("""WITH c AS (SELECT event_id, unnest([event_id % 400, event_id % 300, event_id % 400]) AS cited FROM events)
SELECT event_id, list_sort(list_distinct(list(c.cited))) AS cited FROM c JOIN labels ON doc_id = c.cited GROUP BY event_id""")
def so11_citation_repair(spark, d):
    c = load(spark, d, "events").select("event_id", F.explode(F.array(F.expr("event_id % 400"), F.expr("event_id % 300"), F.expr("event_id % 400"))).alias("doc_id"))
    return c.distinct().join(load(spark, d, "labels"), "doc_id", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_list("doc_id")).alias("cited"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def so12_missing_ids(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("id")).join(load(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
