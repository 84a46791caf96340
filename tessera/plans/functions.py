"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import dates, scoring, text
from tessera.plans.catalog import query
from tessera.plans.views import AS_OF, MENTIONS, mentions, today
from tessera.session import load



@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS norm, sha256(trim(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))) AS hash FROM pages")
def fn1_normalize_title(spark, d):
    return load(spark, d, "pages").select("page_id", text.normalize_title(F.col("url")).alias("norm"), text.title_hash(F.col("url")).alias("hash"))


@query("SELECT page_id, sha256(string_split(lower(regexp_replace(trim(url), '/+$', '')), '?')[1]) AS hash FROM pages")
def fn2_hash_url(spark, d):
    return load(spark, d, "pages").select("page_id", text.hash_url(F.col("url")).alias("hash"))


RULES = [("versus| vs |compare", "comparative"), ("should|recommend", "advisory"), ("today|breaking|just", "breaking"), ("why|how|impact", "analytical")]
CASES = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{r}'" for p, r in RULES)


@query(f"SELECT doc_id, CASE {CASES} ELSE 'general' END AS kind FROM documents")
def fn4_query_type(spark, d):
    return load(spark, d, "documents").select("doc_id", text.first_rule(F.col("text"), RULES, "general").alias("kind"))


TOPICS = {"markets": ["tion", "price"], "science": ["heit", "keit"], "world": ["que", "mente"]}


@query("""WITH c AS (SELECT doc_id, CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'price') AS INTEGER) AS a, CAST(contains(lower(text), 'heit') AS INTEGER) + CAST(contains(lower(text), 'keit') AS INTEGER) AS b, CAST(contains(lower(text), 'que') AS INTEGER) + CAST(contains(lower(text), 'mente') AS INTEGER) AS c FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN c = greatest(a, b, c) THEN 'world' WHEN b = greatest(a, b, c) THEN 'science' ELSE 'markets' END AS topic FROM c""")
def fn5_topic(spark, d):
    return load(spark, d, "documents").select("doc_id", text.last_max_topic(F.col("text"), TOPICS).alias("topic"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_extendedprice > 50000 THEN 'big_sale' WHEN l_returnflag = 'R' THEN 'sale' WHEN l_returnflag = 'A' THEN 'grant' ELSE 'buy' END AS label, CASE WHEN l_returnflag = 'R' AND l_extendedprice > 50000 THEN -1.0 WHEN l_returnflag = 'R' THEN -0.5 WHEN l_returnflag = 'A' THEN 0.1 ELSE 1.0 END AS weight FROM lineitem")
def fn6_trade_class(spark, d):
    big = (F.col("l_returnflag") == "R") & (F.col("l_extendedprice") > 50000)
    pick = lambda a, b, c, e: F.when(big, a).when(F.col("l_returnflag") == "R", b).when(F.col("l_returnflag") == "A", c).otherwise(e)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pick("big_sale", "sale", "grant", "buy").alias("label"), pick(-1.0, -0.5, 0.1, 1.0).alias("weight"))


@query("""WITH i AS (SELECT event_id, [event_id % 9, event_id % 5, event_id % 4] AS items FROM events)
SELECT event_id, coalesce(list_filter(list_transform(items, lambda x: CASE x WHEN 1 THEN 'agreement' WHEN 2 THEN 'results' WHEN 5 THEN 'officers' WHEN 8 THEN 'other' END), lambda y: y IS NOT NULL)[1], 'routine') AS class FROM i""")
def fn7_filing_items(spark, d):
    """The class of the first item that has one."""
    items = F.array(F.expr("event_id % 9"), F.expr("event_id % 5"), F.expr("event_id % 4"))
    named = F.create_map(*[F.lit(x) for x in (1, "agreement", 2, "results", 5, "officers", 8, "other")])
    classes = F.filter(F.transform(items, lambda x: F.element_at(named, x.cast("int"))), lambda y: y.isNotNull())
    return load(spark, d, "events").select("event_id", F.coalesce(F.get(classes, F.lit(0)), F.lit("routine")).alias("class"))


@query("SELECT p_partkey, regexp_extract(p_type, '^([^ (]*)', 1) AS grp, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'stop' WHEN starts_with(p_type, 'SMALL') THEN 'target' ELSE 'other' END AS kind FROM part")
def fn10_reasons(spark, d):
    t = F.col("p_type")
    return load(spark, d, "part").select("p_partkey", text.reason_group(t).alias("grp"), F.when(t.startswith("STANDARD"), "stop").when(t.startswith("SMALL"), "target").otherwise("other").alias("kind"))


@query(r"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gsi'), '<[^>]+>', ' ', 'gs') AS t FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM x)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\f\r\v]+', ' ', 'g')) AS body FROM e""")
def fn12_strip_tags(spark, d):
    return load(spark, d, "pages").select("page_id", text.strip_tags(F.col("html")).alias("body"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 49) || '…' ELSE text END AS clipped FROM documents")
def fn13_clip(spark, d):
    return load(spark, d, "documents").select("doc_id", text.clip(F.col("text"), 50).alias("clipped"))


@query(r"SELECT item_id, list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and'))) AS words FROM benchmark")
def fn14_keywords(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_sort(text.extract_keywords(F.col("text"), ["the", "and"])).alias("words"))


@query("SELECT event_id, nullif(regexp_extract('note: ' || props || ' end', '(?s)\\{.*\\}', 0), '') AS envelope FROM events".replace("\\\\", "\\"))
def fn15_json_envelope(spark, d):
    return load(spark, d, "events").select("event_id", text.json_envelope(F.concat(F.lit("note: "), "props", F.lit(" end"))).alias("envelope"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.none') AS none FROM events")
def fn17_json_paths(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("""SELECT user_id, '[' || string_agg(k, ',' ORDER BY event_id) || ']' AS ks FROM (SELECT user_id, event_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY user_id""")
def fn18_json_rebuild(spark, d):
    e = load(spark, d, "events").select("user_id", F.struct("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).alias("s"))
    return e.groupBy("user_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["k"])).alias("ks"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 12.5 WHEN 1 THEN 7 WHEN 2 THEN NULL ELSE 3 END AS num, CASE WHEN event_id % 2 = 0 THEN ['Yes', 'No'] ELSE ['Up', 'Down'] END AS names FROM events""")
def fn20_lenient_json(spark, d):
    """Numbers that may be strings, arrays that may be strings holding an array."""
    raw = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"p":"12.5","o":["Yes","No"]}' WHEN 1 THEN '{"p":7,"o":"[\\\\"Up\\\\",\\\\"Down\\\\"]"}' WHEN 2 THEN '{"p":"n/a","o":["Yes","No"]}' ELSE '{"p":3,"o":["Up","Down"]}' END""")
    e = load(spark, d, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", F.get_json_object("raw", "$.p").try_cast("double").alias("num"), F.from_json(F.get_json_object("raw", "$.o"), "array<string>").alias("names"))


@query("SELECT o_orderkey, CAST(substr(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END, 1, 10) AS VARCHAR) AS raw, TRY_CAST(substr(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END, 1, 10) AS DATE) AS day FROM orders")
def fn21_parse_day(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_orderdate").cast("string"))
    return load(spark, d, "orders").select("o_orderkey", F.substring(raw, 1, 10).alias("raw"), dates.parse_day(raw).alias("day"))


PHRASES = [("2025-03-04", "2025-03-04"), ("within 10 days", "2024-02-09"), ("2 weeks", "2024-02-13"), ("3 months", "2024-04-30"), ("1 year", "2025-01-30"), ("Q3 2025", "2025-09-30"), ("soon", "2024-02-29"), ("long term", "2024-07-28"), ("whenever", "2024-04-29")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', DATE '{x}')" for p, x in PHRASES) + ") t(phrase, due)")
def fn22_timeframes(spark, d):
    p = spark.createDataFrame([(p,) for p, _ in PHRASES], "phrase string")
    return p.select("phrase", dates.parse_timeframe(F.col("phrase"), today()).alias("due"))


@query("""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, list_filter(generate_series(day + INTERVAL 1 DAY, day + INTERVAL 10 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)[3]::DATE AS third, CAST(len(list_filter(generate_series(day + INTERVAL 1 DAY, day + INTERVAL 9 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS INTEGER) AS between9 FROM o""")
def fn23_trading_days(spark, d):
    o = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.select("day", dates.add_trading_days(F.col("day"), 3).alias("third"), dates.weekdays_between(F.col("day"), F.date_add("day", 9)).alias("between9"))


@query("SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400) AS BIGINT) AS age FROM events")
def fn26_age_days(spark, d):
    return load(spark, d, "events").select("event_id", F.floor((F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 86400).alias("age"))


@query(f"""WITH {MENTIONS}, a AS (SELECT mention_id, date_diff('day', day, DATE '{AS_OF}') AS age, k FROM mentions)
SELECT mention_id, round(CASE WHEN age <= 0 THEN 1 ELSE pow(0.5, age / 14.0) END, 6) AS recency, round(CASE WHEN k <= 0 THEN 0 ELSE 1 - exp(-k / 50.0) END, 6) AS signal FROM a""")
def fn28_recency_and_signal(spark, d):
    return mentions(spark, d).select("mention_id", F.round(scoring.recency(F.date_diff(today(), "day"), 14.0), 6).alias("recency"), F.round(scoring.saturate(F.col("k"), 50.0), 6).alias("signal"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn31_cosine(spark, d):
    e = load(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


W8 = [0.3411, 0.0, 0.3411, 0.2636, 0.0543, 0.0, 0.0, 0.0]  # fixed values: the live strategy's weights


@query(f"""WITH {MENTIONS}, g AS (SELECT entity_id, count(*) FILTER (WHERE sector = 'view') AS v, count(*) FILTER (WHERE sector = 'purchase') AS p, count(*) FILTER (WHERE sector = 'signup') AS s, count(*) FILTER (WHERE sector = 'click') AS c, count(DISTINCT sector) AS div FROM mentions GROUP BY 1),
n AS (SELECT entity_id, div, 1 - exp(-v / 80.0) AS a, 1 - exp(-p / 200.0) AS b, 1 - exp(-s / 300.0) AS e, 1 - exp(-c / 90.0) AS f FROM g),
x AS (SELECT *, greatest(0, least(1, 0.3411 * a + 0.3411 * b + 0.2636 * e + 0.0543 * f)) AS score, (a > 0.3)::INT + (b > 0.3)::INT + (e > 0.3)::INT + (f > 0.3)::INT AS positive FROM n)
SELECT entity_id, round(score, 6) AS score, positive, (positive >= 2 AND div >= 2) OR score >= 0.4 AS converged FROM x WHERE score >= 0.01""")
def cp10_convergence(spark, d):
    """Convergence scoring: saturated dimensions times weights, positive dimensions and the converged flag."""
    n = lambda s: F.count_if(F.col("sector") == s)
    g = mentions(spark, d).groupBy("entity_id").agg(n("view").alias("v"), n("purchase").alias("p"), n("signup").alias("s"), n("click").alias("c"), F.count_distinct("sector").alias("div"))
    zero = F.lit(0.0)
    dims = [scoring.saturate(F.col("v"), 80.0), zero, scoring.saturate(F.col("p"), 200.0), scoring.saturate(F.col("s"), 300.0), scoring.saturate(F.col("c"), 90.0), zero, zero, zero]
    score, positive, converged = scoring.weighted_score(dims, W8, F.col("div"))
    return g.select("entity_id", score.alias("raw"), positive.alias("positive"), converged.alias("converged")).where("raw >= 0.01").select("entity_id", F.round("raw", 6).alias("score"), "positive", "converged")


@query("""WITH m(model, cost) AS (VALUES ('1-', 0.5), ('2-HI', 0.25), ('2', 0.1), ('', 0.01)), r AS (SELECT row_number() OVER () AS i, * FROM m)
SELECT o_orderkey, (SELECT arg_min(cost, i) FROM r WHERE starts_with(o_orderpriority, model)) AS cost FROM orders""".replace("(VALUES ('1-', 0.5), ('2-HI', 0.25), ('2', 0.1), ('', 0.01))", "(SELECT * FROM (VALUES ('1-', 0.5::DOUBLE), ('2-HI', 0.25::DOUBLE), ('2', 0.1::DOUBLE), ('', 0.01::DOUBLE)) v(a, b))"))
def fn39_cost(spark, d):
    """First price row whose prefix fits, from a price table of fixed size kept as an expression."""
    out = F.lit(None).cast("double")
    for prefix, cost in reversed([("1-", 0.5), ("2-HI", 0.25), ("2", 0.1), ("", 0.01)]):
        out = F.when(F.col("o_orderpriority").startswith(prefix), F.lit(cost)).otherwise(out)
    return load(spark, d, "orders").select("o_orderkey", out.alias("cost"))


@query("SELECT lang, round(least(1.3, 1 + 0.3 * count(*) / sum(count(*)) OVER ()), 6) AS affinity FROM documents GROUP BY lang")
def fn41_affinity(spark, d):
    n = load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("lang", F.round(F.least(F.lit(1.3), 1 + 0.3 * F.col("n") / F.col("t")), 6).alias("affinity"))


@query("SELECT event_id, ts < TIMESTAMP '2024-01-29 12:00:00' AS stale FROM events")
def fn43_stale(spark, d):
    return load(spark, d, "events").select("event_id", (F.col("ts") < F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")).alias("stale"))


@query("SELECT o_orderkey, format('{:.0f}%', round(o_totalprice / 5000, 0)) AS odds, CASE WHEN o_totalprice >= 1000 THEN format('{:.1f}k', round(o_totalprice / 1000, 1)) ELSE format('{:.0f}', o_totalprice) END AS volume FROM orders")
def fn44_labels(spark, d):
    p = F.col("o_totalprice")
    return load(spark, d, "orders").select("o_orderkey", F.format_string("%.0f%%", F.round(p / 5000, 0)).alias("odds"), F.when(p >= 1000, F.format_string("%.1fk", F.round(p / 1000, 1))).otherwise(F.format_string("%.0f", p)).alias("volume"))
