"""Streaming queries: the same operators over a stream of the events files, run to their end.

Results lie in the folder that driver and executors share (spark.checkpoint.dir).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.catalog import query
from tessera.session import load
from tessera.sources import scratch, ticks
from tessera.streaming import streams


def _events(spark: SparkSession, d: str) -> DataFrame:
    # a folder is read as a stream of its files; a glob also matches a table that is one file
    schema = load(spark, d, "events").schema
    return streams.stamped(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parque[t]"))


def _folder(spark: SparkSession) -> str:
    return scratch.folder(spark, "stream")


# what the watermark (an hour behind the last event) has closed; the last windows stay open
CLOSED = "m AS (SELECT max(ts) - INTERVAL 1 HOUR AS t FROM events)"
COUNTS = "count(*) AS n, round(sum(value), 4) AS total"


@query(f"""WITH {CLOSED}, w AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS "end" FROM events) SELECT event_type, start, "end", {COUNTS} FROM w, m WHERE "end" <= t GROUP BY event_type, start, "end" """)
def st3_tumbling(spark, d):
    """Days that the watermark has closed (the last, open one is not emitted)."""
    return _plain(streams.run_to_end(streams.tumbling(_events(spark, d), ["event_type"]), _folder(spark)))


@query(f"""WITH {CLOSED}, w AS (SELECT *, date_trunc('day', ts)::TIMESTAMP - to_days(k::INTEGER) AS start FROM events, range(0, 7) r(k)) SELECT event_type, start, start + INTERVAL 7 DAY AS "end", {COUNTS} FROM w, m WHERE start + INTERVAL 7 DAY <= t GROUP BY event_type, start, "end" """)
def st2_sliding(spark, d):
    return _plain(streams.run_to_end(streams.sliding(_events(spark, d), ["event_type"]), _folder(spark)))


@query(f"""WITH {CLOSED}, g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
x AS (SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP + INTERVAL 6 HOUR AS "end", {COUNTS} FROM s GROUP BY user_id, k) SELECT x.* FROM x, m WHERE "end" <= t""")
def st4_sessions(spark, d):
    return _plain(streams.run_to_end(streams.sessions(_events(spark, d), ["user_id"], "6 hours"), _folder(spark)))


def _plain(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def st6_dedup(spark, d):
    """First event of each (user, type) within the watermark; the ledger join makes it once for ever."""
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    return streams.run_to_end(streams.first_seen(e, ["user_id", "event_type", "day"]).select("user_id", "event_type"), _folder(spark)).distinct()


def _last(spark, d, stream, keys: list[str], mode="complete"):
    """The state after the last batch: of a complete sink its last batch, of an update sink the last row of each key."""
    path = _folder(spark)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    streams.run_batches(stream, mode, keep, f"{path}-checkpoint")
    rows = spark.read.parquet(f"{path}/v*")
    if mode == "complete":
        return rows.where(F.col("epoch") == rows.agg(F.max("epoch")).first()[0]).drop("epoch")
    return R.latest(rows, keys, [F.desc("epoch")]).drop("epoch")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def st7_running_totals(spark, d):
    return _last(spark, d, streams.running_totals(_events(spark, d), ["user_id"]), ["user_id"])


@query("SELECT user_id, max(value) AS high, round(max(value) * 0.9, 6) AS stop FROM events GROUP BY user_id")
def st8_high_water(spark, d):
    return _last(spark, d, streams.high_water(_events(spark, d)), ["user_id"], "update")


@query("SELECT user_id, arg_max(value, event_id) AS last, max(ts) AS at FROM events GROUP BY user_id")
def st13_last_price(spark, d):
    return _last(spark, d, streams.last_price(_events(spark, d), "user_id", "value"), ["user_id"]).withColumn("at", F.col("at").cast("timestamp_ntz"))


#: Pages of a block, and of a task that reads them.
PAGES = 64


# prints of a user's events; a page has a thousand events, a frame those of one second; some messages of other kinds are between them
@query("SELECT user_id % 4 AS feed, event_id // 1000 AS page, 'S' || user_id AS symbol, value AS price, (event_id % 7)::DOUBLE AS size, date_trunc('milliseconds', ts) AS ts FROM events WHERE event_type <> 'error'")
def sc21_ticks(spark, d):
    """The events as a paged service of four feeds, read in two runs of one stream: the second goes on where the first ended."""
    path = scratch.folder(spark, "ticks")
    e = load(spark, d, "events").withColumn("page", F.floor(F.col("event_id") / 1000)).withColumn("feed", (F.col("user_id") % 4).cast("int"))
    told = F.struct(F.when(F.col("event_type") == "error", "q").otherwise("t").alias("T"), F.concat(F.lit("S"), "user_id").alias("S"), F.col("value").alias("p"), (F.col("event_id") % 7).cast("double").alias("s"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("t"))
    last = e.agg(F.max("page")).first()[0] or 0
    spark.dataSource.register(ticks.TickSource)
    source, out = f"{path}/service", f"{path}/out"
    found = None
    for lo, hi in ((0, last // 2 + 1), (last // 2 + 1, last + 1)):
        # pages lie in blocks as large as a task's share, each written by one task; a block without events of a feed has an empty frame
        first = lambda page: lo + F.floor((page - lo) / PAGES).cast("bigint") * PAGES  # noqa: B023, E731
        span = lambda page: F.concat_ws("-", first(page), F.least(first(page) + PAGES, F.lit(hi)))  # noqa: B023, E731
        part = e.where(F.col("page").between(lo, hi - 1)).withColumn("span", span(F.col("page"))).repartition("feed", "span")
        frames = part.groupBy("feed", "span", "page", F.date_trunc("second", "ts").alias("at")).agg(F.to_json(F.collect_list(told)).alias("value"))
        every = spark.range(lo, hi, PAGES, 1).select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("feed"), span(F.col("id")).alias("span"), F.col("id").alias("page"), F.lit("[]").alias("value"))
        frames.drop("at").unionByName(every).write.mode("append").partitionBy("feed", "span").parquet(source)
        stream = spark.readStream.format("tessera_ticks").option("client", "tessera.sources.ticks:PageBlocks").option("path", source).option("pages", PAGES).load()
        found = streams.run_to_end(stream, out, checkpoint=f"{path}/checkpoint")
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: A reading counts as good above this value, and for so many hours; ticks are hours, rows may be an hour late.
GOOD, VALID = 20.0, 12

# every fiftieth event of the first third comes with the last third, too late for the ticks that are closed by then
ARRIVALS = f"""a AS (SELECT *, CASE WHEN event_id % 50 = 7 AND day(ts) <= 10 THEN 3 ELSE least((day(ts) - 1) // 10 + 1, 3) END AS part FROM events),
wm AS (SELECT p AS part, max(ts) - INTERVAL 1 HOUR AS t FROM a JOIN range(1, 5) r(p) ON a.part < p GROUP BY p),
k AS (SELECT user_id, a.part, ts, event_id, value, date_trunc('hour', ts) + INTERVAL 1 HOUR AS tick FROM a LEFT JOIN wm USING (part) WHERE wm.t IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > wm.t),
tk AS (SELECT user_id, tick::TIMESTAMP AS tick, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM k, (SELECT t FROM wm WHERE part = 4) WHERE tick <= t GROUP BY ALL)"""


def _arrivals(spark, d, run):
    """Run a stream over the events in three parts that arrive one after another; each run starts again from the checkpoint."""
    path = _folder(spark)
    e = load(spark, d, "events")
    day = F.dayofmonth("ts")
    part = F.when((F.col("event_id") % 50 == 7) & (day <= 10), 3).otherwise(F.least(F.floor((day - 1) / 10) + 1, F.lit(3)))
    out = None
    for n in (1, 2, 3):
        e.where(part == n).write.mode("append").parquet(f"{path}/in")
        stream = streams.stamped(spark.readStream.schema(e.schema).parquet(f"{path}/in"))
        out = streams.run_to_end(run(stream), f"{path}/out", checkpoint=f"{path}/checkpoint")
    return out


@query(f"""WITH {ARRIVALS}, o AS (SELECT *, value > {GOOD} AS good, lag(value) OVER w > {GOOD} AND tick <= lag(tick) OVER w + INTERVAL {VALID} HOUR AS was, lead(tick) OVER w AS next FROM tk WINDOW w AS (PARTITION BY user_id ORDER BY tick))
SELECT user_id, tick AS at, 'entered' AS kind FROM o WHERE good AND NOT coalesce(was, false) UNION ALL SELECT user_id, tick, 'fell' FROM o WHERE NOT good AND was
UNION ALL SELECT user_id, tick + INTERVAL {VALID} HOUR, 'expired' FROM o, (SELECT t FROM wm WHERE part = 4) WHERE good AND (next > tick + INTERVAL {VALID} HOUR OR (next IS NULL AND tick + INTERVAL {VALID} HOUR <= t))""")
def st9_newly_entered(spark, d):
    """Users whose latest reading of an hour is good when it was not before, and how they leave: by a bad reading or by its age."""
    with streams.rocksdb(spark):
        return _arrivals(spark, d, lambda e: streams.entered(streams.ticks(e, "user_id", "value"), "user_id", GOOD, VALID)).withColumn("at", F.col("at").cast("timestamp_ntz"))


SLOTS, EVERY = 4, 300


@query(f"""WITH s AS (SELECT *, ts - to_seconds(user_id % {SLOTS} * {EVERY}) AS shifted FROM events), m AS (SELECT max(shifted) - INTERVAL 1 HOUR AS t FROM s),
g AS (SELECT *, make_timestamp((epoch_us(shifted) // 1000000 // {SLOTS * EVERY} + 1) * {SLOTS * EVERY} * 1000000) AS due FROM s)
SELECT user_id, due + to_seconds(user_id % {SLOTS} * {EVERY}) AS polled_at, count(*) AS n, arg_max(value, struct_pack(a := ts, b := event_id)) AS latest FROM g, m WHERE due <= t GROUP BY user_id, due""")
def st11_sharded_polling(spark, d):
    """What each poll of a user finds: every five minutes a quarter of the users is polled, in turn."""
    e = load(spark, d, "events")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parque[t]")
    out = streams.run_to_end(streams.polled(stream, "user_id", "value", SLOTS, EVERY), _folder(spark))
    return out.withColumn("polled_at", F.col("polled_at").cast("timestamp_ntz"))
