"""Patterns, trends, the go-live gate and the journal: what reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scoring, text

#: Upper bounds of a migration's stages, by the target's share of the source's mentions, with their timelines.
STAGES = [(0.1, "Stage 1 of 5", "6-12 months based on precedent"), (0.25, "Stage 2 of 5", "3-6 months based on precedent"), (0.5, "Stage 3 of 5", "1-3 months based on precedent"),
          (0.75, "Stage 4 of 5", "2-6 weeks based on precedent"), (None, "Stage 5 of 5", "Already converging")]


def migrations(mentions: DataFrame, cutoff: Column, least_source: int = 5, least_target: int = 2) -> DataFrame:
    """(entity_id, source, target, source_n, target_n, stage, timeline, confidence): entities that move from one sector into another.

    mentions: entity_id, sector, day. The source is the sector with the most mentions (of equal ones that of the earliest first mention, then of the smaller name), if it has
    ``least_source``; targets are the others with ``least_target`` whose first mention is not before ``cutoff``. One row for each entity and sector after
    the first aggregation.
    """
    profile = mentions.groupBy("entity_id", "sector").agg(F.count("*").alias("n"), F.min("day").alias("first"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("n"), "first", "sector").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = profile.withColumn("source", F.first("sector").over(w)).withColumn("source_n", F.first("n").over(w))
    found = both.where((F.col("sector") != F.col("source")) & (F.col("source_n") >= least_source) & (F.col("n") >= least_target) & (F.col("first") >= cutoff))
    ratio = F.col("n") / F.col("source_n")
    named = F.lit(None).cast("struct<stage:string,timeline:string>")
    for bound, stage, timeline in reversed(STAGES):
        this = F.struct(F.lit(stage).alias("stage"), F.lit(timeline).alias("timeline"))
        named = this if bound is None else F.when(ratio < bound, this).otherwise(named)
    upto = lambda x: F.least(x, F.lit(1.0))
    confidence = upto(0.3 + 0.3 * upto(F.col("source_n") / 20.0) + 0.2 * upto(F.col("n") / 10.0) + 0.2 * upto(ratio))
    return found.select("entity_id", "source", F.col("sector").alias("target"), "source_n", F.col("n").alias("target_n"), named.alias("x"), confidence.alias("confidence")).select("*", "x.stage", "x.timeline").drop("x")


#: Trends shown, points of each, and the days of its sparkline and of its evidence.
TRENDS, POINTS, SPARK, EVIDENCE = 15, 8, 14, 30


def trends(mentions: DataFrame, predictions: DataFrame, as_of: Column, limit: int = TRENDS) -> DataFrame:
    """The ``limit`` strongest topics of the last EVIDENCE days, each with its points, sparkline, sectors and prediction.

    mentions: mention_id, topic, sector, day, headline, sentiment; predictions: topic, title, confidence, status. A topic needs three mentions or two days; it ranks by days
    times mentions times acceleration (ties by topic). points: the POINTS latest mentions, of one headline only the latest; sparkline: mentions of each of the last SPARK
    days; prediction: the active one of most confidence. Only the topics that are shown are enriched.
    """
    recent = mentions.where((F.col("day") >= F.date_sub(as_of, EVIDENCE)) & (F.col("day") <= as_of))
    week = F.count_if(F.col("day") >= F.date_sub(as_of, 7))
    ranked = recent.groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"), week.alias("w7"), F.avg("sentiment").alias("sentiment"))
    ranked = ranked.where("n >= 3 or days >= 2").withColumn("acceleration", F.round(scoring.acceleration(F.col("w7"), F.col("n")), 9))
    strength = F.round(F.col("days") * F.col("n") * F.col("acceleration"), 6)
    top = ranked.withColumn("strength", strength).orderBy(F.desc("strength"), "topic").limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), "topic")))  # a row for each trend shown
    shown = recent.join(F.broadcast(top.select("topic")), "topic", "left_semi")
    daily = shown.groupBy("topic", F.date_diff(as_of, F.col("day")).alias("ago")).agg(F.count("*").alias("k")).where(F.col("ago") < SPARK)
    by_day = daily.groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("ago", "k"))).alias("by_day"))  # at most SPARK entries
    spark_line = F.transform(F.sequence(F.lit(SPARK - 1), F.lit(0)), lambda i: F.coalesce(F.try_element_at(F.col("by_day"), i), F.lit(0)))
    latest = Window.partitionBy("topic").orderBy(F.desc("day"), F.desc("mention_id"))
    heads = shown.groupBy("topic", "headline").agg(F.max_by(F.struct("day", "mention_id"), F.struct("day", "mention_id")).alias("x")).select("topic", "headline", "x.*")
    heads = heads.withColumn("k", F.row_number().over(latest)).where(F.col("k") <= POINTS)
    points = heads.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("k", "mention_id", "day", "headline"))).alias("points"))
    sectors = shown.groupBy("topic").agg(F.sort_array(F.collect_set("sector")).alias("sectors"))
    active = predictions.where("status = 'active'").groupBy("topic").agg(F.max_by(F.struct("title", "confidence"), F.struct("confidence", "title")).alias("prediction"))
    out = top
    for part in (by_day, points, sectors, active):
        out = out.join(part, "topic", "left")
    return out.select("rank", "topic", "n", "days", "acceleration", "sentiment", F.coalesce(spark_line, F.array_repeat(F.lit(0).cast("bigint"), SPARK)).alias("sparkline"), "points", "sectors", "prediction")


#: The go-live criteria.
MIN_TRADES, MIN_DAYS, MIN_COMPARED, MIN_T, MIN_FACTOR, MAX_DRAWDOWN = 100, 90, 30, 2.0, 1.3, 15.0
CRITERIA = ["trades", "track_record", "net_profit", "edge", "profit_factor", "drawdown", "stops"]


def go_live(closed: DataFrame, drawdowns: DataFrame, unprotected: DataFrame, key: str) -> DataFrame:
    """(key, criterion, passed, current, n_passed, status): the seven criteria of every account, and its status: ready, close (two or fewer missing) or not_yet.

    closed: trades with entry_day, exit_day, pnl, excess (percent over the index, may be null); drawdowns: key, max_drawdown in percent; unprotected: key, n open positions
    without a stop. The edge needs MIN_COMPARED finite excesses with a spread. Without losses the profit factor passes with enough trades and any
    gain. An account without a drawdown fails it. One aggregation; seven rows an account.
    """
    x = F.when(~F.isnan("excess") & (F.abs("excess") != float("inf")), F.col("excess"))
    won, lost = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    a = closed.groupBy(key).agg(
        F.count("*").alias("n"), F.greatest(F.coalesce(F.date_diff(F.max("exit_day"), F.min("entry_day")), F.lit(0)), F.lit(0)).alias("track"), F.sum("pnl").alias("net"),
        F.count(x).alias("compared"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), won.alias("won"), lost.alias("lost"),
    )
    a = a.join(drawdowns, key, "left").join(unprotected.select(key, F.col("n").alias("bare")), key, "left").fillna(0, ["bare"])
    t = F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("compared"))
    factor = F.try_divide(F.col("won"), F.col("lost"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "trades": (F.col("n") >= MIN_TRADES, F.col("n")),
        "track_record": (F.col("track") >= MIN_DAYS, F.col("track")),
        "net_profit": ((F.col("n") > 0) & (F.col("net") > 0), F.col("net")),
        "edge": ((F.col("compared") >= MIN_COMPARED) & (F.col("mean") > 0) & (t >= MIN_T), F.when(F.col("compared") >= MIN_COMPARED, t)),
        "profit_factor": (F.when(F.col("lost") > 0, factor >= MIN_FACTOR).otherwise((F.col("n") >= MIN_TRADES) & (F.col("won") > 0)), factor),
        "drawdown": (F.col("max_drawdown") <= MAX_DRAWDOWN, F.col("max_drawdown")),
        "stops": (F.col("bare") == 0, F.col("bare")),
    }
    each = F.array(*[F.struct(F.lit(c).alias("criterion"), yes(rules[c][0]).alias("passed"), rules[c][1].cast("double").alias("current")) for c in CRITERIA])
    a = a.select(key, each.alias("each")).withColumn("n_passed", F.size(F.filter("each", lambda c: c["passed"])))
    missing = len(CRITERIA) - F.col("n_passed")
    status = F.when(missing == 0, "ready").when(missing <= 2, "close").otherwise("not_yet")
    return a.select(key, "n_passed", status.alias("status"), F.explode("each").alias("c")).select(key, "c.criterion", "c.passed", "c.current", "n_passed", "status")


#: What the journal says for a recorded rule, else for a status.
BECAUSE = {
    "trailing_stop": "the trailing stop was hit", "signal_decay": "signal decay triggered an exit", "profit_target": "the profit target was reached", "hard_stop_loss": "the -15% hard stop was hit",
    "fixed_stop_loss": "the fixed -10% stop was hit (no ATR data)", "manual": "it was closed manually", "manual_not_held": "it was closed manually", "closed_between_runs": "a pending exit order filled between runs",
}
BECAUSE_STATUS = {"stopped_out": "the trailing stop was hit", "expired": "the retired calendar-expiry engine closed it (that rule no longer exists)"}
UNRECORDED = "it was closed manually (exit reason not recorded)"


def journal(name: Column, signals: Column, entry_day: Column, entry: Column, size: Column, exit_day: Column, exit_: Column, pnl: Column, pct: Column, status: Column, reason: Column) -> Column:
    """The journal's text of a trade: its entry with the three strongest signals (array<struct<dimension, value>>; of equal ones the smaller name first), its exit if there is one, and how strong the signals were."""
    top = F.slice(F.array_sort(signals, lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1)).when(a["dimension"] < b["dimension"], -1).when(a["dimension"] > b["dimension"], 1).otherwise(0)), 1, 3)
    drivers = F.array_join(F.transform(top, lambda s: F.concat(s["dimension"], F.lit(" ("), text.fixed(s["value"] * 100, 0), F.lit("%)"))), ", ")
    drivers = F.when(F.size(top) > 0, drivers).otherwise(F.lit("convergence signals"))
    entered = F.concat(F.lit("Entered "), name, F.lit(" long on "), entry_day.cast("string"), F.lit(" at $"), text.fixed(entry, 2), F.lit(" driven by "), drivers, F.lit(". Position size: $"), text.fixed(size, 0), F.lit("."))
    table = lambda t: F.create_map(*[F.lit(x) for pair in t.items() for x in pair])
    rule = F.get(F.split(reason, r"[\s(]"), F.lit(0))
    because = F.coalesce(F.try_element_at(table(BECAUSE), rule), F.try_element_at(table(BECAUSE_STATUS), status), F.lit(UNRECORDED))
    sign = lambda x: F.when(x >= 0, "+").otherwise("")
    result = F.concat(sign(pct), text.fixed(pct, 1), F.lit("%"), F.when(pnl.isNotNull(), F.concat(F.lit(" ($"), sign(pnl), text.fixed(pnl, 0), F.lit(")"))).otherwise(""))
    left = F.concat(F.lit("Exited after "), F.date_diff(exit_day, entry_day).cast("string"), F.lit(" days at $"), text.fixed(exit_, 2), F.lit(" — "), result, F.lit(" because "), because, F.lit("."))
    left = F.when(exit_day.isNotNull() & exit_.isNotNull() & pct.isNotNull(), left)
    strong = F.filter(top, lambda s: s["value"] > 0.5)
    quality = F.when(F.size(strong) >= 2, "Multiple strong signals aligned on this trade.").when(F.size(strong) == 1, F.concat(F.lit("The "), F.get(strong, F.lit(0))["dimension"], F.lit(" signal was the primary driver.")))
    return F.concat_ws(" ", entered, left, quality)


def funnel(pool: DataFrame, kept: DataFrame, summarised: DataFrame, stories: DataFrame) -> DataFrame:
    """(briefing, url_hash, candidate, pool_position, kept, summarised, story_id): the log of a briefing's pool.

    pool: briefing, url_hash, candidate, position; the first candidate of a url is logged, later ones are ignored. kept and summarised: briefing, url_hash of what passed these stages;
    stories: briefing, url_hash, story_id, of which the lowest counts.
    """
    keys = ["briefing", "url_hash"]
    first = pool.groupBy(*keys).agg(F.min(F.struct("position", "candidate")).alias("x"))
    flag = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    out = first.join(flag(kept, "kept"), keys, "left").join(flag(summarised, "summarised"), keys, "left")
    out = out.join(stories.groupBy(*keys).agg(F.min("story_id").alias("story_id")), keys, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return out.select(*keys, "x.candidate", F.col("x.position").alias("pool_position"), yes("kept"), yes("summarised"), "story_id")
