"""Feed sources: every connector reads dropped files into one article record.

A feed is a folder of files as the service returned them. Reading is distributed by file, and
a feed that fails is a row in the failure report, not a failed run.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import scratch

#: The record that all connectors normalise to.
ARTICLE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("content_snippet", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("feed_id", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("financial_metadata", T.StringType()),
    ]
)


def article(df: DataFrame, **columns: Column) -> DataFrame:
    """df projected to the record; columns not given are null, source_type is news by default."""
    columns.setdefault("source_type", F.lit("news"))
    return df.select(*[F.coalesce(columns.get(f.name, F.lit(None)).cast(f.dataType), F.lit("news") if f.name == "source_type" else F.lit(None).cast(f.dataType)).alias(f.name) for f in ARTICLE])


def rss(spark: SparkSession, path: str, source: str, sector: str = "world", tag: str = "item") -> DataFrame:
    """RSS (tag item) or Atom (tag entry) files."""
    schema = "title string, link string, description string, summary string, pubDate string, published string, updated string, id string"
    raw = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.coalesce("published", "updated")))
    return article(raw, title=F.trim("title"), url=F.coalesce(F.nullif(F.trim("link"), F.lit("")), "id"), source_name=F.lit(source), source_id=F.col("id"), published_at=when, content_snippet=F.coalesce("description", "summary"), sector=F.lit(sector), feed_id=F.lit(source))


def json_hits(spark: SparkSession, path: str, source: str, productivity: list[str], sector: str = "tech", other: str = "productivity") -> DataFrame:
    """Search results as {"hits": [...]}; headlines with a listed word get another sector (they are not duplicated)."""
    raw = spark.read.schema("hits array<struct<objectID:string,title:string,url:string,created_at:string,points:bigint>>").json(path, multiLine=True)
    h = raw.select(F.inline("hits"))
    tagged = F.when(F.lower("title").rlike("|".join(productivity)), other).otherwise(sector) if productivity else F.lit(sector)
    return article(h, title=F.col("title"), url=F.col("url"), source_name=F.lit(source), source_id=F.col("objectID"), published_at=F.try_to_timestamp("created_at"), sector=tagged, feed_id=F.lit(source))


def pick(posts: DataFrame, good: Column, per: str, position: str, most: int = 10) -> DataFrame:
    """Posts that are good, each url once (at its first position), at most so many of each group in feed order."""
    from tessera.operators.relational import latest

    once = latest(posts.where(good), ["url"], [F.col(position)])
    return latest(once, [per], [F.col(position)], most)


def markets(spark: SparkSession, path: str) -> DataFrame:
    """Prediction-market pages: numbers may be strings, arrays may be strings; yes/no markets only."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("m"))
    field = lambda n: F.get_json_object("m", f"$.{n}")
    names = F.from_json(field("outcomes"), "array<string>")
    prices = F.transform(F.from_json(field("outcomePrices"), "array<string>"), lambda x: x.try_cast("double"))
    out = raw.select(field("id").alias("id"), field("question").alias("question"), names.alias("outcomes"), prices.alias("prices"), field("volume").try_cast("double").alias("volume"))
    return out.where((F.size("outcomes") == 2) & (F.lower(F.get("outcomes", F.lit(0))) == "yes") & (F.lower(F.get("outcomes", F.lit(1))) == "no"))


def form4(filings: DataFrame, col: str = "xml") -> DataFrame:
    """Ownership filings: owner flags, transaction code, shares and price."""
    value = "struct<value:string>"
    deal = f"struct<transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:{value},transactionPricePerShare:{value}>>"
    schema = f"issuer struct<issuerTradingSymbol:string>, reportingOwner struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string>>, nonDerivativeTable struct<nonDerivativeTransaction:array<{deal}>>"
    x = filings.withColumn("x", F.from_xml(F.col(col), schema)).withColumn("t", F.explode_outer("x.nonDerivativeTable.nonDerivativeTransaction"))
    flag = lambda c: F.lower(F.col(f"x.reportingOwner.reportingOwnerRelationship.{c}")).isin("1", "true")
    amount = lambda c: F.col(f"t.transactionAmounts.{c}.value").try_cast("double")
    return x.select(
        *[c for c in filings.columns if c != col], F.upper("x.issuer.issuerTradingSymbol").alias("ticker"), F.col("x.reportingOwner.reportingOwnerId.rptOwnerName").alias("owner_name"),
        F.coalesce(flag("isDirector"), F.lit(False)).alias("is_director"), F.coalesce(flag("isOfficer"), F.lit(False)).alias("is_officer"),
        F.col("t.transactionCoding.transactionCode").alias("code"), amount("transactionShares").alias("shares"), amount("transactionPricePerShare").alias("price"),
    )


def form4_data(filings: DataFrame, col: str = "xml") -> DataFrame:
    """One record for each ownership filing, as of its first transaction outside the derivative table.

    Filings without one are position reports: code H, no shares. A code that is missing is ``?``, amounts that are missing or no numbers are 0, an ownership that is missing is D
    (direct). A flag holds if any reporting owner has it; name and title are the first that stand in the filing. post_shares: of the first transaction or holding that tells.
    """
    value = "struct<value:string>"
    post = f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{value}>"
    deal = f"struct<transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:{value},transactionPricePerShare:{value}>,{post},ownershipNature:struct<directOrIndirectOwnership:{value}>>"
    owner = "struct<reportingOwnerId:struct<rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>"
    schema = f"reportingOwner array<{owner}>, nonDerivativeTable struct<nonDerivativeTransaction:array<{deal}>,nonDerivativeHolding:array<struct<{post}>>>"
    x = filings.withColumn("_x", F.from_xml(F.col(col), schema)).withColumn("_t", F.get("_x.nonDerivativeTable.nonDerivativeTransaction", F.lit(0)))
    owners = F.col("_x.reportingOwner")
    flag = lambda c: F.coalesce(F.exists(owners, lambda o: F.coalesce(F.lower(o["reportingOwnerRelationship"][c]).isin("1", "true"), F.lit(False))), F.lit(False))
    first = lambda xs: F.get(F.filter(xs, lambda v: v.isNotNull()), F.lit(0))
    number = lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0))
    has = F.col("_t").isNotNull()
    shares, price = (number(F.col(f"_t.transactionAmounts.{c}.value")) for c in ("transactionShares", "transactionPricePerShare"))
    after = [F.transform(f"_x.nonDerivativeTable.{c}", lambda t: t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"]) for c in ("nonDerivativeTransaction", "nonDerivativeHolding")]
    none = F.array().cast("array<string>")
    return x.select(
        *[c for c in filings.columns if c != col], F.when(has, F.coalesce("_t.transactionCoding.transactionCode", F.lit("?"))).otherwise("H").alias("code"), shares.alias("shares"), price.alias("price"), (shares * price).alias("total_value"),
        F.coalesce(first(F.transform(owners, lambda o: o["reportingOwnerId"]["rptOwnerName"])), F.lit("")).alias("owner_name"), flag("isDirector").alias("is_director"), flag("isOfficer").alias("is_officer"), flag("isTenPercentOwner").alias("is_ten_percent_owner"),
        F.coalesce(first(F.transform(owners, lambda o: o["reportingOwnerRelationship"]["officerTitle"])), F.lit("")).alias("officer_title"),
        number(first(F.concat(*[F.coalesce(a, none) for a in after]))).alias("post_shares"), F.coalesce("_t.ownershipNature.directOrIndirectOwnership.value", F.lit("D")).alias("ownership"),
    )


def filing_items(html: Column) -> Column:
    """Item numbers of an 8-K in order of appearance, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)item\s*(?:&nbsp;|\s)*([1-9]\.[0-9]{2})"), F.lit(1)))


def holdings(filings: DataFrame, col: str = "xml") -> DataFrame:
    """13F information tables, one row for each holding."""
    schema = "infoTable array<struct<nameOfIssuer:string,cusip:string,value:bigint,shrsOrPrnAmt:struct<sshPrnamt:bigint>>>"
    x = filings.withColumn("h", F.explode(F.from_xml(F.col(col), schema)["infoTable"]))
    return x.select(*[c for c in filings.columns if c != col], F.col("h.nameOfIssuer").alias("issuer"), F.col("h.cusip").alias("cusip"), F.col("h.value").alias("value"), F.col("h.shrsOrPrnAmt.sshPrnamt").alias("shares"))


def series_change(obs: DataFrame, series: str = "series", day: str = "day", value: str = "value") -> DataFrame:
    """Macro series with the change against the period before."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(series).orderBy(day)
    v = F.col(value).try_cast("double")
    return obs.withColumn(value, v).where(F.col(value).isNotNull()).withColumn("change_pct", F.try_divide((F.col(value) - F.lag(value).over(w)) * 100, F.lag(value).over(w)))


def attention(views: DataFrame, as_of: Column, least: float = 10.0, delta: float = 20.0) -> DataFrame:
    """Pages whose mean daily views of 7 days depart from those of the 30 days before."""
    recent = F.avg(F.when(F.col("day") > F.date_sub(as_of, 7), F.col("views")))
    base = F.avg(F.when((F.col("day") <= F.date_sub(as_of, 7)) & (F.col("day") > F.date_sub(as_of, 37)), F.col("views")))
    x = views.where(F.col("day") <= as_of).groupBy("page").agg(recent.alias("recent"), base.alias("base"))
    return x.where(F.col("base") > least).withColumn("delta", (F.col("recent") - F.col("base")) * 100 / F.col("base")).where(F.abs("delta") >= delta)


def collect(feeds: dict[str, Callable[[], DataFrame]], spark: SparkSession, seconds: float = 600, at_once: int = 8) -> tuple[DataFrame, DataFrame]:
    """(articles of all feeds, failures): feeds are read whole, several at a time, each within so many seconds.

    What a feed gives is written to the scratch folder, so a bad record anywhere in it is found here; a feed
    that fails or takes too long is dropped and reported, and its jobs are cancelled.
    """
    sc = spark.sparkContext

    def one(name: str) -> DataFrame:
        sc.addJobTag(tag(name))
        return scratch.written(spark.createDataFrame([], ARTICLE).unionByName(feeds[name](), allowMissingColumns=True), "feed")

    run = uuid.uuid4().hex
    tag = lambda name: f"{run}-{hashlib.md5(name.encode()).hexdigest()}"
    good, bad = [], []
    pool = ThreadPoolExecutor(max(1, min(at_once, len(feeds))))
    waiting = {name: pool.submit(one, name) for name in feeds}
    for name, future in waiting.items():
        try:
            good.append(future.result(timeout=seconds))
        except Exception as e:  # any feed may fail in any way; the report names it
            sc.cancelJobsWithTag(tag(name))
            future.cancel()
            bad.append((name, f"{type(e).__name__}: {str(e)[:200]}"))
    pool.shutdown(wait=False, cancel_futures=True)
    out = spark.createDataFrame([], ARTICLE)
    for df in good:
        out = out.unionByName(df)
    return out, spark.createDataFrame(bad, "feed string, error string")


def research(entries: DataFrame, since: Column) -> DataFrame:
    """The last version of every paper updated on or after ``since``; entries: paper_id, version, updated, title."""
    new = entries.where(F.col("updated") >= since)
    return new.groupBy("paper_id").agg(F.max_by(F.struct("version", "updated", "title"), "version").alias("x")).select("paper_id", "x.*")


def records(raw: DataFrame, kind: str, title: Column, day: Column, metadata: list[str]) -> DataFrame:
    """Awards, contributions, lobbying or rules as articles: the listed columns become financial_metadata, with their kind."""
    return article(raw, title=title, published_at=day, source_name=F.lit(kind), source_type=F.lit("financial"), financial_metadata=F.to_json(F.struct(F.lit(kind).alias("kind"), *metadata)))


def patents(spark: SparkSession, path: str) -> DataFrame:
    """Patents as {"patents": [...]}, one row for each assignee."""
    schema = "patents array<struct<patent_id:string,patent_title:string,patent_date:string,assignees:array<struct<assignee_organization:string>>>>"
    p = spark.read.schema(schema).json(path).select(F.inline("patents"))
    return p.select("patent_id", "patent_title", F.try_to_date("patent_date").alias("day"), F.explode("assignees.assignee_organization").alias("assignee"))


def batched(names: DataFrame, col: str, most: int) -> DataFrame:
    """Names with the number of the request that asks for them, ``most`` names to a request. A watch list: small."""
    from pyspark.sql.window import Window

    return names.select(col).distinct().withColumn("request", F.floor((F.row_number().over(Window.orderBy(col)) - 1) / most))


def page_windows(fetch: Callable[[str, str], list], start: str, end: str, cap: int) -> list:
    """Rows of [start, end] from a paged service: a window that reaches the row cap is halved. Driver side, for small calendars."""
    from datetime import date, timedelta

    rows = fetch(start, end)
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if len(rows) < cap or a == b:
        return rows
    mid = a + (b - a) // 2
    return page_windows(fetch, start, mid.isoformat(), cap) + page_windows(fetch, (mid + timedelta(days=1)).isoformat(), end, cap)


#: The most requests a calendar may take, all rounds together.
MOST_REQUESTS = 40_000


def paged_calendar(spark: SparkSession, answer: Callable[[DataFrame], DataFrame], start, end, cap: int, width: int = 15) -> tuple[DataFrame, DataFrame]:
    """(rows, full_days) of [start, end] from a service that gives at most ``cap`` rows for a window of days.

    answer takes windows (start, end) and gives rows with their window's start, or a DataFrame that asks for each window inside a task. Windows begin ``width`` days wide; those
    whose answer is full are halved and asked for in the next round, those of one day stay as they are and are listed in full_days. All windows of a round are
    one job, and rounds are as many as halvings: no recursion, and no rows on the driver. A calendar that needs more than MOST_REQUESTS requests raises ValueError.
    """
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {width} days"))
    windows = spark.range(1).select(F.explode(days).alias("start"))
    windows = windows.withColumn("end", F.least(F.date_add("start", width - 1), F.lit(end).cast("date")))
    rows = full = None
    asked = 0
    while True:
        windows = scratch.written(windows, "calendar-windows")
        n = windows.count()
        if n == 0:
            break
        asked += n
        if asked > MOST_REQUESTS:
            raise ValueError(f"the calendar needs more than {MOST_REQUESTS} requests")
        got = scratch.written(answer(windows), "calendar-rows")
        filled = got.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") >= cap).select("start")
        again = windows.join(filled, "start", "left_semi")
        halves, done = again.where("start < end"), again.where("start = end").select(F.col("start").alias("day"))
        part = got.join(halves.select("start"), "start", "left_anti").drop("start")
        rows, full = (part, done) if rows is None else (rows.unionByName(part), full.unionByName(done))
        mid = F.date_add("start", F.floor(F.date_diff("end", "start") / 2).cast("int"))
        halves = halves.select(F.explode(F.array(F.struct("start", mid.alias("end")), F.struct(F.date_add(mid, 1).alias("start"), "end"))).alias("w"))
        windows = halves.select("w.start", "w.end")
    return rows, full
