"""Awards, contributions, lobbying and rules: four services, each with pages {"results": [...]} of its own records, read into articles; and the entities that their metadata name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fixed
from tessera.sources.feeds import article

#: Amounts below which awards and contributions are no news.
LEAST_AWARD, LEAST_CONTRIBUTION = 1_000_000.0, 10_000.0


def money(x: Column, billions: bool = False, none: str | None = None) -> Column:
    """$1.2B (if asked for), $3.4M, $56K or $789; ``none`` for what is not above 0."""
    form = lambda n, by, unit: F.concat(F.lit("$"), fixed(x / by, n), F.lit(unit))
    out = F.when(x >= 1e9, form(1, 1e9, "B")) if billions else F.when(F.lit(False), "")
    out = out.when(x >= 1e6, form(1, 1e6, "M")).when(x >= 1e3, form(0, 1e3, "K"))
    return out.when(x > 0, form(0, 1, "")).otherwise(none) if none else out.otherwise(form(0, 1, ""))


def clipped(x: Column, most: int) -> Column:
    """x if it has at most so many bytes, else its first ``most`` - 3 characters and three dots."""
    return F.when(F.octet_length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most - 3), F.lit("...")))


def _results(spark: SparkSession, path: str, record: str) -> DataFrame:
    return spark.read.schema(f"results array<struct<{record}>>").json(path).select(F.explode("results").alias("r")).select("r.*")


def _or(name: str, other: str) -> Column:
    return F.coalesce(F.col(name), F.lit(other))


def _day(x: Column) -> Column:
    return F.to_timestamp(F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"))


def awards(spark: SparkSession, path: str) -> DataFrame:
    """Federal awards of a million dollars or more."""
    r = _results(spark, path, "`Award ID`:string,`Recipient Name`:string,`Award Amount`:double,`Awarding Agency`:string,Description:string,`Award Type`:string,`NAICS Code`:string,`Start Date`:string")
    x = r.select(
        _or("Award ID", "unknown").alias("award_id"), _or("Recipient Name", "Unknown").alias("recipient"), F.coalesce("Award Amount", F.lit(0.0)).alias("amount"), _or("Awarding Agency", "Unknown Agency").alias("agency"),
        _or("NAICS Code", "N/A").alias("naics"), _or("Award Type", "contract").alias("award_type"), _or("Description", "No description").alias("description"), F.col("Start Date").alias("day"),
    ).where(F.col("amount") >= LEAST_AWARD)
    meta = ["award_id", "recipient", "amount", "agency", "naics", "award_type", "description"]
    title = F.concat("recipient", F.lit(" wins "), money(F.col("amount"), True), F.lit(" "), "agency", F.lit(" contract: "), clipped(F.col("description"), 80))
    return _article(x, title, F.concat(F.lit("https://www.usaspending.gov/award/"), "award_id"), "USASpending", F.lit("usaspending"), F.lit(None), meta)


def contributions(spark: SparkSession, path: str) -> DataFrame:
    """Campaign contributions of ten thousand dollars or more."""
    r = _results(spark, path, "contributor_name:string,contribution_receipt_amount:double,committee:struct<name:string,party:string>,contribution_receipt_date:string,contributor_employer:string,sub_id:string")
    x = r.select(
        _or("contributor_name", "Unknown").alias("contributor"), _or("committee.name", "Unknown Committee").alias("recipient"), F.coalesce("contribution_receipt_amount", F.lit(0.0)).alias("amount"), _or("committee.party", "N/A").alias("party"),
        _or("contributor_employer", "N/A").alias("employer"), F.col("contribution_receipt_date").alias("day"), _or("sub_id", "unknown").alias("sub_id"),
    ).where(F.col("amount") >= LEAST_CONTRIBUTION)
    title = F.concat("contributor", F.lit(" contributes "), money(F.col("amount")), F.lit(" to "), "recipient", F.lit(" ("), "party", F.lit(")"))
    meta = ["contributor", "recipient", "amount", "party", "employer", F.col("day").alias("date"), "sub_id"]
    return _article(x, title, F.concat(F.lit("https://www.fec.gov/data/receipts/?sub_id="), "sub_id"), "FEC", F.concat(F.lit("fec_"), "sub_id"), F.lit("finance"), meta)


def lobbying(spark: SparkSession, path: str) -> DataFrame:
    """Lobbying disclosures with a client, and with an amount or an activity. The amount is the income, else the expenses."""
    act = "struct<general_issue_code_display:string,government_entities:array<struct<name:string>>,description:string>"
    r = _results(spark, path, f"filing_uuid:string,client:struct<name:string>,registrant:struct<name:string>,income:string,expenses:string,lobbying_activities:array<{act}>,filing_type_display:string,filing_year:int,dt_posted:string")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    acts = F.coalesce("lobbying_activities", F.array().cast(f"array<{act}>"))
    x = r.where("filing_uuid is not null and client.name is not null").select(
        "filing_uuid", F.col("client.name").alias("client"), _or("registrant.name", "Unknown firm").alias("registrant"), F.when(number("income") > 0, number("income")).otherwise(number("expenses")).alias("amount"),
        F.array_compact(F.transform(acts, lambda a: a["general_issue_code_display"])).alias("issues"),
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(acts, lambda a: F.coalesce(a["government_entities"]["name"], F.array().cast("array<string>"))))))).alias("government_entities"),
        F.col("filing_type_display").alias("filing_type"), "filing_year", F.size(acts).alias("n"), F.col("dt_posted").alias("day"),
    ).where("amount <> 0 or n > 0")
    about = F.when(F.size("issues") > 0, F.array_join("issues", ", ")).otherwise("unspecified issues")
    title = F.when(F.col("amount") > 0, F.concat("client", F.lit(" spent "), money(F.col("amount"), none="undisclosed amount"), F.lit(" lobbying on "), about)).otherwise(F.concat("client", F.lit(" lobbied on "), about))
    meta = ["filing_uuid", "client", "registrant", "amount", "issues", "government_entities", "filing_type", "filing_year"]
    return _article(x, title, F.concat(F.lit("https://lda.gov/filings/public/filing/"), "filing_uuid", F.lit("/print/")), "Senate LDA", F.concat(F.lit("lda_"), "filing_uuid"), F.lit("finance"), meta)


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Federal rules with a title, a number and a url."""
    r = _results(spark, path, "title:string,document_number:string,html_url:string,abstract:string,type:string,agencies:array<struct<name:string>>,cfr_references:array<struct<title:string,part:string>>,publication_date:string")
    kind = _or("type", "RULE")
    none = F.array().cast("array<string>")
    refs = F.array_compact(F.transform("cfr_references", lambda c: F.concat(c["title"], F.lit(" CFR Part "), c["part"])))
    x = r.where("title is not null and document_number is not null and html_url is not null").select(
        F.col("title").alias("headline"), "document_number", "html_url", F.coalesce(F.array_compact("agencies.name"), none).alias("agencies"), F.when(F.size(refs) > 0, F.array_join(refs, ", ")).otherwise("N/A").alias("cfr_references"),
        F.when(kind == "PRORULE", "Proposed Rule").when(kind == "RULE", "Final Rule").otherwise(kind).alias("rule_type"), _or("abstract", "No abstract available").alias("abstract"), F.col("publication_date").alias("day"),
    )
    who = F.when(F.size("agencies") > 0, F.array_join("agencies", ", ")).otherwise("Unknown Agency")
    return _article(x, F.concat(who, F.lit(": "), clipped(F.col("headline"), 120)), F.col("html_url"), "Federal Register", F.lit("federal_register"), F.lit(None), ["document_number", "agencies", "cfr_references", "rule_type", "abstract"])


def _article(x: DataFrame, title: Column, url: Column, source: str, feed: Column, sector: Column, metadata: list) -> DataFrame:
    told = F.to_json(F.struct(*metadata), {"ignoreNullFields": "false"})
    return article(x, title=title, url=url, source_name=F.lit(source), published_at=_day(F.col("day")), sector=sector, feed_id=feed, language=F.lit("en"), source_type=F.lit("financial"), financial_metadata=told)


#: Employers that are none.
NO_EMPLOYER = ["SELF-EMPLOYED", "NOT EMPLOYED", "RETIRED"]


def named_entities(stories: DataFrame, keep: list[str]) -> DataFrame:
    """(the columns ``keep``, name, normalized, entity_type, sentiment): who the metadata of financial stories name, by rules of their source.

    stories: source_name, financial_metadata. Agencies (of the Federal Register) are read where they are text, cut at commas. Metadata that is no JSON, sources without
    rules and names of fewer than two bytes give nothing; of a filing's names the first three count that differ from the filer's.
    """
    m, s = F.col("financial_metadata"), F.col("source_name")
    told = F.from_json(m, "struct<entity_name:string,filing_type:string,display_names:array<string>,recipient:string,agency:string,contributor:string,employer:string,client:string,registrant:string,assignee:string,product:string>")
    shape = "array<struct<name:string,entity_type:string,sentiment:double>>"
    one = lambda name, kind, sentiment=0.0: F.struct(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("entity_type"), F.lit(sentiment).alias("sentiment"))
    t = F.col("_t")
    form = F.when(t["filing_type"] == "4", "insider_trade").when(t["filing_type"] == "8-K", "material_event").when(t["filing_type"] == "D", "private_placement").otherwise("company")
    others = F.transform(F.filter(F.slice(F.coalesce(t["display_names"], F.array().cast("array<string>")), 1, 3), lambda n: n.isNotNull() & ~n.eqNullSafe(t["entity_name"])), lambda n: one(n, "company"))
    agencies = F.transform(F.split(F.when(F.regexp_like(m, F.lit(r'"agencies"\s*:\s*"')), F.get_json_object(m, "$.agencies")), ","), lambda a: one(F.trim(a), "regulatory_action"))
    hired = F.when(~t["employer"].isin(NO_EMPLOYER), t["employer"])
    rules_of = [
        (F.contains(s, F.lit("EDGAR")), F.concat(F.array(one(t["entity_name"], form)), others)),
        (F.contains(s, F.lit("USASpending")), F.array(one(t["recipient"], "contract_award", 0.5), one(t["agency"], "regulatory_action"))),
        (s == "FEC", F.array(one(t["recipient"], "person"), one(t["contributor"], "person"), one(hired, "company"))),
        (F.contains(s, F.lit("LDA")) | F.contains(s, F.lit("Senate")), F.array(one(t["client"], "company"), one(t["registrant"], "lobbying_disclosure"))),
        (s.isin("USPTO", "Google Patents"), F.array(one(t["assignee"], "patent_cluster", 0.3))),
        (s == "Wikipedia Pageviews", F.array(one(t["entity_name"], "company"))),
        (s == "EIA", F.array(one(t["product"], "topic"))),
        (F.contains(s, F.lit("Federal Register")), agencies),
    ]
    found = F.coalesce(*[F.when(c, x.cast(shape)) for c, x in rules_of])
    each = stories.withColumn("_t", told).select(*keep, F.explode(found).alias("e"))
    normal = F.trim(F.lower("e.name"))
    return each.where(F.col("e.name").isNotNull() & (F.octet_length(normal) >= 2)).select(*keep, "e.name", normal.alias("normalized"), "e.entity_type", "e.sentiment")
