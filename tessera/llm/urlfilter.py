"""URL filtering by rules and by a path-template tree.

Rules decide first (``judge``): a rule names a host and a path; it fits the host and its
subdomains if the url's path starts with the rule's path; the longest fitting rule wins.

Urls that no rule fits are judged by a template tree learnt from labelled urls:

1. every path is cut into segments and each host gets a tree of them. Segments that are
   numbers, hexadecimal strings or dates become typed wildcards at once. At a node whose
   children vary (more than ``FEW`` of them, and on average fewer than ``REPEATS`` urls each)
   all literal children become one wildcard; the tree is walked level by level over the
   counted shapes, not over the urls; segments after the first ``DEPTH`` are one segment;
2. every template counts the allowed and blocked urls below it; branches whose block rate
   does not differ significantly (two-proportion z below ``Z``) are merged: a labelled template with its labelled
   siblings (of the same host and parent), the templates of a host with the same template in all
   hosts of the domain, and so on to all hosts;
3. a template's purity is its smoothed share of blocked urls, with the wider branch's purity
   as prior of weight ``PRIOR``; a url is blocked if the purity exceeds ``REJECT``.

Everything is an aggregate over (host, template) counts, so a host that holds a third of
all urls is pre-aggregated before any shuffle by host.

Defined cases: a null url or one without ``://`` has empty host and path and is judged by the
overall purity; with no labelled url at all the purity is 0 and the verdict allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

FEW, REPEATS = 8, 4.0
DEPTH = 8
Z = 1.96
PRIOR = 4.0
REJECT = 0.5
#: (rule, verdict): host and path of each are split at the first slash.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def parse(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    rest = F.coalesce(F.regexp_extract("url", r"^(?s:.*?)://((?s:.*))$", 1), F.lit(""))
    return (
        pages.withColumn("_rest", rest)
        .withColumn("_host", F.regexp_extract("_rest", r"^([^/?#]*)", 1))
        .withColumn("path", F.regexp_extract(F.expr("substring(_rest, char_length(_host) + 1)"), r"^([^?#]*)", 1))
        .withColumn("host", F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        .drop("_rest", "_host")
    )


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):  # longer ones are asked first: outermost
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _typed(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), F.regexp_replace(segment, r"^[0-9]+", "{n}"))
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{d}"))
        .when(segment.rlike(r"^[0-9A-Fa-f-]{8,}$") & segment.rlike("[0-9]"), F.lit("{h}"))
        .otherwise(segment)
    )


def templates(urls: DataFrame) -> DataFrame:
    """(host, shape, template): the generalised path of every typed path of a host.

    ``urls`` has host and shape (the typed segments) and its count n; one row for each pair.
    """
    t = urls.select("host", "shape", "n", F.array().cast("array<string>").alias("done"))
    deepest = urls.agg(F.max(F.size("shape"))).first()[0] or 0
    for depth in range(deepest):
        # each level reads the one before from the shared folder, so the plan stays short
        t = materialize(t, "url-level") if depth else t
        here = F.get("shape", F.lit(depth))
        node = t.where(F.size("shape") > depth).groupBy("host", "done", here.alias("child")).agg(F.sum("n").alias("n"))
        literal = ~F.col("child").startswith("{")
        vary = (
            node.where(literal).groupBy("host", "done")
            .agg(F.count("*").alias("children"), F.sum("n").alias("below"))
            .where((F.col("children") > FEW) & (F.col("below") < F.col("children") * REPEATS))
            .select("host", "done", F.lit(True).alias("varies"))
        )
        t = t.join(vary, ["host", "done"], "left").withColumn(
            "done",
            F.when(F.size("shape") <= depth, F.col("done"))
            .when(F.col("varies").isNotNull() & ~here.startswith("{"), F.concat("done", F.array(F.lit("{*}"))))
            .otherwise(F.concat("done", F.array(here))),
        ).drop("varies")
    parent = F.when(F.size("done") > 0, F.array_join(F.slice("done", F.lit(1), F.size("done") - 1), "/"))
    return t.select("host", "shape", F.concat(F.lit("/"), F.array_join("done", "/")).alias("template"), parent.alias("parent"))


def _pure(counts: DataFrame) -> DataFrame:
    """host, template, purity from (host, template, parent, allowed, blocked); unlabelled templates included."""
    domain = F.substring_index("host", ".", -2)
    own = counts.withColumn("domain", domain)
    total = F.col("allowed") + F.col("blocked")
    overall = own.agg(F.coalesce(F.sum("blocked") / F.nullif(F.sum(total), F.lit(0)), F.lit(0.0)).alias("p0"))

    def smooth(blocked: Column, n: Column, prior: Column) -> Column:
        return (blocked + PRIOR * prior) / (n + PRIOR)

    def differs(b1: Column, n1: Column, b2: Column, n2: Column) -> Column:
        """Two-proportion z test of a branch against the rest of the wider branch."""
        m, c = n2 - n1, b2 - b1
        p = F.try_divide(b2, n2)
        z = F.try_divide(F.abs(F.try_divide(b1, n1) - F.try_divide(c, m)), F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1), n1) + F.try_divide(F.lit(1), m))))
        return F.coalesce(z >= Z, F.lit(False))

    wide = own.groupBy("template").agg(F.sum("blocked").alias("gb"), F.sum(total).alias("gn"))
    mid = own.groupBy("domain", "template").agg(F.sum("blocked").alias("db"), F.sum(total).alias("dn"))
    mid = mid.join(wide, "template").crossJoin(F.broadcast(overall))  # one row
    pg = smooth(F.col("gb"), F.col("gn"), F.col("p0"))
    mid = mid.withColumn("pg", pg).withColumn("pd", F.when(differs(F.col("db"), F.col("dn"), F.col("gb"), F.col("gn")), smooth(F.col("db"), F.col("dn"), F.col("pg"))).otherwise(F.col("pg")))
    near = own.groupBy("host", "parent").agg(F.sum("blocked").alias("sb"), F.sum(total).alias("sn"))
    own = own.join(mid, ["domain", "template"]).join(near, own["host"].eqNullSafe(near["host"]) & own["parent"].eqNullSafe(near["parent"])).drop(near["host"], near["parent"])
    # against the domain; then, of those that differ, a labelled branch against its siblings
    alone = F.when(differs(F.col("blocked"), total, F.col("sb"), F.col("sn")), smooth(F.col("blocked"), total, F.col("pd"))).otherwise(smooth(F.col("sb"), F.col("sn"), F.col("pd")))
    purity = F.when(differs(F.col("blocked"), total, F.col("db"), F.col("dn")), alone).otherwise(F.col("pd"))
    return own.select("host", "template", purity.alias("purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row.

    The urls that a rule decides are the labelled ones.
    """
    u = parse(pages.select("page_id", "url"))
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    shape = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _typed)
    rest = F.array_join(F.slice(shape, F.lit(DEPTH + 1), F.greatest(F.size(shape) - DEPTH, F.lit(0))), "/")
    shape = F.when(F.size(shape) > DEPTH, F.concat(F.slice(shape, 1, DEPTH), F.array(rest))).otherwise(shape)
    u = u.withColumn("rule", rule).withColumn("decided", decided).withColumn("shape", shape)
    counts = u.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("decided") == "allow", 1).otherwise(0)).alias("allowed"),
        F.sum(F.when(F.col("decided") == "block", 1).otherwise(0)).alias("blocked"),
    )
    counts = materialize(counts, "url-counts")
    named = materialize(templates(counts), "url-templates")
    merged = counts.join(named, ["host", "shape"]).groupBy("host", "template").agg(F.any_value("parent").alias("parent"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    verdicts = named.select("host", "shape", "template").join(_pure(merged), ["host", "template"])
    verdict = F.coalesce("decided", F.when(F.col("purity") > REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return u.join(verdicts, ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def pages(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
