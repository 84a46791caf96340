"""Personal data: fixed base patterns and bootstrapped contextual extraction, as DataFrame operations.

Base spans: e-mail addresses, IP addresses, payment cards (Luhn) and phone numbers. They are
the seeds of a pattern-instance graph:

* an occurrence is a seed, with whatever blanks are in it, or another identifier-like stretch: a word with
  ``DIGITS`` or more digits or an @, and the words of digits and signs that follow it after one blank each, of
  ``LEAST`` or more characters, without a label (``Konto:``) or punctuation around it;
* its lexical patterns are the word before it, the two words before it, and the words on both sides, each
  alone and with the shape of the identifier (runs of digits, small and capital letters). Alone they find
  identifiers of forms that no base pattern has;
* the graph has an edge for every distinct (pattern, instance). A pattern's confidence is the lower bound (Wilson,
  one deviation) of its share of known instances among all it extracts; for the word before, alone, what it extracts
  includes every other word that follows it anywhere in the corpus, so that common words never
  become patterns. An instance's confidence is 1 - product of (1 - confidence) over its patterns. In each of ``ROUNDS``
  rounds Spark scores the patterns from the known instances, then the instances from the
  patterns, and instances of confidence ``ACCEPT`` or more become known;
* occurrences of instances that became known, in a pattern of confidence ``ACCEPT`` or more, are added.

The graph holds distinct edges, pre-aggregated before every shuffle, so a pattern or an
instance that a third of all documents share is one node with one row per neighbour.

Defined cases: null text is empty and has no spans; repeated rows are read alike; long texts and words
are read whole; without seeds nothing is added; words of context are sought within ``NEAR`` code points of
an identifier; other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.spans import SPAN, find, kept, let, listed

KINDS = ["email", "ip", "card", "phone", "context"]
LEAST, DIGITS = 6, 4
SUPPORT, ACCEPT, ROUNDS = 5, 0.8, 3
NEAR = 80
#: Words whose followers are counted are broadcast up to this number (some 50 bytes each), else joined by a shuffle.
BROADCAST_WORDS = 1 << 18

# a match can only begin where a run of its first class begins, or where the last match ended
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # runs of fewer digits fail anyway
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPACE = r"\x20\x09-\x0D"
#: A word with a digit or an @, and the words of digits and signs after it.
LIKELY = rf"(?<![^{SPACE}])(?=[^{SPACE}]*?[0-9@])[^{SPACE}]++(?:\x20(?=[().,/+-]*[0-9])[0-9().,/+-]++(?![^{SPACE}]))*+"
LEAD = r"""^[(\[{<"']*(?:\p{L}+[:=])?[(\[{<"']*"""
TRAIL = r"""[.,;:!?)\]}>"']+$"""
_W, _N = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def _luhn(m: Column) -> Column:
    def check(d: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            x = d.substr(i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return a + F.when(i % 2 == 0, twice).otherwise(x)

        n = F.length(d)
        return F.when(n <= 19, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))

    return let(F.reverse(_digits(m)), check)


def base(docs: DataFrame) -> DataFrame:
    """Adds the base spans (arrays email, ip, card, phone, and base for all) to rows with a non-null text."""
    count = lambda m: F.length(_digits(m))
    return (
        docs.withColumn("_email", find("text", EMAIL, F.contains("text", F.lit("@"))))
        .withColumn("_ip", find("text", IP))
        .withColumn("_card", find("text", CARD))
        .withColumn("_phone", find("text", PHONE, F.contains("text", F.lit("+"))))
        .withColumn("email", kept("_email", 0))
        .withColumn("ip", kept("_ip", 1, _octets))
        .withColumn("card", kept("_card", 2, _luhn))
        .withColumn("phone", kept("_phone", 3, lambda m: count(m).between(10, 15)))
        .drop("_email", "_ip", "_card", "_phone")
        .withColumn("base", F.concat("email", "ip", "card", "phone"))
    )


def occurrences(likely: str) -> Column:
    """array<struct<start, end, instance, seed>> from the base spans and the matches of LIKELY; needs text and base."""
    text = F.col("text")
    span = lambda start, word, seed: F.struct(start.alias("start"), (start + F.length(word)).alias("end"), word.alias("instance"), F.lit(seed).alias("seed"))
    seeds = F.transform("base", lambda b: span(b["start"], text.substr(b["start"] + 1, b["end"] - b["start"]), True))

    def bare(x: Column) -> Column:
        word = F.regexp_replace(F.regexp_replace(x["match"], LEAD, ""), TRAIL, "")
        return let(word, lambda w: span(x["start"] + F.length(F.regexp_extract(x["match"], LEAD, 0)), w, False))

    good = lambda o: (F.length(o["instance"]) >= LEAST) & ((F.length(_digits(o["instance"])) >= DIGITS) | F.contains(o["instance"], F.lit("@")))
    alone = lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"]))
    return F.concat(seeds, F.filter(F.transform(F.col(likely), bare), lambda o: good(o) & alone(o)))


def with_contexts(seen: str) -> Column:
    """Adds to every occurrence the words before (one; two, joined by a blank) and after it, lower case; empty if there is none."""
    text = F.col("text")

    def one(o: Column) -> Column:
        left = F.lower(text.substr(F.greatest(o["start"] - NEAR, F.lit(0)) + 1, F.least(o["start"], F.lit(NEAR))))
        right = F.lower(text.substr(o["end"] + 1, F.lit(NEAR)))
        before = F.regexp_extract(left, rf"({_W}+){_N}*$", 1)
        two = F.concat_ws(" ", *[F.nullif(F.regexp_extract(left, rf"({_W}+){_N}+({_W}+){_N}*$", i), F.lit("")) for i in (1, 2)])
        after = F.regexp_extract(right, rf"^{_N}*({_W}+)", 1)
        return F.struct(o["start"].alias("start"), o["end"].alias("end"), o["instance"].alias("instance"), o["seed"].alias("seed"), before.alias("before"), two.alias("two"), after.alias("after"))

    return F.transform(F.col(seen), one)


def shape(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[0-9]+", "0"), r"\p{Ll}+", "a"), r"\p{Lu}+", "A")


def patterns() -> Column:
    """array<string>: the lexical patterns of a row with before, two, after and instance; those of the word before alone begin with 1|."""
    before, form = F.col("before"), shape(F.col("instance"))
    keys = [F.concat(F.lit("1|"), before)]
    keys += [F.when(F.col("two") != before, F.concat(F.lit("2|"), "two")), F.when(F.col("after") != "", F.concat(F.lit("3|"), before, F.lit("|"), "after"))]
    keys += [F.concat(F.lit("s"), k, F.lit("|"), form) for k in keys]
    return F.when(before == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*keys)))


def wilson(hits: Column, trials: Column) -> Column:
    """The lower bound, one deviation down, of a share."""
    p = hits / trials
    return (p + 1 / (2 * trials) - F.sqrt(p * (1 - p) / trials + 1 / (4 * trials * trials))) / (1 + 1 / trials)


def misses(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(pattern, misses): how often a word that comes before ``SUPPORT`` or more instances comes before something else."""
    here = seen.where("before <> ''").groupBy(F.col("before").alias("word")).agg(F.count("*").alias("met"), F.approx_count_distinct("instance").alias("kinds"))
    here = materialize(here.where(F.col("kinds") >= SUPPORT - 1).select("word", "met"), "pii-words")
    side = F.broadcast(here) if here.count() <= BROADCAST_WORDS else here
    words = docs.select(F.explode(F.split(F.lower("text"), rf"{_N}+")).alias("word"))
    counts = words.join(side.select("word"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return here.join(counts, "word").select(F.concat(F.lit("1|"), "word").alias("pattern"), F.greatest(F.col("n") - F.col("met"), F.lit(0)).alias("misses"))


def discover(edges: DataFrame, missed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern) trusted and (instance) known after all rounds, from distinct edges with a flag ``seed``."""
    # an instance seen as a seed anywhere is a seed
    known = edges.groupBy("instance").agg(F.max("seed").alias("seed")).where("seed").select("instance", F.lit(True).alias("known"))
    known = materialize(known, "pii-known")
    scored = None
    for _ in range(ROUNDS):
        counts = edges.join(known, "instance", "left").groupBy("pattern").agg(F.count("*").alias("all"), F.count("known").alias("hits")).where(F.col("hits") >= SUPPORT)
        trials = F.col("all") + F.coalesce("misses", F.lit(0))
        scored = materialize(counts.join(missed, "pattern", "left").select("pattern", wilson(F.col("hits").cast("double"), trials.cast("double")).alias("confidence")), "pii-patterns")
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        grown = edges.join(scored.where(F.col("confidence") >= ACCEPT), "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("confidence"))
        known = materialize(known.unionByName(grown.where(F.col("confidence") >= ACCEPT).select("instance", F.lit(True).alias("known"))).distinct(), "pii-known")
    return scored.where(F.col("confidence") >= ACCEPT).select("pattern"), known.select("instance")


def find_personal(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row: struct of the columns ``keep``, email, ip, card, phone, base, context: the added spans) of every row."""
    texts = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = base(texts).withColumn("likely", find("text", LIKELY)).withColumn("seen", occurrences("likely")).withColumn("seen", with_contexts("seen"))
    # spans only, no text; row numbers are stable once written
    kept_rows = materialize(rows.select("row", *KINDS[:4], "base", "seen", F.monotonically_increasing_id().alias("number")), "pii-rows")
    seen = kept_rows.where(F.size("seen") > 0).select("number", F.explode("seen").alias("o")).select("number", "o.start", "o.end", "o.seed", "o.before", "o.two", "o.after", "o.instance")
    linked = seen.select("number", "start", "end", "seed", F.md5("instance").alias("instance"), F.explode(patterns()).alias("pattern"))
    edges = materialize(linked.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    trusted, known = discover(edges, materialize(misses(texts, seen), "pii-misses"))
    added = (
        linked.where(~F.col("seed")).join(trusted, "pattern", "left_semi").join(known, "instance", "left_semi").select("number", "start", "end").distinct()
        .groupBy("number").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("spans"))
    )
    return kept_rows.join(added, "number", "left").withColumn("context", F.coalesce(F.col("spans").cast(SPAN), F.array().cast(SPAN))).drop("number", "seen", "spans")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context, n_spans (all of them)."""
    rows = find_personal(docs, ["doc_id"])
    return rows.select(
        "row.doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        listed(F.concat("base", "context"), KINDS).alias("spans"),
        F.size("context").cast("bigint").alias("n_context"),
        (F.size("base") + F.size("context")).cast("bigint").alias("n_spans"),
    )
