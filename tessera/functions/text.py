"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholder names that are not entities.
NOISE = "unknown|n/a|various"


def normalize_title(x: Column) -> Column:
    """Lower case, letters, digits and single blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def title_hash(x: Column) -> Column:
    return F.sha2(normalize_title(x), 256)


def hash_url(x: Column) -> Column:
    """SHA-256 of a url without its query; slashes at the end go before the query does."""
    return F.sha2(F.get(F.split(F.lower(F.regexp_replace(F.trim(x), "/+$", "")), r"\?"), F.lit(0)), 256)


def is_noise(name: Column) -> Column:
    """Placeholder names and shouted names of three words or more."""
    return F.lower(name).rlike(NOISE) | ((F.size(F.split(F.trim(name), " ")) >= 3) & (F.upper(name) == name))


def fixed(x: Column, n: int) -> Column:
    """A number with n (0 to 3) decimals, rounded by its exact binary value: halves go to the even digit, and what is below zero keeps its sign.

    A fraction is taken as whole numbers of 2**-52 and what is left of them, so all that decides is done in integers. For numbers below 10**15.
    """
    x = x.cast("double")
    whole = F.floor(F.abs(x))
    bits = (F.abs(x) - whole) * float(1 << 52)
    rest_bits = (bits - F.floor(bits)) * float(10**n)
    shifted = bits.cast("bigint") * 10**n + F.floor(rest_bits)
    digits, rest = F.shiftright(shifted, 52), shifted.bitwiseAND((1 << 52) - 1)
    half = F.lit(1 << 51)
    up = (rest > half) | ((rest == half) & ((rest_bits != F.floor(rest_bits)) | ((whole * 10**n + digits) % 2 == 1)))
    number = whole * 10**n + digits + up.cast("bigint")
    shown = number.cast("string") if n == 0 else F.concat(F.floor(number / 10**n).cast("string"), F.lit("."), F.lpad((number % 10**n).cast("string"), n, "0"))
    return F.concat(F.when(x < 0, "-").otherwise(""), shown)


def clip(x: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis if something was cut."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def strip_tags(html: Column) -> Column:
    """Visible text: scripts, styles and tags removed, common entities decoded, blanks collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def json_envelope(x: Column) -> Column:
    """From the first { to the last }, null if there is none."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def reason_group(x: Column) -> Column:
    """The first token before a blank or an opening parenthesis."""
    return F.regexp_extract(x, r"^([^ (]*)", 1)


def first_rule(x: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that occurs."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.lower(x).rlike(pattern), F.lit(label)).otherwise(out)
    return out


def last_max_topic(x: Column, topics: dict[str, list[str]], default: str = "general") -> Column:
    """The topic with the most keywords in x; of equal counts the last listed; default if none occurs."""
    low = F.lower(x)
    scored = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (t, ws) in enumerate(topics.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["t"]).otherwise(F.lit(default))


def extract_keywords(x: Column, stop: list[str], least: int = 3) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(F.array_distinct(words), lambda w: (F.length(w) >= least) & ~w.isin(stop))


def words(x: Column) -> Column:
    """The distinct words of a text in lower case, cut at white space."""
    return F.filter(F.array_distinct(F.split(F.lower(x), r"\s+")), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two arrays of distinct words; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def escape_like(x: Column) -> Column:
    r"""x with \, % and _ escaped for LIKE."""
    return F.regexp_replace(x, r"([\\%_])", r"\\$1")


def title_candidates(name: Column) -> Column:
    """Page titles to try for a company name: as it is, without its legal suffix, and both in title case; each once."""
    bare = F.trim(F.regexp_replace(name, r"(?i)[,\s]+(inc|corp|corporation|co|company|ltd|llc|plc|sa|ag|nv|group|holdings)\.?$", ""))
    return F.filter(F.array_distinct(F.array(F.trim(name), bare, F.initcap(F.lower(F.trim(name))), F.initcap(F.lower(bare)))), lambda x: x != "")


def _marked(x: Column, kind: str) -> Column:
    """What stands in the markers [kind: ...] of an answer, in order."""
    return F.regexp_extract_all(x, F.lit(rf"\[{kind}:([^\]]*)\]"), F.lit(1))


def _unquoted(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(x), '^"+|"+$', ""))


def story_references(answer: Column) -> Column:
    """array<bigint>: the ids of [story:N] markers; other contents are left out."""
    return F.array_compact(F.transform(_marked(answer, "story"), lambda m: F.trim(m).try_cast("bigint")))


def followups(answer: Column) -> Column:
    """array<string>: questions of [followup: "..." | type: "..."] markers, as type::question if there is a type."""

    def one(m: Column) -> Column:
        parts = F.split(m, r"\|")
        kind = _unquoted(F.regexp_extract(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), r"^type:(.*)$", 1))
        question = _unquoted(F.get(parts, F.lit(0)))
        return F.when(question != "", F.when(kind != "", F.concat(kind, F.lit("::"), question)).otherwise(question))

    return F.array_compact(F.transform(_marked(answer, "followup"), one))


def predictions(answer: Column) -> Column:
    """array<struct<text, confidence, timeframe>> of [prediction: "..." | confidence: 0.7 | timeframe: "..."] markers; 0.5 where no number stands."""

    def one(m: Column) -> Column:
        parts = F.split(m, r"\|")
        value = F.trim(F.regexp_extract(F.trim(F.get(parts, F.lit(1))), r"^confidence:(.*)$", 1)).try_cast("double")
        frame = _unquoted(F.regexp_extract(F.trim(F.get(parts, F.lit(2))), r"^timeframe:(.*)$", 1))
        got = F.struct(_unquoted(F.get(parts, F.lit(0))).alias("text"), F.coalesce(value, F.lit(0.5)).alias("confidence"), frame.alias("timeframe"))
        return F.when((F.size(parts) >= 3) & (got["text"] != ""), got)

    return F.array_compact(F.transform(_marked(answer, "prediction"), one))


def without_markers(answer: Column) -> Column:
    """An answer without its markers, and without list items that they leave empty."""
    bare = F.regexp_replace(answer, r"\[(?:story|followup|prediction|entity):[^\]]*\]", "")
    return F.regexp_replace(bare, r"(?m)^[ \t]*(?:[0-9]+\.|[-*])[ \t]*(?:\n|\z)", "")


#: Headline rules (side, pattern), the first that occurs counts.
HEADLINES = {
    "upgrade": (1, r"\bUpgrades\b.+\bto\b"),
    "downgrade": (-1, r"\bDowngrades\b.+\bto\b"),
    "beat_both": (1, r"EPS .*Beats.*Sales .*Beat"),
    "miss_both": (-1, r"EPS .*Misses.*Sales .*Miss"),
    "guide_up": (1, r"Raises (FY|Q\d|\d{4}|Full.Year|Annual|Its |Outlook|Guidance).{0,60}(Guidance|Outlook|Forecast|Sales|Revenue|EPS)|Sees .{0,60}Above .{0,20}Est"),
    "guide_down": (-1, r"(Lowers|Cuts|Reduces) (FY|Q\d|\d{4}|Full.Year|Annual|Its |Outlook|Guidance).{0,60}(Guidance|Outlook|Forecast|Sales|Revenue|EPS)|Sees .{0,60}Below .{0,20}Est"),
    "equity_offering": (-1, r"(Proposed|Pricing Of|Prices|Launches) .{0,40}(Public |Underwritten |Registered Direct )?Offering(?!.*Notes)"),
    "initiate_buy": (1, r"Initiates Coverage On .+ With (Buy|Overweight|Outperform|Strong Buy)"),
    "initiate_sell": (-1, r"Initiates Coverage On .+ With (Sell|Underweight|Underperform)"),
    "buyback": (1, r"(Announces|Authorizes|Approves|Board Approves).{0,40}(Buyback|Repurchase)"),
    "pt_raise": (1, r"Maintains .+ Raises Price Target"),
    "pt_lower": (-1, r"Maintains .+ Lowers Price Target"),
}


def headline_rule(x: Column) -> Column:
    """struct<rule, side> of the first rule that a headline meets; null if none."""
    out = F.lit(None).cast("struct<rule:string,side:int>")
    for rule, (side, pattern) in reversed(HEADLINES.items()):
        out = F.when(x.rlike(pattern), F.struct(F.lit(rule).alias("rule"), F.lit(side).alias("side"))).otherwise(out)
    return out


def resolved_refs(cited: Column, offered: Column) -> Column:
    """struct<ids, remapped, dropped>: the ids that an answer cites, each once and in order.

    An id that was offered stands for itself; a number that is none but a place in the list offered (from 0) stands for the id there; others are dropped. Nulls are dropped, too.
    """
    place = lambda r: F.when((r >= 0) & (r < F.size(offered)), F.get(offered, r.cast("int")))
    exact = lambda r: F.coalesce(F.array_contains(offered, r), F.lit(False))
    ids = F.transform(cited, lambda r: F.when(exact(r), r).otherwise(place(r)))
    remapped = F.size(F.filter(cited, lambda r: ~exact(r) & place(r).isNotNull()))
    return F.struct(F.array_distinct(F.array_compact(ids)).alias("ids"), remapped.alias("remapped"), F.size(F.filter(ids, lambda i: i.isNull())).alias("dropped"))
