"""Secret scanning: fixed base patterns and a randomness test battery, as DataFrame expressions.

Base spans: credentials assigned to a telling name, access key ids, and long hexadecimal
strings. The battery looks at every other token of ``LEAST`` or more characters:

* the encoding is inferred from its characters (hexadecimal, base 32, base 36, base 36 with - and _, base 52,
  base 62, base 64; the smallest alphabet that fits), which fixes the alphabet size A. Tokens of digits only or of
  letters of one case, or of a capital and small letters, are numbers and words and infer no encoding;
* three tests compare the token with random text of that alphabet, where their means and
  deviations are known: chi-squared of the character counts (Wilson-Hilferty), the number of runs of digits, small
  letters, capital letters and signs, and the serial correlation at lag 1;
* their three two-sided p-values are combined by Fisher's method: -2 times the sum of their logarithms
  is chi-squared with six degrees of freedom, so the combined p-value has a closed form. Random tokens have
  p-values evenly spread from 0 to 1, others crowd near 0, the more the longer they are;
* false discoveries are controlled in each length class (powers of two) over all distinct tokens of the corpus. Tokens with
  p-values above 1/2 tell how many are random (Storey): r = 2 (h + the root of h), if there are h, which is
  one deviation more than expected, so that chance does not hide secrets. Of the tokens at or above
  a threshold t, r (1 - t) are then random and the rest false; each class takes the least threshold, from
  ``ALPHA`` on, at which the false are no more than the share ``LEVEL``; a class without a token above 1/2 adds nothing.
  The counts are a table of fixed size.

The spans and p-values of all tokens are written once and read twice, for the thresholds and for the result.

Defined cases: null text is empty and has no spans; repeated rows are scanned alike; long
texts are scanned whole; a token that touches a base span is not added; other columns play no part, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.spans import SPAN, find, kept, let, listed

KINDS = ["assign", "access", "hex", "random"]
#: Characters of a token of the battery; the tests cannot tell shorter random ones from identifiers like `chapter12verse3`.
LEAST = 16
LEVEL = 0.05
#: Tokens of a smaller p-value are not random, whatever the class; p-values are counted in steps of 2 ** (-1 / STEPS).
ALPHA, STEPS = 0.001, 4

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # all of at least 18 characters; shorter ones fail anyway
HEX = r"[0-9a-f]{16,}"
_C = "[A-Za-z0-9+/_-]"
#: A whole token with a digit, or with a small letter before a capital one.
TOKEN = rf"(?<!{_C})(?={_C}*?(?:[0-9]|[a-z][A-Z])){_C}{{{LEAST},}}+={{0,2}}"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = [DIGITS, LOWER, UPPER, "+/-_"]
#: Alphabets of the encodings, each in the order of its values, with what a token of it must look like.
ALPHABETS = {
    "hex": (DIGITS + "abcdef", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    "HEX": (DIGITS + "ABCDEF", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    "base32": (UPPER + "234567", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    "base36": (DIGITS + LOWER, "^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    "BASE36": (DIGITS + UPPER, "^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    "base38": (DIGITS + LOWER + "-_", "^(?=.*[0-9])(?=.*[a-z])[0-9a-z_-]+$"),
    "BASE38": (DIGITS + UPPER + "-_", "^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z_-]+$"),
    "base52": (UPPER + LOWER, "^(?=.*[a-z][A-Z])[A-Za-z]+$"),
    "base62": (DIGITS + UPPER + LOWER, "^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$"),
    "base64": (UPPER + LOWER + DIGITS + "+/-_", "^(?=.*[A-Za-z])(?=.*(?:[0-9]|[a-z].*[A-Z]))[A-Za-z0-9+/_-]+$"),
}


def base(docs: DataFrame) -> DataFrame:
    """Adds the base spans (arrays assign, access, hex) to rows with a non-null text."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12
    return (
        docs.withColumn("_assign", find("text", ASSIGN))
        .withColumn("_access", find("text", ACCESS, F.contains("text", F.lit("AKIA"))))
        .withColumn("_hex", find("text", HEX))
        .withColumn("assign", kept("_assign", 0, value))
        .withColumn("access", kept("_access", 1))
        .withColumn("hex", kept("_hex", 2))
        .drop("_assign", "_access", "_hex")
        .withColumn("base", F.concat("assign", "access", "hex"))
    )


def combined(token: Column, alphabet: str) -> Column:
    """Fisher's sum of the three tests: minus the logarithms of their p-values, added up.

    token must be a column or a lambda variable, as it is named many times.
    """
    size = len(alphabet)
    n = F.length(token).cast("double")
    classes = F.translate(token, "".join(CLASSES), "".join(str(i) * len(c) for i, c in enumerate(CLASSES)))
    changes = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double") - 1
    share = [sum(x in c for x in alphabet) / size for c in CLASSES]
    change = 1 - sum(q * q for q in share)
    both = sum(q * (1 - q) ** 2 for q in share) - change**2  # covariance of two neighbouring changes
    runs = (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * both)

    def chi(chars: Column) -> Column:
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
        # mean size - 1, variance 2 (size - 1) (1 - 1 / n): a scaled chi-squared of `free` degrees of freedom
        free = (size - 1) / (1 - 1 / n)
        return (F.cbrt((squares * size / n - n) / (size - 1)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))

    def serial(values: Column) -> Column:
        follow = F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda x, y: x * y)
        return F.aggregate(follow, F.lit(0.0), lambda a, x: a + x) / (((size * size - 1) / 12) * F.sqrt(n - 1))

    def doubt(z: Column) -> Column:
        """Minus the logarithm of a normal deviate's two-sided p-value, approximately."""
        return 0.717 * F.abs(z) + 0.416 * z * z

    chars = F.split(token, "(?!^)")
    values = lambda c: F.transform(c, lambda x: F.instr(F.lit(alphabet), x).cast("double") - (size + 1) / 2)
    return let(chars, lambda c: let(chi(c), doubt) + let(let(values(c), serial), doubt)) + let(runs, doubt)


def p_value(doubts: Column) -> Column:
    """Chance of a larger Fisher's sum of three p-values under randomness."""
    return let(doubts, lambda y: F.exp(-y) * (1 + y + y * y / 2))


def tested(spans: str) -> Column:
    """Tokens with their p-values: array<struct<start, end, size class, p, token's hash>>, those without an encoding left out."""

    def one(x: Column, token: Column) -> Column:
        result = F.lit(None).cast("double")
        for alphabet, form in reversed(ALPHABETS.values()):  # the first that fits is asked first: outermost
            result = F.when(token.rlike(form), p_value(combined(token, alphabet))).otherwise(result)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.floor(F.log2(F.length(token))).cast("int").alias("size"), result.alias("p"), F.xxhash64(token).alias("token"))

    return F.filter(F.transform(F.col(spans), lambda x: let(F.regexp_replace(x["match"], "=+$", ""), lambda t: one(x, t))), lambda x: x["p"].isNotNull())


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(row: struct of the columns ``keep``, assign, access, hex, base: base spans, random: the spans of the battery) of every row."""
    rows = base(docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text")))
    rows = rows.withColumn("token", find("text", TOKEN)).withColumn("tested", tested("token"))
    rows = rows.withColumn("tested", F.filter("tested", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    rows = materialize(rows.select("row", *KINDS[:3], "base", "tested"), "secrets-tested")
    limits = thresholds(rows)
    found = F.filter("tested", lambda x: x["p"] >= F.coalesce(limits[x["size"]], F.lit(2.0)))
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))).cast(SPAN)
    return rows.withColumn("random", spans).drop("tested")


def least_threshold(counts: dict[int, int]) -> float | None:
    """The least threshold that keeps the share of false discoveries, from tokens by step (p is above 2 ** (-(step + 1) / STEPS)); None if there is none."""
    high = sum(n for step, n in counts.items() if step < STEPS)
    random_ones = 2 * (high + math.sqrt(high))
    best, above = None, 0
    for step in range(math.ceil(-math.log2(ALPHA) * STEPS)):
        above += counts.get(step, 0)
        t = 2 ** (-(step + 1) / STEPS)
        if above and random_ones * (1 - t) >= (1 - LEVEL) * above:
            best = t
    return best


def thresholds(rows: DataFrame) -> Column:
    """map<length class, least p-value> over all tested tokens; a table of fixed size (classes by steps) reaches the driver."""
    step = F.floor(-F.log2(F.greatest(F.col("t.p"), F.lit(1e-9))) * STEPS).cast("int")
    distinct = rows.select(F.explode("tested").alias("t")).select("t.token", "t.size", step.alias("step")).distinct()
    counts: dict[int, dict[int, int]] = {}
    for r in distinct.groupBy("size", "step").count().collect():
        counts.setdefault(r["size"], {})[r["step"]] = r["count"]
    least = {size: t for size, c in counts.items() if (t := least_threshold(c)) is not None}
    if not least:
        return F.create_map().cast("map<int,double>")
    return F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = scan(docs, ["doc_id"])
    return rows.select(
        "row.doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        listed(F.concat("base", "random"), KINDS).alias("spans"),
        F.size("random").cast("bigint").alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Every row with its secrets replaced by ``mark``; texts without any stay as they are (null too)."""
    rows = scan(docs, docs.columns).withColumn("text", F.col("row")["text"])
    spans = F.array_sort(F.concat("base", "random"))
    # overlapping spans are joined: the text between the furthest end so far and the next start stays
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["parts"], F.array(F.concat(_cut(F.col("text"), a["at"], s["start"]), F.lit(mark))))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["parts"]).alias("parts"))

    done = F.aggregate(spans, empty, step)
    clean = let(done, lambda d: F.concat(F.array_join(d["parts"], ""), _cut(F.col("text"), d["at"], F.length("text"))))
    text = F.when(F.size("base") + F.size("random") > 0, clean).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _cut(text: Column, start: Column, end: Column) -> Column:
    return text.substr(start + 1, F.greatest(end - start, F.lit(0)))
