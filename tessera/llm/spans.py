"""Spans of regular-expression matches as column expressions (no Python on the executors).

``split`` gives what lies between the leftmost non-overlapping matches of a pattern and
``regexp_extract_all`` the matches themselves, so positions follow by adding lengths. Lengths
count code points. Patterns are Java's; repeated groups are possessive, which
matches the same text here without recursion on long input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches of one text whose lengths are added one by one before block sums are used.
STRIDE = 64

SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once: what a lambda names from outside would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _place(between: Column, matches: Column) -> Column:
    """Matches with their positions; between has what lies before each match, and one piece more.

    Sums of whole strides come first, so a text with n matches costs n * (STRIDE + n / STRIDE) additions.
    """

    def whole(i: Column) -> Column:
        return (i / STRIDE).cast("int")

    def place(sums: Column, blocks: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = _total(F.slice(blocks, F.lit(1), whole(i))) + _total(F.slice(sums, whole(i) * STRIDE + 1, i % STRIDE)) + F.length(F.get(between, i))
            return let(start, lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))

        return F.transform(matches, one)

    sums = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.length(b) + F.length(m))
    blocks = lambda s: F.transform(F.sequence(F.lit(0), whole(F.size(s) - 1)), lambda b: _total(F.slice(s, b * STRIDE + 1, F.lit(STRIDE))))
    return let(sums, lambda s: let(blocks(s), lambda b: place(s, b)))


def find(text: str, pattern: str, gate: Column | None = None) -> Column:
    """array<struct<start, end, match>> of a column's matches; ``gate`` must hold wherever there is a match."""
    parts = F.struct(F.split(F.col(text), pattern, -1).alias("between"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("matches"))
    found = let(parts, lambda p: _place(p["between"], p["matches"]))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    any_match = F.col(text).rlike(pattern)
    return F.when(any_match if gate is None else gate & any_match, found).otherwise(none)


def kept(found: str, kind: int, good=None) -> Column:
    """The spans of a column of ``find`` whose match is good, numbered by kind."""
    col = F.col(found) if good is None else F.filter(F.col(found), lambda x: good(x["match"]))
    return F.transform(col, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(SPAN)


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
