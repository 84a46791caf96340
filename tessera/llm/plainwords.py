"""Lower-cased runs of ASCII letters, digits and all other non-ASCII characters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, after and before A-Z are lower-cased.
BREAK, BREAK_ANY_CASE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: DuckDB SQL for the words of a text.
SQL = f"regexp_extract_all(translate(coalesce({{0}}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def plain_words(text: Column) -> Column:
    """array<string>: the words of a text with A-Z (only these) in lower case; null has none.

    ASCII texts are lowered whole; of others only the words that are not ASCII need the slower translate().
    """
    ascii_only = lambda x: F.length(x) == F.octet_length(x)
    whole = F.split(F.lower(text), BREAK, -1)
    each = F.transform(F.split(text, BREAK_ANY_CASE, -1), lambda w: F.when(ascii_only(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER)))
    return F.coalesce(F.array_remove(F.when(ascii_only(text), whole).otherwise(each), ""), F.array().cast("array<string>"))
