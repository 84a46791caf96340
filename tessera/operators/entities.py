"""Entity resolution, canonicalisation and expansion over names and graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.relational import both_ways, latest
from tessera.sources import scratch

#: Legal suffixes that do not distinguish names.
SUFFIXES = r"\s+(inc|corp|corporation|co|ltd|llc|plc|sa|ag|group|holdings)\.?$"


def bare(name: Column) -> Column:
    """Lower case, single blanks, legal suffix stripped."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " ")), SUFFIXES, "")


def word_runs(names: DataFrame) -> DataFrame:
    """names (bare, longest, ...) with each distinct run of at most ``longest`` whole words of ``bare``, as ``run``."""
    words = F.split("bare", " ")
    ends = lambda i: F.sequence(F.lit(1), F.least(F.size(words) - i + 1, F.col("longest")))
    runs = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(ends(i), lambda n: F.array_join(F.slice(words, i, n), " ")))
    return names.where("longest > 0 and bare is not null").withColumn("run", F.explode(F.array_distinct(F.flatten(runs))))


def tiered_match(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_id, confidence): exact 0.95, suffix-stripped 0.85, whole-word containment 0.6; best tier, then smallest id.

    An entity that a name contains is one of the name's runs of whole words, so containment is an equi-join: a first word that
    all entities share pairs nothing. Runs are no longer than the longest entity.
    """
    n = names.select("name", F.lower(F.trim("name")).alias("low"), bare(F.col("name")).alias("bare")).distinct()
    e = entities.select("entity_id", F.lower(F.trim("entity")).alias("e_low"), bare(F.col("entity")).alias("e_bare"))
    exact = n.join(e, n["low"] == e["e_low"]).select("name", "entity_id", F.lit(0.95).alias("confidence"))
    strip = n.join(e, n["bare"] == e["e_bare"]).select("name", "entity_id", F.lit(0.85).alias("confidence"))
    longest = e.agg(F.coalesce(F.max(F.size(F.split("e_bare", " "))), F.lit(0)).alias("longest"))  # one row
    inside = word_runs(n.crossJoin(F.broadcast(longest))).join(e, F.col("run") == F.col("e_bare"))
    every = exact.unionByName(strip).unionByName(inside.select("name", "entity_id", F.lit(0.6).alias("confidence")))
    return latest(every, ["name"], [F.desc("confidence"), F.col("entity_id")])


def canonicalise(mentions: DataFrame, block: str = "block") -> DataFrame:
    """Adds ``canonical``: the first earlier mention of the block with the same cik, else ticker, else bare name, else a contained name; else itself.

    Greedy in mention order, so one block is handled in one place; blocks must be bounded (for
    example the first letters of the bare name). A mention costs the square of its words, whatever the block's size.
    """

    def parts(name: str) -> list[str]:
        """Every run of whole words of a name."""
        words = (name or "").split(" ")
        return [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mention_id")
        by: dict[tuple, int] = {}
        # of first names: the name, and the first name that holds a run of words; values count up in order
        names: dict[str, tuple[int, int]] = {}
        holding: dict[str, tuple[int, int]] = {}
        out = []
        for m, cik, ticker, name in zip(pdf["mention_id"], pdf["cik"], pdf["ticker"], pdf["bare"], strict=True):
            keys = [(k, v) for k, v in (("cik", cik), ("ticker", ticker), ("name", name)) if v is not None and v == v]
            hit = next((by[k] for k in keys if k in by), None)
            if hit is None:
                met = [names[x] for x in parts(name) if x in names] + [holding[x] for x in (name,) if x in holding]
                hit = min(met)[1] if met else None
            if hit is None:
                hit = m
                names[name] = (len(names), m)
                for x in parts(name):
                    holding.setdefault(x, names[name])
            for k in keys:
                by.setdefault(k, hit)
            out.append(hit)
        return pdf.assign(canonical=out)[["mention_id", "canonical"]]

    rows = mentions.withColumn("bare", bare(F.col("name")))
    return rows.groupBy(block).applyInPandas(assign, "mention_id bigint, canonical bigint")


def _keys(rows: DataFrame) -> DataFrame:
    """(m, k, owner) of every mention: its identifier, its ticker, its name, and every run of whole words inside its name.

    Two mentions are alike if one owns a key that the other has: both own equal identifiers, tickers and names; of a
    name that stands inside another one, the shorter is the owner. Inner runs of fewer than three letters are no keys.
    """
    words = F.split("bare", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda n: F.array_join(F.slice(words, i, n), " "))))
    inner = F.filter(F.array_distinct(runs), lambda r: (F.length(r) >= 3) & (r != F.col("bare")))
    key = lambda kind, value, owner: F.struct(F.concat(F.lit(kind), value).alias("k"), F.lit(owner).alias("owner"))
    own = [key("c:", F.col("cik"), True), key("t:", F.col("ticker"), True), key("n:", F.col("bare"), True)]
    every = F.concat(F.array(*own), F.transform(inner, lambda r: key("n:", r, False)))
    return rows.select("m", F.explode(every).alias("x")).select("m", "x.k", "x.owner").where("k is not null")


def _firsts(rows: DataFrame, owner: str, other: str) -> DataFrame:
    """By key the first mention that owns it and the first that has it."""
    return rows.groupBy("k").agg(F.min(F.when(F.col("owner"), F.col("m"))).alias(owner), F.min("m").alias(other))


def _earlier(owner: str, other: str) -> Column:
    """The first mention like this one that comes before it, from one key's firsts: owners for all, all for owners."""
    first = F.least(F.col(owner), F.when(F.col("owner"), F.col(other)))
    return F.when(first < F.col("m"), first)


def canonicals(mentions: DataFrame) -> DataFrame:
    """(mention_id, canonical): the record that each mention belongs to, as if they were settled one after another by mention_id.

    mentions: mention_id (unique, not null), cik, ticker, name; empty identifiers count as none. A mention joins the first record with its
    cik, else with its ticker, else the first whose name (without legal suffixes) equals, contains or is contained in its own in whole
    words; if there is none it becomes a record, with its own name, cik and ticker. Names of fewer than two letters join nothing: canonical is null.

    Records are those mentions that no earlier record is like. They are found in rounds, all at once: a mention with an earlier record like
    it is none; one without any earlier open mention like it is a record; the rest waits. Pairs are never formed: a key's first
    open mention and first record (two numbers each, aggregated before the shuffle) tell all that have the key. Each round settles
    at least the first open mention of every group, in practice nearly all: the number of rounds is the longest chain of waiting.
    """
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    rows = mentions.select(F.col("mention_id").alias("m"), some("cik").alias("cik"), some("ticker").alias("ticker"), bare(F.col("name")).alias("bare"))
    named = rows.where(F.length("bare") >= 2)
    keys = scratch.written(_keys(named), "mention-keys")
    shared = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    keys = scratch.written(keys.join(shared, "k", "left_semi"), "mention-keys")  # keys of one mention decide nothing
    open_keys, records = keys, None
    while not open_keys.isEmpty():
        seen = open_keys.join(_firsts(open_keys, "open_owner", "open_any"), "k")
        if records is not None:
            seen = seen.join(records, "k", "left")
        else:
            seen = seen.withColumn("rec_owner", F.lit(None).cast("bigint")).withColumn("rec_any", F.lit(None).cast("bigint"))
        told = seen.groupBy("m").agg(F.min(_earlier("rec_owner", "rec_any")).alias("record"), F.min(_earlier("open_owner", "open_any")).alias("waits"))
        told = scratch.written(told, "mention-round")
        new = _firsts(open_keys.join(told.where("record is null and waits is null").select("m"), "m", "left_semi"), "rec_owner", "rec_any")
        known = new if records is None else records.unionByName(new).groupBy("k").agg(F.min("rec_owner").alias("rec_owner"), F.min("rec_any").alias("rec_any"))
        records = scratch.written(known, "mention-records")
        open_keys = scratch.written(open_keys.join(told.where("record is null and waits is not null").select("m"), "m", "left_semi"), "mention-keys")
    out = rows.select(F.col("m").alias("mention_id"), F.when(F.length("bare") >= 2, F.col("m")).alias("itself"))
    if records is None:
        return out.select("mention_id", F.col("itself").alias("canonical"))
    met = keys.join(records, "k").withColumn("record", _earlier("rec_owner", "rec_any"))
    by = [F.min(F.when(F.col("k").startswith(kind), F.col("record"))) for kind in ("c:", "t:", "n:")]
    found = met.groupBy("m").agg(F.coalesce(*by).alias("record"))
    return out.join(found, out["mention_id"] == found["m"], "left").select("mention_id", F.coalesce("record", "itself").alias("canonical"))


def expand(words: DataFrame, aliases: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, word, found): up to ``most`` other names of each word, both ways, lower-cased on both sides."""
    pairs = both_ways(aliases.select(F.lower("name").alias("name"), F.lower("alias").alias("alias")), "name", "alias").distinct()
    x = words.select("query_id", F.lower("word").alias("word")).join(pairs, F.col("word") == F.col("node")).select("query_id", "word", F.col("other").alias("found")).distinct()
    return latest(x, ["query_id", "word"], [F.col("found")], most)


def graph_expanded(queries: DataFrame, names: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, added: array<string>): the names that a query's words lead to over one edge.

    queries: query_id, text; names: node, name (lower case); edges: node, other, strength (both ways, each pair once). A word (three bytes or more, without signs around it) stands
    for the first name, in their order, that contains it. Of each name the ``most`` strongest neighbours count (ties by name). Added are those
    that the query does not contain, each once, in the order of the words and of their strength. Words meet names by the parts of the names' words.
    """
    cut = queries.select("query_id", F.lower("text").alias("low"), F.posexplode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("pos", "raw")).where(F.octet_length("raw") >= 3)
    words = cut.select("query_id", "low", "pos", F.regexp_replace(F.lower("raw"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("w")).where("w <> ''")
    asked = words.select("w").distinct()
    lengths = asked.select(F.length("w").alias("n")).distinct()
    pieces = names.select("name", F.explode(F.array_distinct(F.split("name", r"[ \t\n\x0B\f\r]+"))).alias("piece")).where("piece <> ''")
    sizes = pieces.withColumn("n", F.explode(F.sequence(F.lit(1), F.length("piece")))).join(F.broadcast(lengths), "n", "left_semi")
    parts = sizes.select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("piece") - F.col("n") + 1), lambda i: F.substring(F.col("piece"), i, F.col("n"))))).alias("w"))
    hit = parts.join(asked, "w", "left_semi").groupBy("w").agg(F.min("name").alias("name"))
    of = names.select(F.col("node").alias("other"), F.col("name").alias("other_name"))
    near = latest(edges.join(of, "other"), ["node"], [F.desc("strength"), F.col("other_name")], most)
    w = Window.partitionBy("node").orderBy(F.desc("strength"), "other_name")
    near = near.withColumn("k", F.row_number().over(w)).join(names, "node").select("name", "other_name", "k")
    found = words.join(hit, "w").join(near, "name").where(~F.contains("low", F.col("other_name")))
    first = found.groupBy("query_id", "other_name").agg(F.min(F.struct("pos", "k")).alias("at"))
    listed = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("at", "other_name"))).alias("x"))  # at most ``most`` for each word of a query
    added = F.transform("x", lambda x: x["other_name"])
    return queries.select("query_id").join(listed, "query_id", "left").select("query_id", F.coalesce(added, F.array().cast("array<string>")).alias("added"))


def contained(issuers: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, filings): distinct filings whose issuer equals, contains or is contained in the topic.

    Whichever contains the other, the three letters at the start of the shorter one are somewhere in the longer; names
    shorter than that meet on each of their letters' runs of the same length.
    """
    i = issuers.select("filing", bare(F.col("issuer")).alias("i")).distinct()
    t = topics.select("topic", bare(F.col("topic")).alias("t")).distinct()

    def start(c: str) -> Column:
        return F.substring(c, 1, 3)

    def runs(c: str) -> Column:
        """All runs of one to three letters."""
        of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda p: F.substring(c, p, F.lit(n)))
        return F.explode(F.array_distinct(F.flatten(F.array(of(1), of(2), of(3)))))

    wide = i.withColumn("w", runs("i")).join(t.withColumn("w", start("t")), "w").where(F.contains("i", F.col("t")))
    narrow = i.withColumn("w", start("i")).join(t.withColumn("w", runs("t")), "w").where(F.contains("t", F.col("i")))
    met = wide.select("topic", "filing").unionByName(narrow.select("topic", "filing"))
    return met.groupBy("topic").agg(F.count_distinct("filing").alias("filings"))
