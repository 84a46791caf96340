"""Substring dedup: removal of passages that occur earlier in the corpus.

A window is ``WINDOW`` consecutive words of one document. Every word covered by a window whose
words also start earlier (in a smaller doc_id, or before in the same document) is removed.

1. Candidate phrases. Every window has a leading phrase: of its runs of ``PHRASE`` words the one
   of least hash. Equal windows have equal leading phrases, and neighbouring windows mostly share
   theirs, so a document has about one phrase for each seven words. Hashes of phrases are counted
   over the corpus; a phrase whose hash is met once cannot lie in a repeated window.
2. Confirmation. Rows write out the words of their candidate phrases, and those whose words
   are met twice are the recurring phrases.
3. Location. Each row gets the recurring phrases of its hashes, as words. Documents are streamed in
   shards: the phrases of a shard are compiled into an Aho-Corasick automaton over word numbers, and
   every document of the shard runs through it. A window is a candidate if the automaton finds its leading
   phrase at its place; hashes of phrases play no part in that.
4. Windows. Candidate windows are hashed as a whole (128 bits over all words); for each hash
   the smallest doc_id is kept. A document owns the windows of which it is the smallest (it is told by
   64 bits which of its own windows these are); a candidate window it does not own, or has had before, is removed.

Phrases and windows are aggregated before every shuffle, so a passage that a third of all
documents share costs one row for each task. Joins with a hot key (phrase to
documents) are plain exchanges, which Spark can split. What one step writes for the next is deleted
when it has been used.

Defined cases: null, empty and blank texts have no words; rows of one doc_id never count as
earlier than each other; null doc_id comes after all others (such rows are documents of their
own, and never earlier than each other); with fewer than ``WINDOW`` words
nothing is removed; texts of any length are held one shard (``SHARD_WORDS`` words, at least
one document) at a time; other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, freed, materialize, small_batches
from tessera.llm.wordhash import mix, run_hashes, word_hashes, words

WINDOW, PHRASE = 20, 8
SHARD_WORDS = 200_000
#: Values of one character in the automata.
BASE = 64
LAST = (1 << 63) - 1


class Text:
    """A document's words, their runs and each window's leading phrase."""

    def __init__(self, raw: bytes, bits: int = 64):
        self.raw = raw
        self.starts, self.ends = words(raw)
        self.hashes = word_hashes(raw, self.starts, self.ends)
        #: Hashes of phrases; only their first ``bits`` are used.
        self.runs = run_hashes(self.hashes, PHRASE) >> np.uint64(64 - bits)

    def leaders(self) -> np.ndarray:
        """For each window the place of its leading phrase (the first of least hash)."""
        span = WINDOW - PHRASE + 1
        n = len(self.hashes) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        at = np.arange(len(self.runs))
        size = 1
        while size < span:  # least of 1, 2, 4, ... runs, the last step overlapping
            step = min(size, span - size)
            a, b = at[:-step], at[step:]
            at = np.where(self.runs[b] < self.runs[a], b, a)
            size += step
        return at

    def places(self) -> np.ndarray:
        """The places of leading phrases, each once."""
        at = self.leaders()
        return at[np.flatnonzero(np.diff(at, prepend=-1))]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows at some places."""
        return run_hashes(self.hashes, WINDOW)[at], run_hashes(second(self.hashes), WINDOW)[at]


def second(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the same words that do not follow the first ones' sums."""
    return mix(hashes ^ np.uint64(0xA0761D6478BD642F))


def _raw(text) -> bytes:
    return (text.as_py() or "").encode()


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _phrases(docs: DataFrame, bits: int) -> DataFrame:
    """(phrase, row, twice): the distinct leading phrases of every row, and whether the row leads with one at two places."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for row, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = Text(_raw(t), bits)
                at = text.places()
                if len(at):
                    h, n = np.unique(text.runs[at], return_counts=True)
                    out.append((h, np.full(len(h), row), n > 1))
            h, d, n = ((np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=k)) for i, k in enumerate((np.uint64, np.int64, bool)))
            yield pa.record_batch([_signed(h), pa.array(d, pa.int64()), pa.array(n, pa.bool_())], names=["phrase", "row", "twice"])

    return docs.mapInArrow(freed(run), "phrase bigint, row bigint, twice boolean")


def _spelled(rows: DataFrame, bits: int) -> DataFrame:
    """(phrase, words, twice): the distinct words of every row's candidate phrases, from (text, known hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, bytes, bool]] = []
            for t, known in zip(b.column(0), b.column(1), strict=True):
                text = Text(_raw(t), bits)
                at = text.places()
                at = at[np.isin(text.runs[at], np.asarray(known.values).view(np.uint64))]
                split = text.raw.split()
                seen: dict[tuple[int, bytes], int] = {}
                for h, p in zip(text.runs[at].view(np.int64).tolist(), at.tolist(), strict=True):
                    key = (h, b" ".join(split[p : p + PHRASE]))
                    seen[key] = seen.get(key, 0) + 1
                out += [(*key, n > 1) for key, n in seen.items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["phrase", "words", "twice"])

    return rows.mapInArrow(freed(run), "phrase bigint, words binary, twice boolean")


def locate(texts: list[Text], phrases: set[bytes]) -> list[np.ndarray]:
    """For each text of a shard the places where the automaton of the phrases finds one.

    Word numbers are spelled with characters of ``BASE`` values, another range of characters for each digit: so a
    node has few children (pyahocorasick searches them one by one), and no match can begin inside a number.
    """
    numbers: dict[bytes, int] = {}
    keys = [[numbers.setdefault(w, len(numbers)) for w in p.split()] for p in phrases]
    width = 1
    while BASE**width < len(numbers):
        width += 1
    names = ["".join([chr(1 + d * BASE + n // BASE**d % BASE) for d in range(width)]) for n in range(len(numbers))]
    finder = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for key in keys:
        finder.add_word("".join([names[n] for n in key]))
    finder.make_automaton()
    name, unknown, out = dict(zip(numbers, names, strict=True)).get, "\0" * width, []
    for text in texts:
        found = [end for end, _ in finder.iter("".join([name(w, unknown) for w in text.raw.split()]))]
        out.append((np.array(found, dtype=np.int64) + 1) // width - PHRASE)
    return out


LOCATED = "row bigint, doc bigint, text string, flags binary, n_words bigint, n_removed bigint, kept_sha256 string"


def _located(rows: DataFrame, bits: int) -> DataFrame:
    """Documents with candidates: text and packed window flags. Others: their result.

    From (row, doc, text, spelled: recurring phrases of the row's hashes).
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in LOCATED.split(", ")]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def untouched(row: int, doc: int, raw: bytes) -> tuple:
        split = raw.split()
        return row, doc, None, None, len(split), 0, hashlib.sha256(b" ".join(split)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, int, Text]] = []
        phrases: set[bytes] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            out = []
            for (row, doc, text), places in zip(shard, locate([s[2] for s in shard], phrases), strict=True):
                found = np.zeros(len(text.runs), dtype=bool)
                found[places] = True
                flags = found[text.leaders()]
                if flags.any():
                    out.append((row, doc, text.raw.decode(), np.packbits(flags).tobytes(), len(text.starts), None, None))
                else:
                    out.append(untouched(row, doc, text.raw))
            shard.clear()
            phrases.clear()
            return batch(out)

        for b in batches:
            out = []
            for row, doc, t, spelled in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                raw = _raw(t)
                if not spelled.is_valid:
                    out.append(untouched(row, doc, raw))
                    continue
                shard.append((row, doc, Text(raw, bits)))
                phrases.update(spelled.values.to_pylist())
                size += len(shard[-1][2].starts)
                if size >= SHARD_WORDS:
                    yield flush()
                    size = 0
            yield batch(out)
        if shard:
            yield flush()

    return rows.mapInArrow(freed(run), LOCATED)


def _flagged(packed: bytes, n: int) -> np.ndarray:
    """The places of a text's candidate windows; n: its words."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n - WINDOW + 1))


def _windows(located: DataFrame, key: str) -> DataFrame:
    """(a, b, key): the distinct candidate windows of every row, with its column ``key`` (row or doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for own, t, packed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = Text(_raw(t))
                a, b = text.windows(_flagged(packed, len(text.starts)))
                out.append((a, b, np.full(len(a), own)))
            a, b, own = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=k) for i, k in enumerate((np.uint64, np.uint64, np.int64)))
            yield pa.record_batch([_signed(a), _signed(b), pa.array(own, pa.int64())], names=["a", "b", key])

    return located.select(key, "text", "flags").mapInArrow(freed(run), f"a bigint, b bigint, {key} bigint")


def _resolved(rows: DataFrame, whole_text: bool) -> DataFrame:
    """The results of documents with candidates, from (row, doc, text, flags, owned: first hashes of windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, doc, t, packed, owned in zip(*(batch.column(i).to_pylist() if i in (0, 1, 3) else batch.column(i) for i in range(5)), strict=True):
                text = Text(_raw(t))
                raw, n = text.raw, len(text.starts)
                at = _flagged(packed, n)
                a, _ = text.windows(at)
                first = np.zeros(len(a), dtype=bool)
                first[np.unique(a, return_index=True)[1]] = True
                mine = np.isin(a, np.asarray(owned.values).view(np.uint64)) if owned.is_valid else np.zeros(len(a), dtype=bool)
                gone = at[~(first & mine)]
                cover = np.bincount(gone, minlength=n + 1) - np.bincount(gone + WINDOW, minlength=n + 1)
                removed = np.cumsum(cover[:-1]) > 0
                lost = int(removed.sum())
                split = raw.split()
                kept = b" ".join([split[i] for i in np.flatnonzero(~removed).tolist()] if lost else split)
                out.append((row, doc, n, lost, hashlib.sha256(kept).hexdigest(), (kept if lost else raw).decode() if whole_text else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "doc", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return rows.mapInArrow(freed(run), "row bigint, doc bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def _recurs(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select(*keys)


def _removed(d: DataFrame, whole_text: bool, bits: int = 64) -> DataFrame:
    """row, doc, n_words, n_removed, kept_sha256, kept_text (of rows with candidates, if asked for), from (row, doc, text).

    Rows that share a number must have one doc, or null ids and equal texts. What such a row gets
    from the others are more phrases for its automaton, which change nothing. ``bits`` of a phrase's hash are used.
    """
    phrases = materialize(_phrases(d.select("row", "text"), bits), "phrases")
    again = materialize(_recurs(phrases, "phrase"), "phrases-again")
    known = materialize(phrases.join(again.hint("shuffle_hash"), "phrase").select("phrase", "row"), "phrases-known")
    discard(phrases, again)
    hashes = known.groupBy("row").agg(F.collect_list("phrase").alias("known"))
    spelled = _recurs(_spelled(d.select("row", "text").join(hashes.hint("shuffle_hash"), "row").select("text", "known"), bits), "phrase", "words")
    spelled = materialize(spelled, "phrases-spelled")
    mine = materialize(known.join(spelled.hint("shuffle_hash"), "phrase").select("row", "words"), "phrases-mine")
    discard(known, spelled)
    theirs = mine.groupBy("row").agg(F.collect_list("words").alias("spelled")).hint("shuffle_hash")
    done = materialize(_located(d.join(theirs, "row", "left").select("row", "doc", "text", "spelled"), bits), "phrases-located")
    discard(mine)
    located = done.where("flags is not null").select("row", "doc", "text", "flags")
    first = _windows(located, "doc").groupBy("a", "b").agg(F.min("doc").alias("doc"))
    nameless = located.where(F.col("doc") == LAST)
    none = F.lit(0).cast("bigint").alias("own")
    if nameless.isEmpty():
        owned = first.select("doc", none, "a")
    else:
        # a row without an id gets its own windows only, not those of all such rows
        first = materialize(first, "phrases-first")
        theirs = _windows(nameless, "row").distinct().join(first.where(F.col("doc") == LAST), ["a", "b"])
        owned = first.where(F.col("doc") != LAST).select("doc", none, "a").unionAll(theirs.select("doc", F.col("row").alias("own"), "a"))
    owned = materialize(owned.groupBy("doc", "own").agg(F.collect_list("a").alias("owned")), "phrases-owned")
    discard()
    own = F.when(F.col("doc") == LAST, F.col("row")).otherwise(F.lit(0).cast("bigint"))
    resolved = _resolved(located.withColumn("own", own).join(owned.hint("shuffle_hash"), ["doc", "own"], "left").select("row", "doc", "text", "flags", "owned"), whole_text)
    rest = done.where("flags is null").select("row", "doc", "n_words", "n_removed", "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    return resolved.unionAll(rest)


def _ordered() -> Column:
    """doc_id as the order of windows; null comes last."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    row = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("row")
    return _removed(docs.select(row, _ordered(), "text"), False).select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of the texts; texts that lose nothing stay as they are. Every row stays one row."""
    # row numbers are stable once written; docs' columns travel in a struct, so no name can clash
    columns = F.struct(*[docs[c] for c in docs.columns]).alias("columns")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), columns), "phrases-rows")
    kept = _removed(rows.select("row", "columns.doc_id", "columns.text").select("row", _ordered(), "text"), True).where("n_removed > 0").select("row", "kept_text")
    out = rows.join(materialize(kept, "phrases-kept"), "row", "left")
    text = F.coalesce("kept_text", "columns.text")
    return out.select(*[text.alias(c) if c == "text" else F.col("columns")[c].alias(c) for c in docs.columns])
