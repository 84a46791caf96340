"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over labelled text. A text is cross-parsed
against each automaton: from left to right, the longest match to any place of the
labelled text is one phrase. A language's cross-parsing entropy of a text is its number of phrases
times log2 of the labelled bytes, for each byte of the text (Ziv and Merhav); the language of least
entropy wins.

Texts are parsed as lower-case UTF-8 with one blank for every run of ASCII characters that are not
letters, so phrases cross words. Whole texts are parsed, in blocks of ``BLOCK`` bytes: a phrase ends
with its block. The blocks of many texts step through all automata side by side, one table
look-up for a byte and a language; the automata are flat tables of states by bytes.

Training: a bounded sample, ``SAMPLE_ROWS`` labelled rows of each language (those of
least hash, of those with a letter), at most ``ROW_CHARS`` characters of a row from its first letter on
and ``SAMPLE_BYTES`` bytes of each language in all. Every label is learned. Tables are large, so languages
go in groups of at most ``PASS_BYTES`` of samples, each compared in a pass of its own over the texts;
further passes carry on the least and second least entropy so far. Prediction covers all
rows and whole texts.

Defined cases: null text and text without a letter are ``und`` with score 0; so is every
text if nothing was learned. Ties go to the language first in order. The score is
1 - (least entropy) / (second least entropy); 1 if only one language was learned. Rows
of one id are judged one by one; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import materialize, resident, small_batches

SAMPLE_ROWS = 400
ROW_CHARS = 4096
SAMPLE_BYTES = 1 << 16
#: Bytes of samples whose automata a worker holds at once (a byte takes some 300 bytes of a table).
PASS_BYTES = 6 << 16
BLOCK = 1024
#: Blocks that step side by side.
LANES = 4096
#: Bytes of texts that a worker gathers before it parses them.
GATHER = 4 << 20

letter = regex.compile(r"\p{L}").search
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_NEW, _STATE = 30, (1 << 30) - 1


def normal(text: str | None) -> bytes:
    """What is parsed of a text; empty if it has no letter."""
    if not text or not letter(text):
        return b""
    return b" %b " % b" ".join(text.lower().encode().translate(_LETTERS).split())


def suffix_automaton(sample: bytes, classes: np.ndarray, width: int) -> np.ndarray:
    """The table of a sample's suffix automaton, by state * width + class of the next byte.

    An entry is the next state * width, plus 1 << 30 if the byte begins a new phrase. The root, state 0,
    stands for no phrase at all; bytes of class 0 are in no sample and lead there.
    """
    follow = array("i", [-1]) * (2 * len(sample) * width + width)
    link, length = [-1], [0]
    last = 0
    for c in classes[np.frombuffer(sample, dtype=np.uint8)].tolist():
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and follow[at * width + c] < 0:
            follow[at * width + c] = new
            at = link[at]
        if at >= 0:
            to = follow[at * width + c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                follow[copy * width : (copy + 1) * width] = follow[to * width : (to + 1) * width]
                while at >= 0 and follow[at * width + c] == to:
                    follow[at * width + c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    table = np.frombuffer(follow, dtype=np.int32)[: len(length) * width].reshape(-1, width) * np.int32(width)
    first = np.where(table[0] >= 0, table[0], 0) | (1 << _NEW)
    table[0] = first
    missing = table < 0
    table[missing] = np.broadcast_to(first, table.shape)[missing]
    return table.ravel()


class Model:
    """Suffix automata by language, made from samples of normal text, in one table."""

    def __init__(self, sample: dict[str, bytes]):
        self.langs = sorted(sample)
        seen = np.unique(np.frombuffer(b"".join(sample.values()), dtype=np.uint8))
        self.classes = np.zeros(256, dtype=np.uint8)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.bits = [math.log2(max(2, len(sample[x]))) for x in self.langs]
        parts = [suffix_automaton(sample[x], self.classes, len(seen) + 1) for x in self.langs]
        self.starts = np.cumsum([0, *map(len, parts)])[:-1][:, None]
        self.table = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (row) by language (column)."""
        blocks, owner = [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), BLOCK):
                blocks.append(t[at : at + BLOCK])
                owner.append(i)
        sizes = np.array([len(b) for b in blocks], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        total = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        owners = np.array(owner, dtype=np.int64)
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            np.add.at(total, owners[lanes], self._steps([blocks[i] for i in lanes.tolist()], sizes[lanes]).T)
        return total

    def _steps(self, blocks: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Phrases by language (row) of blocks of falling size."""
        longest = int(sizes[0])
        codes = np.frombuffer(b"".join([b.ljust(longest, b"\0") for b in blocks]), dtype=np.uint8)
        codes = np.ascontiguousarray(self.classes[codes].reshape(-1, longest).T)
        running = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()
        shape = (len(self.langs), len(blocks))
        state, count = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
        state += self.starts
        for step, k in enumerate(running):
            to = self.table.take(state[:, :k] + codes[step, :k], mode="clip")
            count[:, :k] += to >> _NEW
            np.add(to & _STATE, self.starts, out=state[:, :k])
        return count

    def compare(self, texts: list[str | None], before: list | None = None) -> list[tuple[str, float, float] | None]:
        """For each text the language of least entropy, its and the second least entropy (-1 if none), given what earlier languages had."""
        raw = [normal(t) for t in texts]
        out = list(before or [None] * len(raw))
        if not self.langs:
            return out
        counts = self.phrases(raw)
        for i, (t, row) in enumerate(zip(raw, counts.tolist(), strict=True)):
            if not t:
                continue
            found = [(bits * n / len(t), name) for bits, n, name in zip(self.bits, row, self.langs, strict=True)]
            if out[i] is not None:
                name, least, second = out[i]
                found += [(least, name)] + [(second, name)] * (second >= 0)
            # an earlier language comes first among equals, and within a pass the first in order
            found.sort()
            out[i] = (found[0][1], found[0][0], found[1][0] if len(found) > 1 else -1.0)
        return out


def verdict(best: tuple[str, float, float] | None) -> tuple[str, float]:
    """lang_pred and score."""
    if best is None:
        return "und", 0.0
    return best[0], 1.0 if best[2] < 0 else 1 - best[1] / best[2]


def held_out(col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Language -> sample of normal text, from labelled rows that are not held out."""
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    # thin out by hash first, so that a window never sorts a large share of the rows
    # (one row a label: broadcast, so that texts are not dealt out by label)
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), 4.0 * SAMPLE_ROWS / F.count("*")).alias("share"))
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    w = Window.partitionBy("lang").orderBy("rank", "text")
    start = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, ROW_CHARS)
    rows = (
        known.select("lang", rank.alias("rank"), start.alias("text"))
        .join(F.broadcast(share), "lang").where(F.col("rank") < F.col("share") * (1 << 40))
        .withColumn("n", F.row_number().over(w)).where(F.col("n") <= SAMPLE_ROWS)
        .select("lang", "n", "text")
    )
    sample: dict[str, bytes] = {}
    for r in rows.orderBy("n", "lang").toLocalIterator():
        have = sample.get(r["lang"], b" ")
        sample[r["lang"]] = have + normal(r["text"])[1 : 1 + max(0, SAMPLE_BYTES - len(have))]
    return sample


def _model(sample: dict[str, bytes]) -> Model:
    return resident(("langid", tuple(sorted(sample.items()))), lambda: Model(sample))


def groups(sample: dict[str, bytes]) -> list[list[str]]:
    """Languages of one pass each, in order; at least one pass."""
    out: list[list[str]] = [[]]
    held = 0
    for x in sorted(sample):
        if out[-1] and held + len(sample[x]) > PASS_BYTES:
            out.append([])
            held = 0
        out[-1].append(x)
        held += len(sample[x])
    return out


BEST = T.StructType([T.StructField("lang", T.StringType()), T.StructField("least", T.DoubleType()), T.StructField("second", T.DoubleType())])


def identify(docs: DataFrame, sample: dict[str, bytes]) -> DataFrame:
    """(row: struct of docs' columns, lang_pred, score) for every row, without a shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"), F.lit(None).cast(BEST).alias("best"))
    passes = groups(sample)
    for n, group in enumerate(passes):
        rows = _pass(rows, {x: sample[x] for x in group})
        if n < len(passes) - 1:
            rows = materialize(rows, "langid-pass")  # else the passes' workers would hold all automata side by side
    return rows.select("row", F.coalesce("best.lang", F.lit("und")).alias("lang_pred"), _score(F.col("best")).alias("score"))


def _score(best: Column) -> Column:
    return F.when(best.isNull(), 0.0).when(best["second"] < 0, 1.0).otherwise(1 - best["least"] / best["second"])


def _pass(rows: DataFrame, sample: dict[str, bytes]) -> DataFrame:
    """Compares one group of languages; best is what earlier passes found, then with this one's."""
    shared = rows.sparkSession.sparkContext.broadcast(sample)
    kind = pa.struct([("lang", pa.string()), ("least", pa.float64()), ("second", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [t for b in held for t in b.column(1).to_pylist()]
            before = [x and (x["lang"], x["least"], x["second"]) for b in held for x in b.column(2).to_pylist()]
            found = [x and {"lang": x[0], "least": x[1], "second": x[2]} for x in model.compare(texts, before)]
            at = 0
            for b in held:
                yield pa.record_batch([b.column(0), b.column(1), pa.array(found[at : at + b.num_rows], kind)], names=["row", "text", "best"])
                at += b.num_rows
            held.clear()

        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= GATHER:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, rows.schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from the others' labels."""
    few = docs.select("doc_id", "text")
    return identify(few, learn(docs)).select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score")
