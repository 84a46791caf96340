"""Exact BPE encoding in linear time, and table decoding.

The encoder walks a word left to right over the longest vocabulary tokens that
an Aho-Corasick automaton finds at each position. A token may follow another
only if the two are *compatible*: BPE run on their joined text gives just these
two. A sequence of pairwise compatible tokens is the BPE result, so the walk
takes the longest compatible token, tries ever shorter ones when that fails, and
steps back (marking the position dead) when none fits. Positions die at most
once, which bounds the walk. Most words need no step back: their leftmost longest
matches are compatible as they stand.

Tokens are numbered by merge rank inside the encoder: 512 single symbols (a byte,
or a byte that ends a word), then one token per merge rule.

The vocabulary file is the JSON of the public ``tokenizers`` library with a
BPE model that marks word ends by a suffix; normaliser NFC + lower case, words
split by a pattern. Other shapes raise ValueError. Special tokens in a text are
recognised as that library does by default.

Defined cases: null text encodes like an empty one, to no ids; an id outside
the vocabulary raises IndexError on decoding; long texts are decoded in blocks.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import resident, small_batches

#: Entries kept in a worker's table of words (some 200 bytes each) and in its pair table; each starts anew when full.
WORD_CACHE = 1_500_000
PAIR_CACHE = 1_000_000
#: Longer words are not kept.
KEPT_CHARS = 64
#: Letters before this one are letters by Python and by the word pattern alike: a run of them is one word.
LATIN_END = "\u0250"
MARKS = frozenset(".,;:!?)")
#: White space for str.split(), but not by the Unicode property that the word pattern uses.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Ids that are decoded at once.
BLOCK = 1 << 16


def _byte_chars() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class OffsetTable:
    """Byte strings in one buffer; rows are looked up by id and joined."""

    def __init__(self, rows: list[bytes]):
        self.buffer = np.frombuffer(b"".join(rows), dtype=np.uint8)
        self.offsets = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum([len(r) for r in rows], out=self.offsets[1:])

    def join(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """The rows of ids, one after another, in blocks."""
        if len(ids) and int(ids.max()) >= len(self.offsets) - 1:
            raise IndexError("id outside the vocabulary")
        for at in range(0, len(ids), BLOCK):
            part = ids[at : at + BLOCK]
            first = self.offsets[part]
            sizes = self.offsets[part + 1] - first
            ends = np.cumsum(sizes)
            yield self.buffer[np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)]


class _Pairs(dict):
    """left << 20 | right -> whether right may follow left, filled when first asked for."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIR_CACHE:
            self.clear()
        good = self[key] = self.bpe._compatible(key >> 20, key & 0xFFFFF)
        return good


class _Words(dict):
    """Lower-case text without white space -> its ids as bytes, filled when first asked for.

    A word with punctuation after it is put together from the two, and kept as well.
    """

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        if not (chunk.isalpha() and (chunk.isascii() or max(chunk) < LATIN_END)):
            stem, last = chunk[:-1], chunk[-1]
            if last in MARKS and stem.isalpha() and (stem.isascii() or max(stem) < LATIN_END):
                return self._keep(chunk, self[stem] + self[last])
            if len(found := self.bpe.words(chunk)) != 1 or found[0] != chunk:
                return self._keep(chunk, b"".join([self[w] for w in found]))
        return self._keep(chunk, self.bpe._word(chunk))

    def _keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[chunk] = ids
        return ids


class WordBpe:
    """Encoder and decoder of one vocabulary file (its bytes are the argument)."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [x["type"] for x in norm["normalizers"]]
        split = pre["pretokenizers"][0]
        blanks = kinds == ["NFC", "Replace", "Lowercase"] and (norm["normalizers"][1]["pattern"], norm["normalizers"][1]["content"]) == ({"Regex": r"\s+"}, " ")
        if model["type"] != "BPE" or not blanks or split["type"] != "Split" or not split["invert"]:
            raise ValueError("unsupported vocabulary file")
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

        bytes_of = _byte_chars()

        def symbols(token: str) -> str:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            raw = [bytes_of[c] for c in (token[: -len(suffix)] if ends else token)]
            if ends:
                raw[-1] += 256
            return "".join(map(chr, raw))

        rank = {chr(i): i for i in range(512)}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(512)]
        self.merged: dict[int, int] = {}
        public = [0] * 512
        for token, i in vocab.items():
            if len(s := symbols(token)) == 1:
                public[ord(s)] = i
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair = (rank[symbols(left)], rank[symbols(right)])
            new = rank.setdefault(symbols(left + right), len(public))
            if new != len(public):
                raise ValueError("two merge rules make one token")
            self.merged[pair[0] << 20 | pair[1]] = new
            self.parts.append(pair)
            public.append(vocab[left + right])
        self.public = [np.uint32(x).tobytes() for x in public]

        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.sizes = [len(s) for s in rank]
        for s, r in rank.items():
            if r < 512 or self._stands(r):
                self.finder.add_word(s, r)
        self.finder.make_automaton()
        #: The longest token that is a proper prefix of a token; -1 if none.
        self.shorter = [self._longest_prefix(s[:-1]) for s in rank]
        self.pairs = _Pairs(self)
        self.cache = _Words(self)

        top = max([*vocab.values(), *special.values()]) + 1
        names = [b""] * top
        for token, i in {**vocab, **special}.items():
            names[i] = token.encode()
        self.names = OffsetTable([x + b" " for x in names])
        self.digits = OffsetTable([b"%d " % i for i in range(top)])

    def _stands(self, token: int) -> bool:
        """Whether BPE on this token's text ends with the token itself."""
        a, b = self.parts[token]
        return self._compatible(a, b, token)

    def _compatible(self, a: int, b: int, limit: int = 1 << 30) -> bool:
        """Whether no merge across the border of a and b comes before the merges inside them.

        The merges inside a and b are taken back, latest first; at each step a
        rule that would join the two neighbours of the border earlier than what
        was taken back last would have broken the border.
        """
        merged, parts = self.merged, self.parts
        while True:
            if merged.get(a << 20 | b, limit) < limit:
                return False
            open_a, open_b = a >= 512, b >= 512
            if not open_a and not open_b:
                return True
            if open_a and (a > b or not open_b):
                limit, a = a, parts[a][1]
            else:
                limit, b = b + 1, parts[b][0]

    def _longest_prefix(self, s: str) -> int:
        for size in range(self.finder.longest_prefix(s), 0, -1):
            if (token := self.finder.get(s[:size], -1)) >= 0:
                return token
        return -1

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        s = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        n, sizes = len(s), self.sizes
        if n == 1:
            return self.public[ord(s)]
        longest = [-1] * n
        for end, token in self.finder.iter(s):  # by rising end: what stays is the longest
            longest[end + 1 - sizes[token]] = token
        pairs, shorter, public, out = self.pairs, self.shorter, self.public, []
        pos, token = 0, longest[0]
        while token >= 0:  # most words need no step back
            out.append(token)
            pos += sizes[token]
            if pos == n:
                return b"".join([public[x] for x in out])
            left, token = token << 20, longest[pos]
            while token >= 0 and not pairs[left | token]:
                token = shorter[token]
        out = []
        dead = bytearray(n + 1)
        pos, last = 0, -1
        token = longest[0]
        while True:
            if last < 0:
                while token >= 0 and dead[pos + sizes[token]]:
                    token = shorter[token]
            else:
                left = last << 20
                while token >= 0 and (dead[pos + sizes[token]] or not pairs[left | token]):
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += sizes[token]
                if pos == n:
                    return b"".join([public[x] for x in out])
                last, token = token, longest[pos]
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= sizes[token]
                last, token = out[-1] if out else -1, shorter[token]

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any([x in text for x in SEPARATORS]):
            return b"".join(map(self.cache.__getitem__, self.words(text)))  # str.split() would cut at these, the pattern does not
        return b"".join(map(self.cache.__getitem__, text.split()))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (uint32) of a text."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if not any([x in text for x in self.special]):
            raw = self._plain(text)
        else:
            raw = b"".join(np.uint32(self.special[x]).tobytes() if i % 2 else self._plain(x) for i, x in enumerate(self.cut(text)))
        return np.frombuffer(raw, dtype=np.uint32)

    def decode_blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        """UTF-8 of the decoded text in blocks."""
        yield from _trimmed(self.names.join(ids))

    def decode(self, ids) -> str:
        return b"".join(self.decode_blocks(np.asarray(ids, dtype=np.uint32))).decode()

    def digit_blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids in decimal, joined by one space, in blocks."""
        yield from _trimmed(self.digits.join(ids))


def _trimmed(blocks: Iterator[np.ndarray]) -> Iterator[bytes]:
    """All blocks, the last without its trailing space."""
    last = None
    for block in blocks:
        if last is not None:
            yield last.tobytes()
        last = block
    if last is not None:
        yield last[:-1].tobytes()


def codec(blob: bytes) -> WordBpe:
    """The codec of a vocabulary file, built once in each process."""
    return resident(("bpe", hashlib.sha256(blob).digest()), lambda: WordBpe(blob))


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row. The vocabulary (a file of fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = codec(shared.value)
        for b in batches:
            ids = [bpe.encode(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col]).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the decoded text of every row's ids; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    small_batches(encoded.sparkSession)

    def run(batches):
        bpe = codec(shared.value)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([bpe.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col]).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text in one pass, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    small_batches(docs.sparkSession)

    def digest(blocks) -> str:
        h = hashlib.sha256()
        for x in blocks:
            h.update(x)
        return h.hexdigest()

    def run(batches):
        bpe = codec(shared.value)
        for b in batches:
            ids = [bpe.encode(t.as_py()) for t in b.column(1)]
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([digest(bpe.digit_blocks(x)) for x in ids], pa.string()),
                    pa.array([digest(bpe.decode_blocks(x)) for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
