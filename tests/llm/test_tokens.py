import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe, packing
from tests.llm.helpers import AWKWARD, documents, table

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aàß Σσςİé́‍ẞ\x1c\x85\u3000'sTtll1²½Ⅷ٣!?.,., <|endoftext|>\n\t日本語한글😀_-"


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    return bpe.codec(bpe.vocabulary(PATH))


def test_fuzz_against_the_library(theirs, ours, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += ["<|endoftext|>a<|startoftext|>", "".join(rng.choice("thenigao") for _ in range(3000)), "tt" * 500, ""]
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "WORD_CACHE", 50)
    monkeypatch.setattr(bpe, "PAIR_CACHE", 50)
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = ours.encode(text)
        assert ids.tolist() == want.ids, text
        assert ours.decode(ids) == theirs.decode(want.ids, skip_special_tokens=False)


def test_bad_id(ours):
    with pytest.raises(IndexError):
        ours.decode([10**6])


def digests(theirs, text):
    ids = theirs.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_digests(spark, theirs, which):
    docs = table(spark) if which == "awkward" else documents(spark)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], *digests(theirs, r["text"])) for r in docs.collect())
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip_digests(docs, PATH).collect())
    assert got == want


def test_encode_then_decode_frames(spark, theirs):
    docs = table(spark, [(1, "Hello there"), (2, None)])
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    assert back == {1: "hello</w> there</w>", 2: ""}


def test_differencing():
    assert packing.difference([8, 7, 6, 5, 4], 2) and max(w[0] for w in packing.difference([8, 7, 6, 5, 4], 2)) <= 16
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 400):
        sizes = [rng.randrange(1, 4096) for _ in range(n)]
        windows = packing.pack(sizes)
        assert sorted(i for _, members in windows for i in members) == list(range(n))
        assert all(load == sum(sizes[i] for i in members) <= 4096 for load, members in windows)
        assert len(windows) <= 1.25 * -(-sum(sizes) // 4096) + 1
    with pytest.raises(ValueError):
        packing.pack([5000])


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_packing(spark, theirs, which):
    docs = table(spark) if which == "awkward" else documents(spark)
    rows = packing.pack_documents(docs, PATH).collect()
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r["doc_id"]].append(theirs.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for doc, texts in ids.items():
        assert sum(p["length"] for p in pieces[doc]) == sum(map(len, texts))
        for p in pieces[doc]:
            raw = [np.array(t[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes() for t in texts if len(t) == p["doc_tokens"]]
            assert p["ids_crc32"] in [zlib.crc32(x) for x in raw]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_cut_checksums():
    rng = random.Random(4)
    for n in (33, 64, 100, 1000, 4095):
        raw = np.array([rng.randrange(50_000) for _ in range(n)], dtype="<u4")
        crc = lambda a, b, raw=raw: zlib.crc32(raw[a:b].tobytes())
        marks = np.array([crc(0, at) for at in range(packing.STEP, n + 1, packing.STEP)], dtype="<u4")
        piece = packing.Piece(1, 50, n, crc(0, n), n + 50, marks)
        at = 0
        for _ in range(4):
            parts = piece.cut(rng.randrange(1, piece.length + 1))
            if parts is None:
                continue
            first, piece = parts
            assert first.start == 50 + at and first.crc == crc(at, at + first.length)
            at += first.length
            assert piece.start == 50 + at and piece.length == n - at and piece.crc == crc(at, n)


def test_sequences_are_full(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    loads = defaultdict(int)
    for r in packing.pack_documents(docs, PATH).collect():
        loads[r["sequence_id"]] += r["length"]
    assert max(loads.values()) <= 4096
    assert sum(loads.values()) >= 0.99 * 4096 * len(loads)


def test_empty_table(spark):
    assert bpe.round_trip_digests(table(spark, []), PATH).count() == 0
    assert packing.pack_documents(table(spark, []), PATH).count() == 0


def test_words_with_punctuation_are_put_together_once():
    from tessera.llm.bpe import WordBpe, vocabulary

    bpe, asked = WordBpe(vocabulary(PATH)), []
    plain = bpe.words
    bpe.words = lambda x: (asked.append(x), plain(x))[1]
    text = "rain, (rain) rain%%% étéx, "
    once = bpe.encode(text)
    n = len(asked)
    assert bpe.encode(text * 3).tolist() == once.tolist() * 3 and len(asked) == n > 0
    assert once.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
