import hashlib
import random
import re

from tessera.llm import phrases
from tests.llm.helpers import AWKWARD, documents, table


def brute(rows, n=phrases.WINDOW):
    """rows must have distinct ids, or equal texts for equal ids."""
    first = {}
    split = [(float("inf") if i is None else i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for (i, _), (key_id, w) in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (key_id, k):
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrases.remove_repeats(df).collect())


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(k)] for k in (19, 20, 21, 60, 200)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(80))]
        for p in rng.choices(passages, k=rng.randrange(4)):
            cut = rng.randrange(3)
            w += p[cut : len(p) - rng.randrange(3)] + [word() for _ in range(rng.randrange(5))]
        rows.append((1000 - i, " ".join(w)))
    return rows + [(2000, rows[5][1]), (2001, rows[5][1]), (0, "a b " * 100), (1, "a b " * 30)]


def test_against_brute_force(spark):
    rows = AWKWARD + made()
    rows = [r for r in rows if r[0] != 1 or r[1].startswith("plain")]
    assert run(table(spark, rows)) == brute(rows)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 50)
    rows = made(4)
    assert run(table(spark, rows)) == brute(rows)


def test_equal_hashes_of_different_phrases(spark):
    # with two bits most phrases have the hash of others; the automata, which hold words, must tell them apart
    rows = made(5)
    docs = table(spark, rows).selectExpr("doc_id as row", "doc_id as doc", "text")
    got = phrases._removed(docs, False, bits=2)
    assert sorted((r["doc"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == brute(rows)


def test_automaton_finds_words_not_hashes():
    words = [f"w{i}".encode() for i in range(30)]
    texts = [phrases.Text(b" ".join(words)), phrases.Text(b"x " + b"  ".join(words[5:13]) + b"\ny"), phrases.Text(b"w5 w6")]
    places = phrases.locate(texts, {b" ".join(words[5:13]), b"no such phrase of eight words at all here"})
    assert [p.tolist() for p in places] == [[5], [1], []]


def test_clashing_names(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"{i} {passage}", "x", 1, 2, 3, 4) for i in range(2)], "doc_id bigint, text string, kept_text string, row int, columns int, _row int, doc int")
    out = phrases.without_repeats(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(0, f"0 {passage}", "x", 1, 2, 3, 4), (1, "1", "x", 1, 2, 3, 4)]


def test_whole_table_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert run(documents(spark)) == brute(rows)


def test_texts_without_repeats_stay(spark):
    rows = [(1, "one  two\nthree"), (2, None), (3, " ".join(map(str, range(40)))), (4, "x\n" + " ".join(map(str, range(40))))]
    docs = table(spark, rows)
    out = phrases.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: rows[0][1], 2: None, 3: rows[2][1], 4: "x"}


def test_rows_of_null_or_repeated_ids_keep_their_own_texts(spark):
    passage, other = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    rows = [(1, passage), (None, f"first {passage}"), (None, f"second {passage} end"), (None, "third"), (None, None), (None, f"fourth {other}"), (None, f"fifth {other}")]
    rows += [(7, f"a {passage}"), (7, f"b {passage}"), (7, f"b {passage}"), (7, "c")]
    got = [(r["doc_id"], r["text"]) for r in phrases.without_repeats(table(spark, rows)).collect()]
    want = [(1, passage), (None, "first"), (None, "second end"), (None, "third"), (None, None), (None, f"fourth {other}"), (None, f"fifth {other}"), (7, "a"), (7, "b"), (7, "b"), (7, "c")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    removed = sorted((i, n) for i, _, n, _ in run(table(spark, rows)))
    assert removed == [(-1, 0)] * 4 + [(-1, 30)] * 2 + [(1, 0), (7, 0)] + [(7, 30)] * 3


def test_empty_table(spark):
    assert phrases.remove_repeats(table(spark, [])).count() == 0
