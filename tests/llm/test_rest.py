"""Language identification, fingerprints, top-k search, URL filter and the pipeline."""

import hashlib
import math
import zlib

import pytest

import corpus_pipeline
from tessera.llm import fingerprints, langid, registry, topk, urlfilter
from tests.llm.helpers import AWKWARD, SF, documents, table
from tests.oracle import connect, difference


# ---- language identification


def naive_phrases(corpus, text):
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in corpus:
            size += 1
        n, at = n + 1, at + (size if text[at : at + size] in corpus else 1)
    return n


def naive_languages(sample, text):
    """(entropy, language) in order of preference; empty if there is no letter."""
    raw = langid.normal(text)
    if not raw:
        return []
    blocks = [raw[at : at + langid.BLOCK] for at in range(0, len(raw), langid.BLOCK)]
    return sorted((math.log2(len(s)) * sum(naive_phrases(s, b) for b in blocks) / len(raw), x) for x, s in sample.items())


def test_suffix_automaton_against_search():
    corpus = b" the theatre then athens banana bandana "
    model = langid.Model({"x": corpus, "y": b" zz "})
    texts = [b" then ", b" banana theatre ", b"xyz", b" x the", b"anana", b"", b" zzz th"]
    for text, (x, y) in zip(texts, model.phrases(texts).tolist(), strict=True):
        assert (x, y) == (naive_phrases(corpus, text), naive_phrases(b" zz ", text)), text


def test_blocks_side_by_side(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    monkeypatch.setattr(langid, "LANES", 3)
    sample = {"x": b" the theatre then ", "y": b" athens banana "}
    texts = ["then banana! the theatre", "ÄÖ the", "", None, "a", "12", "athens athens athens athens"]
    for text, found in zip(texts, langid.Model(sample).compare(texts), strict=True):
        want = naive_languages(sample, text)
        assert found == ((want[0][1], want[0][0], want[1][0]) if want else None), text


def test_languages_against_search(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 3000)
    docs = documents(spark).orderBy("doc_id").limit(60).select("doc_id", "text", "lang")
    docs = docs.unionByName(table(spark).select("doc_id", "text", "lang"))
    sample = langid.learn(docs)
    assert len(sample) >= 3 and all(len(x) <= 3000 for x in sample.values())
    for size in (6 << 16, 5000):  # one pass, or one for each language
        monkeypatch.setattr(langid, "PASS_BYTES", size)
        rows = langid.identify(docs, sample).select("row.*", "lang_pred", "score").collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = naive_languages(sample, r["text"])
            assert r["lang_pred"] == (want[0][1] if want else "und"), r["text"]
            assert r["score"] == pytest.approx(1 - want[0][0] / want[1][0] if want else 0.0)


def test_languages_of_ties_long_texts_and_clashing_names(spark):
    ids = [i for i in range(90) if zlib.crc32(str(i).encode()) % 4 != 2][:40]  # all are learned from, half of them for each language
    rows = [(i, "same words here", "ba"[k % 2]) for k, i in enumerate(ids)] + [(100, "same " * 400_000 + "!", None), (101, "日本", None), (102, None, "a")]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0, "y") for r in rows], "doc_id bigint, text string, lang string, row int, lang_pred string, score double, best string")
    got = {r["doc_id"]: r for r in langid.languages(docs).collect()}
    assert {got[i]["lang_pred"] for i in ids} == {"a"} and got[100]["lang_pred"] == "a" and got[100]["score"] == 0.0
    assert got[101]["lang_pred"] == "a" and got[102]["lang_pred"] == "und"
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [*ids, 100, 101]
    assert tuple(kept.where(f"doc_id = {ids[1]}").first()) == (ids[1], "same words here", "a", 1, "x", 2.0, "y")


def test_languages_held_out_accuracy_and_defined_cases(spark):
    docs = documents(spark)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.languages(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    got = {r["doc_id"]: r for r in langid.languages(table(spark)).collect()}
    assert [got[i]["lang_pred"] for i in (2, 3, 4, 8)] == ["und"] * 4
    assert got[1]["lang_pred"] == "en" and 0 <= got[1]["score"] <= 1
    assert langid.languages(table(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.languages(table(spark).drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_every_label_is_learned(spark, monkeypatch):
    # 70 languages, each of three letters of its own; the label of most rows has texts in few of them
    word = lambda k: "".join(chr(0x4E00 + 3 * k + i) for i in range(3))
    rows = [(100 * k + i, f"{word(k)} {word(k)}", f"l{k:02d}") for k in range(70) for i in range(8 if k else 12)]
    rows += [(100_000 + i, None if i % 3000 else f"{word(99)} {word(99)}", "zz") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for size in (6 << 16, 200):
        monkeypatch.setattr(langid, "PASS_BYTES", size)
        got = {r["doc_id"]: r["lang_pred"] for r in langid.languages(docs).collect()}
        assert len(got) == len(rows)
        assert all(got[i] == ("und" if t is None else x) for i, t, x in rows)


def test_pipeline_keeps_texts_without_any_label(spark):
    docs = table(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [0, 1, 5, 5, 6, 7]


# ---- fingerprints


def test_fingerprints_are_homomorphic():
    f = fingerprints.Fingerprint("one two\nthree\n\nfour")
    assert str(f) == str(fingerprints.Fingerprint("four\n\none two\nthree"))
    g = fingerprints.Fingerprint("one two\n")
    g.insert("three")
    g.insert("four")
    assert str(g) == str(f)
    g.delete("three")
    assert str(g) != str(f)
    h = fingerprints.Fingerprint.empty()
    for p in ("three", "four", "", "one two"):
        h.insert(p)
    assert str(h) == str(f)
    assert f.likeness(h) == 1.0
    assert fingerprints.Fingerprint("").likeness(fingerprints.Fingerprint("word")) == 0.0


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_edited_neighbours(spark, monkeypatch, which):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    docs = documents(spark) if which == "documents" else table(spark, [r for r in AWKWARD if r[0] not in (None, 5)] + [(5, "x"), (90, "y" * 50)])
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in fingerprints.edited_neighbours(docs).collect()}
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        text, following = r["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        x = got[r["doc_id"]]
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert x["fingerprint"] == str(fingerprints.Fingerprint(text)) and x["edited_fingerprint"] == str(fingerprints.Fingerprint(edited))
        assert 0 <= x["near_next"] <= 1 and 0 <= x["near_edited"] <= 1
    if which == "documents":
        assert sum(x["near_edited"] > x["near_next"] for x in got.values()) > 0.95 * len(got)


def test_fingerprints_of_repeated_null_and_no_rows(spark):
    assert fingerprints.edited_neighbours(table(spark)).count() == len(AWKWARD)
    assert fingerprints.edited_neighbours(table(spark, [])).count() == 0


# ---- top-k


def test_topk_against_sql(spark):
    assert difference(spark, connect(SF), SF, registry.queries()["op6_topk"], registry.oracle_sql()["op6_topk"]) is None


def test_topk_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 3)
    monkeypatch.setattr(topk, "BLOCK", 1)
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [1.0, float("inf"), 2.0]), (7, [-1.0, -2.0, -3.0]), (100, [0.5, 0.1, -0.2]), (8, [9.0]), (None, [1.0, 1.0, 1.0])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 3).collect()))
    q = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i in (0, 1, 2, 7)}
    q[100] = [math.floor(1024 * float(__import__("numpy").float32(x))) for x in (0.5, 0.1, -0.2)]
    want = []
    for a in (0, 100):
        scored = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), b) for b in q if b != a)[:3]
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(scored)]
    assert got == want
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_topk_of_every_length(spark):
    vectors = [(i, [float(i % 7), 1.0, float(-i)]) for i in range(250)] + [(1000 + i, [float(i % 5), float(i)]) for i in range(150)] + [(5001, [1.0])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"), 4).collect()))
    want = []
    for a, x in vectors:
        if a % 100 == 0:
            scored = sorted((-sum(1024 * int(p) * 1024 * int(q) for p, q in zip(x, y, strict=True)), b) for b, y in vectors if b != a and len(x) == len(y))[:4]
            want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(scored)]
    assert {w[0] for w in want} == {0, 100, 200, 1000, 1100}
    assert got == want
    # the most frequent length has no query
    rare = [(1, [1.0]), (2, [2.0]), (3, [3.0]), (100, [1.0, 2.0]), (5, [1.0, 1.0])]
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame(rare, "vec_id bigint, embedding array<float>")).collect()] == [(100, 1, 5, 3 * 1024 * 1024)]


# ---- URL filter


def test_rules_and_parsing(spark):
    urls = [
        (1, "http://Example.COM/en/5?x#y"), (2, "http://www.example.com/en/5"), (3, "https://a.www.example.com/en/"), (4, "http://x.net/es/1"), (5, "http://x.net/fr"), (6, "no scheme"),
        (7, None), (8, ""), (9, "http://com/x"), (10, "http://a.com"), (11, "http://acom/x"), (12, "http://example.com/EN/5"), (13, "a://b://c/d?e"), (1, "http://Example.COM/en/5?x#y"), (14, "http://h#f/x"),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(spark.createDataFrame(urls, "page_id bigint, url string")).collect()}
    assert got[1] == ("example.com", "/en/5", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("www.example.com/en/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5][2] is None
    assert got[6][:3] == got[7][:3] == got[8][:3] == ("", "", None)
    assert got[9][2] == "com/" and got[10] == ("a.com", "", None, got[10][3]) and got[11][2] is None
    assert got[12][2:] == ("com/", "allow") and got[13][:2] == ("b:", "//c/d") and got[14][:2] == ("h", "")
    assert all(v[3] in ("allow", "block") for v in got.values())


def test_templates_generalise(spark):
    urls = [(i, f"http://a.org/user/{'abcdefghijklmnop'[i]}x/photos") for i in range(16)] + [(100, "http://a.org/about"), (101, "http://a.org/2024-01-02/deadbeef01")]
    got = {r["page_id"]: r["template"] for r in urlfilter.judge(spark.createDataFrame(urls, "page_id bigint, url string")).collect()}
    assert got[3] == "/user/{*}/photos" and got[100] == "/about" and got[101] == "/{d}/{h}"
    assert urlfilter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_purity_follows_the_labels(spark):
    urls = [(i, f"http://h{i % 3}.net/es/{i}") for i in range(60)] + [(100 + i, f"http://g{i % 3}.com/blog/{i}") for i in range(60)] + [(500, "http://z.org/es/7"), (501, "http://z.org/blog/7")]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(urls, "page_id bigint, url string")).collect()}
    assert got[500] == "block" and got[501] == "allow"


# ---- pipeline


def test_pipeline_stages(spark):
    docs = documents(spark).limit(120)
    copies = docs.where("doc_id < 5").selectExpr("doc_id + 10000 as doc_id", "text", "lang", "source", "n_chars")
    docs = docs.union(copies).union(table(spark, [(20000, "... 123"), (20001, None)], extra=False))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"] for r in docs.collect()}
    assert not seen["language_id"] & {20000, 20001}
    assert not seen["near_duplicates"] & {10000, 10001, 10002, 10003, 10004}
    assert seen["near_duplicates"] == seen["repeated_passages"] == seen["secrets"] == seen["packing"]
    assert len(seen["packing"]) > 100
