"""The pipeline's stages on awkward tables."""

import corpus_pipeline
from tests.llm.helpers import AWKWARD, SF, table

CLASHING = "base random hex assign access lang_pred score kept_text _doc _key _text _tested row columns token_count doc spelled key size _copy component_id text_ start length".split()
PASSAGE = " ".join(f"passage{i % 7}word{i}" for i in range(60))


def through(spark, docs, last="secrets"):
    """The result of each stage up to one, written and read again like the pipeline does."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        if name != "packing":
            assert got.columns == docs.columns, name
            assert dict(got.dtypes) == dict(docs.dtypes), name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/awkward-{name}"
        got.write.mode("overwrite").parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_empty_table(spark):
    assert {k: v.count() for k, v in through(spark, table(spark, [], extra=False)).items()} == dict.fromkeys([n for n, _ in corpus_pipeline.STAGES], 0)


def test_clashing_names_null_and_repeated_ids_and_long_texts(spark):
    rows = [r for r in AWKWARD if r[0] != 5] + [
        (5, f"five {PASSAGE} a"),
        (5, "another text of the same id altogether"),
        (None, f"no id {PASSAGE} b"),
        (None, f"no id either {PASSAGE} c token=abcdefghijklmnop"),
        (40, "long " + " ".join(f"w{i}" for i in range(700_000))),
        (41, "repeated rows stay or go together as one document does here"),
        (41, "repeated rows stay or go together as one document does here"),
        (42, "repeated rows stay or go together as one document does here"),
    ]
    plain = table(spark, rows, extra=False)
    docs = plain.selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(CLASHING)])
    out = through(spark, docs)
    ids = {k: sorted([(r["doc_id"] is None, r["doc_id"] or 0) for r in v.select("doc_id").collect()]) for k, v in out.items()}
    kept = [i for i, t in rows if t and any(c.isalpha() for c in t)]
    assert ids["language_id"] == sorted([(i is None, i or 0) for i in kept])
    assert ids["near_duplicates"] == sorted([(i is None, i or 0) for i in kept if i != 42])
    assert ids["repeated_passages"] == ids["secrets"] == ids["near_duplicates"]
    for name in ("language_id", "near_duplicates", "repeated_passages", "secrets"):
        assert out[name].select(*CLASHING).distinct().count() == 1, name
        assert tuple(out[name].select(*CLASHING).first()) == tuple(range(len(CLASHING))), name
    texts = {(r["doc_id"], r["text"]) for r in out["secrets"].select("doc_id", "text").collect()}
    assert (5, f"five {PASSAGE} a") in texts and (5, "another text of the same id altogether") in texts
    assert (None, "no id b") in texts and (None, "no id either c [SECRET]") in texts and (None, "a row without an id") in texts
    assert (40, rows[-4][1]) in texts
    packed = out["packing"]
    assert {r["doc_id"] for r in packed.collect()} == {i for i in kept if i != 42}


def test_run_deletes_what_it_wrote(spark, tmp_path):
    from tessera.llm import common

    table(spark, [(i, f"{i} some words and more words {PASSAGE if i % 2 else i}") for i in range(20)], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    before = list(common.written)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 11  # the ten odd ones are copies of each other
    left = [x for x in common.written if x not in before]
    assert sorted(x.rpartition("/")[2].split("-")[0] for x in left) == ["pieces", "stage"]  # the last stage's own


def test_run_leaves_other_queries_alone(spark, tmp_path):
    """A query made before, in a shared folder whose path looks like a stage's, and one that runs beside in another thread."""
    import threading

    from tessera.llm import common, jaccard

    docs = table(spark, [(i, f"{i} some words and more words {PASSAGE if i % 2 else i}") for i in range(20)], extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sc = spark.sparkContext
    shared = common.shared_dir(spark)
    sc.setCheckpointDir(f"{tmp_path}/stage-area/ck")
    try:
        earlier, beside, failed = jaccard.join(docs, 5, 80), [], []

        def others():
            try:
                beside.extend(jaccard.join(docs, 5, 80).collect() for _ in range(3))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

        thread = threading.Thread(target=others)
        thread.start()
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 11
        thread.join()
        assert not failed and [len(x) for x in beside] == [20] * 3
        assert earlier.count() == 20
    finally:
        sc._jsc.sc().setCheckpointDir(shared)


def test_gathered_is_of_one_thread(spark):
    import threading

    from tessera.llm import common

    with common.gathered() as outer:
        a = common.materialize(spark.range(1), "a")
        with common.gathered() as inner:
            b = common.materialize(spark.range(1), "b")
        thread = threading.Thread(target=lambda: common.materialize(spark.range(1), "c"))
        thread.start()
        thread.join()
    assert outer == [a._folder] and inner == [b._folder]
