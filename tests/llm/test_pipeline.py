import sentencepiece

import corpus_pipeline as cp
from leadspark.llm import common as C
from leadspark.llm import op5_sentencepiece as op5
from leadspark.llm import op6_ngram_join as op6
from tests.llm.test_op3 import brute as brute_lines
from tests.llm.test_op4 import brute as brute_items
from tests.llm.test_op6 import brute as brute_classes


def test_stages_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = C.documents(spark, sf).where("doc_id < 70")  # brute force compares all pairs of lines
    columns = docs.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    first = C.settle(cp.quality_rules(spark, docs, sf))
    labels = {r.doc_id: r.quality for r in C.read(spark, sf, "labels").collect()}
    kept = texts(first)
    assert kept.items() <= texts(docs).items() and not [d for d in kept if labels.get(d) == 0]
    second = C.settle(cp.line_dedup(spark, first, sf))
    assert texts(second) == brute_lines(sorted(kept.items()))
    third = C.settle(cp.ngram_join(spark, second, sf))
    classes = brute_classes(sorted(texts(second).items()))
    assert set(texts(third)) == {d for d, c, _ in classes if d == c}
    fourth = C.settle(cp.decontaminate(spark, third, sf))
    items = [(r.item_id, r.text) for r in C.read(spark, sf, "benchmark").collect()]
    bad = {d for d, _ in brute_items(sorted(texts(third).items()), items)}
    assert set(texts(fourth)) == set(texts(third)) - bad
    assert all(x.columns == columns for x in (first, second, third, fourth))
    sp = sentencepiece.SentencePieceProcessor(model_file=op5.model_path())
    got = {r.doc_id: r for r in cp.sentencepiece(spark, fourth, sf).collect()}
    assert {d: r.n_tokens for d, r in got.items()} == {d: len(sp.encode(t)) for d, t in texts(fourth).items()}
    assert all(r.exact for r in got.values())


def test_nulls_and_clashing_columns(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(None, good, None, None, None, 1), (1, None, "en", "s", 3, 2), (2, good, "en", None, 0, 3), (2, good, "en", None, 0, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, d int")
    out = cp.quality_rules(spark, docs, "")
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 2, 2]
    docs = docs.drop("d")
    assert cp.ngram_join(spark, docs, "").count() == 2
    assert cp.line_dedup(spark, docs, "").count() == 4


def test_columns_of_any_name_come_back(spark):
    good = " ".join(f"word{i}" for i in range(80))
    names = ["d", "th", "gone", "kept", "n_lines", "n_removed", "class", "class_th", "row", "n_words", "posterior", "label", "key", "name"]
    rows = [(k, f"{good} {k}\n{'x' * 30} {k * 997}", "en", "s", 3, *(f"{n}{k}" for n in names)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for stage in (cp.quality_rules, cp.line_dedup, cp.ngram_join, cp.decontaminate):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() > 0
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names], stage


def test_different_texts_on_one_id_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (8, text(5)), (None, text(3)), (None, ""), (None, ""), (9, text(1))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.ngram_join(spark, docs, "").collect()), key=repr)
    assert got == sorted([(None, text(k)) for k in (1, 2, 3)] + [(7, text(4)), (7, text(5)), (None, ""), (None, "")], key=repr)
    classes = op6.ngram_classes(C.keyed(docs))
    assert classes.select("class", "class_th").distinct().count() == 6


def test_a_stage_leaves_tables_of_others(spark):
    from leadspark.llm import op9_quality as op9

    sf = "/root/testdata/sf0.001"
    docs = C.documents(spark, sf).where("doc_id < 10")
    before = op9.judge(docs, ["doc_id"])
    first = C.settle(cp.quality_rules(spark, docs, sf))
    cp.decontaminate(spark, first, sf).count()
    assert before.count() == docs.count()


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "a\xa0b \u3000 c", "en", "s", 3), (2, "", "en", None, 0), (2, "x " * 60, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.decontaminate(spark, docs, "/root/testdata/sf0.001").count() == 4
    assert cp.sentencepiece(spark, docs, "").count() == 4
