"""The conditional random field: messages against enumeration, held-out accuracy, edge rows."""

import itertools
import os
import zlib

import numpy as np
import pytest

from dialogscope.llm import langid
from dialogscope.llm.wordtable import numbered

SF = "/root/testdata/sf0.1"
TRAIN = [("the cat and the dog are in the house with them", "en"), ("der Hund und die Katze sind nicht im Haus", "de"),
         ("el perro y la gata están en la casa para siempre", "es")] * 30


@pytest.fixture(scope="module")
def model():
    return langid.fit(TRAIN)


def test_words():
    words, ids = numbered(["The cat's 42!", None, "", "x-Y the", "42 ..."])
    assert words == ["the", "cats", "xy"]
    assert [i.tolist() for i in ids] == [[0, 1], [], [], [2, 0], []]


def test_posteriors_are_those_of_enumeration(model):
    for text in ["the hund casa", "katze", "la house und perro dog", "the " * 3]:
        got = model.posteriors([text])[0]
        words, ids = numbered([text])
        table, step = model.potentials(words)[ids[0]], np.exp(model.transitions)
        total = np.zeros_like(got, dtype=float)
        for path in itertools.product(range(3), repeat=len(table)):
            weight = np.prod([table[t, k] for t, k in enumerate(path)]) * np.prod([step[a, b] for a, b in zip(path, path[1:])])
            for t, k in enumerate(path):
                total[t, k] += weight
        np.testing.assert_allclose(got, total / total.sum(axis=1, keepdims=True), rtol=1e-3, atol=1e-5)


def test_posteriors_cross_the_borders_of_pieces(model, monkeypatch):
    chance = np.random.default_rng(0)
    words = "the cat dog house der hund katze haus el perro gata casa xyz qwe".split()
    texts = [" ".join(chance.choice(words, n)) for n in (5000, 300, 64, 65, 1, 129)]
    whole = model.posteriors(texts)
    monkeypatch.setattr(langid, "PIECE", 1 << 30)
    unbroken = model.posteriors(texts)
    monkeypatch.setattr(langid, "PIECE", 64)
    small = model.posteriors(texts)
    monkeypatch.setattr(langid, "PIECE", 1)
    single = model.posteriors(texts[1:])
    for a, b, c in zip(whole, unbroken, small):
        np.testing.assert_allclose(a, b, atol=2e-5)
        np.testing.assert_allclose(c, b, atol=2e-5)
    for a, b in zip(single, unbroken[1:]):
        np.testing.assert_allclose(a, b, atol=2e-5)


def test_the_model_and_the_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 40_000)
    rows = [(k, f"{'wort ' * 3_000}", f"l{k % 20:02d}") for k in range(200)]
    got = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for _, lang in got} == {r[2] for r in rows} and sum(len(t) for t, _ in got) <= 200 * (langid.LEAST_CHARS + langid.SEGMENTS)
    monkeypatch.setattr(langid, "MODEL_NUMBERS", 50_000)
    many = langid.Crf([f"l{k}" for k in range(40)], np.empty(0, np.uint64))
    assert many.weights.size <= 50_000 and many.potentials(["word"]).shape == (1, 40)


def test_texts_do_not_influence_each_other(model):
    texts = ["the cat " * 300, "der Hund", "la casa " * 700, None, "", "the house der Hund", "word " * 5000]
    together = model.predict(texts)
    assert [(a, pytest.approx(b, abs=1e-4)) for a, b in together] == [model.predict([t])[0] for t in texts]


def test_gradient_step_learns_and_labels_code_switched_text(model):
    assert [model.predict([t])[0][0] for t in ("the dog and the cat", "die Katze und der Hund", "la casa y el perro")] == ["en", "de", "es"]
    runs = model.runs("the cat and the dog are in der Hund und die Katze sind nicht")
    assert runs == [("en", 0, 7), ("de", 7, 7)]
    assert model.runs(None) == [] and model.runs("1 2") == []


def test_query_rows_with_edge_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(TRAIN)]
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 !? \n", "es"), (903, "the house", None), (None, "der Hund", "de"),
           (904, "日本語", "en"), (905, "the house " * 20_000, "en"), (3, "la casa", "es"), (3, "la casa", "es"), (906, "́", "en"), (907, "² ½ ③ Ⅷ ⑵", "de")]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows + odd], "doc_id long, text string, lang string, score double, held_out int")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 906, 907)] == ["und"] * 5 and by[902].score == 0
    assert by[903].lang_pred == "en" and by[905].lang_pred == "en" and by[None].lang_pred == "de" and by[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(nothing).first().lang_pred == "und"
    one = spark.createDataFrame([(k, "some text", "xx") for k in range(8)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(one).collect()} == {"xx"}


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(k * 10 + i, f"word{chr(97 + k // 26)}{chr(97 + k % 26)} text", f"l{k:02d}") for k in range(80) for i in range(8)]
    rows += [(9000 + i, "langes buch mit vielen worten " * 2_000 + " ende" * 4_000, "long") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(docs)
    assert {lang for _, lang in got} == {r[2] for r in rows}
    long = [text for text, lang in got if lang == "long"]
    assert long and all(len(t) <= langid.TEXT_BYTES + langid.SEGMENTS and {"buch", "ende"} <= set(t.split())
                        and set(t.split()) <= set("langes buch mit vielen worten ende".split()) for t in long)
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 40)  # fewer than languages: one row or a few of each
    few = langid.training_rows(docs)
    assert {lang for _, lang in few} == {r[2] for r in rows} and len(few) <= 2 * 81
    monkeypatch.setattr(langid, "MAX_WORDS", 20)
    model = langid.fit(got)
    assert model.langs == sorted({r[2] for r in rows}) and (model.weights != 0).any(axis=0).all()


def test_word_runs_column(spark, model):
    docs = spark.createDataFrame([("the cat and the dog are in der Hund und die Katze sind",), (None,)], "text string")
    got = [[tuple(x) for x in r.runs] for r in docs.select(langid.word_runs(spark, model, docs.text).alias("runs")).collect()]
    assert got == [[("en", 0, 7), ("de", 7, 6)], []]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in langid.op8_language_id(spark, SF).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.97
