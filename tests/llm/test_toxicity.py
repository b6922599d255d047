"""The factorization machine: its sums against plain loops, held-out quality, edge rows."""

import os
import random
import zlib

import numpy as np
import pytest

from dialogscope.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_raw_score_is_the_sum_over_pairs():
    model = toxicity.FactorizationMachine(np.arange(10, 40))
    model.w = np.random.default_rng(0).normal(size=31)
    at = model.positions(np.array([10, 12, 30, 39, 77]))
    assert at.tolist() == [0, 1, 3, 21, 30]
    want = model.w[at].sum() + sum(model.v[a] @ model.v[b] for k, a in enumerate(at) for b in at[k + 1:])
    assert model._raw(at, np.array([0]))[0][0] == pytest.approx(want)


def test_terms_are_sets_of_words_and_affixes():
    text, bucket = toxicity.term_sets(["Idiot, idiot!", None, "", "a idiots"])
    sets = [set(bucket[text == k]) for k in range(4)]
    assert len(sets[0]) == 4 and sets[1] == sets[2] == set()  # the word, and its first 3, 4 and 5 letters
    assert len(sets[0] & sets[3]) == 3  # the affixes
    assert [len(x) for x in toxicity.term_sets([])] == [0, 0]


def test_learns_an_interaction_a_linear_model_misses():
    """Label 1 iff exactly one of two terms is there: no linear weights fit this."""
    pick = random.Random(2)
    texts, labels = [], []
    for _ in range(3000):
        a, b = pick.random() < 0.5, pick.random() < 0.5
        texts.append(" ".join(["qqqa"] * a + ["zzzb"] * b + [f"w{chr(97 + pick.randrange(20))}"]))
        labels.append(int(a != b))
    rows = [(toxicity.term_sets([t])[1], y) for t, y in zip(texts, labels)]
    scores = toxicity.fit(rows).scores(texts)
    assert np.mean((scores > 0.5) == np.array(labels)) > 0.99


def test_query_rows_with_edge_cases(spark):
    pick = random.Random(1)
    rows, marks = [], []
    for i in range(600):
        bad = pick.random() < 0.3
        rows.append((i, " ".join(pick.choices(["fine", "green", "river", "stone", "paper"], k=20) + ["you moron"] * bad)))
        marks.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "123 !!"), (None, "you moron"), (5, rows[5][1]), (1003, "moron " * 50_000), (1004, "you moron")]
    docs = spark.createDataFrame([(*r, "c", 7) for r in rows], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame(marks + [(None, 1), (2000, 1), (7, None), (9, 5)] + marks[:20], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == by[1002].score
    assert by[1004].predicted == 1 and by[None].predicted == 1 and by[None].held_out is False
    truth = dict(marks)
    assert all(by[i].predicted == truth[i] for i in range(600))
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_labels_of_other_documents_do_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(i * 150, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.range(30_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    there = [i * 150 for i in range(200) if zlib.crc32(str(i * 150).encode()) % 4 != 2]
    assert len(toxicity.training_rows(docs, labels)) == len(there) > 130


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_quality(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [(r.score, truth[r.doc_id], r.predicted) for r in toxicity.op7_toxicity(spark, SF).collect() if r.held_out and r.doc_id in truth]
    pos, neg = ([s for s, y, _ in got if y == k] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95
    assert np.mean([y == p for _, y, p in got]) > 0.97
