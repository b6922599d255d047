"""Block search against exhaustive BM25, and contamination against brute-force shingles."""

import os
import random

import numpy as np
import pytest

from dialogscope.llm import decontaminate
from dialogscope.llm.decontaminate import BLOCK, ItemIndex, question_and_answer, shingles, words
from tests.llm.oracle import SF


def vocabulary(n=150):
    pick = random.Random(3)
    return ["".join(pick.choices("abcdefghij", k=pick.randint(2, 6))) for _ in range(n)]


def some_items(n, seed=4):
    pick, names = random.Random(seed), vocabulary()
    return [(i, " ".join(pick.choices(names, k=pick.randint(3, 30))) + ". " + " ".join(pick.choices(names, k=4)) + ".") for i in range(n)]


def exhaustive(index, terms):
    scores = np.zeros(len(index.ids))
    for t in terms:
        for k, w in zip(index.docs[t], index.impacts[t]):
            scores[k] += w
    return {k: s for k, s in enumerate(scores) if s >= index.threshold - 1e-9}


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8])
def test_search_finds_all_items_above_the_threshold(threshold):
    index, pick = ItemIndex(some_items(100), threshold), random.Random(9)
    assert all(0 < w <= 1 for ws in index.impacts for w in ws)
    for _ in range(60):
        terms = np.array(sorted(pick.sample(range(len(index.vocabulary)), pick.randint(1, 90))))
        got = {k: s for b in range(-(-100 // BLOCK)) for k, s in index.search(terms, b)}
        want = exhaustive(index, terms)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_an_items_own_words_score_one():
    items = some_items(40)
    index = ItemIndex(items)
    for k, (_, text) in enumerate(items):
        terms = np.unique([index.vocabulary[w] for w in words(text)])
        assert dict(index.search(terms, k // BLOCK))[k] == pytest.approx(1)


def test_question_and_answer():
    assert question_and_answer("What is it? A b c.") == (["what", "is", "it"], ["a", "b", "c"])
    assert question_and_answer("one two three four") == (["one", "two", "three"], ["four"])
    assert question_and_answer("One.\nTwo three\nfour five.") == (["one", "two", "three"], ["four", "five"])
    assert question_and_answer("") == ([], [])


def brute(docs, items):
    out = set()
    for d, text in docs:
        held = words(text)
        every = {n: set(zip(*(held[i:] for i in range(n)))) for n in range(1, 6)}
        for i, item in items:
            parts = [shingles(p) for p in question_and_answer(item or "")]
            if words(item) and all(sum(x in every[len(x)] for x in p) >= 0.8 * len(p) for p in parts if p):
                out.add((d, i))
    return out


def test_planted_items_are_found(spark):
    pick, items = random.Random(8), some_items(50)
    names = vocabulary(600)[200:]
    noise = lambda n: " ".join(pick.choices(names, k=n))
    docs = [(k, f"{noise(pick.randint(0, 200))} {items[k][1]}\n{noise(pick.randint(0, 200))}") for k in range(50)]
    docs += [(100 + k, f"{noise(63)} {items[k][1].upper().replace(' ', '  ')}") for k in range(20)]
    docs += [(200 + k, noise(300)) for k in range(20)]
    docs += [(300 + k, noise(20) + " " + " ".join(items[k][1].split()[:-6]) + " " + noise(20)) for k in range(20)]  # no answer
    docs += [(400, None), (401, ""), (402, "..."), (None, items[3][1]), (403, noise(40_000) + " " + items[5][1] + " " + noise(9)), (7, docs[7][1])]
    items += [(900, None), (901, ""), (902, "!?"), (2, items[2][1])]
    table = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()]
    want = brute(docs, items)
    assert set(got) == want and len(got) == len(want) + 1  # document 7 stands there twice
    assert {(k, k) for k in range(50)} <= want and (403, 5) in want and not [d for d, _ in want if d is not None and 200 <= d < 400]
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0
    assert decontaminate.contaminated(table, bench.limit(0)).count() == 0


def test_several_index_parts_find_the_same(spark, monkeypatch):
    items = some_items(60)
    docs = spark.createDataFrame([(k, "before it " + items[k][1]) for k in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 20)
    assert [len(i.parts) for i in decontaminate.item_indexes(bench)] == [4]
    monkeypatch.setattr(decontaminate, "PASS_PARTS", 3)
    assert [len(i.parts) for i in decontaminate.item_indexes(bench)] == [3, 1]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(k, k) for k in range(60)} <= got


def test_scores_do_not_depend_on_the_parts(spark, monkeypatch):
    items = some_items(60) + [(70, "one more item under this id. first answer here"), (70, "one more item under this id! second answer here")]
    docs = spark.createDataFrame([(k, "before it " + text + " after") for k, text in items[:60]] + [(70, items[60][1] + " " + items[61][1])], "doc_id long, text string")
    found = lambda b: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.contaminated(docs, b).collect())
    schema = "item_id long, text string"
    one = found(spark.createDataFrame(items, schema))
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 20)
    assert found(spark.createDataFrame(items + items[:1] * 200, schema)) == one
    monkeypatch.setattr(decontaminate, "PASS_PARTS", 1)
    assert found(spark.createDataFrame(items, schema)) == one
    assert len([r for r in one if r[0] == 70]) == 1


@pytest.mark.parametrize("foreign", [3, 30, 100, 200, 3000])
def test_items_with_foreign_words_inside_are_found(foreign):
    pick, names = random.Random(foreign), vocabulary(700)[300:]
    items = [(i, " ".join(pick.choices(vocabulary(), k=60)) + ". " + " ".join(pick.choices(vocabulary(), k=8)) + ".") for i in range(40)]
    docs = []
    for i, text in items:
        every = text.split()
        at = pick.randrange(5, len(every) - 5)
        docs.append((i, " ".join([*pick.choices(names, k=20), *every[:at], *pick.choices(names, k=foreign), *every[at:], *pick.choices(names, k=20)])))
    want = brute(docs, items)
    got = {(d, m[0]) for (d, _), found in zip(docs, ItemIndex(items).matches([t for _, t in docs])) for m in found}
    assert want <= got and {i for i, _ in got} == set(range(40)) and all(d == i for d, i in got)


def test_a_long_text_with_the_question_alone_is_no_match():
    item = "who wrote the long old book about the quiet river and the seven green boats? nobody knows it"
    far = "some words " * 400 + "nobody " + "some words " * 400 + "knows it"
    question = item.split("?")[0]
    assert ItemIndex([(1, item)]).matches([f"{far} {question} {far}", f"{far} {question} and {far} nobody knows it"]) != [[], []]
    assert ItemIndex([(1, item)]).matches([f"nobody here knows {'some words ' * 400} {question} {'some words ' * 400} it"]) == [[]]


@pytest.mark.parametrize("ids", [[7], [None], [7, None]])
def test_many_items_under_one_id(spark, monkeypatch, ids):
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 20)
    monkeypatch.setattr(decontaminate, "PASS_PARTS", 2)
    items = [(ids[k % len(ids)], text) for k, text in some_items(90)]
    index = list(decontaminate.item_indexes(spark.createDataFrame(items, "item_id long, text string")))
    assert sum(len(i.parts) for i in index) == 6 and max(len(p.ids) for i in index for p in i.parts) < 35
    docs = [(k, items[k][1] + " and " + items[-k - 1][1]) for k in range(30)] + [(3, items[3][1] + " and " + items[-4][1])]
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    want = [(d, i) for d, text in docs for i in {i for i, item in items if item in text}]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_copies_are_found():
    """Every item with one word replaced: found wherever 0.8 of its whole shingles are left, in the answer, too."""
    items = some_items(120) + [(900, "who wrote the long old book about the quiet river and the seven green boats? five words in this answer")]
    index, edits = ItemIndex(items), 0
    for i, text in items:
        every = text.split()
        for at in range(len(every)):
            copy = " ".join([*every[:at], "replaced" + every[at][len(every[at].rstrip(".?")):], *every[at + 1:]])
            whole, left = shingles(words(text)), shingles(words(copy))
            found = {m[0] for m in index.matches([f"some text before {copy} and after"])[0]}
            if len(whole & left) >= 0.8 * len(whole):
                edits += 1
                assert i in found, (i, at)
    assert edits > 500
    assert 900 in {m[0] for m in index.matches([items[-1][1].replace("five words", "five items")])[0]}  # four of five words of the answer
    assert 900 not in {m[0] for m in index.matches([items[-1][1].split("?")[0]])[0]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_is_the_brute_force_one(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.op5_decontaminate(spark, SF).collect()}
    assert got == brute(docs, items) and got
