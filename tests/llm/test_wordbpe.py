"""Token counts and the tokenization automaton against the tokenizers library."""

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dialogscope.llm import bpe_automaton, token_counts
from dialogscope.llm.bpe_automaton import Automaton
from dialogscope.llm.token_counts import Merger, TokenCounter
from dialogscope.llm.wordbpe import WordVocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\t", "The cat's 42 hats, won't they'll I'd we've I'm you're!!", "a" * 5000, "ab" * 3000 + "!" * 900,
    "<|startoftext|>hello<|endoftext|><|endoftext|> x <|endoftext", "<|ENDOFTEXT|>", "Größe ÀÉ ñandú straße ſ ŉ µ ª º ½ ² ×÷",
    "é Å Å İI ΣΣ ẞ", "日本語 テキスト 한국어 中文", "😀👍🏽 emoji", "\x00\x01\x1c\x1d\x1e\x1f\x85\xa0z", "​ 　x",
    "ǅ Ǆ Ⱥ İstanbul ﬁ Ａ", "thereforethereandthenwhithersoever", "'s'S'T 'LL''''", "1234567890" * 20, "﻿bom",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return Automaton(WordVocabulary(PATH))


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH)


def random_texts(n):
    pick = random.Random(7)
    letters = "aaeeiioottthhhnnsrdl" + "bcfgkmpuvwyz" + "éßñ" + "'-., 0Z"
    return ["".join(pick.choice(letters) for _ in range(pick.randint(1, 120))) for _ in range(n)]


def test_every_character_is_split_as_the_library_does(library):
    v = WordVocabulary(PATH)
    for c in map(chr, [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]):
        text = f"a{c}b 1{c}{c} {c}"
        want = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        assert ["".join(v.alphabet[b] for b in w.encode()) for w in v.words(text)] == want, hex(ord(c))


def test_encoding_decoding_and_counts_are_the_librarys(library, automaton, counter):
    for text in TEXTS + random_texts(1500):
        want = library.encode(text or "", add_special_tokens=False).ids
        ids = automaton.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert automaton.decode(ids) == library.decode(want, skip_special_tokens=False)
        assert counter.count(text) == len(want), text


def test_long_and_short_merging_agree():
    m = Merger(WordVocabulary(PATH))
    for text in random_texts(300):
        word = "".join(text.lower().split()).replace("'", "") or "x"
        s = m.symbols(word)
        assert m._short(list(s)) == m._long(list(s))


def test_proven_words_are_one_token(library, counter):
    words = random.Random(3).sample(sorted(counter.proven), 3000)
    assert len(counter.proven) > 30_000
    for w in words:
        assert len(library.encode(w, add_special_tokens=False).ids) in (1,) or w in counter.merger.vocabulary.specials \
            or counter.merger.vocabulary.words(w) != [w]


def test_queries_on_rows_with_edge_cases(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(0, "twice", "x", 1), (None, "null id", "x", 1), (0, "twice", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids_sha256 long")
    want = sorted(((i if i is not None else -1, len(library.encode(t or "", add_special_tokens=False).ids),
                    len((t or "").encode())) for i, t, *_ in rows))
    got = token_counts.token_counts(docs, PATH, limit=3).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_bytes) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)
    got = {(r.doc_id, r.ids_sha256): r for r in bpe_automaton.encoding_digests(docs, PATH).collect()}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    empty = docs.limit(0)
    assert token_counts.token_counts(empty, PATH).count() == 0
    assert bpe_automaton.encoding_digests(empty, PATH).count() == 0


def test_encode_then_decode_columns(spark, library):
    docs = spark.createDataFrame([(1, "Hello there, Größe"), (2, None)], "doc_id long, text string")
    ids = docs.select("doc_id", bpe_automaton.encoded(spark, docs.text, PATH).alias("ids"))
    back = {r.doc_id: r.t for r in ids.select("doc_id", bpe_automaton.decoded(spark, ids.ids, PATH).alias("t")).collect()}
    assert back == {1: library.decode(library.encode("Hello there, Größe").ids, skip_special_tokens=False), 2: ""}


def test_module_sizes_are_bounded(automaton):
    assert sys.getsizeof(automaton.gadget) < 50e6
