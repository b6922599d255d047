"""Operator 5: benchmark decontamination by BM25 search of every training passage over the test items.

The test items are indexed, not the training text: term -> postings (item, impact) in blocks with a maximum
impact each.  Impacts are BM25 weights divided by the item's own full score, so 1.0 means that a passage holds
every term of the item.  An item is looked for from the score on that a passage with a match can't miss (``least_score``),
``THRESHOLD`` at most.

The passage is the whole text, whatever its length, so an item is found however many foreign words stand inside it.  Its distinct terms are the
query.  A text without any shingle of an item's question or whole (of its answer, if it has no question) can't match one; this test
is made for all texts of a batch at once.  For the others, blocks of items whose maxima, each item's divided by its least score, do not sum to one can't
hold a match; the remaining (text, block) pairs go through WAND on the block's maxima, which returns *all* items at or above their least score.

Each (text, item) found is verified on five-word shingles: at least ``OVERLAP`` of the item's question and of
its answer, or of the whole item, must occur in the text.  An answer of five words or fewer is graded by its words, if it does not occur as it stands.  With
the whole item's shingles, half of the answer's words must be there or all but one: a question without its answer is no match.  Single words count
only near the item's shingles (between the first and the last that occur, and an item's length around).  The item's answer is its last sentence, its question what stands before;
an item of one sentence is split before its last quarter.

Defined results: null and empty texts and items match nothing, an item of fewer than five words counts as one shingle.
A row of ``docs`` gives one result row per item id it holds: of the texts under the id the one with the highest score, ties by question and then answer
overlap.  Rows that repeat are judged alike; repeated items are one if their ids are equal, and equal rows count once.  Items without an id are one id.
Empty tables give no rows.  Further columns, whatever their names, are ignored (``clean`` keeps those of ``docs``).

The index is broadcast in parts of about ``MAX_ITEMS`` items, dealt by id and text, so that one id may have any number of texts; a pass over the documents takes ``PASS_PARTS`` parts.
The statistics are those of all items, so that scores do not depend on the parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm.common import cut, strings, table

THRESHOLD = 0.8
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 16
MAX_ITEMS = 2_000
PASS_PARTS = 8
K1, B = 0.9, 0.4
BATCH_CHARS = 2_000_000
MEMO_ENTRIES = 200_000
EMPTY, UNKNOWN = -2, -1
_NO_WORD = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?]\s+(?=\S)|\n+(?=\S)")


def words(text: str | None) -> list[str]:
    """Lower-cased runs between white space, letters and digits only."""
    return [w for w in (_NO_WORD.sub("", run) for run in (text or "").lower().split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    if ends and words(text[:ends[-1]]) and words(text[ends[-1]:]):
        return words(text[:ends[-1]]), words(text[ends[-1]:])
    every = words(text)
    cut = len(every) - max(1, len(every) // 4)
    return every[:cut], every[cut:]


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(SHINGLE, len(ids))
    return set(zip(*(ids[i:] for i in range(n)))) if n else set()


def answer_units(ids: list[int]) -> set[tuple[int, ...]]:
    """What an answer is graded by: its shingles, or the words of one that has a single shingle."""
    return shingles(ids) if len(ids) > SHINGLE else {(i,) for i in ids}


def least_score(weight: dict[int, float], rules: list[list[set[tuple[int, ...]]]]) -> float:
    """A lower bound of the weight of the terms that a passage holds when it holds OVERLAP of every part of a rule.

    Each part can miss so many units, and a unit that is missed costs as many terms as it has at most: the terms missed are bounded
    by the fractional knapsack of weights under that number.
    """
    least = 1.0
    for parts in rules:
        room, uses, barred = 0, Counter(), set()
        for part in parts:
            missed = len(part) - int(np.ceil(OVERLAP * len(part) - 1e-9))
            own = Counter(t for unit in part for t in set(unit))
            room += missed * max((len(set(unit)) for unit in part), default=0)
            uses += own
            barred |= {t for t, n in own.items() if n > missed}
        missing = 0.0
        for t in sorted(uses.keys() - barred, key=lambda t: (-weight[t] / uses[t], t)):
            missing += weight[t] * min(1.0, room / uses[t])
            room -= min(room, uses[t])
        least = min(least, 1 - missing)
    return max(least, min(weight.values()))


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of the term numbers side by side in ``columns``."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = h * np.uint64(0x9E3779B97F4A7C15) + (c + 2).astype(np.uint64)
    return h


class _TermIds(dict):
    """Run between white space -> term number, UNKNOWN or EMPTY (bounded memo over the vocabulary)."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, run: str) -> int:
        word = run if run.isalnum() else _NO_WORD.sub("", run)
        found = self[run] = self.vocabulary.get(word, UNKNOWN) if word else EMPTY
        return found


class ItemIndex:
    """Inverted index of test items with block maxima, and the items' shingles."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, stats: tuple | None = None):
        """stats: (number of items, their mean length, {word: items with it}) of all parts' items."""
        self.threshold = threshold
        self.vocabulary: dict[str, int] = {}
        self.ids, self.parts, self.needs, self.sizes, bags = [], [], [], [], []
        for item_id, text in items:
            if every := words(text):
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in every]
                q, a = question_and_answer(text)
                self.ids.append(item_id)
                q, a = ([self.vocabulary[w] for w in p] for p in (q, a))
                self.parts.append((shingles(q), shingles(a), answer_units(a), shingles(numbers), {(w,) for w in a}))
                self.sizes.append(len(numbers))
                bags.append(Counter(numbers))
        n = max(1, len(bags))
        mean = sum(b.total() for b in bags) / n
        found = Counter(t for b in bags for t in b)
        if stats:
            n, mean, df = stats
            found = {self.vocabulary[w]: df[w] for w in self.vocabulary}
        idf = {t: np.log1p((n - d + 0.5) / (d + 0.5)) for t, d in found.items()}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for k, bag in enumerate(bags):
            weight = {t: idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * bag.total() / mean)) for t, tf in bag.items()}
            whole = sum(weight.values())
            weight = {t: w / whole for t, w in weight.items()}
            for t, w in weight.items():
                lists[t].append((k, w))
            q, a, units, every, _ = self.parts[k]
            self.needs.append(min(threshold, least_score(weight, [[q, units], [q, a], [every]])))
        self.docs = [[k for k, _ in p] for p in lists]
        self.impacts = [[w for _, w in p] for p in lists]
        # Largest impact of a term in each range of BLOCK item numbers.
        self.bound = np.zeros((len(lists), -(-len(bags) // BLOCK)))
        for t, p in enumerate(lists):
            np.maximum.at(self.bound[t], np.array([k for k, _ in p]) // BLOCK, [w for _, w in p])
        # The same of impacts divided by the item's least score.
        self.near = np.zeros_like(self.bound)
        for t, p in enumerate(lists):
            np.maximum.at(self.near[t], np.array([k for k, _ in p]) // BLOCK, [w / self.needs[k] for k, w in p])
        anchors: dict[int, set] = {}
        for q, a, _, every, _ in self.parts:
            for unit in (q or a) | every:
                anchors.setdefault(len(unit), set()).add(unit)
        self.anchors = {n: np.unique(gram_hashes(list(np.array(list(some), np.int64).T))) for n, some in anchors.items()}

    def search(self, terms: np.ndarray, block: int, near: bool = False) -> list[tuple[int, float]]:
        """WAND inside one block: (item number, score) of all its items that score at least the threshold (``near``: their
        least score) for the distinct ``terms``.  The block's maxima decide which item comes next and whether to score it."""
        need, out, high = (1 if near else self.threshold) - 1e-9, [], (block + 1) * BLOCK
        most = (self.near if near else self.bound)[terms, block]
        cursors = []  # item, place in the list, end of the block in the list, term, block maximum
        for t, m in zip(terms[most > 0].tolist(), most[most > 0].tolist()):
            docs = self.docs[t]
            at = bisect_left(docs, block * BLOCK)
            cursors.append([docs[at], at, bisect_left(docs, high, at), t, m])
        while cursors:
            cursors.sort()
            reach, item = 0.0, None
            for c in cursors:
                reach += c[4]
                if reach >= need:
                    item = c[0]
                    break
            if item is None:
                break
            if cursors[0][0] == item:  # every cursor before the pivot stands on the pivot's item
                score = sum(self.impacts[c[3]][c[1]] for c in cursors if c[0] == item)
                if score >= (self.needs[item] - 1e-9 if near else need):
                    out.append((item, score))
                item += 1
            for c in cursors:
                if c[0] < item:
                    c[1] = bisect_left(self.docs[c[3]], item, c[1], c[2])
                    c[0] = self.docs[c[3]][c[1]] if c[1] < c[2] else high
            cursors = [c for c in cursors if c[0] < high]
        return out

    def matches(self, texts) -> list[list[tuple[int, float, float, float]]]:
        """For each text the verified items: (item id, score, question overlap, answer overlap)."""
        return ItemIndexes([self]).matches(texts)

    def found(self, seq: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text number, item id, score, question overlap, answer overlap) of the verified items of texts given as term numbers."""
        flat = np.concatenate(seq or [np.empty(0, np.int64)])
        owner = np.repeat(np.arange(len(seq)), [len(s) for s in seq])
        starts = np.zeros(len(flat), bool)
        for n, known in self.anchors.items():
            if (m := len(flat) - n + 1) > 0:
                h = gram_hashes([flat[i:i + m] for i in range(n)])
                starts[:m] |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        for k in np.unique(owner[starts]).tolist():
            terms = np.unique(seq[k])
            terms = terms[terms >= 0]
            text = None
            for block in np.flatnonzero(self.near[terms].sum(axis=0) >= 1 - 1e-9):
                for item, score in self.search(terms, block, near=True):
                    text = text or _Grams(seq[k].tolist())
                    if overlaps := self._verified(text, item):
                        yield k, self.ids[item], score, *overlaps

    def _verified(self, text: _Grams, item: int) -> tuple[float, float] | None:
        """(question overlap, answer overlap) if the text holds the item."""
        q, a, units, every, named = self.parts[item]
        share = lambda part, held: sum(x in held for x in part) / len(part) if part else 1.0
        question, answer, whole = (share(part, text.of(part)) for part in (q, a, every))
        places = [at for part in (q, a, every) for x in part for at in text.of(part).get(x, ())]
        if not places:
            return None
        near = {(w,) for w in text.words[max(0, min(places) - self.sizes[item]):max(places) + SHINGLE + self.sizes[item]]}
        if units is not a:
            answer = max(answer, share(units, near)) if len(units) <= SHINGLE else answer
        size = len(named)
        if question >= OVERLAP and answer >= OVERLAP or whole >= OVERLAP and share(named, near) >= 1 - max(0.5, 1 / size) - 1e-9:
            return question, answer
        return None


class _Grams:
    """A text's runs of n words with their first and last place, made for the lengths that are asked for."""

    def __init__(self, words: list[int]):
        self.words, self.held = words, {}

    def of(self, part: set[tuple[int, ...]]) -> dict[tuple[int, ...], tuple[int, int]]:
        n = len(next(iter(part), ()))
        if n not in self.held:
            grams = list(zip(*(self.words[i:] for i in range(n)))) if n else []
            last = {g: at for at, g in enumerate(grams)}
            first = {g: at for at, g in reversed(list(enumerate(grams)))}
            self.held[n] = {g: (at, last[g]) for g, at in first.items()}
        return self.held[n]


class ItemIndexes:
    """The index parts of one pass: texts are read once, into numbers of a common vocabulary."""

    def __init__(self, parts: list[ItemIndex]):
        self.parts, self.vocabulary = parts, {}
        for p in parts:
            for w in p.vocabulary:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.local = []
        for p in parts:
            place = np.full(len(self.vocabulary) + 2, UNKNOWN, np.int64)  # the last two: EMPTY and UNKNOWN
            place[[self.vocabulary[w] for w in p.vocabulary]] = list(p.vocabulary.values())
            self.local.append(place)
        self.term_ids = _TermIds(self.vocabulary)

    def __getstate__(self):
        return self.__dict__ | {"term_ids": None}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.term_ids = _TermIds(self.vocabulary)

    def matches(self, texts) -> list[list[tuple[int, float, float, float]]]:
        """For each text the verified items of all parts: (item id, score, question overlap, answer overlap), the best text of each id."""
        if len(self.term_ids) > MEMO_ENTRIES:
            self.term_ids.clear()
        if not self.vocabulary:
            return [[] for _ in texts]
        seq = [np.array([*map(self.term_ids.__getitem__, t.lower().split())] if t else [], np.int64) for t in texts]
        seq = [s[s != EMPTY] for s in seq]
        best: list[dict] = [{} for _ in seq]
        for part, local in zip(self.parts, self.local):
            for k, item, *found in part.found([local[s] for s in seq]):
                best[k][item] = max(best[k].get(item, found), found)
        return [[(i, *f) for i, f in sorted(b.items(), key=lambda x: (x[0] is None, x[0]))] for b in best]


def item_words(text: Column) -> Column:
    """The words of ``text`` as an array."""
    @F.arrow_udf("array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([words(t) for t in strings(texts)], pa.list_(pa.string()))

    return found(text)


def item_indexes(items: DataFrame) -> Iterator[ItemIndexes]:
    """Indexes over all items for one pass each: up to PASS_PARTS parts of about MAX_ITEMS items, with the statistics of all."""
    rows = cut(items.select("item_id", "text").where(F.col("text").isNotNull()).distinct())
    n = max(1, -(-rows.count() // (MAX_ITEMS * 3 // 4)))
    part_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    if n > 1:
        held = cut(rows.select(part_of.alias("part"), item_words(F.col("text")).alias("words")).where(F.size("words") > 0))
        total = held.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean")).first()
        df = cut(held.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    parts = []
    for part in range(n):
        some = rows.where(part_of == part).orderBy("item_id", "text").collect()
        stats = None
        if n > 1:
            own = held.where(F.col("part") == part).select(F.explode("words").alias("word")).distinct()
            stats = total.n, total.mean, {r.word: r.df for r in own.join(df, "word").collect()}
        parts.append(ItemIndex([(r.item_id, r.text) for r in some], stats=stats))
        if len(parts) == PASS_PARTS or part == n - 1:
            yield ItemIndexes(parts)
            parts = []


def item_matches(spark: SparkSession, index: ItemIndexes, text: Column) -> Column:
    """The verified items of ``text`` as an array of (item_id, score, question_overlap, answer_overlap)."""
    shared = spark.sparkContext.broadcast(index)
    names = ("item_id", "score", "question_overlap", "answer_overlap")
    kind = pa.list_(pa.struct([(names[0], pa.int64()), *((n, pa.float64()) for n in names[1:])]))

    @F.arrow_udf("array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out, held, size = [], [], 0
            for text in strings(texts):
                held.append(text)
                size += len(text or "")
                if size >= BATCH_CHARS:
                    out += shared.value.matches(held)
                    held, size = [], 0
            out += shared.value.matches(held)
            yield pa.array([[dict(zip(names, m)) for m in row] for row in out], kind)

    return found(text)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item that a row of ``docs`` holds."""
    passes = [(docs.select("doc_id", F.xxhash64("text").alias("h"), F.lit(k).alias("pass"), item_matches(docs.sparkSession, index, F.col("text")).alias("found"))
               .select("doc_id", "h", "pass", F.explode("found").alias("m")).select("doc_id", "h", "pass", "m.*")) for k, index in enumerate(item_indexes(items))]
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    if len(passes) == 1:
        return passes[0].select(*names)
    # Texts of one id may lie in several passes: the best counts, once for each of the equal rows of a pass.
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m")
    once = reduce(DataFrame.union, passes).groupBy("doc_id", "h", "item_id", "pass").agg(best, F.count(F.lit(1)).alias("n"))
    rows = once.groupBy("doc_id", "h", "item_id").agg(F.max("m").alias("m"), F.max("n").alias("n"))
    return rows.select("doc_id", "item_id", "m.*", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*names)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for index in item_indexes(items):
        docs = docs.where(F.size(item_matches(docs.sparkSession, index, F.col("text"))) == 0)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
