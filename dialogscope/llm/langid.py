"""Operator 8: language identification with a linear-chain conditional random field.

Each word is a position, its language the label.  A word's features: character n-grams of two
and three with marks at both ends, affixes of three characters, and membership in the
lexicon of words frequent in the training rows.  N-grams and affixes are hashed into a weight table of
fixed size.  Transitions between labels are learned with them by gradient steps on the
conditional likelihood, over word sequences that switch language every few words.
Prediction runs forward-backward over every word of the whole text; a document's language
is the label with the largest sum of word posteriors, its score that label's mean posterior.

Training reads a bounded sample of every language there is: about ``ROWS_PER_LANG`` rows of each (fewer where they would be more than
``SAMPLE_ROWS`` together, one at least) and about ``MAX_WORDS`` words in all.  Of a text above ``TEXT_BYTES`` the sample
takes ``SEGMENTS`` segments at hashed places, spread over the whole text; where many languages make many rows, each row's share of
``SAMPLE_CHARS`` is less than ``TEXT_BYTES``, and the rows are cut to it before they leave the executors.  Repeated rows are learned once.  The lexicon holds
every word found three times in the sample.  The model that goes to the executors has at most ``MODEL_NUMBERS`` n-gram weights (the table
is halved until buckets times languages fit) besides the lexicon's.

A long text is labelled in pieces of ``PIECE`` words side by side.  Messages cross the pieces' borders: a piece is labelled again with its neighbours'
messages until no border changes, so the posteriors are those of one pass over the whole text.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if no row
can be learned from.  Letters are characters of Unicode category L: digits, fractions, circled and Roman-numeral signs are none.
Rows are independent, ties go to the first language in alphabetical order.  An empty table gives no rows.  Of the input only
doc_id, text and lang are read (``accepted`` keeps all columns), so further columns may have any names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm.common import cut, free_name, held_out, strings, table
from dialogscope.llm.wordtable import codes, gram_buckets, numbered, word_hashes

UND = "und"
MIN_SCORE = 0.3
ROWS_PER_LANG = 500
TEXT_BYTES = 16_384
SEGMENTS = 8
SAMPLE_ROWS = 32_000
SAMPLE_CHARS = 1 << 26
LEAST_CHARS = 256
MAX_WORDS = 250_000
BUCKET_BITS = 16
MODEL_NUMBERS = 1 << 25
PIECE = 1_024
STILL = 1e-6  # of a message that sums to 1
BATCH_CHARS = 1_500_000
GRID = 250_000


# --- features -------------------------------------------------------------------------------

def feature_groups(words: list[str], lexicon: np.ndarray, bits: int = BUCKET_BITS):
    """(word number, feature number) pairs of the words' features, kind by kind, each by word number."""
    flat, start, end = codes(words)
    owner, at = np.repeat(np.arange(len(words)), end - start), np.arange(len(flat))
    left = np.repeat(end, end - start) - at
    for n in (2, 3):
        fits = left >= n
        yield owner[fits], gram_buckets(flat, at[fits], n, n, bits)
    long = np.flatnonzero(end - start >= 4)
    yield long, gram_buckets(flat, start[long], 4, 4, bits)
    yield long, gram_buckets(flat, end[long] - 4, 4, 5, bits)
    if len(lexicon):
        h = word_hashes(flat, start, end)
        place = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[place] == h)
        yield known, (1 << bits) + place[known]


def features(words: list[str], lexicon: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """All (word number, feature number) pairs, by word number."""
    who, what = map(np.concatenate, zip(*feature_groups(words, lexicon, bits)))
    order = np.argsort(who, kind="stable")
    return who[order], what[order]


# --- the model ------------------------------------------------------------------------------

def _forward_backward(potential: np.ndarray, step: np.ndarray, live: np.ndarray | None = None, first: np.ndarray | None = None,
                      last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of (time, sequence, label) potentials and (label, label) transitions, all positive: forward
    and backward messages, each scaled to sum 1.  live: which (time, sequence) places hold a word.

    first, last: each sequence's messages from the words before and after it (first: the transition taken already); without: none.
    """
    forward, backward = np.empty_like(potential), np.ones_like(potential)
    f = potential[0] if first is None else first * potential[0]
    f = f / f.sum(axis=1, keepdims=True)
    forward[0] = f
    for t in range(1, len(potential)):
        f = (f @ step) * potential[t]
        f /= f.sum(axis=1, keepdims=True)
        forward[t] = f
    end = np.ones_like(potential[0]) if last is None else last
    backward[-1] = end
    for t in range(len(potential) - 2, -1, -1):
        b = (potential[t + 1] * backward[t + 1]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        backward[t] = b if live is None else np.where(live[t + 1][:, None], b, end)
    return forward, backward


class _Piece:
    """Some words of a text, with what the neighbouring pieces told it."""

    def __init__(self, text: int, at: int, ids: np.ndarray, labels: int):
        self.text, self.at, self.ids = text, at, ids
        self.first = self.last = np.ones(labels, np.float32)
        self.before = self.after = None

    def told(self, name: str, message: np.ndarray) -> bool:
        """Take a neighbour's message; whether it is another than before."""
        message = message / message.sum()
        changed = np.abs(message - getattr(self, name) / getattr(self, name).sum()).max() > STILL
        setattr(self, name, message)
        return bool(changed)


class Crf:
    """Feature weights, transition weights and the labels' names."""

    def __init__(self, langs: list[str], lexicon: np.ndarray):
        self.langs, self.lexicon = langs, lexicon
        self.bits = BUCKET_BITS
        while self.bits > 8 and len(langs) << self.bits > MODEL_NUMBERS:
            self.bits -= 1
        self.weights = np.zeros(((1 << self.bits) + len(lexicon), len(langs)), np.float32)
        self.transitions = np.zeros((len(langs), len(langs)), np.float32)

    def potentials(self, words: list[str]) -> np.ndarray:
        """exp(score) of every label for every word, scaled to a maximum of 1."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for who, what in feature_groups(words, self.lexicon, self.bits) if words else ():
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1])[:len(who)])
            if len(first):
                out[who[first]] += np.add.reduceat(self.weights[what], first, axis=0)
        return np.exp(np.maximum(out - out.max(axis=1, keepdims=True), -60))

    def posteriors(self, texts: list[str | None]) -> list[np.ndarray]:
        """(word, label) posteriors of each text, all texts together."""
        words, ids = numbered(texts)
        table = self.potentials(words)
        out = [np.empty((len(i), len(self.langs)), np.float32) for i in ids]
        step, todo, longest = np.exp(self.transitions), [], 0
        for k, i in enumerate(ids):
            parts = [_Piece(k, at, i[at:at + PIECE], len(self.langs)) for at in range(0, len(i), PIECE)]
            for a, b in zip(parts, parts[1:]):
                a.after, b.before = b, a
            todo += parts
            longest = max(longest, len(parts))
        for _ in range(longest):  # after as many rounds as a text has pieces its messages are exact, mostly after two
            again = {}
            for some, forward, backward, table_at in self._passes(todo, table, step):
                both = forward * backward
                both /= both.sum(axis=2, keepdims=True)
                for c, p in enumerate(some):
                    n = len(p.ids)
                    out[p.text][p.at:p.at + n] = both[:n, c]
                    if p.after and p.after.told("first", forward[n - 1, c] @ step):
                        again[id(p.after)] = p.after
                    if p.before and p.before.told("last", (table_at[0, c] * backward[0, c]) @ step.T):
                        again[id(p.before)] = p.before
            todo = list(again.values())
        return out

    def _passes(self, pieces: list[_Piece], table: np.ndarray, step: np.ndarray):
        """The pieces in lists of about the same length side by side, shorter ones filled up, with their messages and potentials."""
        pieces = sorted(pieces, key=lambda p: -len(p.ids))
        while pieces:
            size = len(pieces[0].ids)
            some = [p for p in pieces[:max(1, GRID // size)] if len(p.ids) > size // 2]
            pieces = pieces[len(some):]
            grid = np.full((size, len(some)), -1, np.int64)
            for c, p in enumerate(some):
                grid[:len(p.ids), c] = p.ids
            live = grid >= 0
            potential = np.where(live[..., None], table[grid], np.float32(1))
            yield some, *_forward_backward(potential, step, live, np.stack([p.first for p in some]), np.stack([p.last for p in some])), potential

    def predict(self, texts) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= BATCH_CHARS:
                out += self._best(held)
                held, size = [], 0
        return out + self._best(held)

    def _best(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for p in self.posteriors(texts) if self.langs else [()] * len(texts):
            if not len(p):
                out.append((UND, 0.0))
            else:
                mean = p.mean(axis=0, dtype=np.float64)
                out.append((self.langs[int(mean.argmax())], float(min(1.0, mean.max()))))
        return out

    def runs(self, text: str | None) -> list[tuple[str, int, int]]:
        """(language, first word, number of words) of each run of words with the same label."""
        if not self.langs:
            return []
        best = self.posteriors([text])[0].argmax(axis=1)
        edge = np.flatnonzero(np.append(True, best[1:] != best[:-1])[:len(best)])
        return [(self.langs[best[a]], int(a), int(b - a)) for a, b in zip(edge, np.append(edge[1:], len(best)))]


def fit(rows: list[tuple[str, str]], epochs: int = 6, length: int = 64, batch: int = 96, rate: float = 0.3, seed: int = 1) -> Crf:
    """Train on (text, language) rows: segments of 4 to 40 words, shuffled into sequences of mixed languages."""
    chance = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    every, texts = numbered([text for text, _ in rows])
    share = MAX_WORDS / max(MAX_WORDS, sum(map(len, texts)))
    segments, met, place_of = [], set(), {lang: k for k, lang in enumerate(langs)}
    for (_, lang), ids in zip(rows, texts):
        at = 0
        while at < len(ids):
            size = int(chance.integers(4, 41))
            if chance.random() < share or lang not in met:
                segments.append((ids[at:at + size], place_of[lang]))
                met.add(lang)
            at += size
    if not segments:
        return Crf([], np.empty(0, np.uint64))
    counts = np.bincount(np.concatenate([ids for ids, _ in segments]), minlength=len(every))
    model = Crf(langs, np.unique(word_hashes(*codes(every))[counts >= 3]))
    who, what = features(every, model.lexicon, model.bits)
    begin = np.searchsorted(who, np.arange(len(every) + 1))
    total_w = np.full(model.weights.shape, 1e-6, np.float32)
    total_t = np.full(model.transitions.shape, 1e-6, np.float32)
    L = len(langs)
    for _ in range(epochs):
        order = chance.permutation(len(segments))
        ids = np.concatenate([segments[k][0] for k in order])
        gold = np.concatenate([np.full(len(segments[k][0]), segments[k][1]) for k in order])
        n = max(1, len(ids) // length)
        size = min(length, len(ids))
        for lo in range(0, n, batch):
            hi = min(n, lo + batch)
            i, y = (x[lo * size:hi * size].reshape(hi - lo, size).T for x in (ids, gold))  # time, sequence
            flat = i.ravel()
            reach = begin[flat + 1] - begin[flat]
            owner = np.repeat(np.arange(len(flat)), reach)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach)
            feats = what[begin[flat][owner] + place]
            score = np.stack([np.bincount(owner, model.weights[feats, k], len(flat)) for k in range(L)], axis=1)
            potential = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -60)).reshape(size, hi - lo, L)
            step = np.exp(model.transitions.astype(np.float64))
            forward, backward = _forward_backward(potential, step)
            post = forward * backward
            post /= post.sum(axis=2, keepdims=True)
            gap = post.reshape(-1, L).copy()
            gap[np.arange(len(flat)), y.ravel()] -= 1
            scale = 1 / (hi - lo)
            for k in range(L):
                g = np.bincount(feats, gap[owner, k], len(model.weights)) * scale
                total_w[:, k] += g * g
                model.weights[:, k] -= rate * g / np.sqrt(total_w[:, k])
            if size > 1:
                before, after = forward[:-1].reshape(-1, L), (potential[1:] * backward[1:]).reshape(-1, L)
                pairs = step * ((before / ((before @ step) * after).sum(axis=1, keepdims=True)).T @ after)
                gold_pair = np.zeros((L, L))
                np.add.at(gold_pair, (y[:-1].ravel(), y[1:].ravel()), 1)
                g = (pairs - gold_pair) * scale
                total_t += g * g
                model.transitions -= rate * g / np.sqrt(total_t)
    return model


# --- Spark ----------------------------------------------------------------------------------

def sampled_text(text: Column, h: Column, limit: int = TEXT_BYTES) -> Column:
    """``text``, or the hashed segments of one above ``limit`` bytes, without the words cut at their ends."""
    part = F.floor(F.length(text) / SEGMENTS).cast("int")
    size = F.least(part, F.lit(limit // SEGMENTS))
    pieces = [F.substr(text, (part * k + F.pmod(F.xxhash64(h, F.lit(k)), part - size + 1) + 1).cast("int"), size) for k in range(SEGMENTS)]
    whole_words = [F.regexp_replace(F.regexp_replace(p, r"^\S*\s+", ""), r"\s+\S*$", "") for p in pieces]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat_ws(" ", *whole_words))


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample of every language: about ROWS_PER_LANG rows chosen by a hash of doc_id and text, the smallest hash always."""
    known = (docs.select("doc_id", "text", "lang")
             .where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
             .withColumn("h", F.xxhash64("doc_id", "text")))
    counts = cut(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first")))
    n_langs = counts.count()
    if not n_langs:
        return []
    size = max(1, min(ROWS_PER_LANG, SAMPLE_ROWS // n_langs))
    limit = max(LEAST_CHARS, min(TEXT_BYTES, SAMPLE_CHARS // (2 * size * n_langs)))
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30) * F.col("n")
    rows = (known.join(F.broadcast(counts), "lang").where((F.col("h") == F.col("first")) | (place < size))
            .select("lang", "h", (F.col("h") != F.col("first")).alias("other"), place.alias("place"), sampled_text(F.col("text"), F.col("h"), limit).alias("text"))
            .dropDuplicates(["lang", "h"]).orderBy("other", "place", "h", "lang").limit(2 * size * n_langs).select("text", "lang").collect())
    return [(r.text, r.lang) for r in rows]


def predictions(spark: SparkSession, model: Crf, text: Column) -> Column:
    """struct(lang_pred, score) of ``text``."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = shared.value.predict(strings(texts))
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                                             ["lang_pred", "score"])

    return predicted(text)


def word_runs(spark: SparkSession, model: Crf, text: Column) -> Column:
    """The labelled words of ``text`` as runs: array of (lang, first_word, n_words)."""
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))

    @F.arrow_udf("array<struct<lang:string,first_word:int,n_words:int>>")
    def runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[dict(zip(("lang", "first_word", "n_words"), r)) for r in shared.value.runs(t)]
                            for t in strings(texts)], kind)

    return runs(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model learned from ``docs`` itself."""
    spark = docs.sparkSession
    model = fit(training_rows(docs))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictions(spark, model, F.col("text")).alias("p"))
            .select("doc_id", "held_out", "p.*"))


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` with a language: not ``und``, and the label's mean posterior is at least ``min_score``.
    Texts that mix two languages have about one half; below the minimum no language stands out."""
    model, name = fit(training_rows(docs)), free_name(docs, "lang_prediction")
    found = docs.withColumn(name, predictions(docs.sparkSession, model, F.col("text")))
    return found.where((F.col(name)["lang_pred"] != UND) & (F.col(name)["score"] >= min_score)).drop(name)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
