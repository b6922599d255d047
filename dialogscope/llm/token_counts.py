"""Operator 1: token counts with a whole-word shortcut.

Before any text is read, every vocabulary string that ends a word is put through
the merges once; those that come out as one token are *proven* whole.  Counting
a text then looks each word up: a proven word is one token, only other words
are merged (and remembered in a bounded memo, as is the count of a whole run between white space).

Null and empty texts count 0 tokens.  Rows are independent: repeated rows are
counted again, a text of any length is counted whole.
"""

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm.common import strings, table
from dialogscope.llm.wordbpe import END, Memo, WordVocabulary

MEMO_ENTRIES = 150_000
SHORT = 40
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NEVER = 1 << 60


class Merger:
    """Applies the merges to one word's symbols."""

    def __init__(self, vocabulary: WordVocabulary):
        ids = vocabulary.ids
        self.vocabulary = vocabulary
        self.rank = {(ids[a], ids[b]): (k, ids[a + b]) for k, (a, b) in enumerate(vocabulary.merges)}
        self.order = {pair: k << ID_BITS | new for pair, (k, new) in self.rank.items()}  # rank and result in one number

    def symbols(self, word: str) -> list[int]:
        ids, spelled = self.vocabulary.ids, self.vocabulary.spelled(word)
        return [ids[c] for c in spelled[:-1]] + [ids[spelled[-1] + END]]

    def merged(self, symbols: list[int]) -> list[int]:
        return self._short(symbols) if len(symbols) <= SHORT else self._long(symbols)

    def _short(self, s: list[int]) -> list[int]:
        """Merge the leftmost pair of the lowest rank until no pair has a rank."""
        order = self.order
        ranks = [order.get(p, NEVER) for p in zip(s, s[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            s[i:i + 2] = (low & ID_MASK,)
            del ranks[i]
            if i:
                ranks[i - 1] = order.get((s[i - 1], s[i]), NEVER)
            if i < len(ranks):
                ranks[i] = order.get((s[i], s[i + 1]), NEVER)
        return s

    def _long(self, s: list[int]) -> list[int]:
        """The same for words of any length, in n log n steps: a heap of pairs over a linked list."""
        s, n = list(s), len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(s, s[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = after[i] if s[i] is not None else n
            if j >= n or (s[i], s[j]) != pair:
                continue
            s[i], s[j], after[i] = new, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (s[a], s[b]) in self.rank:
                    heapq.heappush(heap, (*self.rank[s[a], s[b]], a, (s[a], s[b])))
        return [x for x in s if x is not None]


def proven_words(merger: Merger) -> dict[str, int]:
    """Words that encode alone as one token, proven by merging each vocabulary string's symbols."""
    byte = {c: b for b, c in enumerate(merger.vocabulary.alphabet)}
    out = {}
    for text, i in merger.vocabulary.ids.items():
        if text.endswith(END) and len(text) > len(END):
            try:
                word = bytes(byte[c] for c in text[: -len(END)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if merger.merged(merger.symbols(word)) == [i]:
                out[word] = 1
    return out


class TokenCounter:
    """Counts tokens: proven words at once, other words by merging, whole runs between white space from a memo."""

    def __init__(self, path: str):
        self.merger = Merger(WordVocabulary(path))
        self.proven = proven_words(self.merger) | dict.fromkeys(self.merger.vocabulary.specials, 1)
        self.__setstate__({})

    def __getstate__(self):
        return {"merger": self.merger, "proven": self.proven}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.by_run = Memo(lambda run: sum(map(self.word, self.merger.vocabulary.run_words(run))), MEMO_ENTRIES)

    def word(self, word: str) -> int:
        return self.proven.get(word) or len(self.merger.merged(self.merger.symbols(word)))

    def count(self, text: str | None) -> int:
        runs = self.merger.vocabulary.runs(text) if text else []
        if runs is not None:
            return sum(map(self.by_run.__getitem__, runs))
        return sum(map(self.word, self.merger.vocabulary.words(text)))


def token_count(spark: SparkSession, text: Column, vocabulary_path: str) -> Column:
    """Number of tokens of ``text``.  The counter that goes to the executors is bounded by the vocabulary file."""
    shared = spark.sparkContext.broadcast(TokenCounter(vocabulary_path))

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = shared.value
        for texts in batches:
            yield pa.array([counter.count(t) for t in strings(texts)], pa.int64())

    return counted(text)


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"),
                        token_count(docs.sparkSession, text, vocabulary_path).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
