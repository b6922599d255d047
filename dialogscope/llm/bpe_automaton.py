"""Operator 3: BPE encoding and decoding with a tokenization automaton.

The automaton starts as one state that accepts every sequence of base symbols.
Each merge (u, v) -> uv is compiled in as a *gadget*: the state q that arcs
labelled u lead to is copied without its arc v, arcs u are redirected to the
copy, and every state with an arc u gets an arc uv to where v leads.  After the
last merge exactly one path spells each word, and its arc labels are the
word's tokens.  (Construction: Berglund, Martens and van der Merwe, "Constructing
a BPE tokenization DFA", 2024.)

All arcs with one label lead to one state, so a state is named by the label that
reaches it.  Written out, the arcs would be about labels squared; they are
kept as the gadgets' log instead, and an entry of the transition table is
computed from the log when first used (memo of bounded size).

An entry: the state after x is a chain of copies - of x, of x's right half, of
its right half, and so on, each link with the gadgets that came before the next
one was made; likewise a label t stands for its left half where it is not
yet made.  The arc t is missing iff a gadget removed one of these from one of those.

Null and empty texts encode to no ids and decode to "".  Rows are independent.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm.common import strings, table
from dialogscope.llm.wordbpe import END, Memo, WordVocabulary

MEMO_ENTRIES = 150_000
LATE = 1 << 60


class Automaton:
    """Deterministic tokenization automaton of a word vocabulary, with encoding and decoding."""

    def __init__(self, vocabulary: WordVocabulary):
        self.vocabulary = vocabulary
        ids = vocabulary.ids
        self.arc_label = vocabulary.labels()
        n = len(self.arc_label)
        self.born, self.left, self.right = [0] * n, [-1] * n, [-1] * n
        self.gadget: dict[tuple[int, int], int] = {}
        merged = {a + b for a, b in vocabulary.merges}
        self.spelling = {s: i for s, i in ids.items() if s not in merged}
        for time, (a, b) in enumerate(vocabulary.merges, 1):
            u, v, label = ids[a], ids[b], ids[a + b]
            if self.born[label]:
                raise ValueError(f"two merges make {a + b!r}: the automaton would not be deterministic")
            if a not in self.spelling or b not in self.spelling or not self._arc(u, v):
                continue  # no state after u has an arc v, so this merge never happens
            self.gadget[u, v] = time
            self.born[label], self.left[label], self.right[label] = time, u, v
            self.spelling[a + b] = label
        self.reach: dict[str, int] = {}  # first two symbols -> length of the longest label that begins with them
        for text in self.spelling:
            plain = text.removesuffix(END)
            self.reach[plain[:2]] = max(self.reach.get(plain[:2], 0), len(plain))
        self.__setstate__({})

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "by_run")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.table: dict[tuple[int, int], bool] = {}
        self.by_run = Memo(self._run_ids, MEMO_ENTRIES)

    def _run_ids(self, run: str) -> bytes:
        return b"".join([self._bytes(w) for w in self.vocabulary.run_words(run)])

    def _bytes(self, word: str) -> bytes:
        special = self.vocabulary.specials.get(word)
        return np.array(self.word_ids(word) if special is None else [special], "<u4").tobytes()

    def _arc(self, x: int, t: int) -> bool:
        """Whether the state after label x has an arc t."""
        born, left, right, gadget = self.born, self.left, self.right, self.gadget
        until_x = LATE
        while x >= 0:
            y, until_t = t, LATE
            while y >= 0:
                time = gadget.get((x, y))
                if time is not None and time < until_x and time <= until_t:
                    return False
                until_t, y = born[y], left[y]
            until_x, x = born[x], right[x]
        return True

    def word_ids(self, word: str) -> list[int]:
        """The labels of the path that spells the word.

        Walks the transition table, longest label first.  A prefix of the word has one path only, so
        a position that leads nowhere is met once, and the walk is linear in the word's length.
        """
        spelled, table, spelling, reach = self.vocabulary.spelled(word), self.table, self.spelling, self.reach
        n, path, starts, dead = len(spelled), [], [], set()
        i, j = 0, min(n, reach.get(spelled[:2], 1))
        while i < n:
            while j > i:
                t = spelling.get(spelled[i:j] + END if j == n else spelled[i:j])
                if t is not None and j not in dead:
                    if not path:
                        break
                    arc = table.get((path[-1], t))
                    if arc is None:
                        arc = table[path[-1], t] = self._arc(path[-1], t)
                    if arc:
                        break
                j -= 1
            if j > i:
                path.append(t)
                starts.append(i)
                i, j = j, min(n, j + reach.get(spelled[j:j + 2], 1))
            else:
                dead.add(i)
                path.pop()
                i, j = starts.pop(), i - 1
        return path

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.table) > 2 * MEMO_ENTRIES:
            self.table.clear()
        runs = self.vocabulary.runs(text) if text else []
        if runs is not None:
            return b"".join(map(self.by_run.__getitem__, runs))
        return b"".join(map(self._bytes, self.vocabulary.words(text)))

    def decode(self, ids: bytes) -> str:
        """The arc labels of the ids, one space between them (the library's rule where a file names no decoder)."""
        return " ".join(map(self.arc_label.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _shared(spark: SparkSession, vocabulary_path: str):
    """The automaton for the executors; its size is bounded by the vocabulary file."""
    return spark.sparkContext.broadcast(Automaton(WordVocabulary(vocabulary_path)))


def encoded(spark: SparkSession, text: Column, vocabulary_path: str) -> Column:
    """The ids of ``text``: binary, four little-endian bytes each."""
    shared = _shared(spark, vocabulary_path)

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shared.value.encode(t) for t in strings(texts)], pa.binary())

    return ids(text)


def decoded(spark: SparkSession, ids: Column, vocabulary_path: str) -> Column:
    """The text of ids that ``encoded`` made (null: null)."""
    shared = _shared(spark, vocabulary_path)

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in batches:
            yield pa.array([None if i is None else shared.value.decode(i) for i in strings(some)], pa.string())

    return texts(ids)


def encoding_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``.

    Ids and decoded texts are several times the input; they are made, hashed and
    dropped batch by batch, and never leave the task.
    """
    shared = _shared(docs.sparkSession, vocabulary_path)

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = shared.value
        for texts in batches:
            rows = []
            for text in strings(texts):
                ids = automaton.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(automaton.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.coalesce(F.col("text"), F.lit(""))).alias("d")).select("doc_id", "d.*")


def encoded_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, four little-endian bytes each) and the digests of ids and decoded text."""
    shared = _shared(docs.sparkSession, vocabulary_path)

    @F.arrow_udf("ids binary, decoded_sha256 string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ids = [shared.value.encode(t) for t in strings(texts)]
            sums = [hashlib.sha256(shared.value.decode(i).encode()).hexdigest() for i in ids]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(sums, pa.string())], ["ids", "decoded_sha256"])

    rows = docs.select("doc_id", both(F.coalesce(F.col("text"), F.lit(""))).alias("b"))
    return rows.select("doc_id", F.floor(F.octet_length("b.ids") / 4).alias("n_tokens"), "b.ids",
                       F.sha2("b.ids", 256).alias("ids_sha256"), "b.decoded_sha256")


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
