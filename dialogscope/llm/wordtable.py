"""Words of many texts at once: each distinct word numbered, and hashed with array operations.

A word is a run between white space, lower-cased, with everything but its letters (Unicode category L) taken out;
runs without a letter are no words.
"""

import re

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_NO_LETTERS = re.compile(r"[\W\d_]+")


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def numbered(texts) -> tuple[list[str], list[np.ndarray]]:
    """The distinct words of the texts, and for each text its words' numbers in order (null: none)."""
    runs = _Numbers()
    ids = [np.array([*map(runs.__getitem__, t.lower().split())] if t else [], np.int64) for t in texts]
    words, own = _Numbers(), np.full(len(runs), -1, np.int64)
    for n, run in enumerate(runs):
        word = run if run.isalpha() else _NO_LETTERS.sub("", run)
        if word and not word.isalpha():  # superscripts, fractions, letter-like numbers
            word = "".join(filter(str.isalpha, word))
        if word:
            own[n] = words[word]
    return list(words), [i[i >= 0] for i in (own[i] for i in ids)]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, each between two marks, and the positions where each word begins and ends."""
    flat = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    return flat, np.concatenate([[0], end[:-1]]).astype(np.int64), end


def word_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``codes``."""
    place = np.arange(len(flat)) - np.repeat(start, end - start)
    powers = np.cumprod(np.full(int(place.max()) + 1, MULTIPLIER))
    h = np.add.reduceat((flat + np.uint64(0x632BE5AB)) * powers[place], start)
    return h ^ (h >> np.uint64(31))


def gram_buckets(flat: np.ndarray, at: np.ndarray, n: int, tag: int, bits: int) -> np.ndarray:
    """The n code points from each position on, hashed into 2^bits buckets."""
    h = np.full(len(at), tag, np.uint64)
    for i in range(n):
        h = (h ^ flat[at + i]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return ((h * MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)
