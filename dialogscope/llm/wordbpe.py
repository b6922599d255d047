"""The word-level BPE vocabulary file: symbols, merges and the split of a text into words.

A text is first split at the special strings, then each part is NFC-normalised
and lower-cased, and cut into words, single digits and runs of punctuation.
Texts made of Latin letters take one regular expression whose character classes
are spelled out; any other text takes the tokenizer library's own normaliser
and pre-tokeniser, so both paths give the library's words.
"""

import json
import re

from tokenizers import Tokenizer

END = "</w>"

# Latin text up to U+017F without U+0130 (its lower case holds a combining mark) and the
# separators U+001C to U+001F (white space to Python only): already in NFC, and every
# library agrees on its letters, digits and spaces.
_NOT_LATIN = re.compile("[^\x00-\x1b -įı-ſ]")
_WORD = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "|[a-zªµºß-öø-ſ]+"
    "|[0-9²³¹¼-¾]"
    "|[^\t-\r \x85\xa0a-z0-9ªµº²³¹¼-¾ß-öø-ſ]+")


class Memo(dict):
    """key -> made(key), remembered for the keys used last: two generations of at most ``size`` short keys."""

    def __init__(self, made, size: int, longest: int = 64):
        super().__init__()
        self.made, self.size, self.longest, self.old = made, size, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.made(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class WordVocabulary:
    """Symbols, merges and special strings of a vocabulary file; splits texts into words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a word BPE with the suffix {END}")
        self.path = path
        self.ids: dict[str, int] = dict(model["vocab"])
        self.merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = byte_alphabet()
        self._library = None

    def __getstate__(self):
        return self.__dict__ | {"_library": None}

    def labels(self) -> list[str]:
        """The string of every id, in order of the ids."""
        every = self.ids | self.specials
        out = [""] * (max(every.values()) + 1)
        for text, i in every.items():
            out[i] = text
        return out

    def spelled(self, word: str) -> str:
        """A word in the byte alphabet, without the end mark."""
        return word if word.isascii() and word.isalnum() else "".join(self.alphabet[b] for b in word.encode())

    def runs(self, text: str) -> list[str] | None:
        """The lower-cased runs between white space of a Latin text without special strings; None for
        other texts.  No word crosses white space, so the words of the runs are those of the text."""
        if _NOT_LATIN.search(text) or any(s in text for s in self.specials):
            return None
        return text.lower().split()

    @staticmethod
    def run_words(run: str) -> list[str]:
        return _WORD.findall(run)

    def words(self, text: str | None) -> list[str]:
        """The words of a text; a special string stands for itself (no other word holds both letters and marks)."""
        if not text:
            return []
        if any(s in text for s in self.specials):
            parts = re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", text)
            return [w for p in parts for w in ([p] if p in self.specials else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not _NOT_LATIN.search(text):
            return _WORD.findall(text.lower())
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
            self._byte = {c: b for b, c in enumerate(self.alphabet)}
        plain = self._library.normalizer.normalize_str(text)
        return [bytes(self._byte[c] for c in w).decode()
                for w, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]
