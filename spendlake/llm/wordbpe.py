"""Pre-tokens of a tokenizer file whose words are merged on their own, and the ids of each pre-token.

The library's normaliser and pre-tokenizer are followed exactly. Texts made of common Latin characters, where Python's
rules and the library's agree, take a fast pattern; all other texts go through the library itself.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Characters for which Python's lower case and classes equal the library's: no control separators, no superscripts, no
#: dotted capital I, nothing that composes.
_UNCOMMON = re.compile("[^\x00-\x1b\x20-©«-±´-¸»¿-įı-ž]")
#: The pattern of the tokenizer file for common characters in lower case, whose letters are ranges. Fixed by the file.
_WORDS = re.compile(r"[a-zµß-öø-ž]+|'(?:[stmd]|re|ve|ll)|[0-9]|(?:[^\w\s]|_)+")
#: The two parts that the file must have for the fast pattern to hold.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: Bytes of pre-tokens and ids that a worker remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED = 24 << 20
#: Bytes that a remembered pre-token takes besides its characters and ids.
OVERHEAD = 180


def _printable_bytes() -> dict[int, str]:
    """Each byte as the character that stands for it in byte-level vocabularies: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._shown = _printable_bytes()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kinds = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
        splits = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.fast = kinds == _NORMALIZERS and splits[0].get("pattern", {}).get("Regex") == _PATTERN

    def _split_plain(self, text: str) -> list[str]:
        if self.fast and not _UNCOMMON.search(text):
            return _WORDS.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text in order; a special string of the tokenizer is one."""
        if self._special is None or "<|" not in text and not self._special.search(text):
            return self._split_plain(text)
        out: list[str] = []
        at = 0
        for m in self._special.finditer(text):
            out += self._split_plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._split_plain(text[at:])

    def ids(self, token: str) -> list[int]:
        """The ids of one pre-token."""
        if token in self.special:
            return [self.special[token]]
        if not (token.isascii() and token.isprintable()) or " " in token:  # else each byte stands for itself
            token = token.encode().decode("latin-1").translate(self._shown)
        return [t.id for t in self.model.tokenize(token)]


class IdPool(dict):
    """The ids of the pre-tokens seen so far, side by side in one array: token -> its number in the pool."""

    def __init__(self, tokenizer: WordTokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer
        self.reset()

    def reset(self) -> None:
        self.clear()
        self._ids, self._ends = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64)
        self._used, self._size = 0, 0
        self._new: list[list[int]] = []

    def __missing__(self, token: str) -> int:
        own = self.tokenizer.ids(token)
        self._new.append(own)
        self._size += OVERHEAD + len(token) + 4 * len(own)
        self[token] = n = len(self)
        return n

    def _take_in(self) -> None:
        """Put the ids of new pre-tokens behind the others. The arrays grow by doubling."""
        if not self._new:
            return
        before = len(self) - len(self._new)
        ends = self._used + np.cumsum(np.fromiter(map(len, self._new), np.int64, len(self._new)))
        self._ids = _grown(self._ids, self._used, int(ends[-1]))
        self._ends = _grown(self._ends, before + 1, len(self) + 1)
        self._ids[self._used : ends[-1]] = np.fromiter(chain.from_iterable(self._new), np.uint32, int(ends[-1]) - self._used)
        self._ends[before + 1 : len(self) + 1] = ends
        self._used, self._new = int(ends[-1]), []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has."""
        if self._size > REMEMBERED:
            self.reset()
        words = [self.tokenizer.split(t) if t else [] for t in texts]
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(per_text.sum()))
        self._take_in()
        return gathered(self._ids, self._ends, codes, per_text)


def _grown(array: np.ndarray, used: int, wanted: int) -> np.ndarray:
    if wanted <= len(array):
        return array
    out = np.zeros(2 * wanted, array.dtype)
    out[:used] = array[:used]
    return out


def gathered(pool: np.ndarray, starts: np.ndarray, codes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pool[starts[c]:starts[c + 1]]`` for each code, joined; and the lengths per text."""
    lengths = starts[codes + 1] - starts[codes]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(starts[codes] - (ends - lengths), lengths)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
    return pool[at], np.diff(bounds)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    return WordTokenizer(path)


@lru_cache(maxsize=4)
def pool(path: str) -> IdPool:
    """One pool for each Python worker."""
    return IdPool(tokenizer(path))
