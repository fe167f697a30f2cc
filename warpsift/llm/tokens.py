"""Token ids of whole texts, from a public tokenizer file.

The file's rules cut a text into words and merge each word for itself, so the ids of a word
are worked out once and kept in a bounded table. That way is open to texts of printable
Latin-1 characters without the file's special markers; every other text goes to the
tokenizer whole. Both ways give the same ids (tests compare them).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Words kept per Python worker; beyond that the table starts anew.
KEPT_WORDS = 500_000

# Characters for which lower-casing, composition and white space agree in every library.
_PLAIN = re.compile("[\t\n\r -~¡-ÿ]*")
# The tokenizer file's own word rule, for these characters.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\s\\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself
    where it is printable, else one of those from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_characters()
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.flat = np.empty(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, word: str) -> int:
        # Straight to the merges: the word is already cut out and in lower case.
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(letters)]
        at = len(self.known)
        if at + 2 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        end = int(self.bounds[at]) + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.bounds[at]:end] = ids
        self.bounds[at + 1] = end
        self.known[word] = at
        return at

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self.whole(text)
        words = _WORDS.findall(text.lower())
        if not words:
            return np.empty(0, np.uint32)
        if len(self.known) > KEPT_WORDS:
            self.forget()
        try:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            known, learn = self.known, self._learn
            at = np.array([known[w] if w in known else learn(w) for w in words], np.int64)
        first = self.bounds[at]
        count = self.bounds[at + 1] - first
        ends = np.cumsum(count)
        # Position of each id in `flat`: its word's first place plus its place in the word.
        where = np.arange(ends[-1]) + np.repeat(first - (ends - count), count)
        return self.flat[where]


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    """The encoder of a file, one per Python worker; None: the box's word tokenizer."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return Encoder(path)
