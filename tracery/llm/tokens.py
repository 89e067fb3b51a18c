"""Token ids of whole texts, by the tokenizers library, with a bounded cache of words for each Python worker."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Words that a worker keeps, and as many older ones, so memory is bounded.
MAX_WORDS = 250_000
#: Letters whose lower case is one letter and that normalization leaves as they are.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_chars() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids by word; a full one becomes the old one, whose words come back when they are met again."""

    def __init__(self, word):
        self.word, self.old = word, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.word(key)
        self[key] = found
        return found

    def age(self, most: int) -> None:
        if len(self) >= most:
            self.old = dict(self)
            self.clear()


class WordTokens:
    """ids(text) as packed little-endian uint32 bytes, equal to Tokenizer.encode(text, add_special_tokens=False).

    A lower-casing tokenizer that drops white space never joins pieces across it, so a text's ids are those
    of its chunks between spaces and line ends. Chunks that are one run of letters go to the library's BPE
    model directly; every other chunk goes through the library's whole pipeline. Only for tokenizers of that
    kind (checked when loaded); for others the whole text is encoded at once.
    """

    def __init__(self, path: str, most: int = MAX_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x["type"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE"
        if self.by_word:
            m = spec["model"]
            self.model = BPE(
                vocab=m["vocab"], merges=[tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]],
                end_of_word_suffix=m["end_of_word_suffix"], cache_capacity=0,
            )
        self.chars, self.most = _byte_chars(), most
        self.cache = _Words(self.word)

    def word(self, word: str) -> bytes:
        """Ids of one chunk without spaces and line ends."""
        if not word:
            return b""
        tail = b""
        if word[-1] in ".," and _LETTERS.fullmatch(word, 0, len(word) - 1):
            word, tail = word[:-1], self.cache[word[-1]]
        if _LETTERS.fullmatch(word):
            low = word.lower()
            mapped = low if low.isascii() else "".join(map(self.chars.__getitem__, low.encode()))
            return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes() + tail
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes() + tail

    def ids(self, text: str | None) -> bytes:
        """Packed ids of a whole text; null has none."""
        if not text:
            return b""
        if not self.by_word:
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if "<|" not in text and text.isascii():  # a special token's name counts only as it is written
            text = text.lower()
        self.cache.age(self.most)
        return b"".join(map(self.cache.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_tokens(path: str, most: int = MAX_WORDS) -> WordTokens:
    """One tokenizer for each worker and file, that keeps `most` words and as many older ones."""
    return WordTokens(path, most)
