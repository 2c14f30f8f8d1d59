"""Byte-level BPE through the tokenizers library, with a bounded cache of pre-tokens.

The vocabulary's pre-tokeniser cuts a text into words that are then encoded each by itself. So the library encodes each
distinct word once and a text's ids are its words' ids in a row. The cut is made here for texts up to U+024F; a text with
any other character, or with an added token of the vocabulary (such as <|endoftext|>, which is one id), goes to the library
as a whole. So do all texts where the file has a normaliser, or another pre-tokeniser than the one that is cut by here.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

import numpy as np

#: Distinct words that a cache keeps; further ones are encoded for the texts at hand.
CACHE_WORDS = 1_000_000


def _ranges(wanted) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x250) if wanted(chr(i)))


#: The vocabulary's public split pattern, with its classes written out for characters below U+0250. Letters and digits are
#: tried first: no contraction begins with one, so the words are the same, and most are found at the first try.
_L = _ranges(lambda c: unicodedata.category(c)[0] == "L")
_N = _ranges(lambda c: unicodedata.category(c)[0] == "N")
_S = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_SPLIT = re.compile(f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: The same for texts of ASCII alone.
_SPLIT_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_WIDE = re.compile("[^\x00-ɏ]")


def cuts_as_here(file: dict) -> bool:
    """Whether a tokenizer file encodes each word of ``_SPLIT`` by itself, and nothing before or behind it."""
    cut = file.get("pre_tokenizer") or {}
    plain = all(not file.get(k) for k in ("normalizer", "truncation", "padding")) and not (file["model"].get("dropout") or file["model"].get("end_of_word_suffix"))
    return plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)


#: The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHARS = [chr(b) for b in range(256)]
for _k, _b in enumerate(b for b in range(256) if b not in _SEEN):
    _CHARS[_b] = chr(0x100 + _k)
_ASCII_CHARS = {b: _CHARS[b] for b in range(128)}


class Encoder:
    """Texts to arrays of ids as bytes, in the narrowest little-endian unsigned type that holds the vocabulary."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = cuts_as_here(json.loads(self.tokenizer.to_str()))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "HI"[self.dtype.itemsize // 4]
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}

    @classmethod
    def get(cls, path: str) -> Encoder:
        """One for each worker process and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """A word by the model alone, without what the library wraps round it for whole texts."""
        known = word.translate(_ASCII_CHARS) if word.isascii() else "".join(map(_CHARS.__getitem__, word.encode()))
        return self._packed([t.id for t in self.model.tokenize(known)])

    def _packed(self, ids: list[int]) -> bytes:
        # small arrays are made faster by the standard library than by numpy, which serves machines of the other byte order
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _words(self, text: str) -> list[str] | None:
        """A text's words, or None if it must go to the library as a whole."""
        if not self.cuts or any(a in text for a in self.added):
            return None
        if text.isascii():
            return _SPLIT_ASCII.findall(text)
        return None if _WIDE.search(text) else _SPLIT.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._words(t) for t in texts]
        out, open_, get, new = [b""] * len(texts), [], self.cache.__getitem__, []
        for k, words in enumerate(cut):
            try:  # most texts have no new word
                if words:
                    out[k] = b"".join(map(get, words))
            except KeyError:
                open_.append(k)
        if open_:
            new = list(set().union(*(cut[k] for k in open_)).difference(self.cache))
            self.cache.update(zip(new, map(self._word, new), strict=True))
            for k in open_:
                out[k] = b"".join(map(get, cut[k]))
        whole = [k for k, words in enumerate(cut) if words is None]
        for k, ids in zip(whole, self._whole([texts[k] for k in whole]) if whole else [], strict=True):
            out[k] = ids
        if len(self.cache) > CACHE_WORDS:
            for word in new:
                del self.cache[word]
        return out
