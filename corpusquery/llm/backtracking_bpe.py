"""Exact BPE by backtracking: longest token matches, checked in pairs, in time linear in a word's length.

A sequence of tokens is what BPE's merges give if and only if each two neighbours are: if no merge across their border would
have come before the merges that made them (``Vocabulary.compatible``). So a word is encoded from the left: the longest token
that begins at a position (found for all positions by one Aho-Corasick pass) is taken if it goes with the token before it, else
the next shorter one that begins it; where none goes, the position is marked as a dead end and the token before is shortened.
Each position is marked once at most.

Tokens that no merges lead to by themselves can't stand in an encoding, and aren't in the automaton. The end of a word is one
character more: the last symbol of a word is another one than the same character within it (``</w>`` in the file).

Words are cut as the tokenizer file says. For texts up to U+024F this is done here; any other text goes through the library's
own normaliser and pre-tokeniser, and its words come back here. Added tokens such as <|endoftext|> are one id each. Decoding
takes the tokens' texts from one blob by a table of offsets and puts a space between them, as the library's decode does for a
file without a decoder; ``words`` gives the text itself back, up to what the file's normaliser takes away.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .kernels import lean
from .tokens import _CHARS, _L, _N, _S

#: Distinct words whose ids a worker keeps, and the longest one it keeps; neighbours whose check it keeps.
CACHE_WORDS, CACHE_LENGTH, CACHE_PAIRS = 400_000, 48, 1 << 18
#: Characters that are cut into words at once (up to the next white space), tokens that are decoded at once, and bytes of texts in a batch of results.
SEGMENT, DECODED, BATCH = 1 << 20, 1 << 15, 1 << 22
#: The mark behind a word, which stands for no byte.
END = "\x00"
#: The cut of the file at hand (fixed value), and the same with its classes written out for characters below U+0250.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = re.compile(f"[{_L}]+|[{_N}]|'(?:[stmd]|re|ve|ll)|[^{_S}{_L}{_N}]+")
_SPLIT_ASCII = re.compile(r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\t-\r a-z0-9]+")
#: Characters that the cut here doesn't know, since they or their small letters lie beyond U+024F.
_WIDE = re.compile(f"[^\x00-\u024f]|[{''.join(chr(i) for i in range(0x250) if max(chr(i).lower()) > chr(0x24F))}]")
_BLANK = re.compile(f"[{_S}]")


class Vocabulary:
    """Tokens of a tokenizer file, their merges, and what backtracking needs of them."""

    def __init__(self, file: dict):
        model = file["model"]
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "dropout", "fuse_unk", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
        size = 1 + max([*ids.values(), *self.added.values()])
        self.text = [""] * size
        for text, i in [*ids.items(), *self.added.items()]:
            self.text[i] = text
        self.end = END if suffix else ""
        #: each token's characters, the merge that makes it and its two halves
        self.chars: dict[int, str] = {}
        self.rank, self.halves = [-1] * size, [(-1, -1)] * size
        for c in _CHARS:
            for text, chars in ((c, c), (c + suffix, c + self.end)):
                if text not in ids:
                    raise ValueError(f"the vocabulary has no symbol {text}")
                self.chars[ids[text]] = chars
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, both = ids[a], ids[b], ids[a + b]
            self.merged.setdefault((left, right), rank)
            if both in self.chars or left not in self.chars or right not in self.chars or not self.compatible(left, right, rank):
                continue  # nothing leads to it this way
            self.chars[both], self.rank[both], self.halves[both] = self.chars[left] + self.chars[right], rank, (left, right)
        self.size = [0] * size
        by_chars = {chars: i for i, chars in self.chars.items()}
        self.automaton = ahocorasick.Automaton()
        #: the longest other token that begins a token
        self.shorter = [-1] * size
        for chars, i in by_chars.items():
            self.size[i] = len(chars)
            self.automaton.add_word(chars, i)
            self.shorter[i] = next((by_chars[chars[:k]] for k in range(len(chars) - 1, 0, -1) if chars[:k] in by_chars), -1)
        self.automaton.make_automaton()
        self.goes = functools.lru_cache(CACHE_PAIRS)(self.compatible)

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether BPE leaves the two tokens as they are side by side. limit: only merges of a lower rank are looked at.

        Back through the merges that made the two, the later one first: the halves at the border must not have had a merge with
        each other that came before. Of equal merges the one on the left comes first."""
        limit = len(self.text) << 1 if limit is None else limit
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < limit:
                return False
            if self.rank[left] > self.rank[right]:
                limit = min(limit, self.rank[left])
                left = self.halves[left][1]
            elif self.rank[right] >= 0:
                limit = min(limit, self.rank[right] + 1)
                right = self.halves[right][0]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Ids of one word in the vocabulary's characters."""
        if not word:
            return []
        chars = word + self.end
        n, size, shorter, goes = len(chars), self.size, self.shorter, self.goes
        longest = [-1] * (n + 1)
        for last, i in self.automaton.iter(chars):  # of one start, the longer ones come later
            longest[last + 1 - size[i]] = i
        dead = bytearray(n + 1)
        if self.end:
            dead[n - 1] = 1
        out, at, before, i = [], 0, -1, longest[0]
        while at < n:
            while i >= 0 and (dead[at + size[i]] or (before >= 0 and not goes(before, i))):
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at += size[i]
                before, i = i, longest[at]
            else:
                dead[at] = 1
                at -= size[before]
                i = shorter[out.pop()]
                before = out[-1] if out else -1
        return out


def _packed(ids: list[int]) -> bytes:
    # small arrays are made faster by the standard library than by numpy, which serves machines of the other byte order
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class Codec:
    """Whole texts to ids and back, by one tokenizer file."""

    _open: dict[str, Codec] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        file = json.loads(self.library.to_str())
        self.vocabulary = Vocabulary(file)
        cuts = [p for p in (file.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        norms = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
        #: whether texts are cut here as the file has it
        self.cuts = norms == ["NFC", "Replace", "Lowercase"] and [c["pattern"].get("Regex") for c in cuts] == [CUT]
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.contents = added
        pieces = [b" " + t.encode() for t in self.vocabulary.text]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.known: dict[str, bytes] = {}

    @classmethod
    def get(cls, path: str) -> Codec:
        """One for each worker process and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _word(self, word: str) -> bytes:
        known = word if word.isascii() and word.isprintable() else "".join(map(_CHARS.__getitem__, word.encode()))
        return _packed(self.vocabulary.encode(known))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not self.cuts or _WIDE.search(text):
            normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            return b"".join(_packed(self.vocabulary.encode(w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))
        words = (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text.lower())
        known = self.known
        try:  # most texts have no new word
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            new = {w: self._word(w) for w in set(words).difference(known)}
            out = b"".join(known[w] if w in known else new[w] for w in words)
            if len(known) < CACHE_WORDS:  # those that were met first stay
                known.update((w, x) for w, x in new.items() if len(w) <= CACHE_LENGTH)
            return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._segment, segments(text)))

    def _segment(self, text: str) -> bytes:
        if not any(c in text for c in self.contents):
            return self._plain(text)
        parts = self.added.split(text)
        return b"".join(self._plain(p) if k % 2 == 0 else _packed([self.vocabulary.added[p]]) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts with a space between them, in UTF-8."""
        every, out = np.frombuffer(ids, "<u4"), []
        for a in range(0, len(every), DECODED):
            some = every[a : a + DECODED]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(self.offsets[some] - ends + lengths, lengths)
            out.append(self.blob[at].tobytes())
        return b"".join(out)[1:]

    def words(self, ids: bytes) -> str:
        """The words behind the ids with a space between them: lossless but for what the file's normaliser and cut leave out."""
        raw, chars, out = {c: b for b, c in enumerate(_CHARS)}, self.vocabulary.chars, bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            if i in chars:
                out += bytes(0x20 if c == END else raw[c] for c in chars[i])
            else:
                out += self.vocabulary.text[i].encode() + b" "
        return out.decode(errors="replace").removesuffix(" ")


def segments(text: str) -> Iterator[str]:
    """The text in pieces of about SEGMENT characters, cut before white space, where no word goes on."""
    a = 0
    while len(text) - a > SEGMENT:
        cut = _BLANK.search(text, a + SEGMENT)
        if not cut:
            break
        yield text[a : cut.start()]
        a = cut.start()
    yield text[a:]


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", decode: bool = False) -> DataFrame:
    """docs(key, text) -> key, ids (binary: little-endian unsigned 32-bit integers); with decode also decoded, the text that the ids stand for.

    Nulls are empty texts. Each row is for itself, so rows of one key, or without one, give a row each; other columns are
    ignored. A very long text is cut into words piece by piece. An empty table gives no rows."""

    @lean
    def each(batches):
        codec = Codec.get(tokenizer)
        for batch in batches:
            begun, size, ids, texts = 0, 0, [], []
            for k, value in enumerate(batch.column(1)):
                ids.append(codec.encode(value.as_py() or ""))
                texts.append(codec.decode(ids[-1]) if decode else b"")
                size += len(ids[-1]) + len(texts[-1])
                if size >= BATCH or k + 1 == batch.num_rows:
                    columns = [batch.column(0).slice(begun, len(ids)), pa.array(ids, pa.binary())] + [pa.array(texts, pa.binary()).cast(pa.string())] * decode
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"][: len(columns)])
                    begun, size, ids, texts = k + 1, 0, [], []

    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(each, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids binary" + ", decoded string" * decode)


def decoded(rows: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """rows(key, ids as ``encoded`` has them) -> key, text. Null ids give a null text."""

    @lean
    def each(batches):
        codec = Codec.get(tokenizer)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=[key, "text"])

    some = rows.select(F.col(key), F.col(ids))
    return some.mapInArrow(each, f"`{key}` {some.schema[0].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    rows = encoded(read(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), decode=True)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
