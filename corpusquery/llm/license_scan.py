"""Licence notices in texts: exact phrases, and short notices with a bounded number of edits.

A text is its words, runs of [0-9a-z] and bytes beyond ASCII after A-Z became a-z, joined by single spaces. For a notice
and at most e edits, the notice is cut into pieces; by the pigeonhole principle all but e of them stand unchanged in any
text that matches, no more than e bytes out of line with one another. Texts are searched for the pieces, and only where so
many are found together does the regex library look for the notice with at most e insertions, deletions and substitutions.

A notice has words that tell it from the others, such as the licence's name. Each of them must stand in the match, exactly
or, from three letters on, with one slip (a letter wrong, missing, extra, or two exchanged) that isn't another licence's
name: otherwise the edits allowed for the whole would turn one licence into another.

A match is a span of words with its edits. Matches of one label don't overlap: those with the fewest edits go first, of equal
ones the leftmost. So round each place the leftmost matches without edits are taken, then in the gaps between them those with
one edit, and so on. Of overlapping matches of different labels the nearer notice stays, by the share of its edits; of equally
near ones the longer, then the one that begins first, then the label that sorts first.

Edits count bytes of the UTF-8 text. Null and empty texts give no words, labels or spans. Very long texts are searched as a
whole, with work in proportion to their length: long stretches full of pieces are narrowed down by distances before the
regex library gets them. Repeated rows and rows without an id give their own results; other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .kernels import ALNUM, lean

#: Exact phrases and their labels (fixed by the contract).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices: label, words, edits allowed, and the words that tell it from others.
NOTICES = [
    ("mit", "released under the mit license", 3, ("mit",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6, ("permission", "granted")),
    ("apache", "licensed under the apache license version 2 0", 4, ("apache",)),
    ("apache", "released under the apache license", 3, ("apache",)),
    ("gpl", "licensed under the gnu general public license version", 5, ("general",)),
    ("gpl", "released under the gpl license", 3, ("gpl",)),
    ("lgpl", "gnu lesser general public license", 3, ("lesser",)),
    ("agpl", "gnu affero general public license", 3, ("affero",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7, ("redistribution", "binary")),
    ("bsd", "released under the bsd license", 3, ("bsd",)),
    ("mpl", "subject to the terms of the mozilla public license", 4, ("mozilla",)),
    ("mpl", "released under the mpl license", 3, ("mpl",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 6, ("permission", "modify")),
    ("isc", "released under the isc license", 3, ("isc",)),
    ("cc-by", "licensed under cc by 4 0", 2, ("cc", "by")),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2, ("cc", "by", "nc")),
    ("cc-by-sa", "licensed under cc by sa 4 0", 2, ("cc", "by", "sa")),
    ("cc-by-sa", "creative commons attribution sharealike", 3, ("sharealike",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5, ("unencumbered",)),
]
#: Names that are no slip of one another.
NAMES = frozenset("mit bsd isc gpl lgpl agpl mpl epl eupl apache zlib mozilla eclipse lesser affero artistic boost".split())
#: Bytes of a piece of a notice, and of a stretch that is narrowed down before the regex library gets it.
PIECE, LONG = 5, 1024
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if ALNUM[b] else 32 for b in range(256))


def pieces(notice: bytes, n: int) -> list[tuple[int, bytes]]:
    """n pieces of even length with their places."""
    cut = np.linspace(0, len(notice), n + 1).astype(int)
    return [(int(a), notice[a:b]) for a, b in zip(cut, cut[1:])]


def one_slip(x: bytes, y: bytes) -> bool:
    """Whether y is x but for one letter wrong, missing or extra, or two neighbours exchanged."""
    if len(x) == len(y):
        odd = [k for k in range(len(x)) if x[k] != y[k]]
        return len(odd) == 1 or len(odd) == 2 and odd[1] == odd[0] + 1 and x[odd[0]] == y[odd[1]] and x[odd[1]] == y[odd[0]]
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def stands_for(word: bytes, name: bytes) -> bool:
    return word == name or len(name) > 2 and word.decode(errors="replace") not in NAMES and one_slip(word, name)


class Notice:
    """A notice with its pieces, of PIECE bytes or so, and patterns. All but ``edits`` of the pieces stand unchanged in a match."""

    def __init__(self, label: str, words: str, edits: int, names: tuple[str, ...] = ()):
        self.label, self.text, self.edits, self.names = label, words.encode(), edits, [x.encode() for x in names]
        self.pieces = pieces(self.text, max(edits + 1, len(self.text) // PIECE))
        self.patterns = [regex.compile(f"(?:{regex.escape(words)}){{e<={k}}}".encode("latin-1")) for k in range(edits + 1)]

    def windows(self, text: bytes) -> list[list[int]]:
        """Stretches, merged where they meet, in which a match may lie."""
        begins, missing = [], 0
        for place, piece in self.pieces:
            own, at = [], text.find(piece)
            missing += at < 0
            if missing > self.edits:
                return []
            while at >= 0:
                own.append(at - place)
                at = text.find(piece, at + 1)
            begins.append(np.array(own, np.int64))
        starts = np.unique(np.concatenate(begins))
        near = sum((np.searchsorted(own, starts + self.edits, "right") > np.searchsorted(own, starts)).astype(int) for own in begins)
        starts = starts[near >= len(self.pieces) - self.edits]
        a, b = np.maximum(0, starts - self.edits), starts + len(self.text) + 2 * self.edits
        for name in self.names:
            if not len(a):
                break
            at = self.places(text, name)
            inside = np.searchsorted(at, a)
            keep = inside < len(at)
            keep[keep] = at[inside[keep]] < b[keep]
            a, b = a[keep], b[keep]
        merged = []
        for x, y in zip(a.tolist(), b.tolist()):
            if merged and x <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], y)
            else:
                merged.append([x, y])
        return merged

    @staticmethod
    def places(text: bytes, name: bytes) -> np.ndarray:
        """Where words begin that stand for a name."""
        out, padded = [], b" " + text + b" "
        for word in {w for w in set(text.split(b" ")) if stands_for(w, name)}:
            at = padded.find(b" " + word + b" ")
            while at >= 0:
                out.append(at)
                at = padded.find(b" " + word + b" ", at + 1)
        return np.array(sorted(out), np.int64)

    def named(self, text: bytes, a: int, b: int) -> bool:
        """Whether the words that the span touches hold the notice's names."""
        end = text.find(b" ", b)
        words = text[text.rfind(b" ", 0, a + 1) + 1 : end if end >= 0 else len(text)].split()
        return all(any(stands_for(w, name) for w in words) for name in self.names)

    def ends(self, text: bytes) -> np.ndarray:
        """Where a match with at most ``edits`` edits may end, by bit-parallel distances (Myers 1999): one pass, whatever the text holds."""
        m = len(self.text)
        full, high = (1 << m) - 1, 1 << (m - 1)
        masks = [sum(1 << k for k in range(m) if self.text[k] == c) for c in range(256)]
        plus, minus, score, out = full, 0, m, []
        for at, c in enumerate(text, 1):
            eq = masks[c]
            down = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up, less = minus | (full & ~(across | plus)), plus & across
            if up & high:
                score += 1
            elif less & high:
                score -= 1
            up, less = up << 1 & full, less << 1 & full
            plus, minus = less | (full & ~(down | up)), up & down
            if score <= self.edits:
                out.append(at)
        return np.array(out, np.int64)

    def narrowed(self, text: bytes, a: int, b: int) -> list[list[int]]:
        """A long stretch cut down to where matches lie."""
        if b - a < LONG:
            return [[a, b]]
        out: list[list[int]] = []
        for end in (a + self.ends(text[a:b])).tolist():
            begin = max(a, end - len(self.text) - self.edits)
            if out and begin <= out[-1][1]:
                out[-1][1] = end
            else:
                out.append([begin, end])
        return out

    def spans(self, text: bytes):
        for a, b in (x for y in self.windows(text) for x in self.narrowed(text, y[0], min(y[1], len(text)))):
            found, gaps = [], [(a, b)]
            for pattern in self.patterns:
                left = []
                for start, end in gaps:
                    at = start
                    for m in pattern.finditer(text[start:end]):
                        found.append((start + m.start(), start + m.end(), sum(m.fuzzy_counts)))
                        left.append((at, found[-1][0]))
                        at = found[-1][1]
                    left.append((at, end))
                gaps = [(x, y) for x, y in left if y - x >= len(self.text) - self.edits]
            for x, y, n in sorted(found):
                if self.named(text, x, y):
                    yield self.label, x, y, n, len(self.text)


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.notices = [Notice(*n) for n in notices]

    def spans(self, text: bytes) -> list[tuple[str, int, int, int, int]]:
        """text: words joined by single spaces. (label, first byte, end, edits, notice's length) of each notice found, in order."""
        found = [span for notice in self.notices for span in notice.spans(text)]
        if len({label for label, *_ in found}) > 1:
            taken: list[tuple[int, int, str]] = []  # by start
            longest, kept = max(b - a for _, a, b, *_ in found), []
            for span in sorted(found, key=lambda x: (x[3] / x[4], -x[4], x[1], x[0])):
                label, a, b, *_ = span
                near = taken[bisect.bisect_left(taken, (a - longest,)) : bisect.bisect_left(taken, (b,))]
                if not any(a < y and other != label for _, y, other in near):
                    bisect.insort(taken, (a, b, label))
                    kept.append(span)
            found = kept
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, raw: bytes) -> dict:
        words = raw.translate(_TABLE).split()
        joined = b" ".join(words)
        padded = b" " + joined + b" "
        base, hits = set(), []
        for phrase, label in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                base.add(label)
                hits.append(at)
                at = padded.find(phrase, at + 1)
        spans = self.spans(joined)
        if hits or spans:
            #: Where each word begins: places are told in words by one look-up each.
            begins = np.flatnonzero(np.frombuffer(padded, np.uint8)[:-1] == 32)
        starts = np.searchsorted(begins, hits).tolist() if hits else []
        labels = base | {label for label, *_ in spans}
        score = max((1.0 - edits / length for *_, edits, length in spans), default=0.0)
        word = lambda at: int(np.searchsorted(begins, at, "right")) - 1
        found = [{"label": label, "first_word": word(a), "last_word": word(max(a, b - 1)), "edits": edits} for label, a, b, edits, _ in spans]
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1.0 if starts else score, "spans": found,
        }


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first_word, last_word, edits)."""
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
    schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)])

    @lean
    def each(batches):
        scanner = Scanner(phrases, notices)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = part.column(1).cast(pa.large_binary())
                rows = pa.RecordBatch.from_pylist([scanner.scan(x.as_py() or b"") for x in texts], schema)
                yield pa.RecordBatch.from_arrays([part.column(0), *rows.columns], names=["doc_id", *schema.names])

    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(each, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, edits: int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).withColumn("n_fuzzy", F.size("spans").cast("long")).drop("spans")
