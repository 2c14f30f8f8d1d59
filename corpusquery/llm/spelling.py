"""Spelling variants: words that differ by one edit, and the form that a variant belongs to.

Words are counted by task first, then by word. Pairs that differ by exactly one inserted, deleted or replaced code point are
found by a positional q-gram index. For lengths c and c + 1, one edit leaves the first half of the shorter word's length in
place, or the rest of it at the end; so words are dealt to shards by a hash of each of the two halves, and near words meet in
one of them. A shard holds an inverted index of its words, from length, position and q-gram (with marks at the ends) to a list of
words. A word asks for those of its own length (the same positions) and of one more (the same position or the next). An edit
spoils q of the grams of the longer word at most, so a near word has T or more of the others; whatever has T of N grams is in one
of the N - T + 1 shortest lists, which are merged by a heap; the remaining lists are searched for the candidates that come out of
it. Candidates with T grams or more are verified. A pair that agrees in both halves counts in the shard of the first.

Halves that very many words have (more than MOST_WORDS) are shards of their own, in blocks: a word stands in the index of one
block and asks all of them. No list is cut. Forms are followed by doubling, each round from a table; a form has twice the
occurrences of its variant at least, so there are few rounds.

A null text has no words, a null id counts as an empty one; very long texts are read piece by piece. Rows of one id are counted
each. Of equal counts the smaller word in code-point order is the form. Other columns are ignored, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import even_keys, materialise, n_partitions, read
from .kernels import lean

#: Code points of a word, and its occurrences, at least; how many times as often as its variant a form must stand.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: Of the words with their document, one in so many loses a code point (the variants that the contract asks for).
SLIPS = 97
Q = 4
#: Distinct words that a task counts before it hands them on; characters of a text that are cut at once.
COUNTED, SEGMENT = 400_000, 1 << 22
#: Entries of a shard on average, and words with one half from which on it is in blocks.
SHARD_WORDS, MOST_WORDS = 4000, 8000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = re.compile("[a-zÀ-ÿ]+")


def _runs(text: str) -> Iterator[list[str]]:
    """The text's runs of letters, with A-Z made small, piece by piece."""
    text = text.encode().translate(_LOWER).decode()
    if len(text) <= SEGMENT:
        yield _RUN.findall(text)
        return
    out = []
    for m in _RUN.finditer(text):
        out.append(m.group())
        if len(out) >= SEGMENT >> 3:
            yield out
            out = []
    yield out


def slipped(key, run: str, slips: int = SLIPS) -> str:
    """The run as the contract has it in a document: whole, or without one code point."""
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    if h % slips:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_COUNT, length: int = LEAST_LENGTH, slips: int | None = SLIPS) -> DataFrame:
    """docs(key, text) -> word, n: words of ``length`` code points or more with ``least`` occurrences or more. slips=None: words as they stand."""

    @lean
    def each(batches):
        total: dict[str, int] = defaultdict(int)

        def handed():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        crc = zlib.crc32
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                begun = crc(f"{'' if k is None else k}:".encode())
                for runs in _runs(value.as_py() or ""):
                    for run, n in Counter(runs).items():
                        if slips and (h := crc(run.encode(), begun)) % slips == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        if len(run) >= length:
                            total[run] += n
                    if len(total) >= COUNTED:
                        yield handed()
        yield handed()

    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one code point replaced, or inserted."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(b) != len(a) + 1:
        return False
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[at:] == b[at + 1 :]


class Index:
    """Positional q-grams of words of one class and side: for each length and position, from gram to places in the list of words, in order."""

    def __init__(self, q: int = Q):
        self.q, self.words, self.places = q, [], {}
        self.lists: dict[int, list[dict[str, list[int]]]] = {}

    def grams(self, word: str) -> list[str]:
        padded = "\x00" * (self.q - 1) + word + "\x01" * (self.q - 1)
        return [padded[i : i + self.q] for i in range(len(word) + self.q - 1)]

    def add(self, word: str) -> None:
        place = self.places[word] = len(self.words)
        self.words.append(word)
        grams = self.grams(word)
        for lists, gram in zip(self.lists.setdefault(len(word), [{} for _ in grams]), grams, strict=True):
            if gram in lists:
                lists[gram].append(place)
            else:
                lists[gram] = [place]

    def candidates(self, word: str, grams: list[str], more: int) -> Iterator[int]:
        """Places of other words of ``more`` (0 or 1) code points more that have as many grams of the word, at the same position or up to ``more`` behind, as one edit leaves."""
        by, n = self.lists.get(len(word) + more), len(grams)
        if by is None:
            return
        needed = n + more - self.q
        if more:
            found = [[x for x in (here.get(gram), behind.get(gram)) if x] for here, behind, gram in zip(by, by[1:], grams)]
        else:
            found = [[x] if (x := here.get(gram)) else [] for here, gram in zip(by, grams)]
        found.sort(key=lambda lists: sum(map(len, lists)))
        short, long = found[: n - needed + 1], found[n - needed + 1 :]
        own = self.places.get(word, -1)
        if all(len(x) == 1 and x[0] == own for lists in short for x in lists):
            return  # the word itself, or nothing
        merged = [zip(x, [k] * len(x)) for k, lists in enumerate(short) for x in lists]
        place = have = last = -1
        for p, k in heapq.merge(*merged, [(len(self.words), -1)]):
            if p == place:
                have += k != last
                last = k
                continue
            if place >= 0 and place != own and self._enough(place, have - 1, long):
                yield place
            place, have, last = p, 1, k

    @staticmethod
    def _enough(place: int, misses: int, long: list) -> bool:
        """Whether the place stands in all of the long lists but so many: there are needed - 1 of them, and one in the short lists is counted."""
        for lists in long:
            for x in lists:
                i = bisect_left(x, place)
                if i < len(x) and x[i] == place:
                    break
            else:
                misses -= 1
                if misses < 0:
                    return False
        return True


def _halves(word: str, shorter: int) -> tuple[str, str]:
    """The first half, and the rest at the end, of what the shorter of two lengths leaves."""
    half = shorter // 2
    return word[:half], word[len(word) - (shorter - half) :]


def _pairs(words: DataFrame, q: int) -> DataFrame:
    """words(word, n) -> word, near, near_n: each two words that differ by one edit, both ways round."""
    size = F.length("word")
    # as the shorter one with words of its length and one more, and as the longer one with words of one less
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("c"), size.alias("size"))
    half = F.floor(F.col("c") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("half")), F.struct(F.lit(1).alias("side"), F.substring("word", F.col("size") - (F.col("c") - half) + 1, F.col("c") - half).alias("half")))
    rows = rows.select("word", "n", "c", (F.col("c") == F.col("size")).alias("asks"), F.explode(sides).alias("s"))
    rows = materialise(rows.select("word", "n", "c", "asks", "s.side", F.xxhash64("c", "s.side", "s.half").alias("key")), "halves")
    # halves of very many words: their number is bounded by that of the words over MOST_WORDS
    hot = rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > MOST_WORDS).select("key", F.ceil(F.col("m") / MOST_WORDS).cast("int").alias("blocks"))
    spark = words.sparkSession
    total = rows.count()
    n = max(2 * n_partitions(spark), -(-total // SHARD_WORDS))
    keys = F.split(F.lit(",".join(map(str, even_keys(n, n_partitions(spark)).tolist()))), ",").cast("array<int>") if n <= 1 << 15 else None
    shard = F.pmod(F.col("key"), F.lit(n)).cast("int")
    shard = (F.element_at(keys, shard + 1) if keys is not None else shard).cast("long")
    dealt = rows.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = dealt.select("word", "n", "c", "side", "asks", F.when(F.col("blocks").isNull(), shard).otherwise(F.col("key")).alias("shard"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), own.alias("own"))
    dealt = dealt.withColumn("held", F.col("block") == F.col("own")).filter("asks OR held").drop("own")

    @lean
    def each(table: pa.Table) -> pa.Table:
        indexes, asking, number = {}, [], {}
        columns = [table.column(c).to_pylist() for c in ("word", "n", "c", "side", "asks", "held")]
        for word, n, c, side, asks, held in zip(*columns, strict=True):
            number[word] = n
            if held:
                if (c, side) not in indexes:
                    indexes[c, side] = Index(q)
                indexes[c, side].add(word)
            if asks:
                asking.append((word, c, side))
        out = []
        for word, c, side in asking:
            index = indexes.get((c, side))
            if index is None:
                continue
            grams = index.grams(word)
            for more in (0, 1):
                for place in index.candidates(word, grams, more):
                    other = index.words[place]
                    if not more and other <= word:
                        continue  # of one length, each pair once; held and asked for by both
                    if one_edit(word, other):
                        same = [x == y for x, y in zip(_halves(word, c), _halves(other, c), strict=True)]
                        if same[side] and not (side and same[0]):
                            out += [(word, other, number[other]), (other, word, number[word])]
        names = ["word", "near", "near_n"]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=names)

    return dealt.groupBy("shard", "block").applyInArrow(each, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root, by doubling: each round follows as far as all rounds before."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = materialise(now, "roots")
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        if now.join(up, "root", "left_semi").isEmpty():
            return now
        now = now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"))


def variants(words: DataFrame, times: int = TIMES, q: int = Q) -> DataFrame:
    """words(word, n), each word once -> word, form (the near word of largest n, if that is ``times`` the word's or more), root (where forms lead), n, n_near, form_n."""
    words = materialise(words.select("word", "n"), "words")
    near = _pairs(words, q).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best"))
    rows = words.join(near, "word", "left")
    enough = -F.col("best.least") >= times * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.least")).alias("form_n"))
    rows = materialise(rows, "forms")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counts(read(spark, sf_dir, "documents")))
