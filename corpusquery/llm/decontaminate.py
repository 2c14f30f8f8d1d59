"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared as word sequences (runs of [0-9a-z] and bytes beyond ASCII, A-Z as a-z).
Greedy string tiling takes the longest match between unmarked words of both sides again and again, marks it as a tile, and
stops below MIN_TILE words; tiles may stand in any order, so moved passages still count. The item's share of words under
tiles is its coverage. Matches are found by Karp-Rabin: rolling hashes of windows of the current search length, which
falls from the item's length to MIN_TILE, and each hit is compared word by word.

Documents meet items through shared windows of MIN_TILE words (seeds). Every tile consists of seeds, so the words of an
item under seeds bound its coverage: pairs below the threshold by that bound need no tiling. An item of fewer than
MIN_TILE words is one window of its own length, and matches as a whole or not.

The benchmark's size is checked: the index of up to BLOCK_BYTES of it is built once and broadcast; a larger one is cut into
blocks by a hash of the item's text, and documents are scanned once for each block (the stage: in one scan, from one block's
worker to the next).

Null and empty texts and items match nothing. Documents and items without an id are searched like the others, and come back
with a null id; the stage decides on rows, not on ids. Repeated documents give repeated rows; of repeated item ids each row is
an item. Ties between tiles: see ``tiles``. Other columns are ignored, and kept by the stage, whatever their names. An empty
table on either side gives no rows; the stage keeps every document where there is no item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .kernels import ALNUM, U64, doc_words, lean, mix, ngrams

MIN_TILE = 5
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15


def _rolled(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``length`` words: each step of the doubling joins two shorter windows."""
    if len(words) < length:
        return np.zeros(0, U64)
    out, have, power, factor = None, 0, words, _BASE
    span, rest = 1, length
    while rest:
        if rest & 1:
            out = power.copy() if out is None else out[: len(words) - have - span + 1] * U64(factor) + power[have : len(words) - span + 1]
            have += span
        rest >>= 1
        if rest:
            power = power[:-span] * U64(factor) + power[span:] if len(power) > span else power[:0]
            factor = factor * factor % (1 << 64)
            span *= 2
    return out[: len(words) - length + 1]


def _meeting(text: np.ndarray, item: np.ndarray, places: np.ndarray, spots: np.ndarray, behind: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of each place i and spot j whose windows' hashes are equal and whose words in front (behind, before) are not."""
    order = np.lexsort((before, item))
    item, spots, before = item[order], spots[order], before[order]
    low, high = np.searchsorted(item, text), np.searchsorted(item, text, "right")
    kept = np.flatnonzero(high > low)
    text, places, behind, low, high = text[kept], places[kept], behind[kept], low[kept], high[kept]
    # of the spots with one hash, those of one word in front lie together
    pairs = item ^ mix(before.view(U64))
    runs = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (before[1:] != before[:-1]))))
    ends = np.append(runs[1:], len(item))
    by = np.argsort(pairs[runs], kind="stable")
    at = np.minimum(np.searchsorted(pairs[runs][by], text ^ mix(behind.view(U64))), len(by) - 1)
    hit = by[at]
    same = (item[runs[hit]] == text) & (before[runs[hit]] == behind)
    skip_low, skip_high = np.where(same, runs[hit], high), np.where(same, ends[hit], high)
    i, j = [], []
    for a, b in ((low, skip_low), (skip_high, high)):
        n = b - a
        i.append(np.repeat(places, n))
        j.append(spots[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
    return np.concatenate(i), np.concatenate(j)


def tiles(text: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(place in the text, place in the item, words) of the greedy tiles, longest first; of equal length, the earliest in the item, then in the text.

    Only windows of unmarked words are looked for, and only pairs that can't be extended to the front; those that are left are
    extended together, a word at a time. It ends as soon as the item has no unmarked window left."""
    n, m = len(text), len(item)
    least = min(least, m)
    if not least:
        return []
    free_t, free_i = np.ones(n + 1, bool), np.ones(m + 1, bool)
    free_t[n] = free_i[m] = False
    found, search = [], m
    windows, spots = _rolled(text, search), _rolled(item, search)

    def open_(free: np.ndarray, length: int) -> np.ndarray:
        """Where windows of unmarked words begin."""
        marked = np.concatenate(([0], np.cumsum(~free[:-1])))
        return np.flatnonzero(marked[length:] == marked[: len(marked) - length]) if len(free) > length else np.zeros(0, np.int64)

    while len(open_(free_i, least)):
        at_t, at_i = open_(free_t, search), open_(free_i, search)
        at_t = at_t[np.isin(windows[at_t], spots[at_i])]
        i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(at_t):
            # words in front as numbers; what isn't free in front, or not there, is like no word of the other side
            numbers = np.unique(np.concatenate((text[at_t - 1], item[at_i - 1])), return_inverse=True)[1].astype(np.int64)
            behind = np.where((at_t > 0) & free_t[at_t - 1], numbers[: len(at_t)], -1)
            before = np.where((at_i > 0) & free_i[at_i - 1], numbers[len(at_t) :], -2)
            i, j = _meeting(windows[at_t], spots[at_i], at_t, at_i, behind, before)
        if len(i):
            size, alive = np.zeros(len(i), np.int64), np.arange(len(i))
            while len(alive):
                x, y = i[alive] + size[alive], j[alive] + size[alive]
                on = free_t[x] & free_i[y]
                on[on] = text[x[on]] == item[y[on]]
                alive = alive[on]
                size[alive] += 1
            i, j, size = (x[size >= search] for x in (i, j, size))
        if len(i):
            longest = int(size.max())
            i, j = i[size == longest], j[size == longest]
            order = np.lexsort((i, j))
            i, j = i[order], j[order]
            while len(i):
                x, y = int(i[0]), int(j[0])
                free_t[x : x + longest] = free_i[y : y + longest] = False
                found.append((x, y, longest))
                apart = (np.abs(i - x) >= longest) & (np.abs(j - y) >= longest)
                i, j = i[apart], j[apart]
        elif search == least:
            break
        else:
            search = max(least, search // 2)
            windows, spots = _rolled(text, search), _rolled(item, search)
    return found


class Index:
    """Seeds of a block of items, in flat arrays."""

    def __init__(self, items: list[tuple[int | None, str]], least: int):
        self.least, self.ids = least, [i for i, _ in items]
        parts = [(words, np.diff(first)) for _, words, first in doc_words(pa.array([t or "" for _, t in items], pa.large_string()), ALNUM)]
        self.words = np.concatenate([np.zeros(0, U64), *(w for w, _ in parts)])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        self.lengths = sorted(set(np.minimum(least, self.sizes).tolist()) - {0})
        hashes, first = ngrams(self.words, self.at, least)
        order = np.argsort(hashes, kind="stable")
        #: Of each seed, by its place in the sorted hashes: item, and place in the item.
        self.item = np.repeat(np.arange(len(items)), np.diff(first))[order]
        self.place = (np.arange(len(hashes)) - first[:-1][np.repeat(np.arange(len(items)), np.diff(first))])[order]
        self.hashes, self.first = np.unique(hashes[order], return_index=True)
        self.last = np.append(self.first[1:], len(hashes))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.hashes >> U64(44)] = True

    def seeds(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in self.hashes) of each seed."""
        rows, places = [], []
        for length in self.lengths:
            hashes, at = ngrams(words, first, length)
            maybe = np.flatnonzero(self.sieve[hashes >> U64(44)])
            where = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            real = self.hashes[where] == hashes[maybe]
            rows.append(np.searchsorted(at, maybe[real], "right") - 1)
            places.append(where[real])
        return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, np.int64),) * 2

    def pairs(self, words: np.ndarray, first: np.ndarray, threshold: float):
        """(row, item, coverage, tiles) of the pairs that reach the threshold."""
        rows, places = self.seeds(words, first)
        for row in np.unique(rows).tolist():
            text = words[first[row] : first[row + 1]]
            for item in self.near(np.unique(places[rows == row]), threshold):
                got = tiles(text, self.words[self.at[item] : self.at[item + 1]], self.least)
                covered = sum(k for *_, k in got)
                if covered >= threshold * self.sizes[item]:
                    yield row, item, covered / int(self.sizes[item]), len(got)

    def near(self, places: np.ndarray, threshold: float) -> list[int]:
        """Items of which enough words stand under the seeds at these places in self.hashes."""
        n = self.last[places] - self.first[places]
        each = np.arange(n.sum()) + np.repeat(self.first[places] - (np.cumsum(n) - n), n)
        order = np.lexsort((self.place[each], self.item[each]))
        item, place = self.item[each][order], self.place[each][order]
        # a seed covers its words up to the next seed of the item, or its whole length
        reach = np.minimum(self.least, self.sizes[item] - place)
        same = item[1:] == item[:-1]
        reach[:-1][same] = np.minimum(reach[:-1], np.diff(place))[same]
        under = np.bincount(item, reach, minlength=len(self.sizes)) if len(item) else np.zeros(len(self.sizes))
        return np.flatnonzero((under > 0) & (under >= threshold * self.sizes)).tolist()


def _indexes(spark: SparkSession, items: DataFrame, item_text: str, item_key: str, least: int):
    """A broadcast index for each block of the benchmark."""
    items = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    for k in range(blocks):
        some = [tuple(r) for r in (items.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else items).collect()]
        if some:
            yield spark.sparkContext.broadcast(Index(sorted(some, key=lambda r: (r[0] is None, r[0] or 0, r[1])), least))


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", least: int = MIN_TILE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, coverage (0 to 1) and n_tiles of each document and item whose coverage reaches the threshold."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema, out = "doc_id long, item_id long, coverage double, n_tiles int", None
    for shared in _indexes(docs.sparkSession, items, item_text, item_key, least):

        @lean
        def each(batches, shared=shared):
            for batch in batches:
                for a, words, first in doc_words(batch.column(1), ALNUM):
                    got = list(shared.value.pairs(words, first, threshold))
                    ids = batch.column(0).take(pa.array([a + row for row, *_ in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([shared.value.ids[i] for _, i, _, _ in got], pa.int64()), pa.array([c for *_, c, _ in got], pa.float64()), pa.array([n for *_, n in got], pa.int32())], names=["doc_id", "item_id", "coverage", "n_tiles"])

        hits = docs.mapInArrow(each, schema)
        out = hits if out is None else out.union(hits)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", least: int = MIN_TILE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs in which no item's coverage reaches the threshold, each decided where it stands."""
    for shared in _indexes(docs.sparkSession, items, item_text, item_key, least):

        @lean
        def each(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, words, first in doc_words(batch[text], ALNUM):
                    keep[[a + row for row, *_ in shared.value.pairs(words, first, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(each, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a covered benchmark item."""
    return clean(docs, read(spark, sf_dir, "benchmark"))
