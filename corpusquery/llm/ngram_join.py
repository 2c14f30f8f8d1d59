"""Exact similarity join on sets of word n-grams, filtered by prefixes under several global orders of the n-grams.

A pair whose Jaccard similarity is at least t shares, under any order of all n-grams, one of the first
n - ceil(t n) + 1 n-grams of either set. Rare n-grams come first in every order here, but the orders differ: the first goes
by document frequency, the next by its logarithm rounded up, ties by a different hash in each. So an n-gram of one document
alone uses up prefix places without making candidates, a passage that many documents share stands at the end, and n-grams of
like frequency stand in another order each time. Candidates are met under the first order, at places that still leave
enough overlap; those that don't share a prefix n-gram under each of the others are dropped; the rest is verified.

Copies never meet as pairs:
 1. equal sets are one class (grouped by a 128-bit digest and their size);
 2. under each prefix n-gram, every class is first compared with one class only, the smallest id there (a star): of those
    that pass all orders, with the smallest; links that hold make components;
 3. then classes of different components that share a prefix n-gram are compared, all of them: within a component there
    is nothing left to find.
So a group of near copies takes a number of comparisons in proportion to its size, and no link between components is lost.

Hot keys are split: a class of many rows by a salt of their ids, a hub of many candidates by a salt of the other side, and a
prefix n-gram of many classes into blocks, each pair of which is a key of its own.

A document is its id: rows of one id are one document, whose set is the union over the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, drop, materialise, n_batches, read, with_batch
from .exchange import counted
from .graph import components
from .kernels import NON_SPACE, U64, doc_words, lean, mix, ngrams

ORDERS = 2
#: Words of a shingle and the least similarity in percent, for near duplicates.
WIDTH, PERCENT = 5, 80
#: Parts of a class of many rows; rows of one key in a join of pairs, and classes of one n-gram in a block.
SALTS, SPLIT = 64, 256
_SEEDS = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]
_CLASS = ["d1", "d2", "n_shingles"]


def _sets(column, width: int):
    """(first row, distinct n-gram hashes sorted within each row, first of each row with the total at the end)."""
    for a, words, first in doc_words(column, NON_SPACE):
        hashes, at = ngrams(words, first, width)
        yield a, *_distinct(np.repeat(np.arange(len(at) - 1), np.diff(at)), hashes, len(at) - 1)


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], np.concatenate(([0], np.cumsum(np.bincount(rows[keep], minlength=n)))).astype(np.int64)


def _xors(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row's values; 0 for a row without any."""
    sums = np.concatenate((np.zeros(1, U64), np.bitwise_xor.accumulate(values))) if len(values) else np.zeros(1, U64)
    return (sums[at[1:]] ^ sums[at[:-1]]).view(np.int64)


def row_digests(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, and two 64-bit exclusive sums over the set's hashes that stand for it, of each row."""

    @lean
    def each(batches):
        for batch in batches:
            for a, hashes, at in _sets(batch.column(1), width):
                d1, d2 = (pa.array(_xors(mix(hashes ^ s), at)) for s in _SEEDS[:2])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(at) - 1), pa.array(np.diff(at)), d1, d2], names=["doc_id", *_CLASS[2:], *_CLASS[:2]])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(each, "doc_id long, n_shingles long, d1 long, d2 long")


def set_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """As ``row_digests``, but rows of one id have the digest of the union of their sets."""
    rows = materialise(row_digests(docs, width=width), "digests")
    several = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*_CLASS)).alias("a"), F.max(F.struct(*_CLASS)).alias("b")).filter("a <> b").select("doc_id")
    if several.isEmpty():
        return rows
    several = materialise(several, "several")

    @lean
    def each(batches):
        for batch in batches:
            for a, hashes, at in _sets(batch.column(1), width):
                ids = batch.column(0).slice(a, len(at) - 1).take(pa.array(np.repeat(np.arange(len(at) - 1), np.diff(at))))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.view(np.int64)) for x in (hashes, *(mix(hashes ^ s) for s in _SEEDS[:2])))], names=["doc_id", "h", "m1", "m2"])

    grams = docs.join(several, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(each, "doc_id long, h long, m1 long, m2 long").distinct()
    union = grams.groupBy("doc_id").agg(F.count("*").alias("n_shingles"), F.bit_xor("m1").alias("d1"), F.bit_xor("m2").alias("d2"))
    return materialise(rows.join(several, "doc_id", "left_anti").union(rows.select("doc_id").join(union, "doc_id").select(rows.columns)), "digests")


def _needed(n: int, percent: int) -> int:
    """ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def _prefixes(docs: DataFrame, classes: DataFrame, width: int, percent: int, orders: int, batch_bytes: int) -> DataFrame:
    """For the classes that share a prefix n-gram with another: doc_id, n, the set, the prefix under the first order (structs of an n-gram's hash and its place), and under the others (arrays of hashes)."""
    n = n_batches(docs, batch_bytes=batch_bytes)
    side = with_batch(classes.select(F.col("class_id").alias("doc_id")), n)

    def items(table: pa.Table, side: pa.Table):
        """The classes' sets by their ids: sorted distinct n-grams, in how many sets each stands, and ids, places of the sets' n-grams and bounds."""
        ids = table["doc_id"].to_numpy()
        mine = np.flatnonzero(np.isin(ids, side["doc_id"].to_numpy()))
        table = table.take(mine)
        ids, of = np.unique(ids[mine], return_inverse=True)
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for a, h, at in _sets(table["text"], width):
            rows.append(np.repeat(of[a : a + len(at) - 1], np.diff(at)))
            hashes.append(h)
        hashes, at = _distinct(np.concatenate(rows), np.concatenate(hashes), len(ids))
        found, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        return found, [counts.astype(np.int64)], (ids, hashes, place, at)

    def answer(_: pa.Table, kept: tuple, totals: list[np.ndarray]) -> pa.Table:
        ids, hashes, place, at = kept
        df, out = totals[0][place], []
        for k in range(len(ids)):
            h, d = hashes[at[k] : at[k + 1]], df[at[k] : at[k + 1]]
            size, alone = len(h), int((d == 1).sum())
            most = size - _needed(size, percent) + 1
            if not size or alone >= most:
                continue
            row = {"doc_id": int(ids[k]), "n": size, "grams": h.tobytes(), "others": []}
            for o in range(orders):
                first = h[np.lexsort((mix(h ^ _SEEDS[o]), np.ceil(np.log2(d) / o) if o else d))[alone:most]].view(np.int64).tolist()
                if o:
                    row["others"].append(first)
                else:
                    row["prefix"] = [{"h": x, "i": i} for i, x in enumerate(first, alone)]
            out.append(row)
        return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("grams", pa.binary()), ("prefix", pa.list_(pa.struct([("h", pa.int64()), ("i", pa.int32())]))), ("others", pa.list_(pa.list_(pa.int64())))]))

    schema = "doc_id long, n long, grams binary, prefix array<struct<h: long, i: int>>, others array<array<long>>"
    return counted(with_batch(docs, n), side, items, answer, schema, n)


def _enough(a: str, b: str, percent: int) -> Column:
    """Whether n-grams at places i of both sets, the first that they share, can leave the overlap that a link needs."""
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.i"), F.col(f"{b}.n") - F.col(f"{b}.i"))
    return rest * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent


def _attached(pairs: DataFrame, on: str, rows: DataFrame) -> DataFrame:
    """pairs with the columns of the row of rows(id, ...) whose id stands in ``on``. Ids of more than SPLIT pairs are dealt by a salt of the other end, and their rows repeated for each salt."""
    other = "b" if on == "a" else "a"
    hot = pairs.groupBy(on).agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")).filter("parts > 1").select(F.col(on).alias("hot"), "parts")
    salted = pairs.join(hot, pairs[on] == hot["hot"], "left").select(pairs["*"], F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    rows = rows.join(hot, rows["id"] == hot["hot"], "left").select(rows["*"], F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("row_salt"))
    return salted.join(rows, (salted[on] == rows["id"]) & (salted["salt"] == rows["row_salt"])).drop("id", "salt", "row_salt")


def _meeting(pairs: DataFrame, cand: DataFrame, orders: int) -> DataFrame:
    """The pairs (a, b) that share a prefix n-gram under each further order."""
    if orders < 2:
        return pairs
    for on in ("b", "a"):
        pairs = _attached(pairs, on, cand.select(F.col("doc_id").alias("id"), F.col("others").alias(f"of_{on}")))
    for o in range(orders - 1):
        pairs = pairs.filter(F.arrays_overlap(F.get("of_a", o), F.get("of_b", o)))
    return pairs.select("a", "b")


def _verified(pairs: DataFrame, cand: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet 100 * intersection >= percent * union."""

    @lean
    def each(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    for on in ("b", "a"):
        pairs = _attached(pairs, on, cand.select(F.col("doc_id").alias("id"), F.col("grams").alias(f"set_{on}")))
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(each, "a long, b long")


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """rows(id, n, h, i) -> a, b: each class with the smallest one below each of its prefix n-grams."""
    hub = rows.groupBy("h").agg(F.min(F.struct("id", "n", "i")).alias("b"))
    near = rows.alias("x").join(hub.select("h", "b.*").alias("y"), "h").filter((F.col("x.id") > F.col("y.id")) & _enough("x", "y", percent))
    return near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _apart(rows: DataFrame, percent: int) -> DataFrame:
    """rows(id, n, h, i, c) -> a, b: the classes of different components c below one prefix n-gram. An n-gram of many classes is cut into blocks, and each pair of blocks is a key."""
    open_ = rows.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.ceil(F.count("*") / SPLIT).cast("int").alias("blocks")).filter("c0 < c1").select("h", "blocks")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.join(open_, "h").select("id", "n", "h", "i", "c", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = materialise(dealt.select("id", "n", "h", "i", "c", "mine", F.least("mine", "other").alias("u"), F.greatest("mine", "other").alias("v")), "open")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("h", "u", "v")]
    once = (F.col("x.u") == F.col("x.v")) | (F.col("x.mine") != F.col("y.mine"))
    met = dealt.alias("x").join(dealt.alias("y"), same).filter((F.col("x.c") < F.col("y.c")) & once & _enough("x", "y", percent))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def linked(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set), component_id (smallest id that links reach).

    Words are runs of bytes other than space and 0x09-0x0D with A-Z as a-z; a text of fewer words than ``width`` is one
    n-gram. A null or empty text has no n-gram and is linked with nothing. Repeated rows of one id come back as often as
    they stand there, with the union of their sets. A row without an id comes back with the size of its own set, and null as
    class and component. Sets of equal similarity aren't told apart: whatever reaches the threshold is a link. Other columns
    are ignored, whatever their names. An empty table gives no rows."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    digests = set_digests(docs, width)
    named = digests.filter("doc_id IS NOT NULL AND n_shingles > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = materialise(named.groupBy(*_CLASS, "salt").agg(F.min("doc_id").alias("part_id")), "parts")
    classes = parts.groupBy(*_CLASS).agg(F.min("part_id").alias("class_id"))
    cand = materialise(_prefixes(docs.filter("doc_id IS NOT NULL"), classes, width, percent, orders, batch_bytes), "prefixes")
    rows = cand.select(F.col("doc_id").alias("id"), "n", F.explode("prefix").alias("p")).select("id", "n", "p.h", "p.i")

    stars = materialise(_meeting(_stars(rows, percent), cand, orders).groupBy("a").agg(F.min("b").alias("b")), "stars")
    links = materialise(_verified(stars, cand, percent), "links")
    comp = materialise(components(links), "components")

    labelled = cand.select("doc_id").join(comp, cand.doc_id == comp.id, "left").select("doc_id", F.coalesce("component", "doc_id").alias("c"))
    pairs = materialise(_meeting(_apart(rows.join(labelled, rows.id == labelled.doc_id).select("id", "n", "h", "i", "c"), percent), cand, orders), "pairs")
    more = materialise(_verified(pairs, cand, percent), "links")
    comp = materialise(components(links.union(more)), "components")
    drop(cand, stars, pairs, links, more)

    ids = classes.join(comp, classes.class_id == comp.id, "left").select(*_CLASS, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    ids = parts.join(ids, _CLASS).select(*_CLASS, "salt", "class_id", "component_id")
    out = named.join(ids, [*_CLASS, "salt"]).select("doc_id", "n_shingles", "class_id", "component_id")
    return out.union(digests.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", "doc_id", "doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each linked group, the one of the smallest id.

    Where ids are missing or repeat, rows are numbered and the number is the key: one row of each group stays."""
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        first = linked(docs).filter("doc_id = component_id").select("doc_id")
        return docs.join(first, "doc_id", "left_semi").select(docs.columns)
    number = next(c for c in (f"row_{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    docs = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    first = linked(docs, key=number).filter("doc_id = component_id").select(F.col("doc_id").alias(number))
    return docs.join(first, number, "left_semi").drop(number)


#: Groups by brute force: every shared 3-word shingle joins its documents.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2
"""
