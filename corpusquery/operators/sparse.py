"""BM25L over chunks: an index of their tokens, and a batch of queries."""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import tables
from .ranking import best, blocks, checked_k, id_type, ids_of, in_turn, runs, top_k

K1, B, DELTA = 1.5, 0.75, 0.5
#: Terms of queries, and queries, that tasks score at once; cells of a matrix of scores, and shares of scores that are added up at once.
BLOCK_TERMS, BLOCK_QUERIES, CELLS, EXPANDED = 1 << 16, 1 << 12, 1 << 21, 1 << 22
_SCHEMA = "chunk_id {}, dl long, terms array<string>"


@dataclass
class SparseIndex:
    """documents(chunk_id, dl, terms): each chunk's number of tokens, and the tokens. All else is counted from them."""

    documents: DataFrame

    @property
    def stats(self) -> DataFrame:
        """One row: n, avgdl. Chunks without a token count as well."""
        return self.documents.agg(F.count("*").alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) / F.greatest(F.lit(1), F.count("*"))).alias("avgdl"))

    @property
    def terms(self) -> DataFrame:
        """term, df (chunks that have it) and cf (times that it stands in them), by one shuffle of partial sums."""
        ordered = self.documents.select(F.sort_array("terms").alias("t"))
        firsts = F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("t", i - 1) != x)).cast("long").alias("first")))
        return ordered.select(F.explode(firsts).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.first").alias("df"), F.count("*").alias("cf"))

    @property
    def postings(self) -> DataFrame:
        """term, chunk_id, tf, dl."""
        return self.documents.select("chunk_id", "dl", F.explode("terms").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf", "dl")

    def kept(self) -> SparseIndex:
        """The index with its tokens taken once, in a table of this application."""
        return SparseIndex(tables.materialise(self.documents, "tokens"))

    def write(self, path: str, part: str | None = None) -> SparseIndex:
        """Replaces the index under the path, or adds to it (or replaces) one named part. A reader sees what is complete:
        a part counts once it is written whole, and what it replaces goes afterwards, so the path may be the one read from."""
        spark = self.documents.sparkSession
        before = tables.parts(spark, path) if part is None else [part]
        name = part or f"whole-{uuid.uuid4().hex}"
        self.documents.write.mode("overwrite").parquet(f"{path}/{name}")
        tables.mark(spark, path, name)
        if part is None:
            tables.unmark(spark, path, before)
        return SparseIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> SparseIndex:
        names = tables.parts(spark, path)
        if not names:
            return SparseIndex(spark.createDataFrame([], _SCHEMA.format("string")))
        return SparseIndex(spark.read.parquet(*(f"{path}/{n}" for n in names)))

    @staticmethod
    def clear(spark: SparkSession, path: str) -> None:
        tables.unmark(spark, path, tables.parts(spark, path))


def index(chunks: DataFrame, text: str = "text") -> SparseIndex:
    """chunks(chunk_id, text) -> its index."""
    cut = chunks.select("chunk_id", tokens(F.col(text)).alias("terms"))
    return SparseIndex(cut.select("chunk_id", F.size("terms").cast("long").alias("dl"), "terms"))


def idf(n, df):
    return F.log(n + 1) - F.log(df + 0.5)


def _hits(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """chunk_id, dl, hits: the places in the vocabulary of a chunk's tokens that are there, one for each occurrence."""
    shared = documents.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def each(batches):
        for batch in batches:
            terms = batch.column(2)
            codes = pc.index_in(terms.flatten(), value_set=shared.value)
            known = np.concatenate(([0], np.cumsum(codes.is_valid().to_numpy(zero_copy_only=False))))
            bounds = np.concatenate(([0], np.cumsum(terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            hits = pa.ListArray.from_arrays(pa.array(known[bounds], pa.int32()), codes.drop_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), hits], names=["chunk_id", "dl", "hits"])

    return documents.select("chunk_id", "dl", "terms").mapInArrow(each, f"chunk_id {id_type(documents, 'chunk_id')}, dl long, hits array<int>")


def _flat(hits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the vocabulary, occurrences) of a batch's hits."""
    lengths = hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows, codes = np.repeat(np.arange(len(lengths)), lengths), hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, counts = np.unique(rows << 32 | codes, return_counts=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, counts


def _counted(hits: DataFrame, size: int) -> tuple[int, float, np.ndarray]:
    """(chunks, their mean length, chunks that have each of the terms)."""

    def each(batches):
        n, length, df = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            n, length = n + batch.num_rows, length + (pc.sum(batch.column(0)).as_py() or 0)
            df += np.bincount(_flat(batch.column(1))[1], minlength=size)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *found], pa.int64()), pa.array([n, length, *df[found]], pa.int64())], names=["k", "n"])

    got = {r.k: r.n for r in hits.select("dl", "hits").mapInArrow(each, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(size)
    for k, n in got.items():
        if k >= 0:
            df[k] = n
    n = got.get(-2, 0)
    return n, got.get(-1, 0) / max(1, n), df


def add_up(scores: np.ndarray, rows: np.ndarray, codes: np.ndarray, gain: np.ndarray, first: np.ndarray, by: np.ndarray, often: np.ndarray) -> None:
    """Adds to scores (rows, queries) the gain of each (row, term) for the queries that ask for the term: those in by and often from first[term] on."""
    many = first[codes + 1] - first[codes]
    ends = np.cumsum(many)
    for x, y in runs(ends, EXPANDED):
        times = many[x:y]
        at = np.repeat(first[codes[x:y]] - (ends[x:y] - times), times) + np.arange(ends[x] - many[x], ends[y - 1])
        cells = np.repeat(rows[x:y], times) * scores.shape[1] + by[at]
        scores += np.bincount(cells, np.repeat(gain[x:y], times) * often[at], minlength=scores.size).reshape(scores.shape)


def search(ix: SparseIndex, queries: DataFrame, k: int | None = None, delta_on_missing: bool = False, digits: int | None = None, k1: float = K1, b: float = B, delta: float = DELTA) -> DataFrame:
    """query_id, chunk_id, score, rank of the k best chunks (5 by default) with a positive score; of equal scores the smaller chunk id goes first.

    queries(query_id, text) are a stated set, in blocks of a checked size, each finished before the next. The corpus is gone
    through once for each block, for the tokens that the block asks for; these are counted, then scored where they lie, and each
    batch of chunks hands on the k best of each query. Nothing is shuffled by term. A term counts as often as a query has it.
    ``inverted`` searches an index of postings instead, and reads what the queries ask for.

    delta_on_missing: every known query term gives all chunks the share that a chunk without it has."""
    k = checked_k(k, 5)
    spark, kind, query_kind = ix.documents.sparkSession, id_type(ix.documents, "chunk_id"), id_type(queries, "query_id")
    asked = queries.select("query_id", tokens(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
    schema = f"query_id {query_kind}, chunk_id {kind}, score double"
    ranked = lambda rows: top_k(rows, k, F.desc("score"), F.col("chunk_id"))

    def scored(block):
        vocabulary = sorted({t for r in block for t in r.terms})
        hits = tables.materialise(_hits(ix.documents, vocabulary), "hits")
        n, avgdl, df = _counted(hits, len(vocabulary))
        place = {t: j for j, t in enumerate(vocabulary)}
        # of each term, the queries that ask for it and how often, one after the other: as many entries as the block has terms
        times = sorted((place[t], q, m) for q, r in enumerate(block) for t, m in Counter(r.terms).items() if df[place[t]])
        of, by, often = (np.array([x[c] for x in times], t) for c, t in enumerate((np.int64, np.int64, float)))
        first = np.searchsorted(of, np.arange(len(vocabulary) + 1))
        weight = np.log(n + 1) - np.log(df + 0.5)
        missing = weight * (k1 + 1) * delta / (k1 + delta) * delta_on_missing
        base = np.bincount(by, missing[of] * often, minlength=len(block))
        shared = spark.sparkContext.broadcast((ids_of(asked, block), first, by, often, weight, missing, base))

        def each(batches):
            ids, first, by, often, weight, missing, base = shared.value
            step = max(1, CELLS // len(ids))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    rows, codes, tf = _flat(part.column(2))
                    dl = part.column(1).to_numpy(zero_copy_only=False)[rows]
                    ctd = tf / (1 - b + b * dl / max(1.0, avgdl))
                    gain = weight[codes] * (k1 + 1) * (ctd + delta) / (k1 + ctd + delta) - missing[codes]
                    scores = np.tile(base, (part.num_rows, 1))
                    add_up(scores, rows, codes, gain, first, by, often)
                    yield best(part.column(0), scores, ids, k, digits, positive=True)

        def release():
            shared.destroy()
            tables.drop(hits)

        return ranked(hits.mapInArrow(each, schema)), release

    in_blocks = blocks(asked.toLocalIterator(), lambda r: len(set(r.terms)), BLOCK_TERMS, BLOCK_QUERIES)
    return in_turn(in_blocks, scored, lambda: ranked(spark.createDataFrame([], schema)), "sparse")
