"""Exact nearest neighbours: cosine over one vector a chunk, late interaction over a vector a token.

Queries are a stated set: they are read a block at a time, of a checked number of values, and broadcast; a task keeps the k
best of each query from every batch of rows that it reads, k whatever ties. So the rows that are shuffled grow with tasks, not
with pairs. Of several blocks, each is finished before the next one is read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import best, blocks, checked_k, id_type, ids_of, in_turn, runs, top_k

#: Values of query vectors, and queries, that are sent to a task at once; cells of a matrix of scores, of chunks or of tokens.
BLOCK_VALUES, BLOCK_QUERIES, CELLS = 1 << 22, 1 << 12, 1 << 22
EPS = 1e-10
TOKEN_EPS = 1e-12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """A zero vector on the right counts as of length EPS, so it scores 0."""
    return dot(a, b) / (norm(a) * F.when(norm(b) == 0, EPS).otherwise(norm(b)))


def indexed(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vectors with their norms, as the sink stores them."""
    return vectors.withColumn("norm", norm(F.col(embedding)))


def check_dimensions(vectors: DataFrame, embedding: str = "embedding") -> int | None:
    """The one dimension of all vectors; more than one is an error."""
    low, high = vectors.agg(F.min(F.size(embedding)), F.max(F.size(embedding))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} dimensions in one column")
    return low


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, width or 0)


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int | None = None, digits: int | None = None) -> DataFrame:
    """vectors(chunk_id, embedding), queries(query_id, embedding) -> query_id, chunk_id, score, rank: k nearest (5 by default), negatives too.

    A query of length 0 has no results, a chunk of length 0 scores 0. Of equal scores the smaller chunk id goes first."""
    k = checked_k(k, 5)
    asked = queries.select("query_id", "embedding").filter(norm(F.col("embedding")) > 0)

    def prepared(block):
        unit = np.array([r.embedding for r in block], np.float64)
        return unit / np.linalg.norm(unit, axis=1, keepdims=True)

    def score(column, unit):
        x = _matrix(column, unit.shape[1])
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return (x / np.where(size == 0, EPS, size)) @ unit.T

    return _searched(vectors.select("chunk_id", "embedding"), asked, prepared, score, lambda r: len(r.embedding), k, digits)


def maxsim_search(token_vectors: DataFrame, query_tokens: DataFrame, k: int | None = None, digits: int | None = None) -> DataFrame:
    """token_vectors(chunk_id, embeddings: array of vectors), query_tokens(query_id, embeddings) -> query_id, chunk_id, score, rank.

    The score sums, over the query's tokens, the largest cosine with any of the chunk's tokens. Chunks and queries without tokens give no row."""
    k = checked_k(k, 5)
    asked = query_tokens.select("query_id", "embeddings").filter(F.size("embeddings") > 0)

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), TOKEN_EPS)

    def prepared(block):
        return np.cumsum([0, *(len(r.embeddings) for r in block)])[:-1], unit(np.concatenate([np.array(r.embeddings, np.float64) for r in block]))

    def score(column, block):
        first, tokens = block
        if not len(column):
            return np.zeros((0, len(first)))
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        flat, most, out = column.flatten(), max(1, CELLS // len(tokens)), np.empty((len(column), len(first)))
        for x, y in runs(ends, most):
            begin = int(ends[x - 1]) if x else 0
            # a chunk of more tokens than go at once stands alone
            near = None
            for a in range(begin, int(ends[y - 1]), most):
                sims = unit(_matrix(flat.slice(a, min(most, int(ends[y - 1]) - a)))) @ tokens.T
                near = sims if near is None else np.maximum(near.max(axis=0, keepdims=True), sims.max(axis=0, keepdims=True))
            if near.shape[0] > 1:
                near = np.maximum.reduceat(near, np.concatenate(([0], ends[x : y - 1] - begin)), axis=0)
            out[x:y] = np.add.reduceat(near, first, axis=1)
        return out

    rows = token_vectors.select("chunk_id", "embeddings").filter(F.size("embeddings") > 0)
    return _searched(rows, asked, prepared, score, lambda r: sum(map(len, r.embeddings)), k, digits)


def _searched(vectors: DataFrame, asked: DataFrame, prepared: Callable, score: Callable, size: Callable, k: int, digits: int | None) -> DataFrame:
    """The k best of each query. prepared(block of queries) is broadcast; score(column of vectors, that) gives scores (rows, queries)."""
    schema, spark = f"query_id {id_type(asked, 'query_id')}, chunk_id {id_type(vectors, 'chunk_id')}, score double", vectors.sparkSession
    ranked = lambda rows: top_k(rows, k, F.desc("score"), F.col("chunk_id"))

    def search(block):
        shared = spark.sparkContext.broadcast((ids_of(asked, block), prepared(block)))

        def each(batches):
            ids, queries = shared.value
            step = max(1, CELLS // len(ids))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    yield best(part.column(0), score(part.column(1), queries), ids, k, digits)

        return ranked(vectors.mapInArrow(each, schema)), shared.destroy

    return in_turn(blocks(asked.toLocalIterator(), size, BLOCK_VALUES, BLOCK_QUERIES), search, lambda: ranked(spark.createDataFrame([], schema)), "nearest")


def token_arrays(rows: DataFrame) -> DataFrame:
    """rows(chunk_id, token_pos, embedding) -> chunk_id, embeddings in the order of the tokens."""
    return rows.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", "embedding"))), lambda x: x["embedding"]).alias("embeddings"))
