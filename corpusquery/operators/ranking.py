"""Ranks, top-k lists, and blocks of stated queries."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.tables import own_dir


def checked_k(k: int | None, default: int) -> int:
    """None and 0 mean the default; a negative k is an error."""
    k = k or default
    if k < 0:
        raise ValueError(f"k must not be negative: {k}")
    return k


def top_k(rows: DataFrame, k: int, *order: Column, by: str = "query_id", name: str = "rank") -> DataFrame:
    """The first k rows of each query with their rank from 1. Rows beyond k are dropped below the shuffle too."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col(name) <= k)


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def ids_of(df: DataFrame, rows: list) -> pa.Array:
    """The rows' query_id, of the type that the table's column has."""
    return pa.array([r.query_id for r in rows], to_arrow_type(df.schema["query_id"].dataType))


def blocks(rows: Iterable, size: Callable, most: int, most_rows: int) -> Iterator[list]:
    """Runs of rows of a size of ``most`` together and of ``most_rows`` rows, at most (but one row at least)."""
    out, total = [], 0
    for row in rows:
        if out and (total + size(row) > most or len(out) == most_rows):
            yield out
            out, total = [], 0
        out.append(row)
        total += size(row)
    if out:
        yield out


def in_turn(runs: Iterator[list], search: Callable, empty: Callable, name: str) -> DataFrame:
    """The rows that search(block) -> (rows, release) finds for each block of queries.

    One block alone is left to Spark as a plan. Of several, each is finished and written before the next one is read, and what it needed is released, so that the driver and the tasks hold one block however many there are."""
    first = next(runs, None)
    if first is None:
        return empty()
    then = next(runs, None)
    if then is None:
        return search(first)[0]
    path, schema = None, None
    for block in itertools.chain((first, then), runs):
        rows, release = search(block)
        path, schema = path or f"{own_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}", rows.schema
        rows.write.mode("append").parquet(path)
        session = rows.sparkSession
        release()
    return session.read.schema(schema).parquet(path)


def best(ids: pa.Array, scores: np.ndarray, query_ids: pa.Array, k: int, digits: int | None = None, positive: bool = False) -> pa.RecordBatch:
    """query_id, chunk_id, score of each query's k best rows in scores (rows, queries): of equal scores those of the smallest ids, so k rows at most, however many tie. positive: only scores above 0."""
    if digits is not None:
        scores = np.floor(scores * 10.0**digits + 0.5) / 10.0**digits
    order = pc.sort_indices(ids).to_numpy()
    scores = scores[order]
    keep = scores > 0 if positive else np.ones(scores.shape, bool)
    if len(scores) > k:
        edge = -np.partition(-scores, k - 1, axis=0)[k - 1]
        above, level = scores > edge, scores == edge
        keep &= above | level & (np.cumsum(level, axis=0) <= k - above.sum(axis=0))
    rows, cols = np.nonzero(keep)
    return pa.RecordBatch.from_arrays([query_ids.take(pa.array(cols)), ids.take(pa.array(order[rows])), pa.array(scores[rows, cols])], names=["query_id", "chunk_id", "score"])


def runs(ends: np.ndarray, most: int):
    """Ranges [x, y) of entries that are ``most`` together, given where each ends, or one entry."""
    x = 0
    while x < len(ends):
        before = int(ends[x - 1]) if x else 0
        y = max(x + 1, int(np.searchsorted(ends, before + most, "right")))
        yield x, y
        x = y
