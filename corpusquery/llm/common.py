"""Shared helpers: folds, sizes, and the batch plan that several operators use; tables between steps are the engine's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import drop, materialise, own_dir

__all__ = ["BATCH_BYTES", "MOST_KEYS", "crc_fold", "drop", "even_keys", "materialise", "n_batches", "n_partitions", "own_dir", "read", "with_batch"]
#: Bytes of text that one batch of documents holds on average.
BATCH_BYTES = 6 << 20
#: Keys that are chosen so that they are dealt evenly; more than so many are even enough by chance.
MOST_KEYS = 1 << 15


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def n_batches(docs: DataFrame, text: str = "text", batch_bytes: int = BATCH_BYTES) -> int:
    """How many batches of about ``batch_bytes`` the texts make, two for each shuffle partition at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(2 * n_partitions(docs.sparkSession), -(-total // batch_bytes))


def _murmur(x: np.ndarray) -> np.ndarray:
    """Spark's hash of integers, by which it deals rows out (Murmur3, 32 bits, seed 42)."""
    turn = lambda v, k: (v << np.uint32(k)) | (v >> np.uint32(32 - k))
    h = np.uint32(42) ^ turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.int32)


def even_keys(n: int, partitions: int) -> np.ndarray:
    """n distinct integers that a shuffle by hash deals evenly to its partitions, as far as n goes round; many for each come out even by themselves."""
    if n > MOST_KEYS:
        return np.arange(n, dtype=np.int32)
    size = 16 * (n + partitions)
    while True:
        x = np.arange(size, dtype=np.int32)
        to = _murmur(x) % partitions
        order = np.argsort(to, kind="stable")
        first = np.searchsorted(to[order], np.arange(partitions))
        turn = np.arange(size) - first[to[order]]
        if np.bincount(to, minlength=partitions).min() >= -(-n // partitions):
            return x[order[np.argsort(turn, kind="stable")[:n]]]
        size *= 2


def with_batch(docs: DataFrame, n: int, key: str = "doc_id", spare: str | None = None) -> DataFrame:
    """docs with a column batch by the hash of the key, of ``spare`` where the key is null."""
    by = F.pmod(F.coalesce(F.xxhash64(key) if not spare else F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.xxhash64(spare or key)), F.lit(n)).cast("int")
    keys = even_keys(n, n_partitions(docs.sparkSession))
    if n <= MOST_KEYS:  # the list is folded into one literal when the plan is made
        by = F.element_at(F.split(F.lit(",".join(map(str, keys.tolist()))), ",").cast("array<int>"), by + 1)
    return docs.withColumn("batch", by)
