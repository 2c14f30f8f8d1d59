"""Corpus-wide counts of hashed items, asked for and answered batch by batch.

Documents are dealt into batches by their id. Each batch sends every distinct item once, with its count in the batch,
to the shard that owns the item's range of hashes; a shard adds up the counts and answers each batch in the order in which
it asked. An item of a third of all rows is thus one entry a batch: no key is hot, and nothing is broadcast or capped;
counts are 64 bits wide.

There are as many shards as a third of the batches, and as shuffle partitions at least, so a shard's size doesn't grow with
the corpus. Every batch asks every shard; beyond FAN shards that would be too many small rows, so batches then ask in two
steps: a group of batches adds up what it has of a range of hashes, the groups' sums go to the range's shards, and the
answers come back the same way. Rows stay in proportion to the batches times the root of their number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even_keys, n_partitions
from .kernels import U64, bundle, lean, pack, unbundle, unpack

#: Shards that a batch asks directly.
FAN = 512
_REQUEST = "batch int, crowd int, shard int, place int, items binary, counts binary"
_REPLY = "batch int, crowd int, shard int, totals binary"


def shard_slices(items: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of each shard's run in sorted hashes, shards + 1 of them."""
    step = (1 << 64) // shards + 1
    return np.concatenate(([0], np.searchsorted(items, np.array([step * k for k in range(1, shards)], dtype=U64)), [len(items)])).astype(np.int64)


def tally(items: np.ndarray, weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct items, and for each the sums of the weights (or the count)."""
    if weights is None:
        found, counts = np.unique(items, return_counts=True)
        return found, [counts.astype(np.int64)]
    order = np.argsort(items, kind="stable")
    ordered = items[order]
    head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return ordered[head], [np.add.reduceat(w[order], head).astype(np.int64) if len(head) else np.zeros(0, np.int64) for w in weights]


def _ints(values: list[int]) -> pa.Array:
    return pa.array(values, pa.int32())


def _cut(found: np.ndarray, counts: list[np.ndarray], shards: int, inside: tuple[int, int] = (0, 1)):
    """(shard, items, counts) of each shard that has any; ``inside`` (k, K): of the shards k * shards to (k + 1) * shards, where K * shards share all hashes."""
    k, whole = inside
    cuts = shard_slices(found, shards * whole)[k * shards : (k + 1) * shards + 1]
    cuts[0], cuts[-1] = 0, len(found)  # all that was sent to k belongs to its shards, whatever the rounding of the bounds
    for j in range(shards):
        a, b = cuts[j], cuts[j + 1]
        if b > a:
            yield k * shards + j, pack(found[a:b]), bundle([pack(c[a:b]) for c in counts])


def _summed(table: pa.Table, kinds: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of requests: sorted distinct items, their counts, and each request's places among the items."""
    keys = [unpack(x.as_py(), U64) for x in table["items"]]
    blobs = [unbundle(x.as_py()) for x in table["counts"]]
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    parts = np.split(place, np.cumsum([len(x) for x in keys])[:-1])
    totals = []
    for kind in range(kinds):
        total = np.zeros(len(found), np.int64)
        for part, blob in zip(parts, blobs, strict=True):  # a request's items are distinct
            total[part] += unpack(blob[kind], np.int64)
        totals.append(total)
    return found, totals, parts


def counted(docs: DataFrame, side: DataFrame | None, items: Callable, answer: Callable, schema: str, batches: int, kinds: int = 1) -> DataFrame:
    """docs has a column batch of ``batches`` values. items(table, side table) gives (sorted distinct hashes, [counts] * kinds, what answer needs);
    answer(table, that, [corpus-wide counts of the hashes] * kinds) gives a pa.Table of ``schema``.
    side, if given, has a column batch too: small rows that a batch needs, such as which documents count."""
    partitions = n_partitions(docs.sparkSession)
    shards = max(partitions, batches // 3)
    ranges, within = (shards, 1) if shards <= FAN else (math.isqrt(shards - 1) + 1,) * 2
    crowds = -(-batches // ranges)
    places = even_keys(ranges, partitions).tolist()
    has_side = side is not None

    def ask(table: pa.Table, other: pa.Table | None) -> pa.Table:
        found, counts, _ = items(table, other)
        batch = table["batch"][0].as_py() if table.num_rows else other["batch"][0].as_py()
        rows = list(_cut(found, counts, ranges))
        shard = [k for k, *_ in rows]
        return pa.table({"batch": _ints([batch] * len(rows)), "crowd": _ints([batch % crowds] * len(rows)), "shard": _ints(shard), "place": _ints([places[k] for k in shard]), "items": pa.array([x for _, x, _ in rows], pa.binary()), "counts": pa.array([x for *_, x in rows], pa.binary())})

    @lean
    def merge(table: pa.Table) -> pa.Table:
        found, totals, _ = _summed(table, kinds)
        crowd, k = table["crowd"][0].as_py(), table["shard"][0].as_py()
        rows = list(_cut(found, totals, within, (k, ranges)))
        return pa.table({"batch": _ints([-1] * len(rows)), "crowd": _ints([crowd] * len(rows)), "shard": _ints([j for j, *_ in rows]), "place": _ints([j for j, *_ in rows]), "items": pa.array([x for _, x, _ in rows], pa.binary()), "counts": pa.array([x for *_, x in rows], pa.binary())})

    @lean
    def add_up(table: pa.Table) -> pa.Table:
        _, totals, parts = _summed(table, kinds)
        return pa.table({"batch": table["batch"], "crowd": table["crowd"], "shard": table["shard"], "totals": pa.array([bundle([pack(t[p]) for t in totals]) for p in parts], pa.binary())})

    def gathered(rows: pa.Table) -> list[np.ndarray]:
        """Totals of each kind, in the order of the hashes."""
        order = np.argsort(np.array(rows["shard"].to_numpy()), kind="stable")
        blobs = [unbundle(rows["totals"][int(k)].as_py()) for k in order]
        return [np.concatenate([np.zeros(0, np.int64), *(unpack(b[kind], np.int64) for b in blobs)]) for kind in range(kinds)]

    @lean
    def hand_out(table: pa.Table, answers: pa.Table) -> pa.Table:
        totals = gathered(answers)
        _, _, parts = _summed(table, 0)
        return pa.table({"batch": table["batch"], "crowd": table["crowd"], "shard": table["shard"], "totals": pa.array([bundle([pack(t[p]) for t in totals]) for p in parts], pa.binary())})

    @lean
    def reply(table: pa.Table, other: pa.Table) -> pa.Table:
        rows = other.filter(pa.compute.greater_equal(other["shard"], 0))
        mine = other.filter(pa.compute.less(other["shard"], 0)) if has_side else None
        found, _, kept = items(table, mine)
        totals = gathered(rows)
        assert all(len(t) == len(found) for t in totals), "a batch changed between asking and scoring"
        return answer(table, kept, totals)

    if side is None:
        requests = docs.groupBy("batch").applyInArrow(lean(lambda t: ask(t, None)), _REQUEST)
    else:
        requests = docs.groupBy("batch").cogroup(side.groupBy("batch")).applyInArrow(lean(ask), _REQUEST)
    if within == 1:
        replies = requests.groupBy("place").applyInArrow(add_up, _REPLY)
    else:
        answers = requests.groupBy("crowd", "shard").applyInArrow(merge, _REQUEST).groupBy("place").applyInArrow(add_up, _REPLY)
        answers = answers.withColumn("range", F.floor(F.col("shard") / within).cast("int"))
        replies = requests.groupBy("crowd", "shard").cogroup(answers.groupBy("crowd", "range")).applyInArrow(hand_out, _REPLY)
    replies = replies.select("batch", "shard", "totals")
    if side is not None:
        replies = replies.unionByName(side.withColumns({"shard": F.lit(-1), "totals": F.lit(None).cast("binary")}), allowMissingColumns=True)
    return docs.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(reply, schema)
