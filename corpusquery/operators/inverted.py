"""An inverted index for BM25L that is searched by its postings: only those that a batch of queries needs are read.

Under a path stand parts, each of which counts once it is whole; a part has postings and one row of statistics. Postings are made
where the chunks lie, by segments: runs of at most SEGMENT chunks of a task, numbered from 0. They stand in blocks of at most BLOCK
(chunk's number, occurrences) of a term in a segment, in folders by a hash of the term (bucket), with their largest number of
occurrences and smallest length; the folder HEADS has each segment's chunk ids and lengths, once. The two bounds limit the weight
that a block can give, whatever the mean length becomes as parts are added; so what is stored never changes, and adding a part
costs what it holds. Nothing is shuffled for it.

A search takes its queries, a table of any size, in blocks of a checked size, each finished before the next, and reads the buckets
that a block asks for. First the rarest terms of each query are scored, up to FIRST postings: the k-th best sum found is a score
that the k-th best chunk reaches at least. Then blocks of postings whose bound with those of all other terms can't reach it for any
query are left out, the others meet by segment, and are scored there for the queries whose bounds in the segment can reach it. So
what is shuffled is a block of postings once, whatever the number of queries that ask for it, and each segment's k best of a query;
no pair of a query and a chunk is. All of this is exact: what is left out is below the k-th best score by more than rounding.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import tables
from .ranking import best, blocks, checked_k, id_type, ids_of, in_turn, top_k
from .sparse import B, BLOCK_QUERIES, BLOCK_TERMS, CELLS, DELTA, K1, SparseIndex, add_up

#: Folders of postings, and the one of chunk ids and lengths; postings of a block.
BUCKETS, HEADS, BLOCK = 64, -1, 1024
#: Chunks of a segment, whose numbers have two bytes, and bytes of their tokens.
SEGMENT, SEGMENT_BYTES = 1 << 16, 1 << 26
#: Postings of a query's rarest terms that are scored for the first bound.
FIRST = 1 << 14
_ROUNDING = 1e-9


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _segments(batches, most: int, most_bytes: int):
    """Runs of batches that are a segment each."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for part in (batch.slice(a, most) for a in range(0, batch.num_rows, most)):
            if held and (rows + part.num_rows > most or size + part.nbytes > most_bytes):
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
            held.append(part)
            rows, size = rows + part.num_rows, size + part.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _made(ix: SparseIndex, buckets: int, block: int, named: bool) -> DataFrame:
    """Blocks of postings and, without a term, the heads of segments, with their bucket. named: blocks alone, with the chunks' ids."""
    kind = id_type(ix.documents, "chunk_id")
    own = f"postings array<struct<chunk_id: {kind}, tf: int, dl: bigint>>" if named else f"segment long, rows binary, tf array<int>, chunk_ids array<{kind}>, lengths array<bigint>"

    def counted(batches):
        for held in _segments(batches, SEGMENT, SEGMENT_BYTES):
            ids, lengths_of, terms = (held.column(k).combine_chunks() for k in range(3))
            dl, lengths = lengths_of.to_numpy(zero_copy_only=False), terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = terms.flatten().dictionary_encode()
            if not len(flat):
                continue
            order = pc.sort_indices(flat.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            keys, tf = np.unique(place[flat.indices.to_numpy(zero_copy_only=False)] << 32 | np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
            code, rows = keys >> 32, keys & 0xFFFFFFFF
            begins = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            cut = np.flatnonzero((np.arange(len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code))))) % block == 0)
            edges, n = np.append(cut, len(code)), len(cut)
            columns = {
                "term": flat.dictionary.take(pa.array(order[code[cut]])),
                "df": pa.array(np.diff(edges), pa.int64()), "cf": pa.array(np.add.reduceat(tf, cut), pa.int64()),
                "max_tf": pa.array(np.maximum.reduceat(tf, cut), pa.int32()), "min_dl": pa.array(np.minimum.reduceat(dl[rows], cut), pa.int64()),
            }
            times = pa.array(tf, pa.int32())
            if named:
                posting = pa.StructArray.from_arrays([ids.take(pa.array(rows)), times, pa.array(dl[rows], pa.int64())], names=["chunk_id", "tf", "dl"])
                yield pa.RecordBatch.from_pydict(columns | {"postings": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), posting)})
                continue
            segment = uuid.uuid4().int >> 65
            numbers = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * 2).astype(np.int32)), pa.py_buffer(rows.astype("<u2"))])
            whole = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, lengths_of)]
            stored = {"segment": pa.array(np.full(n, segment)), "rows": numbers, "tf": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), times)}
            yield pa.RecordBatch.from_pydict(columns | stored | {"chunk_ids": pa.nulls(n, whole[0].type), "lengths": pa.nulls(n, whole[1].type)})
            head = {name: pa.nulls(1, x.type) for name, x in (columns | stored).items()}
            yield pa.RecordBatch.from_pydict(head | {"segment": pa.array([segment]), "chunk_ids": whole[0], "lengths": whole[1]})

    made = ix.documents.select("chunk_id", "dl", "terms").mapInArrow(counted, f"term string, df long, cf long, max_tf int, min_dl long, {own}")
    return made.withColumn("bucket", F.when(F.col("term").isNull(), HEADS).otherwise(bucket_of(F.col("term"), buckets)))


def postings(ix: SparseIndex, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """bucket, term, postings, df, cf, max_tf, min_dl: the blocks that ``add`` writes, with the chunks' ids and lengths in place of their numbers."""
    return _made(ix, buckets, block, named=True)


@dataclass
class InvertedIndex:
    """The parts under a path."""

    spark: SparkSession
    path: str

    def add(self, ix: SparseIndex, part: str | None = None, buckets: int | None = None) -> InvertedIndex:
        """Adds the chunks of an index as a part (or replaces a part of that name), at the cost of what it holds. A chunk is in one part."""
        names = tables.parts(self.spark, self.path)
        there = self.buckets if names else None
        if buckets and there and buckets != there:
            raise ValueError(f"an index of {there} buckets can't have a part of {buckets}")
        buckets, name = buckets or there or BUCKETS, part or f"part-{uuid.uuid4().hex}"
        folder = lambda table: f"{self.path}/{table}/part={name}"
        _made(ix, buckets, BLOCK, named=False).write.mode("overwrite").partitionBy("bucket").parquet(folder("postings"))
        ix.documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(folder("stats"))
        tables.mark(self.spark, self.path, name)
        return self

    def _has(self, folder: str) -> bool:
        """Whether the folder has a bucket: a part without any token has none."""
        files, where = tables.hadoop_path(self.spark, folder)
        return files.exists(where) and any(s.getPath().getName().startswith("bucket=") for s in files.listStatus(where))

    def _read(self, table: str) -> DataFrame | None:
        """The complete parts' rows."""
        folders = [f for f in (f"{self.path}/{table}/part={n}" for n in tables.parts(self.spark, self.path)) if table == "stats" or self._has(f)]
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*folders).drop("part") if folders else None

    @property
    def buckets(self) -> int:
        return self._read("stats").first().buckets

    def table(self, name: str, buckets: list[int]) -> DataFrame | None:
        """Rows of these buckets: no other folder is among the files to read."""
        rows = self._read(name)
        return None if rows is None else rows.filter(F.col("bucket").isin(buckets))

    def clear(self) -> None:
        names = tables.parts(self.spark, self.path)
        tables.unmark(self.spark, self.path, names)
        for folder in (f"{self.path}/{table}/part={n}" for table in ("postings", "stats") for n in names):
            files, where = tables.hadoop_path(self.spark, folder)
            files.delete(where, True)

    def search(self, queries: DataFrame, k: int | None = None, digits: int | None = None, k1: float = K1, b: float = B, delta: float = DELTA, first: int = FIRST) -> DataFrame:
        """query_id, chunk_id, score, rank, as ``sparse.search`` gives them. queries(query_id, text) may be a table of any size."""
        k, spark, everything = checked_k(k, 5), self.spark, self._read("postings")
        kind = "string" if everything is None else everything.schema["chunk_ids"].dataType.elementType.simpleString()
        schema = "query_id {}, " + f"chunk_id {kind}, score double"
        query_kind = id_type(queries, "query_id")
        ranked = lambda rows: top_k(rows, k, F.desc("score"), F.col("chunk_id"))
        nothing = lambda: ranked(spark.createDataFrame([], schema.format(query_kind)))
        if everything is None:
            return nothing()
        # rows of one query_id are one query
        words = queries.select("query_id", tokens(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
        asked = words.groupBy("query_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
        stats = self._read("stats").agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.max("buckets").alias("buckets")).first()
        n, mean = stats.n, max(1.0, stats.length / max(1, stats.n))
        heads = self.table("postings", [HEADS]).select("segment", F.lit(None).cast("int").alias("code"), F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("array<int>").alias("tf"), "chunk_ids", "lengths")

        def share(tf, dl):
            ctd = tf / (1 - b + b * dl / mean)
            return (ctd + delta) / (k1 + ctd + delta)

        def scored(block):
            vocabulary = sorted({t for r in block for t in r.terms})
            places = spark.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.string()), "code": pa.array(range(len(vocabulary)), pa.int32())}))
            wanted = sorted(r[0] for r in places.select(bucket_of(F.col("term"), stats.buckets)).distinct().collect())
            lists = self.table("postings", wanted)
            known = lists.join(F.broadcast(places), "term").groupBy("code").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")).collect()
            df, weight, most = (np.zeros(len(vocabulary)) for _ in range(3))
            for r in known:
                df[r.code], weight[r.code] = r.df, (np.log(n + 1) - np.log(r.df + 0.5)) * (k1 + 1)
                most[r.code] = weight[r.code] * share(r.max_tf, r.min_dl)
            place = {t: j for j, t in enumerate(vocabulary)}
            # of each query, its terms from the rarest: as many entries as the block has terms
            entries = sorted((q, df[place[t]], place[t], m) for q, r in enumerate(block) for t, m in Counter(r.terms).items() if df[place[t]])
            by, of, often = (np.array([x[c] for x in entries], t) for c, t in ((0, np.int64), (2, np.int64), (3, float)))
            ends = np.cumsum(df[of])
            begin = np.searchsorted(by, by)
            before = ends - df[of] - (ends - df[of])[begin] if len(by) else ends
            total = np.bincount(by, often * most[of], minlength=len(block))

            def found(rare: np.ndarray, least: np.ndarray, ids: pa.Array, id_kind: str, digits: int | None):
                """Rows of these entries' postings, and what they need. Blocks and queries that can't reach least are left out."""
                # of each term, the queries that ask for it, one after the other
                order = np.flatnonzero(rare)[np.argsort(of[rare], kind="stable")]
                starts = np.searchsorted(of[order], np.arange(len(vocabulary) + 1))
                need = np.full(len(vocabulary), np.inf)
                np.minimum.at(need, of[order], (least[by] - total[by] + often * most[of])[order] / (often * weight[of])[order])
                codes = np.unique(of[order])
                terms = pa.table({"term": pa.array([vocabulary[c] for c in codes], pa.string()), "code": pa.array(codes, pa.int32()), "need": pa.array(need[codes], pa.float64())})
                shared = spark.sparkContext.broadcast((ids, starts, by[order], often[order], of[order], weight, least))
                reach = share(F.col("max_tf").cast("double"), F.col("min_dl").cast("double")) * (1 + _ROUNDING) >= F.col("need") - _ROUNDING
                met = lists.join(F.broadcast(spark.createDataFrame(terms)), "term").filter(reach)
                met = met.select("segment", "code", "rows", "tf", F.lit(None).cast(f"array<{kind}>").alias("chunk_ids"), F.lit(None).cast("array<bigint>").alias("lengths"))

                def each(segment: pa.Table) -> pa.Table:
                    ids, starts, by, often, of, weight, least = shared.value
                    is_head = pc.is_null(segment["code"])
                    head, rest = segment.filter(is_head), segment.filter(pc.invert(is_head))
                    chunk_ids = head["chunk_ids"].combine_chunks().flatten()
                    out = [best(chunk_ids.slice(0, 0), np.zeros((0, len(ids))), ids, k, digits, positive=True)]
                    if rest.num_rows:
                        lists = rest["tf"].combine_chunks()
                        codes = np.repeat(rest["code"].to_numpy(), lists.value_lengths().to_numpy())
                        rows = np.frombuffer(b"".join(rest["rows"].to_pylist()), "<u2").astype(np.int64)
                        order = np.argsort(rows, kind="stable")
                        codes, rows = codes[order], rows[order]
                        gain = share(lists.flatten().to_numpy()[order], head["lengths"].combine_chunks().flatten().to_numpy()[rows]) * weight[codes]
                        highest = np.zeros(len(weight))
                        np.maximum.at(highest, codes, gain)
                        able = np.bincount(by, often * highest[of], minlength=len(ids))
                        able = (able > 0) & (able * (1 + _ROUNDING) >= least)
                        stay = able[by]
                        to = (np.cumsum(able) - 1)[by[stay]]
                        starts = np.concatenate(([0], np.cumsum(stay)))[starts]
                        own = ids.take(pa.array(np.flatnonzero(able)))
                        step = max(1, CELLS // max(1, len(own)))
                        for a in range(0, len(chunk_ids) if len(own) else 0, step):
                            x, y = np.searchsorted(rows, (a, a + step))
                            part = chunk_ids.slice(a, step)
                            scores = np.zeros((len(part), len(own)))
                            add_up(scores, rows[x:y] - a, codes[x:y], gain[x:y], starts, to, often[stay])
                            out.append(best(part, scores, own, k, digits, positive=True))
                    return pa.Table.from_batches(out)

                return met.unionByName(heads).groupBy("segment").applyInArrow(each, schema.format(id_kind)), shared

            numbers, none = pa.array(range(len(block)), pa.int64()), np.zeros(len(block))
            rows, shared = found(before < first, none, numbers, "long", None)
            least = none.copy()
            for r in ranked(rows).filter(F.col("rank") == k).collect():
                least[r.query_id] = r.score * (1 - _ROUNDING) - (0 if digits is None else 10.0**-digits)
            shared.destroy()
            rows, shared = found(np.ones(len(by), bool), least, ids_of(asked, block), query_kind, digits)
            return ranked(rows), shared.destroy

        in_blocks = blocks(asked.toLocalIterator(), lambda r: len(set(r.terms)), BLOCK_TERMS, BLOCK_QUERIES)
        return in_turn(in_blocks, scored, nothing, "inverted")


def read(spark: SparkSession, path: str) -> InvertedIndex:
    return InvertedIndex(spark, path)
