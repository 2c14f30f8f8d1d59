"""Exact nearest neighbours by cosine from vectors that are stored in clusters, of which a search reads those that it needs.

Each cluster is a folder, with its centre, the number of its vectors and its radius: the largest angle between a vector and the
centre, over all vectors. By the triangle inequality of angles no vector of a cluster is nearer to a query than the angle to the
centre less the radius. A search first scores the clusters that lie nearest to each query, which gives a k-th best score; then
the others whose bound reaches that score. Clusters that no query of a block needs aren't read, and in those that are read a
query is scored only where its own bound asks for it. Results are those of ``dense.cosine_search``.

Centres come from a bounded sample, the vectors of the smallest id hashes (SAMPLE); they decide how much is read, never what is
found. Vectors of length 0 are a cluster of their own, with the score 0. Very large clusters are several files, as they are
dealt out by a salt too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from .dense import BLOCK_QUERIES, BLOCK_VALUES, CELLS, EPS, _matrix, check_dimensions, norm
from .ranking import best, blocks, checked_k, id_type, ids_of, in_turn, top_k

#: Vectors that centres are found from, rounds, vectors of a cluster on average, clusters at most; salts within a cluster.
SAMPLE, ROUNDS, SIZE, MOST, SALTS = 20_000, 8, 2000, 4096, 16
#: Clusters of each query that are scored first; how far single precision may put a vector outside its radius, as an angle.
FIRST, SLACK = 2, 1e-5
_ZERO = -1


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, EPS, size)


def centres_of(sample: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """n or fewer unit centres of unit vectors, by spherical k-means."""
    distinct = np.unique(sample, axis=0)
    if not len(distinct):
        return np.zeros((0, sample.shape[1]))
    at = np.random.default_rng(seed).choice(len(distinct), min(n, len(distinct)), replace=False)
    centres = distinct[at]
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        long = np.linalg.norm(sums, axis=1) > EPS
        centres[long] = _unit(sums[long])
    return centres


@dataclass
class Clusters:
    """Vectors under a path, by cluster, and the table of clusters (cluster, centre, n, radius)."""

    spark: SparkSession
    path: str

    @staticmethod
    def write(vectors: DataFrame, path: str, clusters: int | None = None) -> Clusters:
        """vectors(chunk_id, embedding) of one dimension. clusters: as many as make SIZE vectors each, MOST at most, unless given."""
        spark, rows = vectors.sparkSession, vectors.select("chunk_id", "embedding")
        check_dimensions(rows)
        n = rows.count()
        sample = rows.filter(norm(F.col("embedding")) > 0).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").collect()
        centres = centres_of(_unit(np.array([r[0] for r in sample], np.float64) if sample else np.zeros((0, 1))), clusters or min(MOST, -(-n // SIZE)))
        shared = spark.sparkContext.broadcast(centres)

        def assigned(batches):
            centres = shared.value
            for batch in batches:
                x = _matrix(batch.column(1), centres.shape[1])
                near, cosine = np.full(len(x), _ZERO), np.ones(len(x))
                real = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
                for a in range(0, len(real), max(1, CELLS // max(1, len(centres)))):
                    some = real[a : a + max(1, CELLS // max(1, len(centres)))]
                    scores = _unit(x[some]) @ centres.T
                    near[some], cosine[some] = scores.argmax(axis=1), scores.max(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(cosine)], names=["chunk_id", "embedding", "cluster", "cosine"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        made = tables.materialise(rows.mapInArrow(assigned, f"{kinds}, cluster int, cosine double"), "assigned")
        salt = F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS))
        big = F.broadcast(made.groupBy("cluster").agg(F.count("*").alias("m")))  # MOST rows at most
        dealt = made.join(big, "cluster").repartition("cluster", F.when(F.col("m") > SALTS * SIZE, salt).otherwise(0))
        dealt.select("chunk_id", "embedding", "cluster").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/rows")
        told = made.groupBy("cluster").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect()
        table = [(r.cluster, r.n, float(np.arccos(np.clip(r.least, -1, 1))), centres[r.cluster].tolist() if r.cluster != _ZERO else None) for r in told]
        spark.createDataFrame(table, "cluster int, n long, radius double, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")
        return Clusters(spark, path)

    def search(self, queries: DataFrame, k: int | None = None, digits: int | None = None, report: list | None = None) -> DataFrame:
        """As ``dense.cosine_search``. report: gets, for each block of queries, (clusters read, clusters, pairs of query and vector scored, pairs)."""
        k = checked_k(k, 5)
        asked = queries.select("query_id", "embedding").filter(norm(F.col("embedding")) > 0)
        told = sorted(self.spark.read.parquet(f"{self.path}/clusters").collect(), key=lambda r: r.cluster)
        numbers, sizes, radius = (np.array([r[c] for r in told]) for c in ("cluster", "n", "radius"))
        rows = self.spark.read.parquet(f"{self.path}/rows") if told else self.spark.createDataFrame([], "chunk_id string, embedding array<float>, cluster int")
        schema = f"query_id {id_type(asked, 'query_id')}, chunk_id {id_type(rows, 'chunk_id')}, score double"
        ranked = lambda x: top_k(x, k, F.desc("score"), F.col("chunk_id"))
        margin = 1e-9 + (0 if digits is None else 10.0**-digits)

        def found(unit: np.ndarray, ids: pa.Array, wanted: np.ndarray):
            """Scores of the queries in the clusters where wanted (queries, clusters) says so."""
            at = np.flatnonzero(wanted.any(axis=0))
            shared = self.spark.sparkContext.broadcast((unit, ids, {int(numbers[c]): np.flatnonzero(wanted[:, c]) for c in at}))

            def each(batches):
                unit, ids, by = shared.value
                for batch in batches:
                    clusters = batch.column(2).to_numpy(zero_copy_only=False)
                    for c in np.unique(clusters).tolist():
                        mine, step = np.flatnonzero(clusters == c), max(1, CELLS // max(1, len(by[c])))
                        for a in range(0, len(mine), step):
                            part = batch.take(pa.array(mine[a : a + step]))
                            yield best(part.column(0), _unit(_matrix(part.column(1))) @ unit[by[c]].T, ids.take(pa.array(by[c])), k, digits)

            some = rows.filter(F.col("cluster").isin([int(numbers[c]) for c in at])).select("chunk_id", "embedding", "cluster")
            return ranked(some.mapInArrow(each, schema)).drop("rank"), shared

        def search(block):
            ids, unit = ids_of(asked, block), _unit(np.array([r.embedding for r in block], np.float64))
            real = np.flatnonzero(numbers != _ZERO)
            bound = np.zeros((len(block), len(numbers)))  # a vector of length 0 scores 0
            centres = np.array([told[c].centre for c in real]).reshape(len(real), unit.shape[1])
            angle = np.arccos(np.clip(unit @ centres.T, -1, 1))
            bound[:, real] = np.cos(np.maximum(0, angle - radius[real] - SLACK))
            order = np.argsort(-bound, axis=1, kind="stable")
            # the nearest clusters, until they hold k vectors
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, (np.arange(len(numbers)) < FIRST) | (held < k), axis=1)
            near, shared = found(unit, ids, first)
            near = tables.materialise(near, "near")
            reached = {r.query_id: r.s for r in near.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("m")).filter(F.col("m") >= k).collect()}
            least = np.array([reached.get(r.query_id, -np.inf) for r in block])
            wanted = ~first & (bound >= least[:, None] - margin)
            if report is not None:
                both = wanted | first
                report.append((int(both.any(axis=0).sum()), len(numbers), int((both * sizes).sum()), int(len(block) * sizes.sum())))
            more, again = found(unit, ids, wanted)
            return ranked(near.union(more)), lambda: (shared.destroy(), again.destroy())

        if not told:
            return ranked(self.spark.createDataFrame([], schema))
        return in_turn(blocks(asked.toLocalIterator(), lambda r: len(r.embedding), BLOCK_VALUES, BLOCK_QUERIES), search, lambda: ranked(self.spark.createDataFrame([], schema)), "nearest")
