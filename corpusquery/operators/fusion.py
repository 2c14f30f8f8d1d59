"""Reciprocal rank fusion of a dense and a sparse ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 60


def fuse(dense: DataFrame, sparse: DataFrame, k: int = K) -> DataFrame:
    """dense, sparse(query_id, chunk_id, rank, score) -> query_id, chunk_id, rrf_score, sparse_rank, sparse_score, dense_rank, dense_score, rank.

    A side without the chunk has rank -1 and score 0. Equal scores: dense results in their order, then the others in the sparse order.
    A chunk twice in a list counts each rank; its last one is shown."""
    def side(ranked: DataFrame, name: str) -> DataFrame:
        return ranked.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias(f"{name}_term"), F.max(F.struct("rank", "score")).alias(name))

    out = side(dense, "d").join(side(sparse, "s"), ["query_id", "chunk_id"], "full_outer")
    out = out.withColumn("rrf_score", F.coalesce("d_term", F.lit(0.0)) + F.coalesce("s_term", F.lit(0.0)))
    out = out.select(
        "query_id", "chunk_id", "rrf_score", F.coalesce("s.rank", F.lit(-1)).alias("sparse_rank"), F.coalesce("s.score", F.lit(0.0)).alias("sparse_score"), F.coalesce("d.rank", F.lit(-1)).alias("dense_rank"), F.coalesce("d.score", F.lit(0.0)).alias("dense_score")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.col("dense_rank") < 0, "dense_rank", "sparse_rank", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order))


def rounded(fused: DataFrame) -> DataFrame:
    """Scores to six places, halves to the even digit."""
    return fused.withColumns({c: F.bround(c, 6) for c in ("rrf_score", "sparse_score", "dense_score")})
