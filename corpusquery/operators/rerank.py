"""Reranking of fused candidates by the scores in a model's reply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import extract_ranking
from .ranking import checked_k

TOP_N = 3


def rerank(candidates: DataFrame, replies: DataFrame, n: int | None = None) -> DataFrame:
    """candidates(query_id, chunk_id, rrf_score, rank), replies(query_id, reply) -> query_id, chunk_id, rerank_score, rrf_score, original_rank, rerank_source, rank.

    A candidate whose index (rank - 1) the reply leaves out scores ten times its fused score. The order stays as it is, with the
    fused score as the new one, for a single candidate, without a reply (null or no row), and for a reply that can't be parsed."""
    n = checked_k(n, TOP_N)
    parsed = replies.select("query_id", extract_ranking(F.col("reply")).alias("scores"))
    size = F.count("*").over(W.partitionBy("query_id"))
    rows = candidates.select("query_id", "chunk_id", "rrf_score", F.col("rank").alias("original_rank")).withColumn("size", size).join(parsed, "query_id", "left")
    by_index = F.map_from_entries(F.col("scores"))
    given = F.try_element_at(by_index, (F.col("original_rank") - 1).cast("int"))
    used = (F.col("size") > 1) & F.col("scores").isNotNull()
    rows = rows.select("query_id", "chunk_id", F.when(used, F.coalesce(given, F.col("rrf_score") * 10.0)).otherwise(F.col("rrf_score")).alias("rerank_score"), "rrf_score", "original_rank", F.when(used, "model").otherwise("fusion").alias("rerank_source"))
    order = [F.when(F.col("rerank_source") == "model", F.col("rerank_score")).desc_nulls_last(), F.col("original_rank")]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= n)
